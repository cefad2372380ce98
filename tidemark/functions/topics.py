"""Topics as columns: ``key/a.b.*...?ttl=1h&last=10`` taken apart with SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_of(raw: Column) -> Column:
    """What stands before the first ``?``."""
    return F.split(raw, "\\?")[0]


def key_and_topic(raw: Column) -> tuple[Column, Column]:
    """``key/topic?options`` taken apart; without a ``/`` both are null."""
    parts = F.split(topic_of(raw), "/", 2)
    return F.when(F.size(parts) == 2, parts[0]), F.get(parts, F.lit(1))


def options_of(raw: Column) -> Column:
    """array<struct<key, value>> of the options after the first ``?``; items without both sides are left out."""
    items = F.split(F.coalesce(F.get(F.split(raw, "\\?"), F.lit(1)), F.lit("")), "&")
    pairs = F.filter(F.transform(items, lambda x: F.split(x, "=")), lambda p: (F.size(p) >= 2) & (p[0] != "") & (p[1] != ""))
    return F.transform(pairs, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))


def option(raw: Column, name: str) -> Column:
    """The first value of an option, or null."""
    return F.get(F.filter(options_of(raw), lambda o: o["key"] == name), F.lit(0))["value"]


def option_number(raw: Column, name: str) -> Column:
    """The first value of an option as a whole number, or null where it is none."""
    return option(raw, name).try_cast("long")


def levels_of(topic: Column) -> Column:
    """The levels; empty ones are left out, so ``a..b`` is ``a.b``. A trailing ``...`` is no level."""
    return F.filter(F.split(topic, "\\."), lambda x: x != "")


def is_multi(topic: Column) -> Column:
    return topic.endswith("...")


def is_wildcard(topic: Column) -> Column:
    return is_multi(topic) | F.exists(levels_of(topic), lambda x: x == "*")


def depth_of(topic: Column) -> Column:
    return F.size(levels_of(topic)) + is_multi(topic).cast("int")


def normal(topic: Column) -> Column:
    return F.concat(F.array_join(levels_of(topic), "."), F.when(is_multi(topic), F.lit("...")).otherwise(F.lit("")))


def pattern_regex(pattern: Column) -> Column:
    """The regular expression that matches what a pattern matches: ``*`` one level, ``p...`` one or more levels below p."""
    quoted = F.transform(levels_of(pattern), lambda x: F.when(x == "*", F.lit("[^.]+")).otherwise(F.regexp_replace(x, r"([\\^$.|?*+()\[\]{}])", r"\\$1")))
    body = F.array_join(quoted, "\\.")
    below = F.when(body == "", F.lit("[^.]+(\\.[^.]+)*")).otherwise(F.concat(body, F.lit("(\\.[^.]+)+")))
    return F.concat(F.lit("^"), F.when(is_multi(pattern), below).otherwise(body), F.lit("$"))


#: Access bits, fixed values.
OWNER, ADMIN, READ, WRITE = 2, 4, 8, 16


def access_mask(access: Column) -> Column:
    """Bits of an access string: o (owner) 2, a (admin) 4, r 8, w 16."""
    bit = lambda c, n: F.when(access.contains(c), n).otherwise(0)
    return bit("o", OWNER) + bit("a", ADMIN) + bit("r", READ) + bit("w", WRITE)


def _little_endian(number: Column, size: int) -> Column:
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))


def _number(raw: Column, at: int, size: int) -> Column:
    digits = F.hex(F.substring(raw, at + 1, size))
    return F.conv(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))), 16, -10).cast("long")


#: The epoch of message ids, in Unix seconds: a fixed value.
EPOCH = 1555770000


def message_id(contract: Column, seq: Column, seconds: Column) -> Column:
    """16 bytes, each part with its lowest byte first: 2**32 - 1 less the seconds since EPOCH, contract, seq."""
    stamp = F.lit(0xFFFFFFFF) - (seconds - EPOCH)
    return F.unhex(F.concat(_little_endian(stamp.cast("long"), 4), _little_endian(contract.cast("long"), 4), _little_endian(seq.cast("long"), 8)))


def message_id_parts(raw: Column) -> Column:
    """struct<contract, seq, seconds> of a message id."""
    return F.struct(_number(raw, 4, 4).alias("contract"), _number(raw, 8, 8).alias("seq"), (F.lit(0xFFFFFFFF) - _number(raw, 0, 4) + EPOCH).alias("seconds"))


#: The digits of base32 texts: fixed values.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
#: The same digits as conv() writes and reads them.
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(raw: Column) -> Column:
    """Five bits a digit, highest first, the last ones filled up with zero bits; no padding.

    Blocks of 5 bytes are 8 digits. raw stands once in the result, for Spark evaluates it again wherever it stands.
    """
    blocks = F.regexp_extract_all(F.hex(raw), F.lit(".{1,10}"), F.lit(0))
    digits = F.transform(blocks, lambda b: F.substring(F.lpad(F.conv(F.rpad(b, 10, "0"), 16, 32), 8, "0"), F.lit(1), F.ceil(F.length(b) * 4 / 5).cast("int")))
    return F.translate(F.array_join(digits, ""), _PLAIN, DIGITS)


def unbase32(text: Column) -> Column:
    """The bytes that base32 read; null where a character is no digit or the length is none that base32 gives.

    Blocks of 8 digits are 5 bytes. text stands once in the result, as raw does in base32.
    """
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,8}"), F.lit(0))
    octets = lambda b: F.substring(F.lpad(F.conv(F.rpad(F.translate(b, DIGITS, _PLAIN), 8, "0"), 32, 16), 10, "0"), F.lit(1), F.floor(F.length(b) * 5 / 8).cast("int") * 2)
    good = lambda b: b.rlike(r"\A[A-Za-f]+\z") & F.length(b).isin(2, 4, 5, 7, 8)
    return F.unhex(F.array_join(F.transform(blocks, lambda b: F.when(good(b), octets(b)).otherwise("!")), ""))  # unhex gives null for "!"
