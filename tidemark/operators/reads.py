"""Reads of a messages DataFrame (contract, seq, topic, payload, created_at, expires_at, ...)."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import BadRequest, TopicEmpty, TopicTooLarge
from ..functions.durations import parse_duration
from ..functions.topics import is_wildcard, pattern_regex
from .match import match

DEFAULT_LIMIT, MAX_LIMIT, MASTER_CONTRACT = 1000, 100_000, 3376684800


@dataclass(frozen=True)
class Query:
    """topic with options (``?last=1h`` or ``?last=10``); now is explicit."""

    topic: str
    contract: int = MASTER_CONTRACT
    limit: int = 0
    last: str | None = None

    def with_contract(self, contract: int) -> Query:
        return replace(self, contract=contract)

    def with_limit(self, limit: int) -> Query:
        return replace(self, limit=limit)

    def with_last(self, last: str) -> Query:
        return replace(self, last=last)

    def resolve(self, now: datetime, default_limit: int = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT) -> tuple[str, datetime | None, int]:
        """Normalised topic, cutoff (or none) and limit."""
        head, _, tail = self.topic.partition("?")
        levels = [x for x in head.split(".") if x]
        if not levels and not head.endswith("..."):
            raise TopicEmpty("the topic is empty")
        if len(self.topic.encode()) > 65_536:
            raise TopicTooLarge("the topic is too large")
        options: dict[str, str] = {}
        for item in tail.partition("?")[0].split("&"):
            k, _, v = item.partition("=")
            if k and v:
                options.setdefault(k, v.partition("=")[0])
        last, limit, cutoff = self.last or options.get("last"), self.limit, None
        if last is not None:
            if last.lstrip("+-").isdigit():
                limit = max(limit, int(last))
            else:
                try:
                    cutoff = (now - timedelta(microseconds=parse_duration(last) / 1000)).replace(microsecond=0)
                except ValueError as e:
                    raise BadRequest(str(e)) from e
        return ".".join(levels) + ("..." if head.endswith("...") else ""), cutoff, min(limit or default_limit, max_limit)


def alive(now: datetime) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def live(messages: DataFrame, now: datetime) -> DataFrame:
    """Rows that have not expired at ``now``."""
    return messages.where(alive(now))


def not_deleted(messages: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows that no tombstone (contract, seq) names."""
    return messages.join(tombstones.select("contract", "seq"), ["contract", "seq"], "left_anti")


def unseen(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (contract, seq) the table does not hold yet."""
    return rows.join(stored.select("contract", "seq"), ["contract", "seq"], "left_anti")


def memory_first(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Both parts of a table; where both hold a (contract, seq), the row in memory."""
    return memory.unionByName(unseen(disk, memory).select(*memory.columns))


def expired_by_minute(messages: DataFrame, now: datetime) -> DataFrame:
    """contract, minute, messages: what has expired at ``now``, by the minute of expiry."""
    gone = messages.where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz"))
    return gone.groupBy("contract", F.date_trunc("minute", "expires_at").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("messages"))


def get(messages: DataFrame, query: Query, now: datetime) -> DataFrame:
    """The newest rows of a topic: exact top-k by seq after all filters.

    A static topic also finds what is stored under patterns that match it; a wildcard topic finds only the same pattern.
    """
    topic, cutoff, limit = query.resolve(now)
    same = F.col("topic") == topic
    if not topic.endswith("...") and "*" not in topic.split("."):
        same = same | ((F.col("topic").endswith("...") | F.col("topic").contains("*")) & is_wildcard(F.col("topic")) & F.regexp_like(F.lit(topic), pattern_regex(F.col("topic"))))
    rows = messages.where((F.col("contract") == query.contract) & same & alive(now))
    if cutoff is not None:
        rows = rows.where(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz"))  # a whole second: truncation changes nothing
    return rows.orderBy(F.desc("seq")).limit(limit)


def newest_of_each_topic(messages: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("contract", "topic").orderBy(F.desc("seq")))
    return messages.withColumn("rank", rank).where(F.col("rank") <= k)


def topics(messages: DataFrame) -> DataFrame:
    """The topic dictionary: contract, topic, messages, first and last seq."""
    return messages.groupBy("contract", "topic").agg(F.count("*").alias("messages"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def by_seq(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that ``wanted`` (contract, seq) names."""
    return messages.join(wanted.select("contract", "seq").distinct(), ["contract", "seq"], "left_semi")


def _bits(key: Column, bits: int, hashes: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)))


def bloom(keys: DataFrame, column: str, bits: int = 160_000, hashes: int = 7) -> bytes:
    """A Bloom filter of a column; its size is ``bits``, however many keys there are."""
    at = keys.select(F.explode(_bits(F.col(column), bits, hashes)).alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / 32_768).alias("part")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32_768))).alias("map")).collect()  # bits / 32,768 rows of 4 KB
    out = bytearray(-(-bits // 32_768) * 4096)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["map"]
    return bytes(out)


def might_hold(key: Column, held: bytes, bits: int = 160_000, hashes: int = 7) -> Column:
    """False only for keys that the filter never saw."""
    octet = lambda at: F.conv(F.hex(F.substring(F.lit(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.forall(_bits(key, bits, hashes), lambda at: F.getbit(octet(at), (at % 8).cast("int")) == 1)


def filtered_by_seq(messages: DataFrame, wanted: DataFrame, bits: int = 160_000, hashes: int = 7) -> DataFrame:
    """by_seq behind a Bloom filter, which keeps most other rows from being shuffled; ``bits`` is about ten times the number
    of wanted rows for one row in a hundred let through in vain. The result does not depend on it."""
    return by_seq(messages.where(might_hold(F.col("seq"), bloom(wanted, "seq", bits, hashes), bits, hashes)), wanted)


def ranges(messages: DataFrame) -> DataFrame:
    """contract, first_seq and last_seq of each run of consecutive numbers.

    Only the ends of runs are put in order, not the rows.
    """
    seqs = messages.select("contract", "seq").distinct()

    def ends(step: int, name: str) -> DataFrame:
        beside = seqs.select("contract", (F.col("seq") + step).alias("seq"))
        place = F.row_number().over(W.partitionBy("contract").orderBy("seq")).alias("place")
        return seqs.join(beside, ["contract", "seq"], "left_anti").select("contract", F.col("seq").alias(name), place)

    return ends(1, "first_seq").join(ends(-1, "last_seq"), ["contract", "place"]).select("contract", "first_seq", "last_seq")


def relay(messages: DataFrame, requests: DataFrame, now: datetime, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """History for many requests (request_id, contract, pattern, last_seconds): the newest ``limit`` rows of each, newest first."""
    rows = match(messages, requests).where(alive(now))
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.col("last_seconds").cast("decimal(18,6)"))
    rows = rows.where(F.date_trunc("second", "created_at").cast("timestamp_ntz") >= since)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("seq")))).where(F.col("rank") <= limit)
