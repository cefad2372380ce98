"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` (once for each level, spaces between allowed) quote another message. Runs of lines of one
level are passages; passages and their single lines are normalised (lower case, white space as one space) and hashed. A
quoted hash is joined with the first message of the same conversation that has it among its own words; the message
replies to the latest message so found at its lowest quote level that finds any. Threads follow replies to their root by
pointer jumping. The result is one row for each message, without quotes, with its place in the reply order: threads by
their root, messages of a thread by turn; a reply never stands before what it quotes.

A conversation is never gathered in one task: places are sums of counts over nested groups of at most 512 turns or
threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

QUOTE = r"^[ \t]*((?:>[ \t]*)+)"
SPAN = 512


def passages(text: Column) -> Column:
    """array<struct<level int, body string>>: runs of lines of one quote level; level 0 is the message's own words; blank lines part runs."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), r"[ \t]", ""))
    marked = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.trim(F.regexp_replace(x, QUOTE, "")).alias("body")))
    marked = F.transform(marked, lambda x: F.struct(F.when(x["body"] == "", -1).otherwise(x["level"]).alias("level"), x["body"].alias("body")))

    def joined(m: Column) -> Column:
        begins = F.transform(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["level"] != x["level"]))
        pieces = F.zip_with(m, begins, lambda x, b: F.concat(F.when(b, F.concat(F.lit("\u0001"), x["level"].cast("string"), F.lit("\u0002"))).otherwise(F.lit(" ")), F.translate(x["body"], "\u0001\u0002", "  ")))
        runs = F.filter(F.split(F.array_join(pieces, ""), "\u0001"), lambda x: (x != "") & ~x.startswith("-1"))
        return F.transform(runs, lambda x: F.struct(F.split(x, "\u0002")[0].cast("int").alias("level"), F.split(x, "\u0002")[1].alias("body")))

    return F.element_at(F.transform(F.array(marked), joined), 1)


def own_words(text: Column) -> Column:
    """The text without quoted lines; lines and blank lines of its own stay, white space at both ends goes."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.rlike(QUOTE)), "\n"), r"^\s+|\s+$", "")


def normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def units(text: Column) -> Column:
    """array<struct<level, hash>> of a message's passages and of their single lines."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, QUOTE, "")) != "")
    single = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), r"[ \t]", "")).alias("level"), F.md5(normal(F.regexp_replace(x, QUOTE, ""))).alias("hash")))
    runs = F.transform(passages(text), lambda x: F.struct(x["level"].alias("level"), F.md5(normal(x["body"])).alias("hash")))
    return F.array_distinct(F.concat(runs, single))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, reply_to, thread, depth, position, quotes and found of every row of ``messages``
    (conv_id, turn, role, text; other columns are ignored).

    body is the text without quotes; reply_to the turn it replies to (null: none found), thread the turn of its root, depth
    the replies from there, position its place in the conversation's reply order from 0 (messages of one turn: by role and
    text; exact repeats take places one after another); quotes and found count its quoted passages and lines, and those
    found in an earlier message. Null texts are empty. Messages without conv_id or turn quote nothing and are threads of
    their own; a null conv_id is a conversation, its null turns come last. Texts of any length are read whole; repeated rows
    and messages of one turn share their links; an empty table gives no rows.
    """
    text = F.col("text")
    base = durable(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", own_words(text).alias("body"), units(text).alias("units"), F.md5(F.coalesce(text, F.lit(""))).alias("digest")))
    said = base.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", F.col("u.level").alias("level"), F.col("u.hash").alias("hash"))
    first = said.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = said.where("level > 0")
    met = quoted.join(first, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    low = F.min(F.when(F.col("origin").isNotNull(), F.struct("level", -F.col("origin"))))
    replies = durable(met.groupBy("conv_id", "turn").agg(F.count("*").alias("quotes"), F.count("origin").alias("found"), (-low["col2"]).alias("reply_to")))
    # pointer jumping over messages that reply: up is an ancestor, far the replies to it
    jump = durable(replies.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("far")))
    while True:
        above = jump.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        after = durable(jump.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("up2").isNotNull().alias("moved")))
        jump = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    known = replies.join(jump, ["conv_id", "turn"], "left")
    rows = base.join(known, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("up", "turn")).withColumn("far", F.coalesce("far", F.lit(0).cast("long")))
    # places: threads in spans of turns, turns in spans
    rows = rows.withColumn("a", F.floor(F.col("thread") / SPAN)).withColumn("b", F.floor(F.col("turn") / SPAN))
    rows = durable(rows.select("conv_id", "turn", "role", "body", "digest", "reply_to", "thread", "far", "a", "b", F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("found", F.lit(0)).alias("found")))

    def before(groups: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
        w = W.partitionBy(*by).orderBy(F.col(key).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
        return groups.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    fine = rows.groupBy("conv_id", "a", "thread", "b").agg(F.count("*").alias("n"))
    threads = fine.groupBy("conv_id", "a", "thread").agg(F.sum("n").alias("n"))
    spans = threads.groupBy("conv_id", "a").agg(F.sum("n").alias("n"))
    in_spans = before(spans, ["conv_id"], "a", "p1").drop("n")
    in_threads = before(threads, ["conv_id", "a"], "thread", "p2").drop("n")
    in_fine = before(fine, ["conv_id", "a", "thread"], "b", "p3").drop("n")
    same = lambda x, y, keys: [x[k].eqNullSafe(y[k]) for k in keys]

    def with_(x: DataFrame, y: DataFrame, keys: list[str], name: str) -> DataFrame:
        return x.join(y, same(x, y, keys)).select(x["*"], y[name])

    placed = with_(in_fine, in_threads, ["conv_id", "a", "thread"], "p2")
    placed = with_(placed, in_spans, ["conv_id", "a"], "p1")
    placed = placed.select("conv_id", "a", "thread", "b", (F.col("p1") + F.col("p2") + F.col("p3")).alias("p"))
    rows = with_(rows, placed, ["conv_id", "a", "thread", "b"], "p")
    inner = W.partitionBy("conv_id", "a", "thread", "b").orderBy(F.col("turn").asc_nulls_last(), "role", "digest")
    return rows.select("conv_id", "turn", "role", "body", "reply_to", "thread", F.col("far").alias("depth"), (F.col("p") + F.row_number().over(inner) - 1).alias("position"), "quotes", "found")


def chats(linked: DataFrame, span: int = SPAN) -> DataFrame:
    """Conversations from what ``link`` gives: conv_id, part, messages and content of each run of ``span`` places in reply order.

    messages are structs of position, turn, role, reply_to, depth and body without quotes; content is the text of a chat, a
    line with the role before each body. A conversation of more than ``span`` messages comes in several parts, so no row
    gathers an unbounded group; messages without words of their own are left out of content.
    """
    item = F.struct("position", "turn", "role", "reply_to", "depth", "body")
    rows = linked.groupBy("conv_id", F.floor(F.col("position") / span).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("messages"))
    said = F.filter("messages", lambda m: m["body"] != "")
    content = F.array_join(F.transform(said, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit("\n"), m["body"])), "\n\n")
    return rows.select("conv_id", "part", "messages", content.alias("content"))
