"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Targets: each source's share of all words by weight, at most ``cap`` times its own size; the excess is shared again by
   weight among the others (water filling in closed form over the sorted ratios of cap and weight).
2. Blocks: a source's documents fall into blocks by a hash, so the order of block numbers is a random one. A source's quota
   is a number of block units: whole passes over its blocks and, in the order of their numbers, as many blocks more as its
   target needs. Of the last unit's block, documents are taken until the running size comes nearest to the target: in hash
   order, those of more than a 32nd of what is missing last, by size.
3. Splitting tree: the output shards are halved again and again. At each node the block quotas of all sources are split
   exactly: the left half's total is half the node's, its composition a multivariate-hypergeometric draw, made source by
   source by inverting the conditional distribution with a hashed number; many sources are drawn in groups first. The leaves
   hold how many units of each source a shard gets, and from which on.
4. Each shard draws its units, so draws are disjoint; a document is taken once for each unit drawn on its block (but for the
   last unit's documents left out). Within a shard, rows are ordered by a hash.

Only sizes and hashes are aggregated. The tree works on counts: one row for each node and group of sources. Documents are
joined with their block's row on (source, block), which spreads a hot source over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, durable

WEIGHTS = (5, 2, 1)
SEED = "mix-2"
GROUP = 256  # sources in one row of the tree
SPAN = 4096  # blocks whose sizes one window adds up
#: Columns of the results; columns of docs with these names are not carried.
OWN = ("size", "source_size", "target", "taken", "block", "shards", "copy", "shard")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """skey, number (in code point order, null last), documents, source_size and target of each source.

    The windows run over one row a source.
    """
    per = sizes.groupBy("skey").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    named = per.withColumn("number", F.row_number().over(W.orderBy("skey")) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    named = named.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    up = W.orderBy(F.col("most") / F.col("w"), "number").rowsBetween(W.unboundedPreceding, -1)
    here = W.orderBy(F.col("most") / F.col("w"), "number").rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy("number").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = named.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(up), F.lit(0))).withColumn("open_w", F.sum("w").over(here))
    level = F.col("left").cast("double") / F.col("open_w")
    free = F.col("left") * F.col("w") <= F.col("most") * F.col("open_w")  # unsaturated: in exact whole numbers
    named = named.withColumn("level", F.min(F.when(free, F.struct(F.col("most") / F.col("w"), "number", level.alias("level")))).over(everything))
    over = F.col("level.level").isNull() | (F.struct(F.col("most") / F.col("w"), F.col("number")) < F.struct(F.col("level.col1"), F.col("level.number")))
    target = F.when(over, F.col("most").cast("double")).otherwise(F.col("level.level") * F.col("w"))
    return named.select("skey", "number", "documents", "source_size", target.alias("target"))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``marked`` are among ``draws`` out of ``population``: the inverse of the distribution at ``u``.

    Terms are summed over all values within 9 standard deviations and 9 of the mean; both sums are folds without arrays.
    """
    n, k, d = population.cast("double"), marked.cast("double"), draws.cast("double")
    mean = d * k / n
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))))
    low = F.greatest(F.lit(0.0), d - (n - k), F.floor(mean - 9 * sd - 9).cast("double"))
    high = F.least(k, d, F.ceil(mean + 9 * sd + 9).cast("double"))
    steps = F.sequence(low.cast("long"), high.cast("long"))

    def following(p: Column, x: Column) -> Column:
        return p * (k - x) * (d - x) / ((x + 1) * F.greatest(n - k - d + x + 1, F.lit(1.0)))

    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("t")), lambda s, x: F.struct(following(s["p"], x.cast("double")).alias("p"), (s["t"] + s["p"]).alias("t")))["t"]
    start = F.struct(F.lit(1.0).alias("p"), (u * total).alias("t"), high.cast("long").alias("at"), F.lit(False).alias("done"))
    end = F.aggregate(
        steps,
        start,
        lambda s, x: F.struct(
            following(s["p"], x.cast("double")).alias("p"), (s["t"] - s["p"]).alias("t"), F.when(~s["done"] & (s["p"] >= s["t"]), x).otherwise(s["at"]).alias("at"), (s["done"] | (s["p"] >= s["t"])).alias("done")
        ),
    )
    return F.when((marked <= 0) | (draws <= 0), F.lit(0).cast("long")).when(draws >= population, marked).otherwise(end["at"])


def uniform(*what: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *what)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def drawn_in_turn(units: Column, draws: Column, hashed: list[Column], first: Column) -> Column:
    """A multivariate-hypergeometric draw of ``draws`` out of ``units``, an array of counts: how many of each."""
    total = F.aggregate(units, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("rest"), draws.alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        got = hypergeometric(s["rest"], x, s["draws"], uniform(*hashed, first + F.size(s["out"])))
        kept = F.transform(F.array(got), lambda g: F.struct((s["rest"] - x).alias("rest"), (s["draws"] - g).alias("draws"), F.concat(s["out"], F.array(g)).alias("out")))
        return F.element_at(kept, 1)

    return F.aggregate(units, start, step)["out"]


def split_quotas(quotas: DataFrame, levels: int, groups: int = 1, seed: str = SEED) -> DataFrame:
    """quotas: ``group`` and ``units``, the block quotas of the group's sources, for each of ``groups`` groups of GROUP sources.

    Returns shard, group, units and begin (the units of each source that the shards before take) for 2**levels shards. Each
    source's units add up to its quota; the shards' totals differ by 1 at most for each level.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "group", "units", F.transform("units", lambda x: F.lit(0).cast("long")).alias("begin"))
    for level in range(levels):
        at = [F.lit(seed), F.lit(level), F.col("node")]
        nodes = nodes.withColumn("total", F.aggregate("units", F.lit(0).cast("long"), lambda a, x: a + x))

        def half(total: Column, at: list = at) -> Column:
            return F.floor(total / 2).cast("long") + F.when((total % 2 == 1) & (uniform(*at) < 0.5), 1).otherwise(0).cast("long")

        if groups == 1:
            nodes = nodes.withColumn("draws", half(F.col("total")))
        else:
            per = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("group", "total"))).alias("g"), F.sum("total").alias("all"))
            got = drawn_in_turn(F.col("g.total"), half(F.col("all")), [*at, F.lit("group")], F.lit(0))
            per = per.select("node", F.explode(F.arrays_zip(F.col("g.group").alias("group"), got.alias("draws"))).alias("x")).select("node", "x.group", "x.draws")
            nodes = nodes.join(per, ["node", "group"])
        nodes = nodes.withColumn("left", drawn_in_turn(F.col("units"), F.col("draws"), at, F.col("group") * GROUP))
        nodes = nodes.select("group", F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("units"), F.col("begin")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("units", "left", lambda a, b: a - b).alias("units"), F.zip_with("begin", "left", lambda a, b: a + b).alias("begin")),
        )).alias("x")).select("x.node", "group", "x.units", "x.begin")
        if level % 8 == 7 and level + 1 < levels:
            nodes = durable(nodes.repartition("node"))
    return nodes.withColumnRenamed("node", "shard")


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, shards: int | None = None, shard_words: int = 4_000_000, block_docs: int = 512, seed: str = SEED) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns the columns in ``carry`` (default: doc_id; names that the result has itself are left out) and size (words; null
    text: 0), source_size, target (of its source, in words), taken (words, repeats counted), block, and shards: the output
    shard of each copy. A null source is a source of its own, the last. A document of no words is taken as often as its block
    is. Repeated rows count each and fare alike; a null doc_id is like an empty one. Texts of any length are counted whole.
    The number of shards is a power of two: ``shards`` rounded up, or by default one for about ``shard_words`` words, 16 at
    least. An empty table gives no rows.
    """
    carry = [c for c in carry or ["doc_id"] if c not in OWN]
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    base = docs.select(F.struct(*carry).alias("row"), skey.alias("skey"), count_words(F.col("text")).alias("size"), key.alias("key"))
    sizes = durable(base if carry == ["doc_id"] else base.drop("row"))
    if carry == ["doc_id"]:
        base = sizes
    whole = F.floor(F.col("target") + 0.5).cast("long")
    sources = source_targets(sizes, weights, cap)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("extra", whole - F.col("passes") * F.col("source_size"))
    sources = durable(sources.withColumn("blocks", F.ceil(F.col("documents") / block_docs).cast("long")))
    told = sources.agg(F.count("*").alias("sources"), F.sum("source_size").alias("words"), F.sum("blocks").alias("blocks")).first()

    def near(rows: DataFrame) -> DataFrame:
        """One row a source: joined by broadcast while there are few; else AQE splits hot sources."""
        return F.broadcast(rows) if told["sources"] <= 10_000 else rows

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(near(of), "skey").withColumn("block", F.conv(F.substring("key", 1, 12), 16, 10).cast("long") % F.col("blocks"))

    # sizes of the blocks before each: spans of blocks first, so that no window holds all blocks of a source
    sums = placed(sizes, sources.select("skey", "blocks")).groupBy("skey", "block").agg(F.sum("size").alias("n")).withColumn("span", F.floor(F.col("block") / SPAN))
    up = W.partitionBy("skey").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = sums.groupBy("skey", "span").agg(F.sum("n").alias("n")).select("skey", "span", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("spans_before"))
    inner = W.partitionBy("skey", "span").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = (F.col("spans_before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("before")
    blocks = sums.join(spans, ["skey", "span"]).select("skey", "block", before)
    # the last unit's block, and how far its documents are taken
    edge = blocks.join(near(sources.select("skey", "extra")), "skey").where("before < extra").groupBy("skey").agg(F.max(F.struct("block", (F.col("extra") - F.col("before")).alias("missing"))).alias("edge"))
    sources = durable(sources.join(edge, "skey", "left").select(*sources.columns, F.coalesce("edge.block", F.lit(-1)).alias("edge"), F.coalesce("edge.missing", F.lit(0)).alias("missing")))
    late = F.when(F.col("size") * 32 > F.col("missing"), F.col("size")).otherwise(0).cast("long").alias("late")
    order = W.partitionBy("skey").orderBy("late", "key").rowsBetween(W.unboundedPreceding, -1)
    on_edge = placed(sizes, sources.select("skey", "blocks", "edge", "missing")).where("block = edge").groupBy("skey", late, "key").agg(F.sum("size").alias("n"), F.first("missing").alias("missing"))
    on_edge = on_edge.withColumn("upto", F.coalesce(F.sum("n").over(order), F.lit(0))).where("2 * upto + n <= 2 * missing")  # the beginning of the order
    cuts = on_edge.groupBy("skey").agg(F.max(F.struct("late", "key")).alias("cut"))
    sources = durable(sources.join(cuts, "skey", "left").select(*sources.columns, "cut"))

    levels = (shards - 1).bit_length() if shards else max(4, (int(told["words"] or 0) // shard_words).bit_length())
    unit = F.struct("number", (F.col("passes") * F.col("blocks") + F.col("edge") + 1).alias("units"))
    quotas = sources.groupBy(F.floor(F.col("number") / GROUP).alias("group")).agg(F.array_sort(F.collect_list(unit)).alias("q")).select("group", F.col("q.units").alias("units"))
    leaves = split_quotas(quotas, levels, max(1, -(-told["sources"] // GROUP)), seed)
    leaves = leaves.select("shard", "group", F.posexplode(F.arrays_zip("units", "begin")).alias("place", "x")).where("x.units > 0")
    units = leaves.select((F.col("group") * GROUP + F.col("place")).alias("number"), "shard", F.explode(F.sequence(F.col("x.begin"), F.col("x.begin") + F.col("x.units") - 1)).alias("unit"))
    units = durable(units).join(near(sources.select("number", "skey", "blocks")), "number")
    # a unit is one pass over one block; a block has a unit for each of its copies
    drawn = units.groupBy("skey", (F.col("unit") % F.col("blocks")).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "shard"))), lambda x: x["shard"].cast("int")).alias("shards"))
    drawn = F.broadcast(drawn) if (told["blocks"] or 0) <= 100_000 else drawn
    rows = placed(base, sources.select("skey", "blocks", "source_size", "target", "edge", "missing", "cut")).join(drawn, ["skey", "block"], "left")
    left_out = (F.col("block") == F.col("edge")) & ~F.coalesce(F.struct(late, "key") <= F.col("cut"), F.lit(False))
    rows = rows.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))).withColumn("shards", F.slice("shards", F.lit(1), F.size("shards") - left_out.cast("int")))
    return rows.select("row.*", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "block", "shards")


def draw(mixed: DataFrame, seed: str = SEED) -> DataFrame:
    """One row for each copy that ``mix`` takes, dealt by shard and shuffled within it: its columns, copy and shard instead of shards.

    Each copy is a row of its own, so a shard holds about as many words as any other.
    """
    rows = mixed.select(*[c for c in mixed.columns if c != "shards"], F.posexplode("shards").alias("copy", "shard"))
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "doc_id", "copy"))
