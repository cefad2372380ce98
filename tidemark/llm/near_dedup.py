"""Near-duplicate classes of documents by ProbMinHash, banding and verification.

Shingles are ``width`` consecutive words (a shorter text is one shingle); a shingle's weight is how often it occurs.
Similarity is the probability Jaccard index J_P; for texts that repeat no shingle it is the Jaccard index.

1. Exact copies (same words in the same order) meet by a 128-bit hash: each distinct text is one node.
2. ProbMinHash: each shingle is a Poisson process with its weight as rate; each arrival falls on one random component of
   the signature, the earliest arrival there wins, and a shingle stops once it arrives later than all components.
   Signatures of two texts agree in a component with probability J_P. Bands of components make buckets.
3. Verification: of each bucket, the document with the most company over all buckets is compared exactly with those that
   are not linked to it yet, whole texts on both sides; links merge classes. So a group of n near copies of one
   text takes about n comparisons and not n squared. After ``star_rounds`` such rounds, all pairs of a bucket that are
   still in different classes are compared: in small buckets pair by pair; the members of large ones meet in blocks of
   bounded size, where matrix products count common shingles, and only a spanning forest of the links leaves a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FIRST, Rolling, WordHashes, components, durable, forest, mixed, texts_of

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(items: np.ndarray, counts: np.ndarray, width: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts one after another, and words of each -> (text's number, shingle, weight), sorted by text and shingle."""
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = rolling(items, width)
    inside = np.arange(len(h)) + width <= ends[owner[: len(h)]]
    owners, found = [owner[: len(h)][inside]], [h[inside]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        owners.append(np.array([i]))
        found.append(rolling(items[ends[i] - counts[i] : ends[i]], int(counts[i])))
    owner, h = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def prob_minhash(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Signatures (texts x m) of shingle hashes; a text without shingles has zeros."""
    when, who = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    t, alive, last, turn = np.zeros(len(h)), np.arange(len(h)), np.full(texts, np.inf), 0
    while len(alive):
        turn += 1
        r = mixed(h[alive] + np.uint64(turn * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        t[alive] -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[alive]
        early = t[alive] <= last[owner[alive]]  # arrivals come in order: a shingle that is late once is done
        alive, r = alive[early], r[early]
        if not len(alive):
            break
        place = ((mixed(r) >> np.uint64(40)).astype(np.int64) * m >> 24) + owner[alive] * m
        np.minimum.at(when, place, t[alive])
        won = when[place] == t[alive]
        who[place[won]] = h[alive[won]]
        rest = np.unique(owner[alive])
        last[rest] = when.reshape(texts, m)[rest].max(axis=1)
        alive = alive[t[alive] < last[owner[alive]]]
    return who.reshape(texts, m)


def bands_of(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` components; the band's number is part of it."""
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows)
    h = np.tile(np.arange(1, m // rows + 1, dtype=np.uint64) * _STEP, (n, 1))
    for i in range(rows):
        h = mixed(h + parts[:, :, i])
    return h.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted distinct elements, weights): the sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    both = np.union1d(a[0], b[0])
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])], y[np.searchsorted(both, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate(([0.0], np.cumsum(y)))  # elements of a smaller ratio count by y, others by x
    above = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))
    d = np.flatnonzero((x > 0) & (y > 0))
    k = np.searchsorted(ratio, ratio[d])
    return float((1.0 / (above[k] / x[d] + below[k] / y[d])).sum())


class _Shingler:
    def __init__(self, width: int):
        self.width, self.hashes, self.rolling = width, WordHashes(), Rolling(FIRST)

    def __call__(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array([len(x) for x in words], np.int64)
        items = np.concatenate([self.hashes.array(x) for x in words]) if words else np.empty(0, np.uint64)
        return shingles(items, counts, self.width, self.rolling)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (hash of the text as it is), content (128-bit hash of the words; null: no words) and bands of each row."""
    held: dict = {}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["s"] = _Shingler(width)
        for batch in batches:
            texts, at = texts_of(batch), 0
            while at < len(texts):
                words, n, begin = [], 0, at
                while at < len(texts) and (n < 400_000 or at == begin):
                    words.append(texts[at].split())
                    n += len(words[-1])
                    at += 1
                owner, h, weight = held["s"](words)
                found = bands_of(prob_minhash(owner, h, weight, len(words), bands * rows), rows)
                content = pa.array([xxhash.xxh3_128_digest(b" ".join(x)) if x else None for x in words], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * bands), pa.array(found.ravel()))
                yield pa.record_batch([*(batch.column(i).slice(begin, at - begin) for i in (0, 1)), content, lists], ["doc_id", "key", "content", "bands"])

    return identified(docs).select("doc_id", "key", "text").mapInArrow(sign, "doc_id long, key binary, content binary, bands array<long>")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a hash of the text: rows that agree in doc_id and key differ in nothing that matters here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), "text")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have J_P >= threshold."""
    held: dict = {}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["s"], held["sets"] = _Shingler(width), {}
        sets = held["sets"]

        def weighted(text: bytes):
            key = xxhash.xxh3_128_digest(text)
            if key not in sets:
                if len(sets) >= 200:
                    sets.clear()
                sets[key] = held["s"]([text.split()])[1:]
            return sets[key]

        for batch in batches:
            keep = [probability_jaccard(weighted(x), weighted(y)) >= threshold - 1e-12 for x, y in zip(texts_of(batch, "x"), texts_of(batch, "y"), strict=True)]
            yield pa.record_batch([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], ["u", "v"])

    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "u long, v long")


class _Sets:
    """Weighted shingle sets of a block's texts; similarity of many pairs at once."""

    def __init__(self, shingler: _Shingler, texts: list[bytes]):
        owner, h, weight = shingler([x.split() for x in texts])
        self.ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.size = np.diff(self.ends)
        self.h, self.weight = h, weight
        self.plain = np.bincount(owner, weight, len(texts)) == self.size  # repeats no shingle: J_P is the Jaccard index
        # only shingles that two texts of the block have can be common
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        keep = n[at] > 1
        self.owner = owner[keep]
        self.column = np.unique(at[keep], return_inverse=True)[1] if keep.any() else np.empty(0, np.int64)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.h[self.ends[i] : self.ends[i + 1]], self.weight[self.ends[i] : self.ends[i + 1]]

    def similar(self, left: np.ndarray, right: np.ndarray, wanted: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (of ``wanted``: left x right) at or above the threshold."""
        columns = int(self.column.max()) + 1 if len(self.column) else 0
        common, step = np.zeros((len(left), len(right)), np.float32), 20_000
        for c in range(0, columns, step):
            here = (self.column >= c) & (self.column < c + step)
            m = np.zeros((len(self.size), min(step, columns - c)), np.float32)
            m[self.owner[here], self.column[here] - c] = 1
            common += m[left] @ m[right].T
        jaccard = common / np.maximum(self.size[left][:, None] + self.size[right][None, :] - common, 1)
        both = self.plain[left][:, None] & self.plain[right][None, :]
        yes = wanted & both & (jaccard >= threshold - 1e-6)
        for i, j in zip(*np.nonzero(wanted & ~both & (common > 0)), strict=True):
            yes[i, j] = probability_jaccard(self.of(left[i]), self.of(right[j])) >= threshold - 1e-12
        return np.nonzero(yes)


def rest_of_pairs(now: DataFrame, small: int) -> DataFrame:
    """Pairs (a, b) of nodes with different labels in the buckets of ``now`` (band, node, label, size) that have at most ``small`` members."""
    few = now.where(F.col("size") <= small).select("band", "node", "label")
    other = few.select("band", F.col("node").alias("node2"), F.col("label").alias("label2"))
    return few.join(other, "band").where("node < node2 and label <> label2").select(F.col("node").alias("a"), F.col("node2").alias("b"))


def links_in_blocks(now: DataFrame, texts: DataFrame, width: int, threshold: float, small: int, block: int = 256) -> DataFrame:
    """Links (u, v) between nodes with different labels in buckets of more than ``small`` members: as many as connect what they link.

    Buckets with the same first star (``anchor``) are taken together, so that members of many common buckets meet once.
    """
    many = now.where(F.col("size") > small).select(F.col("anchor").alias("star"), "node", "label").distinct()
    sizes = many.groupBy("star").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    many = many.join(sizes, "star").join(texts, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    many = many.select("star", "node", "label", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    many = many.select("star", "node", "label", "text", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    held: dict = {}

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        if not held:
            held["s"] = _Shingler(width)
        node, label, own = (table.column(c).to_numpy() for c in ("node", "label", "own"))
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        a, b = _Sets(held["s"], texts_of(table)).similar(left, right, label[left][:, None] != label[right][None, :], threshold)
        u, v = forest(node[left[a]], node[right[b]])
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return many.groupBy("star", "i", "j").applyInArrow(compare, "u long, v long")


def _decided(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5, star_rounds: int = 1, small: int = 24) -> DataFrame:
    """doc_id, key, content, class_id and chosen (whether doc_id and key stand for the class) of every row of ``docs``."""
    signed = durable(signatures(docs, width, bands, rows))
    reps = signed.where("content is not null").groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep"), F.min("bands").alias("bands"))
    reps = durable(reps.withColumn("node", F.monotonically_increasing_id()))  # numbers stay once they are written
    single = reps.select("node", F.explode("bands").alias("band"))
    shared = single.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    open_ = durable(single.join(shared, "band"))
    degree = open_.groupBy("node").agg(F.sum("n").alias("degree"))
    open_ = open_.drop("n").join(degree, "node")
    asked = degree.select("node").join(reps.select("node", "rep.doc_id", "rep.key"), "node")
    held = identified(docs)
    if not signed.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        held = held.dropDuplicates(["doc_id", "key"])  # repeated rows: one is enough, and they merge before the shuffle
    texts = durable(held.join(asked, (held["key"] == asked["key"]) & held["doc_id"].eqNullSafe(asked["doc_id"])).select("node", "text"))
    edges = tested = labels = None
    for turn in range(star_rounds + 1):
        now = open_ if labels is None else open_.join(labels.withColumnRenamed("root", "label"), "node", "left")
        now = now.withColumn("label", F.col("node") if labels is None else F.coalesce("label", "node"))
        per = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("degree", -F.col("node"), F.col("label").alias("label"))).alias("star"))
        per = per.where("low <> high").select("band", (-F.col("star.col2")).alias("star"), F.col("star.label").alias("star_label"))
        now = now.join(per, "band")  # only buckets in which classes meet
        now = durable(now if turn else now.withColumn("anchor", F.col("star")))
        if turn < star_rounds:
            pairs = now.where("label <> star_label").select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b"))
        else:
            now = durable(now.join(now.groupBy("band").agg(F.count("*").alias("size")), "band"))
            pairs = rest_of_pairs(now, small)
        pairs = pairs.distinct()
        pairs = durable(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        found = verified(pairs, texts, width, threshold)
        found = durable(found if turn < star_rounds else found.unionByName(links_in_blocks(now, texts, width, threshold, small)))
        edges = found if edges is None else edges.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if turn == 0 or not found.isEmpty():
            labels = components(edges)
        open_ = now.where("node <> star").select("node", "band", "degree", "anchor")
        if now.isEmpty():
            break
    linked = durable(labels.join(reps.select("node", "content", "rep"), "node"))
    linked = linked.select("root", "content").join(linked.groupBy("root").agg(F.min("rep").alias("best")), "root").select("content", "best")
    named = reps.select("content", "rep").join(linked, "content", "left").select("content", F.coalesce("best", "rep").alias("best"))
    judged = signed.select("doc_id", "key", "content").join(named, "content", "left")
    class_id, wordless = F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")), F.col("content").isNull()
    return judged.select("doc_id", "key", "content", class_id.alias("class_id"), (wordless | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))).alias("chosen"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Options and defaults: width 5, threshold 0.8, bands 32, rows 5 (components of a band), star_rounds 1, small 24.

    Two texts are linked if J_P of their shingles is ``threshold`` or more; classes are what links connect, class_id the
    smallest doc_id of the class (null if none has one), kept marks the row that stands for its class: the one with that
    doc_id and, if several texts of the class have it, one of them. Rows of one doc_id are judged each by its own text. A row
    without doc_id takes part like any other and is kept only if no row of its class has a doc_id. Repeated rows get equal
    results. Texts without words link with nothing and are kept. With 32 bands of 5 components a pair at 0.8 shares no bucket
    with probability 3e-6.
    """
    return _decided(docs, **options).select("doc_id", "class_id", F.col("chosen").alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their classes, one for each class, and all rows without words; all columns kept.

    Of rows that agree in doc_id and text one stays. Options are those of near_duplicates.
    """
    stay = _decided(docs, **options).where("chosen").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first(F.col("content").isNull()).alias("wordless"))
    stay = durable(stay.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), ((F.col("n") > 1) & ~F.col("wordless")).alias("_again")))
    names = {c: _unused(c, docs.columns) for c in stay.columns}
    stay = stay.withColumnsRenamed(names)
    id_, key, again = (F.col(names[c]) for c in ("_id", "_key", "_again"))
    met = docs.join(stay, (_key(docs["text"]) == key) & docs["doc_id"].cast("long").eqNullSafe(id_))
    if stay.where(again).isEmpty():
        return met.select(*docs.columns)
    once = met.where(again).dropDuplicates([names["_id"], names["_key"]])
    return met.where(~again).unionByName(once).select(*docs.columns)


def _unused(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name
