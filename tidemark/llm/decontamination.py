"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words of which some positions are ignored, so a hit survives substitutions at
these positions. The masked hashes of benchmark items are joined with those at every position of every document; around
each hit, words are compared along the diagonal, and an overlap counts if enough of a long enough stretch is equal.

The benchmark side is joined by broadcast in blocks of at most ``block_words`` words: usually one block, and no shuffle. A
larger benchmark takes one pass over the documents for each block, one after another, so that one block's index is held at a
time; what a pass finds is kept by the text's hash, since overlaps depend on the text alone. The result is the same for any
``block_words``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, durable, mixed

#: 1: the word counts; 0: it is ignored. Span 11, weight 5 to 7. Between equal ends, every placement of 2 substitutions in 11
#: to 14 words and of 3 in 15 or 16 words leaves a hit of one mask at least.
MASKS = ("11101100100", "10110011001", "11010010110", "11111100000", "00000111111", "11000101001", "10101000110")
WORD = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def seeds(items: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The masked hash at each position of an array of word hashes."""
    n = len(items) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for i, x in enumerate(mask):
        if x == "1":
            h = (h + items[i : i + n]) * _FACTOR
    return mixed(h)


def stretch(equal: np.ndarray, least: int, share: float) -> tuple[int, int]:
    """The longest run with at least ``share`` of its ``least`` or more positions equal, ends equal: (begin, end), or (0, 0)."""
    n = len(equal)
    if n < least:
        return 0, 0
    total = np.concatenate(([0.0], np.cumsum(equal - share)))
    # total[j] >= total[i] means that the share holds on i..j; for each i the last such j
    best = (0, 0)
    highest = np.maximum.accumulate(total[::-1])[::-1]
    for i in np.flatnonzero(equal):
        if n - i < max(least, best[1] - best[0] + 1):
            break
        j = int(np.searchsorted(-highest, -total[i] + 1e-9, side="right")) - 1
        while j > i and not equal[j - 1]:
            j -= 1
        if j - i >= least and j - i > best[1] - best[0] and total[j] >= total[i] - 1e-9:
            best = (int(i), j)
    return best


class Index:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...]):
        self.masks, self.hashes = masks, WordHashes()
        self.items = [(k, self.array(words_of(t))) for k, t in items]
        found = [(seeds(a, m, j), np.full(max(0, len(a) - len(m) + 1), i), np.arange(max(0, len(a) - len(m) + 1))) for j, m in enumerate(masks) for i, (_, a) in enumerate(self.items)]
        keys, item, at = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(3))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order].astype(np.uint64), item[order], at[order]
        #: One bit for each of at least 16 places a key; most positions of a document stop here.
        self.shift = np.uint64(64 - max(12, (16 * len(keys)).bit_length()))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.keys >> self.shift] = True
        #: Items shorter than the masks are found as whole runs of words.
        span = min(map(len, masks))
        self.short: dict[int, list] = {}
        for i, (_, a) in enumerate(self.items):
            if 0 < len(a) < span:
                self.short.setdefault(len(a), []).append(i)

    def array(self, words: list[str]) -> np.ndarray:
        return self.hashes.array(words)

    def overlaps(self, words: np.ndarray, least: int, share: float) -> list[tuple[int, int, int, int]]:
        """(item's id, first word in the document, words spanned, words equal) of each item that overlaps, its longest."""
        diagonals = set()
        for j, mask in enumerate(self.masks):
            h = seeds(words, mask, j)
            hits = np.flatnonzero(self.maybe[h >> self.shift])
            if len(hits):
                a, b = np.searchsorted(self.keys, h[hits]), np.searchsorted(self.keys, h[hits], side="right")
                for p, x, y in zip(hits[a < b], a[a < b], b[a < b], strict=True):
                    diagonals.update((int(self.item[k]), int(p - self.at[k])) for k in range(x, y))
        best: dict[int, tuple] = {}
        for i, d in sorted(diagonals):
            item = self.items[i][1]
            lo, hi = max(0, -d), min(len(item), len(words) - d)
            equal = item[lo:hi] == words[d + lo : d + hi]
            x, y = stretch(equal, min(least, len(item)), share)
            if y > x and y - x > best.get(i, (0, 0, 0))[1]:
                best[i] = (d + lo + x, y - x, int(equal[x:y].sum()))
        for n, items in self.short.items():
            if len(words) >= n:
                runs = np.lib.stride_tricks.sliding_window_view(words, n)
                for i in items:
                    at = np.flatnonzero((runs == self.items[i][1]).all(axis=1))
                    if len(at):
                        best[i] = (int(at[0]), n, n)
        return [(self.items[i][0], *x) for i, x in best.items()]


FOUND = "array<struct<item_id: bigint, first_word: int, span: int, equal: int>>"


class Matcher:
    """Overlaps of texts with one block of the benchmark, sorted by item (null last), place and length."""

    def __init__(self, shipped, masks: tuple[str, ...], least: int, share: float):
        self.shipped, self.masks, self.least, self.share, self.index = shipped, masks, least, share, None

    def __call__(self, text: str | None) -> list[tuple]:
        if self.index is None:
            self.index = Index(self.shipped.value, self.masks)
        if not text or not self.index.items:
            return []
        return sorted(self.index.overlaps(self.index.array(words_of(text)), self.least, self.share), key=lambda r: (r[0] is None, *(x or 0 for x in r)))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, masks: tuple[str, ...] = MASKS, block_words: int = 2_000_000) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored): the benchmark items that its text
    overlaps, and where.

    An overlap is a stretch, along one alignment of item and document, of at least ``least`` words (all of a shorter
    item) of which ``share`` or more are equal, found by a seed hit. Words are lower-case runs of word characters.
    Returns doc_id, contaminated, item_ids (sorted, null last), first_words, spans and equal (for each item the longest
    overlap's first word in the document, words spanned, and words equal). Items shorter than the masks must occur whole.
    Each row is judged by its own whole text, however long, with or without doc_id. Null and empty texts and items overlap
    nothing. Repeated rows and rows of one doc_id give a row each; repeated items are listed each; an empty benchmark clears
    all, an empty table gives no rows.
    """
    blocks = _blocks(benchmark, block_words)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(blocks) == 1:
        match = Matcher(docs.sparkSession.sparkContext.broadcast(blocks[0]), masks, least, share)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column(0), _structs([match(x) for x in batch.column(1).to_pylist()])], ["doc_id", "found"])

        rows = text.mapInArrow(find, f"doc_id long, found {FOUND}")
    else:
        hits = _hits(text, blocks, masks, least, share)
        rows = text.select("doc_id", F.md5("text").alias("key")).join(hits, "key", "left").select("doc_id", F.coalesce("found", F.array().cast(FOUND)).alias("found"))
    return rows.select("doc_id", *(F.col(f"found.{c}").alias(n) for c, n in (("item_id", "item_ids"), ("first_word", "first_words"), ("span", "spans"), ("equal", "equal"))), (F.size("found") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, masks: tuple[str, ...] = MASKS, block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` whose own text overlaps no benchmark item, all columns kept. With one block without a shuffle."""
    blocks = _blocks(benchmark, block_words)
    if len(blocks) == 1:
        match = Matcher(docs.sparkSession.sparkContext.broadcast(blocks[0]), masks, least, share)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not match(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    gone = _hits(docs.select("text"), blocks, masks, least, share).select("key")
    if gone.count() <= 500_000:  # 40 bytes each
        gone = F.broadcast(gone)
    return docs.join(gone, F.md5(docs["text"]) == gone["key"], "left_anti")


def _structs(rows: list[list[tuple]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    item, first, span, equal = zip(*(x for r in rows for x in r), strict=True) if ends[-1] else ((), (), (), ())
    fields = [pa.array(item, pa.int64()), pa.array(first, pa.int32()), pa.array(span, pa.int32()), pa.array(equal, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["item_id", "first_word", "span", "equal"]))


def _hits(texts: DataFrame, blocks: _Blocks, masks: tuple[str, ...], least: int, share: float) -> DataFrame:
    """key (md5 of a text) and found of each distinct text that overlaps any item, from one pass for each block."""
    parts = None
    for number in range(len(blocks)):
        match = Matcher(texts.sparkSession.sparkContext.broadcast(blocks[number]), masks, least, share)

        def find(batches: Iterator[pa.RecordBatch], match: Matcher = match) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [match(x) for x in batch.column(1).to_pylist()]
                some = pa.array([bool(x) for x in found], pa.bool_())
                yield pa.record_batch([batch.column(0).filter(some), _structs([x for x in found if x])], ["key", "found"])

        part = texts.where("text is not null").select(F.md5("text").alias("key"), "text").mapInArrow(find, f"key string, found {FOUND}")
        part = durable(part.dropDuplicates(["key"]))  # equal texts have equal overlaps
        parts = part if parts is None else parts.unionByName(part)
    x = F.struct(F.col("x.item_id").isNull().alias("last"), "x.*")
    return durable(parts.select("key", F.explode("found").alias("x")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(x)), lambda y: F.struct(*(y[c].alias(c) for c in ("item_id", "first_word", "span", "equal")))).alias("found")))


class _Blocks:
    """Blocks of benchmark rows, fetched when they are asked for: about ``block_words`` words each at most, but for one longer item."""

    def __init__(self, items: DataFrame, n: int):
        self.items, self.n = items, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> list[tuple[int | None, str]]:
        mine = self.items if self.n == 1 else self.items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == i)
        return [(r.item_id, r.text) for r in mine.select("item_id", "text").collect()]


def _blocks(benchmark: DataFrame, block_words: int) -> _Blocks:
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return _Blocks(items, max(1, -(-int(chars) // (2 * block_words))))  # a word and what parts it from the next take 2 characters at least
