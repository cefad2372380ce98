"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document. A word goes if a window covers it whose words also start in a
document with a smaller doc_id.

1. Documents are dealt into chunks. Each chunk counts its windows in ``depth`` rows of a count-min sketch, by the window's
   anchor: the sub-window of half the width whose hash is smallest, the leftmost of equal ones. Equal windows have equal
   anchors, so an anchor is seen at least as often as the window; neighbouring windows mostly share theirs, so there are
   about 13 times fewer (for 50 words) to count. The sketch has about 8 counters an anchor and row, so it is kept sparse
   (the sorted numbers of the counters a chunk touched, as differences, with one bit for "more than once") and split into
   shards by counter.
2. Each shard adds the chunks' parts and returns to each chunk one bit for each counter it sent: the total is 2 or more.
   A window whose anchor's counters all say so is estimated repeated. The estimate is never too low, so no repeat is lost.
3. For these windows only, a chunk sends one 128-bit hash with the smallest doc_id it has seen with it. Shards group
   them exactly and return one bit for each: a smaller doc_id exists elsewhere.
4. Each chunk removes what these windows cover.

Traffic: the text once (the same exchange is reused for all steps), about 2 bytes an anchor and row of the sketch, and 24
bytes for each distinct window of a chunk that is estimated repeated. A passage that millions of documents share costs one
record a chunk and not one a document, so no task gets more than its share of it. Chunks and shards both grow with the text;
so that their messages do not grow with the product, beyond ``fan`` shards they go through batches of chunks: a chunk sends
one message for each range of shards, a batch merges those of its chunks and sends one for each shard, and the answers take
the same way back. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, SECOND, Rolling, WordHashes, back, in_chunks, mixed, ordered

PART = "chunk long, kind int, shard long, body binary"


def packed(cells: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted distinct numbers as differences, with one bit for each."""
    steps = np.diff(cells, prepend=np.uint64(0))
    wide = steps >= 0xFFFF
    return b"".join((np.array([len(cells), wide.sum()], "<u4").tobytes(), np.where(wide, 0xFFFF, steps).astype("<u2").tobytes(), steps[wide].astype("<u8").tobytes(), np.packbits(more).tobytes()))


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide = np.frombuffer(body, "<u4", 2)
    steps = np.frombuffer(body, "<u2", n, 8).astype(np.uint64)
    steps[steps == 0xFFFF] = np.frombuffer(body, "<u8", wide, 8 + 2 * int(n))
    return np.cumsum(steps), np.unpackbits(np.frombuffer(body, np.uint8, offset=8 + 2 * int(n) + 8 * int(wide)), count=int(n)).astype(bool)


def leftmost_minima(values: np.ndarray, span: int) -> np.ndarray:
    """Where the smallest of each run of ``span`` values is, the leftmost of equal ones."""
    at, have = np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at


class _Plan:
    """Numbers that all steps share."""

    def __init__(self, width: int, words: int, depth: int, shard_windows: int, fan: int):
        self.width, self.depth = width, depth
        self.anchor = max(1, width // 2)
        self.span = width - self.anchor + 1  # anchors that a window chooses from
        anchors = 2 * int(words) // (self.span + 1)
        self.bits = max(16, anchors.bit_length() + 3)
        self.shard_bits = max(4, (anchors // shard_windows).bit_length())
        self.low = np.uint64(self.bits - self.shard_bits)  # bits of a counter's number within its shard
        self.sent_bits = self.shard_bits if self.shard_bits <= fan.bit_length() - 1 else -(-self.shard_bits // 2)
        self.sent_low = np.uint64(self.bits - self.sent_bits)  # and within the range that a chunk sends as one message
        self.inner_bits = self.shard_bits - self.sent_bits  # shards of a range; 0: each range is one
        self.batch_bits = self.inner_bits + 2  # chunks of a batch, so that its messages are no shorter than theirs


class _Chunk:
    """The windows of a chunk's documents and the counters they touch."""

    def __init__(self, plan: _Plan, table: pa.Table, one: Rolling, two: Rolling):
        self.plan, self.one, self.two = plan, one, two
        self.order, self.ids, texts = ordered(table)
        self.texts = texts
        hashes = WordHashes()  # of this chunk alone: words that outlive it would keep the memory of all others from being used again
        arrays = [hashes.array(x.split()) for x in texts]
        self.counts = np.array([len(x) for x in arrays], np.int64)
        self.items = items = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        del arrays, hashes
        ends = np.cumsum(self.counts)
        self.begins = ends - self.counts
        n = max(0, len(items) - plan.width + 1)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        inside = np.arange(n) + plan.width <= ends[doc[:n]]
        self.at = np.flatnonzero(inside)  # where windows start
        self.doc = doc[self.at]
        first, second = one(items, plan.anchor), two(mixed(items), plan.anchor)
        chosen = leftmost_minima(first, plan.span)[self.at] if n else np.empty(0, np.int64)
        new = np.diff(chosen, prepend=-1) != 0  # windows in order choose anchors in order
        anchors, number = chosen[new], np.cumsum(new) - 1
        self.rows = []
        for r in range(plan.depth):
            cells, which = np.unique((first[anchors] if not r else mixed(second[anchors] + np.uint64(r))) >> np.uint64(64 - plan.bits), return_inverse=True)
            self.rows.append((cells, which, number))

    def sketches(self) -> Iterator[tuple[int, int, bytes]]:
        low = self.plan.sent_low
        for r, (cells, which, _) in enumerate(self.rows):
            more = np.bincount(which, minlength=len(cells)) > 1
            shard = cells >> low
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if a < b:
                    yield r, int(shard[a]), packed(cells[a:b] & ((np.uint64(1) << low) - np.uint64(1)), more[a:b])

    def repeated(self, answers: dict) -> np.ndarray:
        """The windows that are estimated repeated. answers: bits by row and shard."""
        found = np.ones(len(self.at), bool)
        for r, (cells, which, number) in enumerate(self.rows):
            shard = cells >> self.plan.sent_low
            cuts = np.flatnonzero(np.diff(shard)) + 1
            bits = [np.unpackbits(np.frombuffer(answers[r, int(shard[a])], np.uint8), count=b - a) for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True) if a < b]
            if bits:
                found &= np.concatenate(bits).astype(bool)[which][number]
        return np.flatnonzero(found)

    def grouped(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows sorted by hash; the first of each hash; the hash's number for each window. The first has the smallest doc_id."""
        self.h1, self.h2 = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.uint64)  # of the windows in which
        self.h1[which] = self.one(self.items, self.plan.width)[self.at[which]]
        self.h2[which] = self.two(mixed(self.items), self.plan.width)[self.at[which]]
        order = which[np.lexsort((self.doc[which], self.h2[which], self.h1[which]))]
        a, b = self.h1[order], self.h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order, order[new], np.cumsum(new) - 1


def remove_repeats(docs: DataFrame, width: int = 50, depth: int = 2, chunk_chars: int = 4_000_000, shard_windows: int = 2_000_000, fan: int = 256, keep_layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) without passages that start in earlier documents.

    Returns doc_id, n_words, n_removed, kept_text and removed (pairs of first word and end of each removed run, counted
    from 0), and the columns in ``carry``, which may not have these names or ``chunk``; others are ignored. kept_text joins
    the kept words by one space; with ``keep_layout`` a document that loses nothing keeps its text as it is, null too. Null
    texts count as empty. Texts of any length are read whole. Rows with the same doc_id, repeated ones too, do not take words
    from one another; a null doc_id counts as larger than any other. An empty table gives no rows.
    """
    if clash := {"doc_id", "text", "chunk", "n_words", "n_removed", "kept_text", "removed"} & {c.lower() for c in carry}:
        raise ValueError(f"columns of the result can't be carried: {sorted(clash)}")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    base = in_chunks(docs, ["doc_id", "text", *carry], chunk_chars)
    words = docs.agg(F.sum(F.length("text") - F.length(F.translate("text", " \t\n\r\x0b\x0c", "")) + 1)).first()[0] or 0
    plan = _Plan(width, words, depth, shard_windows, fan)

    def tools():
        return Rolling(FIRST), Rolling(SECOND)

    def out(rows: list) -> pa.Table:
        chunk, kind, shard, body = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int64()), "body": pa.array(body, pa.binary())})

    held: dict = {}

    def chunk_of(table: pa.Table) -> _Chunk:
        if not held:
            held["tools"] = tools()
        return _Chunk(plan, table, *held["tools"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        return out([(key[0].as_py(), r, s, body) for r, s, body in chunk_of(table).sketches()])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << int(plan.low), np.uint8)
        parts = [unpacked(x) for x in table.column("body").to_pylist()]
        for cells, more in parts:
            total[cells] = np.minimum(total[cells] + 1 + more, 2)
        return out([(c, key[0].as_py(), key[1].as_py(), np.packbits(total[cells] > 1).tobytes()) for c, (cells, _) in zip(table.column("chunk").to_pylist(), parts, strict=True)])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """The messages of a batch's chunks for one range of shards -> one message for each of its shards."""
        kind, part, batch = (x.as_py() for x in key)
        if kind < 0:
            h1, h2, ids = np.concatenate([np.frombuffer(x, np.uint64).reshape(3, -1) for x in table.column("body").to_pylist()], axis=1)
            order, new = _sorted_windows(h1, h2, ids.view(np.int64))
            first = order[new]
            return out([(batch, kind, s, h1[first[a:b]].tobytes() + h2[first[a:b]].tobytes() + ids[first[a:b]].tobytes()) for s, a, b in _runs(h1[first] >> np.uint64(64 - plan.shard_bits))])
        parts = [unpacked(x) for x in table.column("body").to_pylist()]
        cells, more = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        new = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
        cells, more = cells[new], np.add.reduceat(1 + more[order].astype(np.int64), new) > 1
        within = (np.uint64(1) << plan.low) - np.uint64(1)
        return out([(batch, kind, part << plan.inner_bits | s, packed(cells[a:b] & within, more[a:b])) for s, a, b in _runs(cells >> plan.low)])

    def scatter(key: tuple, sent: pa.Table, told: pa.Table) -> pa.Table:
        """What a batch's chunks sent for one range of shards and the answers to the batch -> the answer to each chunk."""
        kind, part, _ = (x.as_py() for x in key)
        bits = dict(zip(told.column("inner").to_pylist(), told.column("body").to_pylist(), strict=True))

        def joined(shard: np.ndarray) -> np.ndarray:
            return np.concatenate([np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a) for s, a, b in _runs(shard)]).astype(bool)

        rows, bodies = [], sent.column("body").to_pylist()
        if kind < 0:
            parts = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in bodies]
            h1, h2, ids = np.concatenate(parts, axis=1)
            ids = ids.view(np.int64)
            order, new = _sorted_windows(h1, h2, ids)
            number, first = np.cumsum(new) - 1, order[new]
            later = np.empty(len(order), bool)
            later[order] = (ids[order] > ids[first][number]) | joined(h1[first] >> np.uint64(64 - plan.shard_bits))[number]
            ends = np.cumsum([x.shape[1] for x in parts])
            replies = np.split(later, ends[:-1])
        else:
            parts = [unpacked(x)[0] for x in bodies]
            cells = np.unique(np.concatenate(parts))
            twice = joined(cells >> plan.low)
            replies = [twice[np.searchsorted(cells, x)] for x in parts]
        for c, x in zip(sent.column("chunk").to_pylist(), replies, strict=True):
            rows.append((c, kind, part, np.packbits(x).tobytes()))
        return out(rows)

    def told_by(merging, sent: DataFrame) -> DataFrame:
        """The answers of shards to what chunks sent."""
        if not plan.inner_bits:
            return sent.groupBy("kind", "shard").applyInArrow(merging, PART)
        sent = sent.withColumn("batch", F.shiftright("chunk", plan.batch_bits))
        met = sent.groupBy("kind", "shard", "batch")
        told = met.applyInArrow(gather, PART).groupBy("kind", "shard").applyInArrow(merging, PART)
        told = told.select("kind", F.shiftright("shard", plan.inner_bits).alias("shard"), F.col("chunk").alias("batch"), "body", F.when(F.col("kind") < 0, F.col("shard")).otherwise(F.col("shard").bitwiseAND((1 << plan.inner_bits) - 1)).alias("inner"))
        return met.cogroup(told.groupBy("kind", "shard", "batch")).applyInArrow(scatter, PART)

    def answers(table: pa.Table, second: bool = False) -> dict:
        rows = zip(*(table.column(x).to_pylist() for x in ("kind", "shard", "body")), strict=True)
        return {(k, s) if not second else s: b for k, s, b in rows if (k < 0) == second}

    def exact(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = chunk_of(table)
        _, first, _ = chunk.grouped(chunk.repeated(answers(told)))
        shard = chunk.h1[first] >> np.uint64(64 - plan.sent_bits)
        rows = []
        for s, a, b in _runs(shard):
            part = first[a:b]
            rows.append((key[0].as_py(), -1, s, chunk.h1[part].tobytes() + chunk.h2[part].tobytes() + chunk.ids[chunk.doc[part]].tobytes()))
        return out(rows)

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in table.column("body").to_pylist()]
        h1, h2, ids = np.concatenate(parts, axis=1)
        ids = ids.view(np.int64)
        order, new = _sorted_windows(h1, h2, ids)
        later = np.empty(len(order), bool)
        later[order] = ids[order] > ids[order][new][np.cumsum(new) - 1]
        rows, at = [], 0
        for c, part in zip(table.column("chunk").to_pylist(), parts, strict=True):
            rows.append((c, -1, key[1].as_py(), np.packbits(later[at : at + part.shape[1]]).tobytes()))
            at += part.shape[1]
        return out(rows)

    def cut(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = chunk_of(table)
        order, first, number = chunk.grouped(chunk.repeated(answers(told)))
        bits = answers(told, second=True)
        elsewhere = [np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a) for s, a, b in _runs(chunk.h1[first] >> np.uint64(64 - plan.sent_bits))]
        elsewhere = np.concatenate(elsewhere).astype(bool) if elsewhere else np.empty(0, bool)
        mine, least = chunk.ids[chunk.doc[order]], chunk.ids[chunk.doc[first]][number] if len(order) else np.empty(0, np.int64)
        gone = chunk.at[order[(mine > least) | elsewhere[number]]] if len(order) else np.empty(0, np.int64)
        edge = np.zeros(int(chunk.counts.sum()) + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + plan.width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        absent = table.column("text").is_null().take(pa.array(chunk.order, pa.int64())).to_pylist()
        kept, removed, n_removed = [], [], []
        for i, text in enumerate(chunk.texts):
            words = text.split()
            mask = covered[chunk.begins[i] : chunk.begins[i] + len(words)]
            n = int(mask.sum())
            n_removed.append(n)
            if n:
                turns = np.flatnonzero(np.diff(mask, prepend=False, append=False))
                removed.append(turns.reshape(-1, 2).tolist())
                kept.append(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m]))
            else:
                removed.append([])
                kept.append(b" ".join(words) if not keep_layout else None if absent[i] else text)
        return pa.table({
            "doc_id": back(chunk.ids), "n_words": pa.array(chunk.counts), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(removed, pa.list_(pa.list_(pa.int32()))),
            **{c: table.column(c).take(pa.array(chunk.order, pa.int64())) for c in carry},
        })

    chunks = base.groupBy("chunk")
    flags = told_by(merge, chunks.applyInArrow(count, PART))
    firsts = chunks.cogroup(flags.groupBy("chunk")).applyInArrow(exact, PART)
    later = told_by(decide, firsts)
    told = flags.unionByName(later)
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(cut, ", ".join(["doc_id long, n_words long, n_removed long, kept_text string, removed array<array<int>>", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)]))


def _sorted_windows(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by hash and doc_id, and which of them, in this order, are the first of their hash."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _runs(shard: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(shard)) + 1
    return [(int(shard[a]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True) if a < b]
