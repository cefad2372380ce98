"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, of order ``ORDER``. Chunks of documents count their distinct n-grams and, for trusted documents,
how often each occurs; shards merge them by n-gram. All counts of lower orders, context totals and discounts follow by
grouped aggregation, and probabilities by joins on contexts and suffixes from the lowest order up. Shards answer each
chunk with the log-probabilities of the n-grams it sent, and chunks add them up for each document. Beyond ``fan`` shards
these messages go through batches of chunks, both ways, so that their number does not grow with chunks times shards. No
table of n-grams is broadcast or collected: everything that grows with the text stays in shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import durable, in_chunks_by_id, mixed, ordered, texts_of
from .substring_dedup import packed, unpacked

ORDER = 5
START = b"\xff" * (ORDER - 1)  # no byte of UTF-8


def grams_of(text: bytes) -> np.ndarray:
    """The n-gram that ends at each byte, as a number of 8 * ORDER bits."""
    b = np.frombuffer(START + text, np.uint8).astype(np.uint64)
    n, out = len(text), np.zeros(len(text), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(8)) | b[i : i + n]
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts from the counts of counts; where those are missing, 0.5, 1 and 1.5."""
    if min(n1, n2) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` with each text compressed by itself, for the shuffle to chunks; null stays null."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if x is None else codec.compress(x) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([pa.array(texts, pa.binary()) if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(squeeze, StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType) for f in docs.schema]))


def opened(table: pa.Table) -> pa.Table:
    """A chunk of what ``squeezed`` gave, with its texts as UTF-8 bytes."""
    codec = zstandard.ZstdDecompressor()
    texts = [None if x is None else codec.decompress(x) for x in table.column("text").to_pylist()]
    return table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """grams: shard, key and n (times seen in trusted text, 0 for n-grams that are only asked for) -> shard, key, logp."""
    levels = {ORDER: grams.select("key", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):  # how many different bytes were seen in front of a shorter n-gram
        levels[k] = levels[k + 1].groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
    of = None
    for k, level in levels.items():
        one = level.agg(F.lit(k).alias("k"), *(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        of = one if of is None else of.unionByName(one)
    found = {r["k"]: discounts(*(r[f"n{i}"] or 0 for i in (1, 2, 3, 4))) for r in of.collect()}  # ORDER rows
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = found[k]
        level = levels[k].withColumn("ctx", F.shiftright("key", 8))
        totals = level.where("c > 0").groupBy("ctx").agg(F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"), F.sum((F.col("c") > 2).cast("long")).alias("n3"))
        level = level.join(totals, "ctx", "left")
        if lower is None:
            level = level.withColumn("q", F.lit(1 / 257))
        else:
            level = level.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower, "suffix")
        cut = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        p = (F.col("c") - cut + (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) * F.col("q")) / F.col("total")
        level = level.select("key", F.coalesce(p, F.col("q")).alias("p"))
        lower = level.select(F.col("key").alias("suffix"), F.col("p").alias("q"))
    return grams.select("shard", "key").join(level, "key").select("shard", "key", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, chunk_chars: int = 6_000_000, shard_chars: int = 16_000_000, fan: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, perplexity (a byte; null for empty texts) and the columns in ``keep`` of every row of ``docs``.

    The model is trained on the documents whose doc_id is in ``trusted``. Without any trusted text every byte has
    probability 1/257.
    """
    columns = ["doc_id", "text", *keep]
    base, marks = in_chunks_by_id(docs, columns, trusted.where("doc_id is not null").select("doc_id").distinct(), chunk_chars)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(3, (int(chars) // shard_chars).bit_length())
    sent_bits = bits if bits <= fan.bit_length() - 1 else -(-bits // 2)  # of the range of shards that a chunk sends as one message
    inner_bits = bits - sent_bits  # shards of a range; 0: each range is one
    batch_bits = inner_bits + 2  # chunks of a batch, so that its messages are no shorter than theirs

    def sharded(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of keys by shard and number, and (shard, begin, end); n-grams that begin alike share a shard."""
        shard = mixed((keys >> np.uint64(16)) + np.uint64(1)) >> np.uint64(64 - bits)
        order = np.lexsort((keys, shard))
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        return order, [(int(shard[order[a]]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True) if a < b]

    def distinct(texts: list[bytes]) -> np.ndarray:
        found, part, size = [], [], 0
        for x in [*texts, None]:
            if x is None or size > 1_000_000:
                if part:
                    found.append(pd.unique(np.concatenate(part)))
                part, size = [], 0
            if x:
                part.append(grams_of(x))
                size += len(x)
        return pd.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)

    def ask(key: tuple, table: pa.Table, marked: pa.Table) -> pa.Table:
        _, ids, texts = ordered(opened(table))
        keys = np.sort(distinct(texts))
        counts = np.zeros(len(keys), np.int64)
        good = np.isin(ids, marked.column("doc_id").to_numpy())
        for i in np.flatnonzero(good):
            if texts[i]:
                g, n = np.unique(grams_of(texts[i]), return_counts=True)
                counts[np.searchsorted(keys, g)] += n
        return messages(key[0].as_py(), keys, counts, sent_bits)

    def messages(sender: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
        order, parts = sharded(keys, bits)
        rows = []
        for s, a, b in parts:
            k, n = keys[order[a:b]], counts[order[a:b]]
            rows.append((sender, s, packed(k, n > 0), n[n > 0].astype("<u4" if n.max() < 1 << 32 else "<u8").tobytes()))
        chunk, shard, body, times = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "shard": pa.array(shard, pa.int64()), "body": pa.array(body, pa.binary()), "times": pa.array(times, pa.binary())})

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of several messages, sorted, and how often they were seen."""
        found = [(k, seen, np.frombuffer(times, "<u4" if len(times) == 4 * seen.sum() else "<u8")) for (k, seen), times in ((unpacked(b), t) for b, t in zip(table.column("body").to_pylist(), table.column("times").to_pylist(), strict=True))]
        keys = np.concatenate([k for k, _, _ in found])
        counts = np.zeros(len(keys), np.int64)
        counts[np.concatenate([seen for _, seen, _ in found])] = np.concatenate([times for _, _, times in found])
        del found
        order = np.argsort(keys, kind="stable")  # all chunks' parts by one sort
        keys = keys[order]
        new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[new], np.add.reduceat(counts[order], new) if len(new) else counts

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        return pa.table({"shard": pa.array(np.full(len(keys), key[0].as_py())), "key": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """The messages of a batch's chunks for one range of shards -> one message for each of its shards."""
        return messages(key[1].as_py(), *merged(table), bits)

    def scatter(key: tuple, sent: pa.Table, told: pa.Table) -> pa.Table:
        """What a batch's chunks sent for one range of shards and the answers to the batch -> the answer to each chunk."""
        parts = [unpacked(x)[0] for x in sent.column("body").to_pylist()]
        keys = np.unique(np.concatenate(parts))
        logp = told_of(keys, dict(zip(told.column("inner").to_pylist(), told.column("logp").to_pylist(), strict=True)), bits)
        return pa.table({"chunk": sent.column("chunk"), "shard": sent.column("shard"), "logp": pa.array([logp[np.searchsorted(keys, x)].tobytes() for x in parts], pa.binary())})

    def told_of(keys: np.ndarray, bodies: dict, bits: int) -> np.ndarray:
        logp = np.empty(len(keys), "<f4")
        order, parts = sharded(keys, bits)
        for s, a, b in parts:
            logp[order[a:b]] = np.frombuffer(bodies[s], "<f4")
        return logp

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, logp = known.column("key").to_numpy().astype(np.uint64), known.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order].astype("<f4")
        bodies = [logp[np.searchsorted(keys, unpacked(x)[0])].tobytes() for x in asked.column("body").to_pylist()]
        return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "logp": pa.array(bodies, pa.binary())})

    def add(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        texts = texts_of(opened(table))
        keys = np.sort(distinct(texts))
        logp = told_of(keys, dict(zip(told.column("shard").to_pylist(), told.column("logp").to_pylist(), strict=True)), sent_bits).astype(np.float64)
        index = pd.Index(keys)
        sums, part, size = [], [], 0
        for i, x in enumerate(texts):
            part.append(x)
            size += len(x)
            if size > 1_000_000 or i == len(texts) - 1:
                codes, seen = pd.factorize(np.concatenate([grams_of(y) for y in part]))
                values = logp[index.get_indexer(seen)][codes] if len(seen) else np.empty(0)
                total = np.concatenate(([0.0], np.cumsum(values)))
                ends = np.cumsum([len(y) for y in part])
                sums += (total[ends] - total[ends - np.array([len(y) for y in part])]).tolist()
                part, size = [], 0
        n = np.array([len(x) for x in texts], np.int64)
        p = np.exp(-np.array(sums) / np.maximum(n, 1))
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(n), "perplexity": pa.array(p, mask=n == 0), **{c: table.column(c) for c in keep}})

    chunks = squeezed(base).groupBy("chunk")
    message = "chunk long, shard long, body binary, times binary"
    sent = asked = durable(chunks.cogroup(marks.groupBy("chunk")).applyInArrow(ask, message))
    if inner_bits:
        sent = sent.withColumn("batch", F.shiftright("chunk", batch_bits))
        asked = durable(sent.groupBy("shard", "batch").applyInArrow(gather, message))
    grams = durable(asked.groupBy("shard").applyInArrow(merge, "shard long, key long, n long"))
    told = asked.groupBy("shard").cogroup(log_probabilities(grams).groupBy("shard")).applyInArrow(answer, "chunk long, shard long, logp binary")
    if inner_bits:
        told = told.select(F.shiftright("shard", inner_bits).alias("shard"), F.col("chunk").alias("batch"), F.col("shard").alias("inner"), "logp")
        told = sent.groupBy("shard", "batch").cogroup(told.groupBy("shard", "batch")).applyInArrow(scatter, "chunk long, shard long, logp binary")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(add, ", ".join([f"doc_id {kinds['doc_id']}", "n_bytes long", "perplexity double", *(f"{c} {kinds[c]}" for c in keep)]))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.97, step: float = 0.001, least: int = 50, **options) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and keep of every row of ``docs`` (doc_id, text, lang).

    Trusted text is what ``labels`` (doc_id, quality) marks 1. A fifth of it (crc32 of the doc_id as text leaves 0 modulo
    5) isn't trained on: the threshold of a language is the ``quantile`` of log-perplexity, in steps of ``step``, over these
    documents, drawn towards that over all languages as if ``least`` more documents had it. Documents above the threshold
    are not kept.
    0.97 has the least sum of low-quality documents kept and trusted ones rejected at sf0.1.
    Empty texts have no perplexity and are not kept; without any trusted text all others are. A null lang is a language.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = durable(perplexities(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), good.where(~aside), keep=("lang",), **options))
    told = scored.join(good.where(aside), "doc_id", "left_semi").where("perplexity is not null")
    bins = told.groupBy("lang", F.ceil(F.log("perplexity") / step).alias("bin")).agg(F.count("*").alias("n"))

    def cut(by: list[str]) -> DataFrame:
        counted = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*by, F.lit(0))  # bins: a few thousand a language
        counted = counted.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        return counted.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(*by).agg(F.min("bin").alias("bin"), F.max("all").alias("all"))

    overall = cut([]).first()["bin"]  # one row; null without any held-out document
    drawn = (F.col("bin") * F.col("all") + (overall or 0) * least) / (F.col("all") + least)
    own = cut(["lang"]).select(F.col("lang").alias("_lang"), F.exp(drawn * step).alias("own"))
    joined = scored.join(own, scored["lang"].eqNullSafe(own["_lang"]), "left")
    threshold = F.coalesce("own", F.lit(None if overall is None else math.exp(overall * step)).cast("double"))
    keep = F.coalesce(F.col("perplexity") <= threshold, F.col("perplexity").isNotNull())
    return joined.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
