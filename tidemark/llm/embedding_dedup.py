"""Near-duplicate embeddings by an inverted multi-index.

Codebooks of ``k`` centroids each are trained on the two halves of unit vectors (on a bounded sample); their product is a
grid of k * k cells, and every vector is stored in one. A query visits cells in the order of the sum of its halves'
squared distances (the multi-sequence order) and stops after the number of cells that reaches the target recall; that
number is measured on true neighbours in the sample and on sample vectors turned by as much as the threshold allows.
Queries and stored vectors meet in blocks of bounded size, where cosines are computed in double precision. The cells of
a grid row (near centroids of the first half have near numbers) meet together, so a query is sent there once and not once
a cell.

Equal vectors are collapsed first. A block returns counts, and of its links only a spanning forest, so its output has no
more rows than its input. Vectors of different lengths never meet: each length has an index of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, forest


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids, in the order of their projection on the direction in which they vary most."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    main = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0] if c.size else np.zeros(c.shape[1])
    return c[np.argsort(c @ main, kind="stable")]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def multi_sequence(a: np.ndarray, b: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the first ``visits`` cells (i, j) by a[i] + b[j]; of equal sums the one nearer in the first half.

    All cells nearer in both halves come before a cell, so the n-th visited has (place in a) * (place in b) <= n: these
    about n log n cells are all that the traversal can reach in n steps, and they are sorted for many rows at once.
    """
    k = a.shape[1]
    visits, first = min(visits, k * k), min(k, visits)
    i, j = np.argsort(a, axis=1, kind="stable")[:, :first], np.argsort(b, axis=1, kind="stable")[:, :first]
    p, q = np.nonzero(np.arange(1, first + 1)[:, None] * np.arange(1, first + 1)[None, :] <= visits)
    sums = np.take_along_axis(a, i, 1)[:, p] + np.take_along_axis(b, j, 1)[:, q]
    best = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(i[:, p], best, 1), np.take_along_axis(j[:, q], best, 1)


class MultiIndex:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, target: float, per_cell: int = 32, rounds: int = 12, max_k: int = 1024):
        rng = np.random.default_rng(7)
        self.half = max(1, sample.shape[1] // 2)
        self.k = max(1, min(len(sample), max_k, round(math.sqrt(rows / per_cell)))) if sample.shape[1] > 1 else 1
        self.visits = 1
        self.books = [kmeans(x, self.k, rounds, rng) for x in (sample[:, : self.half], sample[:, self.half :])] if self.k > 1 else []
        if self.k > 1:
            self.visits = self.calibrated(sample, threshold, target, rng)

    def calibrated(self, sample: np.ndarray, threshold: float, target: float, rng: np.random.Generator, ask: int = 1000, each: int = 50) -> int:
        """Cells to visit so that the share ``target`` of pairs is found, of true ones and of turned ones alike.

        ``ask`` vectors of the sample ask; of each one's true neighbours, ``each`` drawn evenly stand for all of them by
        weight. Turned ones are one neighbour each in a random direction, at a cosine from the threshold to 1.
        """
        asked = sample[rng.choice(len(sample), min(len(sample), ask), replace=False)]
        side = rng.standard_normal(asked.shape)
        side -= (side * asked).sum(axis=1, keepdims=True) * asked
        cosine = rng.uniform(threshold, 1, (len(asked), 1))
        turned = cosine * asked + np.sqrt(1 - cosine**2) * side / np.maximum(np.sqrt((side * side).sum(axis=1, keepdims=True)), 1e-300)
        q, near, weight = [], [], []
        for x in asked:
            found = np.flatnonzero(sample @ x >= threshold)
            some = rng.permutation(found)[:each]
            q.append(np.repeat(x[None, :], len(some), axis=0))
            near.append(sample[some])
            weight.append(np.full(len(some), len(found) / max(1, len(some))))
        return max(self.needed(asked, turned, np.ones(len(asked)), target), self.needed(np.concatenate(q), np.concatenate(near), np.concatenate(weight), target))

    def needed(self, q: np.ndarray, near: np.ndarray, weight: np.ndarray, target: float) -> int:
        ranks = np.minimum(self.rank(q, self.cells(near)), self.rank(near, self.cells(q)))  # a pair is found if either visits the other
        order = np.argsort(ranks, kind="stable")
        at = np.searchsorted(np.cumsum(weight[order]), target * weight.sum())
        return int(min(self.k**2, max(2, ranks[order[min(at, len(order) - 1)]] + 1))) if len(order) else 2

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        if self.k == 1:
            return np.zeros(len(x), np.int64)
        a, b = self.halves(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of a cell in the order in which each vector visits cells: how many have a smaller sum."""
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), 1000):
            a, b = self.halves(x[i : i + 1000])
            b_sorted = np.sort(b, axis=1)
            for r, c in enumerate(cells[i : i + 1000]):
                own = a[r, c // self.k] + b[r, c % self.k]
                out[i + r] = np.searchsorted(b_sorted[r], own - a[r] - 1e-12).sum()
        return out

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The first cells in multi-sequence order (rows x visits)."""
        if self.k == 1:
            return np.zeros((len(x), 1), np.int64)
        i, j = multi_sequence(*self.halves(x), self.visits)
        return i * self.k + j


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, target: float = 0.998, sample_rows: int = 20_000, block: int = 2048, per_cell: int = 32, max_k: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Vectors of one length are linked if their cosine, in double precision, is ``threshold`` or more; each pair found is
    verified. n_links counts the other vectors linked directly (copies and repeated rows too); component_id is the smallest
    vec_id reachable by links; kept says vec_id = component_id, so repeated rows are kept alike. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, as do rows without vec_id; an empty table gives no
    rows. The codebooks of a length are fitted on ``sample_rows`` vectors at most; every vector is indexed and asks.
    ``target`` is the share of pairs at or above the threshold to be found. A length of at most ``block`` distinct vectors has
    one cell. Beyond ``max_k`` centroids a half, cells grow; a full cell is cut into blocks, so nothing is lost.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind, number = ("float", np.float32) if kind == "float" else ("double", np.float64)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("x"))
    good = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))
    reps = durable(plain.where(good).groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).withColumn("length", F.size("x")))
    indexes = {}
    for r in reps.groupBy("length").count().orderBy("length").collect():  # one row a length
        if r["count"] > block:
            sample = reps.where(F.col("length") == r["length"]).orderBy(F.xxhash64("id")).limit(sample_rows).select("x").toArrow()  # bounded
            flat = sample.column("x").combine_chunks().flatten().to_numpy()
            indexes[r["length"]] = MultiIndex(unit(flat.reshape(-1, r["length"])), r["count"], threshold, target, per_cell, max_k=max_k)
        else:
            indexes[r["length"]] = MultiIndex(np.zeros((1, 1)), 1, threshold, target)
    if not indexes:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shipped = vectors.sparkSession.sparkContext.broadcast(indexes)  # 2 k centroids of half a vector for each length

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            for n in np.unique(lengths):
                index, mine = shipped.value[int(n)], np.flatnonzero(lengths == n)
                for i in range(0, len(mine), 1000):
                    part = batch.take(pa.array(mine[i : i + 1000]))
                    raw = part.column(2).flatten().to_numpy().astype(number).reshape(-1, n)
                    x = unit(raw)
                    cells, visits = index.cells(x), index.visited(x).astype(np.int64)
                    yield pa.record_batch([
                        part.column(0), part.column(1), part.column(3), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(cells // index.k), pa.array(cells % index.k),
                        pa.array(list(visits // index.k), pa.list_(pa.int64())), pa.array(list(visits % index.k), pa.list_(pa.int64())),
                    ], ["id", "w", "length", "x", "row", "column", "rows", "columns"])

    dealt = durable(reps.select("id", "w", "x", "length").mapInArrow(deal, 'id long, w long, length int, x binary, row long, column long, rows array<long>, columns array<long>'))
    visits = F.struct(F.col("rows"), F.col("columns"))
    asks = dealt.select("id", "w", "length", "x", "row", "column", visits.alias("v"), F.explode(F.array_distinct("rows")).alias("to"))
    held = dealt.groupBy("length", F.col("row").alias("to")).agg(F.count("*").alias("held"))
    asked = asks.groupBy("length", "to").agg(F.count("*").alias("asked"))
    parts = held.join(asked, ["length", "to"]).select("length", "to", F.ceil(F.col("held") / block).cast("int").alias("s"), F.ceil(F.col("asked") / (2 * block)).cast("int").alias("q"))
    share = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    stored = dealt.withColumn("to", F.col("row")).join(parts, ["length", "to"])
    stored = stored.select("length", "to", share("s").alias("si"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qi"), F.lit(True).alias("stored"), "id", "w", "x", "row", "column", visits.alias("v"))
    asking = asks.join(parts, ["length", "to"])
    asking = asking.select("length", "to", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("si"), share("q").alias("qi"), F.lit(False).alias("stored"), "id", "w", "x", "row", "column", "v")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        length, to, k = key[0].as_py(), key[1].as_py(), shipped.value[key[0].as_py()].k
        ids, w, row, column, is_stored = (table.column(c).to_numpy() for c in ("id", "w", "row", "column", "stored"))
        x = unit(np.frombuffer(b"".join(table.column("x").to_pylist()), number).reshape(-1, length))
        rows, columns = (matrix(table.column("v").combine_chunks().field(c)) for c in ("rows", "columns"))
        counts, us, vs = np.zeros(len(ids), np.int64), [], []
        q = np.flatnonzero(~is_stored)
        at, of = np.nonzero(rows[q] == to)  # which query visits which column of this grid row
        at, of = q[at], columns[q[at], of]
        cells = row * k + column
        for c in np.unique(column[is_stored]):
            s, asks = np.flatnonzero(is_stored & (column == c)), at[of == c]
            for i in range(0, len(asks), 512):
                a, b = np.nonzero(x[asks[i : i + 512]] @ x[s].T >= threshold)
                a, b = asks[i : i + 512][a], s[b]
                other = ids[a] != ids[b]
                a, b = a[other], b[other]
                np.add.at(counts, a, w[b])
                one_way = ~(rows[b] * k + columns[b] == cells[a][:, None]).any(axis=1)  # the stored vector won't find this pair itself
                np.add.at(counts, b[one_way], w[a[one_way]])
                u, v = forest(ids[a], ids[b])
                us.append(u)
                vs.append(v)
        u, v = np.concatenate(us) if us else np.empty(0, np.int64), np.concatenate(vs) if vs else np.empty(0, np.int64)
        some = np.flatnonzero(counts)
        return pa.table({"u": pa.array(np.concatenate((ids[some], u))), "v": pa.array(np.concatenate((ids[some], v))), "n": pa.array(np.concatenate((counts[some], np.zeros(len(u), np.int64))))})

    met = durable(stored.unionByName(asking).groupBy("length", "to", "si", "qi").applyInArrow(meet, "u long, v long, n long"))
    links = met.where("n > 0").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(met.where("n = 0").select("u", "v")).withColumnRenamed("node", "id")
    named = reps.join(links, "id", "left").join(roots, "id", "left").select("x", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = plain.where(good).join(named, "x").select("vec_id", "n_links", "component_id")
    lone = plain.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
