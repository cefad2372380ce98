"""What several operators share: chunked execution, word hashing, rolling window hashes, checkpoints."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the ASCII controls 9 to 13; bytes.split() cuts at the same bytes.
NOT_WORD = r"[\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max
_MASK = 0xFFFFFFFFFFFFFFFF


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only in local mode and where the session names none."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if where is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def count_words(text: Column) -> Column:
    """Number of words of a text (null: 0), in the JVM."""
    parts = F.split(text, NOT_WORD, -1)
    inner = F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(inner).cast("long")


def in_chunks(docs: DataFrame, columns: list[str], chunk_chars: int, least: int = 32) -> DataFrame:
    """``columns`` (doc_id and text among them) and ``chunk``, a stable number that deals rows into chunks.

    Chunks hold about ``chunk_chars`` characters, whatever the size of the table, so a task that handles one chunk
    needs bounded memory. The number depends on the row alone: lost tasks rebuild the same chunks.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(least, -(-int(chars) // chunk_chars))
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"), *columns)


def in_chunks_by_id(docs: DataFrame, columns: list[str], others: DataFrame, chunk_chars: int, least: int = 32) -> tuple[DataFrame, DataFrame]:
    """As in_chunks, by doc_id alone, so that the rows of ``others`` (doc_id, ...) meet theirs; rows without doc_id are dealt by their text."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = F.lit(max(least, -(-int(chars) // chunk_chars)))
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return docs.select(F.pmod(F.xxhash64(own), n).alias("chunk"), *columns), others.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), n).alias("chunk"), *others.columns)


class WordHashes(dict):
    """Word bytes -> 64-bit hash; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of all runs of ``width`` consecutive items."""

    def __init__(self, factor: int):
        self.factor, self.inverse = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, items: np.ndarray, width: int) -> np.ndarray:
        n = len(items)
        if n < width:
            return np.empty(0, np.uint64)
        if len(self.up) < n:
            for name, f in (("up", self.factor), ("down", self.inverse)):
                powers = np.full(1 << n.bit_length(), f, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(items * self.up[:n], out=total[1:])
        return mixed((total[width:] - total[:-width]) * self.down[: n - width + 1])


FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def texts_of(table: pa.Table | pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in table.column(name).cast(pa.binary()).to_pylist()]


def ids_of(table: pa.Table | pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """An integer column, null as the largest number."""
    import pyarrow.compute as pc

    return pc.fill_null(table.column(name).cast(pa.int64()), int(NO_ID)).to_numpy(**({} if isinstance(table, pa.Table) else {"zero_copy_only": False}))


def ordered(table: pa.Table) -> tuple[list[int], np.ndarray, list[bytes]]:
    """An order of a chunk's rows that depends on nothing but doc_id and text, and these two in it."""
    ids, texts = ids_of(table), texts_of(table)
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return order, ids[order], [texts[i] for i in order]


def back(ids: np.ndarray) -> pa.Array:
    """The column that ids_of read."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (u, v): one row (node, root) for each node with an edge; root is
    the smallest node it reaches.

    Alternating large-star and small-star rounds, each cut by a reliable checkpoint, until no edge changes: the number
    of rounds grows with the logarithm of the nodes. Minima are aggregated before the shuffle; a hub's edges are joined
    with one row, which AQE splits.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, was = durable(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        star = e.join(low, "u")
        e = durable(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, smallest node it reaches through them), for nodes that are not the smallest."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        was = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == was).all():
            break
    more = low != np.arange(len(nodes))
    return nodes[more], nodes[low[more]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
