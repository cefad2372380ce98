"""A versioned key-value view of a log (time_id, key, op, ref_time_id, value; ord if a block holds several entries of a key).

op is put or del; time_id names a block, ord an entry's place in it. A later put in a block replaces the earlier one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "time_id long, key long, op string, ref_time_id long, value string, ord long"


def _ord(log: DataFrame) -> Column:
    return F.coalesce(F.col("ord"), F.lit(0)).cast("long") if "ord" in log.columns else F.lit(0).cast("long")


def versions(log: DataFrame) -> DataFrame:
    """Versions (time_id, key, value) that stand after replay.

    Entries of a block and key are put in the order of the log (time_id, ord; a delete after a put of the same place): the
    version stands if the last one is a put, with its value. A delete names the block it is for by ref_time_id.
    """
    block = F.when(F.col("op") == "del", F.col("ref_time_id")).otherwise(F.col("time_id"))
    place = F.struct(F.col("time_id"), _ord(log), F.col("op") == "del")
    last = log.groupBy(block.alias("block"), "key").agg(F.max_by(F.struct("op", "value"), place).alias("last"))
    return last.where("last.op = 'put'").select(F.col("block").alias("time_id"), "key", "last.value")


def latest(log: DataFrame) -> DataFrame:
    """The newest standing version of each key."""
    return versions(log).groupBy("key").agg(F.max("time_id").alias("time_id"), F.max_by("value", "time_id").alias("value"))


def lookup(log: DataFrame, time_id: int, key: int) -> DataFrame:
    """One version; the filter reaches the scan of both its puts and its deletes."""
    mine = ((F.col("op") == "put") & (F.col("time_id") == time_id)) | ((F.col("op") == "del") & (F.col("ref_time_id") == time_id))
    return versions(log.where(mine & (F.col("key") == key)))


def keys(log: DataFrame) -> DataFrame:
    """Standing keys of each time block."""
    return versions(log).select("time_id", "key")


def blocks(log: DataFrame) -> DataFrame:
    """Time blocks with their keys' number; ascending when ordered by time_id."""
    return keys(log).groupBy("time_id").agg(F.count("*").alias("keys"))


def size(log: DataFrame) -> DataFrame:
    return keys(log).agg(F.count("*").alias("size"))


def put(rows: DataFrame, time_id: int) -> DataFrame:
    """Log entries of ``rows`` (key, value; ord where a key comes more than once) in the block ``time_id``."""
    return rows.select(F.lit(time_id).cast("long").alias("time_id"), F.col("key").cast("long").alias("key"), F.lit("put").alias("op"), F.lit(None).cast("long").alias("ref_time_id"), "value", _ord(rows).alias("ord"))


def delete_newest(log: DataFrame, doomed: DataFrame, time_id: int | None = None) -> DataFrame:
    """Tombstones for the newest version of each key in ``doomed`` (key); older versions show again.

    They are logged in the block ``time_id``, by default in the version's own, after all its entries.
    """
    newest = latest(log).join(doomed.select("key").distinct(), "key", "left_semi")
    if "ord" in log.columns and time_id is None:
        upper = log.groupBy("time_id", "key").agg(F.max(_ord(log)).alias("ord"))
        newest = newest.join(upper, ["time_id", "key"])
    at = F.col("time_id") if time_id is None else F.lit(time_id).cast("long")
    out = [at.alias("time_id"), F.col("key"), F.lit("del").alias("op"), F.col("time_id").alias("ref_time_id"), F.lit(None).cast("string").alias("value")]
    return newest.select(*out, *([(F.col("ord") if time_id is None else F.lit(0)).cast("long").alias("ord")] if "ord" in log.columns else []))


def free(log: DataFrame, time_id: int) -> DataFrame:
    """The log without a time block."""
    return log.where((F.col("time_id") != time_id) & ~F.col("ref_time_id").eqNullSafe(F.lit(time_id)))


def varz(log: DataFrame) -> DataFrame:
    """One row: count (standing versions), puts, dels and blocks of a log."""
    told = log.agg(F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "del").alias("dels"), F.count_distinct("time_id").alias("blocks"))
    return size(log).select(F.col("size").alias("count")).crossJoin(told)  # one row each


class Batch:
    """Puts and deletes that are logged together, in the order given, or not at all."""

    def __init__(self):
        self.steps: list[tuple[str, DataFrame]] = []

    def put(self, rows: DataFrame) -> None:
        self.steps.append(("put", rows))

    def delete(self, doomed: DataFrame) -> None:
        self.steps.append(("del", doomed))


class LogStore:
    """A log as a Parquet folder: each put, delete or batch is one append in a block of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def log(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.root)

    def batch(self, work: Callable[[Batch], None]) -> int:
        """The block's time_id; an error in ``work`` leaves the log as it was. Places of later steps come after earlier ones."""
        batch, before = Batch(), self.log()
        work(batch)
        time_id, new, first = (before.agg(F.max("time_id")).first()[0] or 0) + 1, None, 0
        for kind, rows in batch.steps:
            log = before if new is None else before.unionByName(new)
            part = put(rows, time_id) if kind == "put" else delete_newest(log, rows, time_id)
            part = part.withColumn("ord", F.col("ord") + first)
            first += 1 + int((rows.agg(F.max("ord")).first()[0] or 0) if kind == "put" and "ord" in rows.columns else 0)
            new = part if new is None else new.unionByName(part)
        if new is not None:
            new.write.mode("append").parquet(self.root)
        return time_id

    def put(self, rows: DataFrame) -> int:
        return self.batch(lambda b: b.put(rows))

    def delete(self, doomed: DataFrame) -> int:
        return self.batch(lambda b: b.delete(doomed))
