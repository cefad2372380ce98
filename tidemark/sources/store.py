"""Message tables: validation, appends, tombstones, compaction, and the mapping of the bundled tables."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import BadRequest, Closed, Immutable, InvalidTtl, Locked, PayloadEmpty, PayloadTooLarge, TopicEmpty, TopicTooLarge
from ..functions.durations import parse_duration, seconds_of
from ..functions.topics import levels_of, normal, option, topic_of
from ..operators.reads import DEFAULT_LIMIT, MASTER_CONTRACT, MAX_LIMIT, Query, get, not_deleted

MAX_TOPIC, MAX_PAYLOAD = 65_536, 1 << 30


@dataclass(frozen=True)
class Options:
    """Settings of a store: deletes allowed, payloads encrypted by default, limits of reads, and what reads do with files that
    can't be read (fail, or leave them out)."""

    mutable: bool = False
    encryption: bool = False
    default_query_limit: int = DEFAULT_LIMIT
    max_query_limit: int = MAX_LIMIT
    contract: int = MASTER_CONTRACT
    skip_corrupt: bool = False


@dataclass(frozen=True)
class Entry:
    """A message to put; each ``with_`` method gives a changed copy."""

    topic: str
    payload: str | bytes
    ord: int = 0
    contract: int = MASTER_CONTRACT
    expires_at: datetime | None = None

    def with_payload(self, payload: str | bytes) -> Entry:
        return replace(self, payload=payload)

    def with_contract(self, contract: int) -> Entry:
        return replace(self, contract=contract)

    def with_ttl(self, ttl: str, now: datetime) -> Entry:
        try:
            return replace(self, expires_at=now + timedelta(microseconds=parse_duration(ttl) / 1000))
        except ValueError as e:
            raise InvalidTtl(str(e)) from e


def entries(spark: SparkSession, rows: list[Entry]) -> DataFrame:
    """Entries as rows for ``Store.put``, in the order of the list."""
    data = [(r.ord or i, r.topic, r.payload.encode() if isinstance(r.payload, str) else r.payload, r.contract, r.expires_at) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord long, topic string, payload binary, contract long, expires_at timestamp_ntz")


def events_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as messages; every third event expires after as many hours as its value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ttl = F.make_dt_interval(hours=F.floor("value").cast("int"))
    return e.select(
        (F.col("user_id") % 4).alias("contract"), (F.col("event_id") + 1).alias("seq"), F.concat(F.lit("app.u"), F.col("user_id").cast("string"), F.lit("."), F.col("event_type")).alias("topic"),
        F.col("props").alias("payload"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + ttl).alias("expires_at"), "value", "event_type", "user_id",
    )


def conversations_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a log of puts: key conv_id, time_id turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("turn").alias("time_id"), F.col("conv_id").alias("key"), F.lit("put").alias("op"), F.lit(None).cast("bigint").alias("ref_time_id"), F.col("text").alias("value"))


def ttl_fails(raw: Column) -> Column:
    ttl = option(raw, "ttl")
    return ttl.isNotNull() & seconds_of(ttl).isNull()


def parsed(rows: DataFrame, now: datetime) -> DataFrame:
    """Incoming rows (topic with options, payload, expires_at or none) with normalised topic, levels, depth and expiry.

    A row's own expiry goes before the ttl option (a duration or seconds). A ttl that doesn't parse is an error.
    """
    ttl = option(F.col("topic"), "ttl")
    seconds = seconds_of(ttl)
    until = F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    own = F.col("expires_at") if "expires_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
    t = topic_of(F.col("topic"))
    wrong = F.raise_error(F.concat(F.lit("not a ttl: "), ttl)).cast("timestamp_ntz")
    return rows.withColumns({"expires_at": F.when(ttl_fails(F.col("topic")), wrong).otherwise(F.coalesce(own, until)), "levels": levels_of(t), "topic": normal(t)}).withColumn("depth", F.size("levels"))


def valid(rows: DataFrame) -> Column:
    return F.col("topic").isNotNull() & (F.col("topic") != "") & (F.octet_length("topic") <= MAX_TOPIC) & F.col("payload").isNotNull() & (F.octet_length("payload") > 0) & (F.octet_length("payload") <= MAX_PAYLOAD)


def sync_totals(rows: DataFrame) -> DataFrame:
    """What a commit of ``rows`` takes in, by contract: messages, bytes, invalid rows and the highest seq of valid ones."""
    ok = F.coalesce(valid(rows), F.lit(False))
    return rows.groupBy("contract").agg(F.count_if(ok).alias("messages"), F.sum(F.when(ok, F.octet_length("payload"))).alias("bytes"), F.count_if(~ok).alias("invalid"), F.max(F.when(ok, F.col("seq"))).alias("upper_seq"))


def sealed(payload: Column, key: bytes) -> Column:
    return F.aes_encrypt(payload.cast("binary"), F.lit(key), F.lit("GCM"))


def opened(payload: Column, key: bytes) -> Column:
    """Null where the key is another one."""
    return F.try_aes_decrypt(payload, F.lit(key), F.lit("GCM"))


def numbered(rows: DataFrame, after: int, order: str, staging: str) -> DataFrame:
    """seq from ``after`` + 1 without gaps, in the order of a column: range partitions are written to ``staging`` (a shared
    folder), counted, and read back, so that counts and numbers are of the same rows whatever is lost; no global window."""
    spark = rows.sparkSession
    rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()).write.parquet(staging)
    ranged = spark.read.parquet(staging)
    begin = after
    starts = []
    for r in ranged.groupBy("_p").count().orderBy("_p").collect():  # one row a partition
        starts.append((r["_p"], begin))
        begin += r["count"]
    start = spark.createDataFrame(starts, "_p int, _start long")
    inner = F.row_number().over(W.partitionBy("_p").orderBy(order))
    return ranged.join(F.broadcast(start), "_p").withColumn("seq", F.col("_start") + inner).drop("_p", "_start")


class Batch:
    """Puts and deletes that a store commits together, or not at all."""

    def __init__(self):
        self.puts: list[tuple[DataFrame, int, bool]] = []
        self.deletes: list[DataFrame] = []

    def put(self, rows: DataFrame, contract: int | None = None, encrypted: bool | None = None) -> None:
        self.puts.append((rows, contract, encrypted))

    def delete(self, tombstones: DataFrame) -> None:
        self.deletes.append(tombstones)


class Store:
    """A table of messages under a root: puts and tombstones of a commit are one append to its log.

    Writers take numbers after the highest one, so there may be one at a time: ``with store:`` holds the store's lock, a file
    that only one can create.
    """

    def __init__(self, spark: SparkSession, root: str, mutable: bool = False, key: bytes | None = None, options: Options | None = None):
        self.spark, self.root, self.key, self.closed, self.owner = spark, root, key, False, False
        self.options = options or Options(mutable=mutable)

    def __enter__(self) -> Store:
        self._open()
        fs, path = self._fs("_LOCK")
        try:
            fs.create(path, False).close()
        except Exception as e:
            if fs.exists(path):
                raise Locked(f"another writer holds {self.root}") from e
            raise
        self.owner = True
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Give up the lock; reads and writes fail from here on."""
        if self.owner:
            fs, path = self._fs("_LOCK")
            fs.delete(path, False)
        self.owner, self.closed = False, True

    def _open(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def new_contract(self) -> int:
        return random.getrandbits(32)

    def put(self, rows: DataFrame, now: datetime, contract: int | None = None, encrypted: bool | None = None) -> None:
        """Append rows (topic, payload, ord; contract and expires_at if they differ): all of them or, if one is invalid, none."""
        self.batch(lambda b: b.put(rows, contract, encrypted), now)

    def delete(self, tombstones: DataFrame, now: datetime | None = None) -> None:
        """Append tombstones (contract, seq)."""
        self.batch(lambda b: b.delete(tombstones), now or datetime.now())

    def batch(self, work: Callable[[Batch], None], now: datetime) -> None:
        """Commit what ``work`` puts and deletes as one append; an error in it, or an invalid row, leaves the store as it was."""
        self._open()
        batch = Batch()
        work(batch)
        if batch.deletes and not self.options.mutable:
            raise Immutable("the store is immutable")
        rows = None
        for order, (part, contract, encrypted) in enumerate(batch.puts):
            part = self._prepared(part, now, contract, encrypted).withColumn("_order", F.struct(F.lit(order).alias("part"), F.col("ord").alias("ord")))
            rows = part if rows is None else rows.unionByName(part)
        staging, columns = f"{self.root}/_staging-{uuid.uuid4().hex}", ["contract", "seq", "topic", "levels", "depth", "payload", "created_at", "expires_at", "encrypted"]
        log = None
        if rows is not None:
            log = numbered(rows.drop("ord"), self.last_seq(), "_order", staging).withColumn("created_at", F.lit(now).cast("timestamp_ntz")).select(F.lit("put").alias("kind"), *columns)
        for gone in batch.deletes:
            gone = gone.select(F.lit("del").alias("kind"), F.col("contract").cast("long").alias("contract"), F.col("seq").cast("long").alias("seq"))
            log = gone if log is None else log.unionByName(gone, allowMissingColumns=True)
        if log is not None:
            log = log.sortWithinPartitions("kind", "contract", "topic", "seq") if rows is not None else log
            log.write.mode("append").option("parquet.bloom.filter.enabled#seq", "true").partitionBy("kind", "contract").parquet(f"{self.root}/log")
        fs, path = self._fs(staging.rpartition("/")[2])
        fs.delete(path, True)

    def _prepared(self, rows: DataFrame, now: datetime, contract: int | None, encrypted: bool | None) -> DataFrame:
        """Parsed and encrypted rows; one pass over them tells what is invalid."""
        topic, size = topic_of(F.col("topic")), F.octet_length("payload")
        faults = {
            InvalidTtl: ttl_fails(F.col("topic")), TopicEmpty: F.coalesce(normal(topic), F.lit("")) == "", TopicTooLarge: F.octet_length(normal(topic)) > MAX_TOPIC,
            PayloadEmpty: F.coalesce(size, F.lit(0)) == 0, PayloadTooLarge: size > MAX_PAYLOAD,
        }
        found = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(e.__name__) for e, c in faults.items())).first()
        for error in faults:
            if found[error.__name__]:
                raise error(f"{found[error.__name__]} rows: {error.__doc__}")
        encrypted = self.options.encryption if encrypted is None else encrypted
        if encrypted and self.key is None:
            raise BadRequest("no key")
        rows = parsed(rows, now)
        payload = F.col("payload").cast("binary")
        own = F.col("contract").cast("long") if "contract" in rows.columns and contract is None else F.lit(self.options.contract if contract is None else contract).cast("long")
        return rows.select("ord", own.alias("contract"), "topic", "levels", "depth", (sealed(payload, self.key) if encrypted else payload).alias("payload"), "expires_at", F.lit(encrypted).alias("encrypted"))

    def read(self) -> DataFrame:
        """Rows that are not deleted; payloads are decrypted if there is a key."""
        rows = self._log()
        if rows is None:
            raise BadRequest("the store is empty")
        gone = rows.where("kind = 'del'").select("contract", "seq")
        rows = rows.where("kind = 'put'").drop("kind")
        if self.key is not None:
            rows = rows.withColumn("payload", F.when(F.col("encrypted"), opened(F.col("payload"), self.key)).otherwise(F.col("payload")))
        return not_deleted(rows, gone)

    def get(self, query: Query, now: datetime) -> DataFrame:
        """``reads.get`` under the store's limits."""
        _, _, limit = query.resolve(now, self.options.default_query_limit, self.options.max_query_limit)
        return get(self.read(), query, now).limit(limit)

    def _log(self) -> DataFrame | None:
        self._open()
        fs, path = self._fs("log")
        if not fs.exists(path):
            return None
        reader = self.spark.read.schema(LOG)
        return (reader.option("ignoreCorruptFiles", "true") if self.options.skip_corrupt else reader).parquet(f"{self.root}/log")

    def last_seq(self) -> int:
        rows = self._log()
        return 0 if rows is None else rows.where("kind = 'put'").agg(F.max("seq")).first()[0] or 0

    def compact(self, to: str, now: datetime) -> None:
        """Write what is neither deleted nor expired to a new root; payloads stay encrypted."""
        rows = Store(self.spark, self.root, options=self.options).read()
        rows = rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))).withColumn("kind", F.lit("put"))
        rows.repartition("contract", "topic").sortWithinPartitions("topic", "seq").write.partitionBy("kind", "contract").parquet(f"{to}/log")

    def expire(self, now: datetime) -> int:
        """Append tombstones for what has expired; how many."""
        gone = self.read().where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")).select("contract", "seq")
        number = gone.count()
        if number:
            log = gone.withColumn("kind", F.lit("del"))
            log.write.mode("append").partitionBy("kind", "contract").parquet(f"{self.root}/log")
        return number

    def count(self) -> int:
        return self.read().count()

    def file_size(self) -> int:
        """Bytes of the log's files."""
        fs, path = self._fs("log")
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


LOG = "seq long, topic string, levels array<string>, depth int, payload binary, created_at timestamp_ntz, expires_at timestamp_ntz, encrypted boolean, kind string, contract long"
