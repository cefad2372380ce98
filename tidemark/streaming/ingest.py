"""Structured Streaming: ingestion, fan-out against static subscriptions, tumbling and triggered batches, flow control."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.pubsub import fan_out


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder; the number of files a trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_stream(stream: DataFrame, root: str, checkpoint: str, interval: str | None = None):
    """Append to a message table; restarts go on from the checkpoint. Without an interval it ends when all input is taken."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_fan_out(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return fan_out(stream, subscriptions)


def tumbling(stream: DataFrame, width: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Messages for each topic and window of event time; created_at is read as UTC and the window's start given back without zone."""
    timed = stream.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark("_at", late)
    out = timed.groupBy(F.window("_at", width).alias("w"), "topic").agg(F.count("*").alias("messages"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "topic", "messages")


def triggered_batches(deliveries: DataFrame, max_messages: int, max_bytes: int, flush_ms: int | None = None) -> DataFrame:
    """Batches of each conn_id that close at ``max_messages`` messages or ``max_bytes`` payload bytes, in the order of seq
    within a trigger, or when nothing came for ``flush_ms``: conn_id, batch, messages, bytes, first_seq, last_seq. A stream with
    ``flush_ms`` waits for the clock, so it never ends by itself, as one that takes what is available now does.

    What is open is kept as state, and the batch's number alone once it is flushed. A trigger's rows of one connection are
    sorted together: their number is what ``read_stream`` takes in a trigger.
    """
    columns = ["conn_id", "batch", "messages", "bytes", "first_seq", "last_seq"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, n, size, first, last = state.get if state.exists else (0, 0, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            out, batch, n, size, first, last = [(key[0], batch, n, size, first, last)] if n else [], batch + (n > 0), 0, 0, 0, 0
        else:
            rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
            seq, upto, at = rows["seq"].to_numpy(), rows["bytes"].to_numpy().cumsum(), 0
            while at < len(seq):
                before = upto[at - 1] if at else 0
                close = min(at + max_messages - n - 1, int(upto.searchsorted(before + max_bytes - size)))  # where the batch closes
                end = min(close, len(seq) - 1)
                first = int(seq[at]) if n == 0 else first
                n, size, last, at = n + end - at + 1, size + int(upto[end] - before), int(seq[end]), end + 1
                if close == end:
                    out.append((key[0], batch, n, size, first, last))
                    batch, n, size, first, last = batch + 1, 0, 0, 0, 0
        state.update((batch, n, size, first, last))
        if n and flush_ms:
            state.setTimeoutDuration(flush_ms)
        yield pd.DataFrame(out, columns=columns)

    rows = deliveries.select("conn_id", "seq", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("bytes"))
    return rows.groupBy("conn_id").applyInPandasWithState(step, "conn_id long, batch long, messages long, bytes long, first_seq long, last_seq long", "batch long, n long, size long, first long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout if flush_ms else GroupStateTimeout.NoTimeout)


NEXT = {None: {"NOTIFY", "PUBLISH"}, "NOTIFY": {"RECEIVE"}, "RECEIVE": {"PUBLISH"}, "PUBLISH": {"RECEIPT", "ACKNOWLEDGE"}, "RECEIPT": {"COMPLETE"}, "ACKNOWLEDGE": set(), "COMPLETE": set()}


def flow_control(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Accepted controls of each (session_id, message_id): the automaton drops repeats and controls out of turn.

    With ``keep_ms`` a message's state goes that long after its last control (repeats of a complete message are known until
    then), and the stream never ends by itself; without it state is kept.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get[0] if state.exists else None, []
        if state.hasTimedOut:
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
            for place, control in zip(rows["ord"].to_list(), rows["control"].to_list(), strict=True):
                if control in NEXT.get(now, set()):
                    now = control
                    out.append((key[0], key[1], place, now))
            if now is not None:
                state.update((now,))
                if keep_ms:
                    state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["session_id", "message_id", "ord", "control"])

    return stream.groupBy("session_id", "message_id").applyInPandasWithState(step, "session_id long, message_id long, ord long, control string", "control string", "append", GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout)


PACKET = "kind string, contract long, session_id long, message_id long, topic string, payload string, corrupt string"


def decoded(raw: DataFrame) -> DataFrame:
    """Packets from lines of JSON (value): kind, contract, session_id, message_id, topic, payload; what can't be read stands in corrupt."""
    return raw.select(F.from_json(F.col("value").cast("string"), PACKET, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("p")).select("p.*")


def encoded(packets: DataFrame) -> DataFrame:
    """Packets as lines of JSON (value)."""
    return packets.select(F.to_json(F.struct(*[c for c in packets.columns if c != "corrupt"])).alias("value"))


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Hand each trigger's rows and its number to ``send``; after a failure the number comes again, so ``send`` can know it."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**trigger).start()
