"""Publish and subscribe as joins: fan-out, delivery decisions, batches, flow control, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.topics import WRITE, access_mask, is_wildcard, levels_of, normal
from .match import match


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row for each message and matching subscription (contract, pattern, conn_id, sub_id, delivery_mode, delay_ms)."""
    return match(messages, subscriptions)


def to_live(deliveries: DataFrame, connections: DataFrame) -> DataFrame:
    return deliveries.join(connections.select("conn_id"), "conn_id", "left_semi")


def delivery(publish_mode: Column, delivery_mode: Column, delay_ms: Column) -> Column:
    """NOTIFY if both sides ask for a handshake (modes 1 and 2), BATCH for batched or delayed subscriptions, else DIRECT."""
    return F.when(publish_mode.isin(1, 2) & delivery_mode.isin(1, 2), "NOTIFY").when((delivery_mode == 2) | (delay_ms > 0), "BATCH").otherwise("DIRECT")


def batches(deliveries: DataFrame, batch_ms: int = 1000) -> DataFrame:
    """Tumbling batches: (created_at + batch + delay) cut to the batch duration; conn_id, bucket_ms, messages, first and last seq."""
    ms = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 1000) + batch_ms + F.col("delay_ms")
    return deliveries.groupBy("conn_id", (ms - F.pmod(ms, F.lit(batch_ms))).alias("bucket_ms")).agg(F.count("*").alias("messages"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def flow_state(control: DataFrame) -> DataFrame:
    """The latest control of each (session_id, message_id) by ord."""
    return control.groupBy("session_id", "message_id").agg(F.max_by("control", "ord").alias("control"))


def pending(control: DataFrame) -> DataFrame:
    """What a resumed session still owes: messages that are not complete."""
    return flow_state(control).where("control <> 'COMPLETE'")


def subscribed(changes: DataFrame) -> DataFrame:
    """Subscriptions with a positive count of (conn_id, pattern, change +1 or -1)."""
    return changes.groupBy("conn_id", "pattern").agg(F.sum("change").alias("refs")).where("refs > 0")


def allowed(requests: DataFrame, flag: int) -> DataFrame:
    """Requests whose mask has the flag."""
    return requests.where(F.col("mask").bitwiseAND(flag) == flag)


def generate_keys(requests: DataFrame, secret: str) -> DataFrame:
    """Keys (contract, key, target, mask) for requests (contract, topic, access such as rw): the key names contract, target and
    mask under the secret. A topic of more than 23 levels gets none; an access string without o, a, r or w has mask 0."""
    rows = requests.where(F.size(levels_of(F.col("topic"))) <= 23).select("contract", normal(F.col("topic")).alias("target"), access_mask(F.col("access")).alias("mask"))
    text = F.concat_ws("\u0000", F.lit(secret), "contract", "target", "mask")
    return rows.select("contract", F.substring(F.sha2(text, 256), 1, 26).alias("key"), "target", "mask")


def authorised(requests: DataFrame, keys: DataFrame, flag: int, publish: bool = False) -> DataFrame:
    """Requests (contract, key, topic) whose key (contract, key, target, mask) has the flag and is for the topic or, with target
    ``...``, for all; wildcard tells that the target is a pattern. With ``publish`` such keys are forbidden."""
    held = keys.where(F.col("mask").bitwiseAND(flag) == flag).select("contract", "key", "target")
    found = requests.join(held, ["contract", "key"]).where((F.col("target") == F.col("topic")) | (F.col("target") == "..."))
    found = found.withColumn("wildcard", is_wildcard(F.col("target"))).drop("target")
    return found.where(~F.col("wildcard")) if publish else found


def acknowledged(requests: DataFrame, keys: DataFrame, well_formed: Column) -> DataFrame:
    """requests to publish (contract, key, topic) with the answer in ``reply``: BAD_REQUEST where ``well_formed`` is not true,
    FORBIDDEN where no static key of the contract may write to the topic, else ACKNOWLEDGE. One row a request."""
    held = keys.where((F.col("mask").bitwiseAND(WRITE) == WRITE) & ~is_wildcard(F.col("target")))
    held = held.select("contract", "key", F.col("target").alias("topic")).distinct().withColumn("_held", F.lit(True))
    reply = F.when(~F.coalesce(well_formed, F.lit(False)), "BAD_REQUEST").when(F.col("_held").isNull(), "FORBIDDEN").otherwise("ACKNOWLEDGE")
    return requests.join(held, ["contract", "key", "topic"], "left").withColumn("reply", reply).drop("_held")


def log_key(session_id: Column, message_id: Column) -> Column:
    """The message's number in the upper half, the session's in the lower."""
    return F.shiftleft(message_id.cast("long"), 32) + session_id.cast("long")


def session_log(packets: DataFrame) -> DataFrame:
    """What sessions keep for a resume: key, session_id, message_id and kind of packets (session_id, message_id, ord, way, kind).

    A PUBLISH on the way out and a RECEIPT on the way in are kept until a COMPLETE goes out; the last by ord counts.
    """
    kept = ((F.col("way") == "out") & F.col("kind").isin("PUBLISH", "COMPLETE")) | ((F.col("way") == "in") & (F.col("kind") == "RECEIPT"))
    last = packets.where(kept).groupBy("session_id", "message_id").agg(F.max_by("kind", "ord").alias("kind")).where("kind <> 'COMPLETE'")
    return last.select(log_key(F.col("session_id"), F.col("message_id")).alias("key"), "session_id", "message_id", "kind")


def of_session(key: Column, session_id: Column) -> Column:
    return key.bitwiseAND(0xFFFFFFFF) == session_id


def resumed(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """What sessions (session_id) are notified of again when they resume: their kept PUBLISH packets."""
    return log.where("kind = 'PUBLISH'").join(sessions.select("session_id"), of_session(log["key"], sessions["session_id"]), "left_semi")


def reset(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """The log without what these sessions keep."""
    return log.join(sessions.select("session_id"), of_session(log["key"], sessions["session_id"]), "left_anti")


def connected(log: DataFrame, connects: DataFrame) -> DataFrame:
    """The log after sessions connect (session_id, ord, clean): what a session kept goes if its last connect is clean; notify
    tells what a session that resumes is notified of again."""
    last = connects.groupBy("session_id").agg(F.max_by("clean", "ord").alias("_clean"))
    rows = log.join(last, "session_id", "left").where("_clean is null or not _clean")
    return rows.withColumn("notify", F.col("_clean").isNotNull() & (F.col("kind") == "PUBLISH")).drop("_clean")


def server_varz(connections: DataFrame, subscriptions: DataFrame, messages: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row: connections, subscriptions, in_msgs, in_bytes, out_msgs and out_bytes."""

    def traffic(rows: DataFrame, way: str) -> DataFrame:
        return rows.agg(F.count("*").alias(f"{way}_msgs"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias(f"{way}_bytes"))

    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    return count(connections, "connections").crossJoin(count(subscriptions, "subscriptions")).crossJoin(traffic(messages, "in")).crossJoin(traffic(deliveries, "out"))  # one row each


def message_ids(deliveries: DataFrame, span: int = 65_536) -> DataFrame:
    """message_id: 1, 2, ... for each conn_id by seq and sub_id.

    Counts of spans of seq are added up, so that no task sorts a whole connection.
    """
    spans = deliveries.withColumn("_s", F.floor(F.col("seq") / span))
    counts = spans.groupBy("conn_id", "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("conn_id").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(W.partitionBy("conn_id", "_s").orderBy("seq", "sub_id"))
    placed = spans.withColumn("_i", inner).join(counts.withColumn("_b", before).drop("_n"), ["conn_id", "_s"])
    return placed.withColumn("message_id", F.col("_b") + F.col("_i")).drop("_s", "_i", "_b")


def once(rows: DataFrame) -> DataFrame:
    """One row for each (contract, seq)."""
    return rows.dropDuplicates(["contract", "seq"])
