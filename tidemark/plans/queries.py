"""The query catalogue over the bundled tables, and the same queries in DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.topics import DIGITS, READ, WRITE, access_mask, base32, depth_of, is_multi, is_wildcard, key_and_topic, levels_of, message_id, message_id_parts, normal, option, option_number, topic_of, unbase32
from ..operators import cluster, kv, metrics, pubsub, reads
from ..operators.match import match
from ..sources import store
from ..sources.store import conversations_as_log, events_as_messages
from ..streaming import ingest

NOW = datetime(2024, 1, 31)
PATTERNS = ((0, "..."), (1, "app..."), (2, "app.*.view"), (3, "*.u3.click"), (0, "app.u4.*"), (1, "app.*.*"), (2, "app.u2.purchase"), (3, "app.u3..."), (0, "app"), (1, "x..."), (2, "*"))
SUBSCRIPTIONS = tuple((c, p, 100 + i % 3, i % 3, 500 * (i % 2), i) for i, (c, p) in enumerate(PATTERNS))


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "contract long, pattern string")


def _subscriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBSCRIPTIONS, "contract long, pattern string, conn_id long, delivery_mode int, delay_ms int, sub_id long")


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    return pubsub.fan_out(events_as_messages(spark, d), _subscriptions(spark))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return events_as_messages(spark, d).select(F.col("event_type").alias("metric"), F.col("seq").alias("ord"), F.floor(F.col("value") * 1000).alias("duration_ns"))


def get_last_topk(spark: SparkSession, d: str) -> DataFrame:
    q = reads.Query("app.u1.click?last=360h", contract=1, limit=50)
    return reads.get(events_as_messages(spark, d), q, NOW).select("seq", "payload", "created_at")


def get_contract(spark: SparkSession, d: str) -> DataFrame:
    return events_as_messages(spark, d).where("contract = 1").orderBy(F.desc("seq")).limit(100).select("seq", "topic")


def parse_topics(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    raw = F.concat("topic", F.when(F.col("seq") % 2 == 0, "...").otherwise("..*"), F.lit("?ttl=1h&last="), F.col("seq").cast("string"), F.lit("&ttl=9&bad&x="))
    t = topic_of(raw)
    return e.select("seq", normal(t).alias("topic"), F.size(levels_of(t)).cast("long").alias("levels"), depth_of(t).cast("long").alias("depth"), is_multi(t).alias("multi"), is_wildcard(t).alias("wildcard"), option(raw, "ttl").alias("ttl"), option(raw, "last").alias("last_n"))


def live_at_now(spark: SparkSession, d: str) -> DataFrame:
    return reads.live(events_as_messages(spark, d), NOW).groupBy("topic").agg(F.count("*").alias("messages"))


def not_deleted(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    return reads.not_deleted(e, e.where("(seq - 1) % 17 = 0")).select("contract", "seq")


def match_patterns(spark: SparkSession, d: str) -> DataFrame:
    return match(events_as_messages(spark, d), _patterns(spark)).select("contract", "pattern", "seq")


def topic_latest_k(spark: SparkSession, d: str) -> DataFrame:
    return reads.newest_of_each_topic(events_as_messages(spark, d), 3).select("contract", "topic", "seq", "rank")


def topic_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return reads.topics(events_as_messages(spark, d))


def relay(spark: SparkSession, d: str) -> DataFrame:
    requests = spark.createDataFrame([(1, 0, "app...", 86400), (2, 1, "app.u1.*", 864000), (3, 2, "...", 3600000), (4, 3, "app.u3.click", 3600)], "request_id long, contract long, pattern string, last_seconds long")
    return reads.relay(events_as_messages(spark, d), requests, NOW).select("request_id", "seq", "rank")


def fanout(spark: SparkSession, d: str) -> DataFrame:
    return _deliveries(spark, d).groupBy("sub_id", "conn_id").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq"))


def delivery_plan(spark: SparkSession, d: str) -> DataFrame:
    how = pubsub.delivery((F.col("seq") % 3).cast("int"), F.col("delivery_mode"), F.col("delay_ms"))
    return _deliveries(spark, d).groupBy("sub_id", how.alias("delivery")).agg(F.count("*").alias("messages"))


def batch_windows(spark: SparkSession, d: str) -> DataFrame:
    return pubsub.batches(_deliveries(spark, d), 3_600_000)


def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return kv.latest(conversations_as_log(spark, d))


def kv_lookup(spark: SparkSession, d: str) -> DataFrame:
    return kv.lookup(conversations_as_log(spark, d), 1, 3)


def kv_keys(spark: SparkSession, d: str) -> DataFrame:
    return kv.blocks(conversations_as_log(spark, d))


def kv_size(spark: SparkSession, d: str) -> DataFrame:
    return kv.size(kv.free(conversations_as_log(spark, d), 0))


def kv_delete_replay(spark: SparkSession, d: str) -> DataFrame:
    log = conversations_as_log(spark, d)
    return kv.latest(log.unionByName(kv.delete_newest(log, log.where("key % 2 = 0"))))


def sample_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.statistics(_samples(spark, d))


def bounded_sample(spark: SparkSession, d: str) -> DataFrame:
    return metrics.statistics(metrics.bounded(_samples(spark, d))).select("metric", "n", "avg", "p50", "p95", "min", "max")


def counters(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    return metrics.counters(e.select(F.col("event_type").alias("metric"), F.when(F.col("seq") % 5 == 0, -1).otherwise(1).cast("long").alias("delta")))


def gauges(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gauges(events_as_messages(spark, d).select(F.col("topic").alias("metric"), F.col("seq").alias("ord"), "value"))


def varz(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    return e.agg(F.max("seq").alias("seq"), F.count("*").alias("puts"), F.count(F.when(reads.alive(NOW), 1)).alias("live"), F.sum(F.octet_length("payload")).alias("in_bytes"), F.count_distinct("contract", "topic").alias("topics"))


def uptime(spark: SparkSession, d: str) -> DataFrame:
    return events_as_messages(spark, d).select("seq", metrics.uptime(F.col("seq") * 37).alias("uptime"))


def flow_state(spark: SparkSession, d: str) -> DataFrame:
    steps = F.array(*map(F.lit, ("NOTIFY", "RECEIVE", "PUBLISH", "RECEIPT", "COMPLETE")))
    c = events_as_messages(spark, d).select(F.col("user_id").alias("session_id"), (F.col("seq") % 7).alias("message_id"), F.col("seq").alias("ord"), F.element_at(steps, (F.col("seq") % 5 + 1).cast("int")).alias("control"))
    return pubsub.pending(c)


def key_access_mask(spark: SparkSession, d: str) -> DataFrame:
    access = F.element_at(F.array(*map(F.lit, ("r", "w", "rw", "rwa", "o", ""))), (F.col("seq") % 6 + 1).cast("int"))
    r = events_as_messages(spark, d).select("seq", access_mask(access).alias("mask"))
    return pubsub.allowed(r, WRITE)


def dedup_seq(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d).select("contract", "seq", "payload")
    return pubsub.once(e.unionByName(e.where("seq % 2 = 0")))


def session_refcount(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    return pubsub.subscribed(e.select(F.col("user_id").alias("conn_id"), F.col("event_type").alias("pattern"), F.when(F.col("seq") % 3 == 0, -1).otherwise(1).cast("long").alias("change")))


def connected_deliveries(spark: SparkSession, d: str) -> DataFrame:
    connections = spark.createDataFrame([(100,), (102,)], "conn_id long")
    return pubsub.to_live(_deliveries(spark, d), connections).groupBy("conn_id").agg(F.count("*").alias("messages"))


def second_buckets(spark: SparkSession, d: str) -> DataFrame:
    return events_as_messages(spark, d).groupBy(F.date_trunc("second", "created_at").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("messages"))


def kv_live_keys(spark: SparkSession, d: str) -> DataFrame:
    return kv.keys(conversations_as_log(spark, d))


def statsd(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("seq") % 5 == 0, -1).otherwise(1).cast("long")
    return metrics.statsd(events_as_messages(spark, d).select(F.col("event_type").alias("metric"), delta.alias("delta"), F.floor(F.col("value") * 1000).alias("duration_ns"), F.col("user_id").alias("member")))


def varz_json(spark: SparkSession, d: str) -> DataFrame:
    return metrics.as_json(events_as_messages(spark, d).groupBy("contract").agg(F.max("seq").alias("seq"), F.count("*").alias("puts")))


def sync_totals(spark: SparkSession, d: str) -> DataFrame:
    return store.sync_totals(events_as_messages(spark, d).withColumn("payload", F.when(F.col("seq") % 11 > 0, F.col("payload"))))


def sync_new(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    return reads.unseen(e, e.where("seq % 3 = 0")).select("contract", "seq", "topic")


def memory_first(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d).select("contract", "seq", "payload")
    return reads.memory_first(e.where("seq % 10 = 0").withColumn("payload", F.lit("newer")), e)


def expired_by_minute(spark: SparkSession, d: str) -> DataFrame:
    return reads.expired_by_minute(events_as_messages(spark, d), NOW)


def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("topic", F.lit("?ttl="), (F.col("seq") % 48).cast("string"), F.lit("h"))
    return store.parsed(events_as_messages(spark, d).withColumn("topic", raw), NOW).select("seq", "topic", "depth", "expires_at")


def encrypted_payloads(spark: SparkSession, d: str) -> DataFrame:
    key = b"0123456789abcdef"
    e = events_as_messages(spark, d).withColumn("sealed", store.sealed(F.col("payload"), key))
    return e.select("contract", "seq", store.opened(F.col("sealed"), key).cast("string").alias("payload"), (F.col("sealed") != F.col("payload").cast("binary")).alias("changed"))


def secure_topics(spark: SparkSession, d: str) -> DataFrame:
    key, topic = key_and_topic(F.col("raw"))
    raw = F.concat(F.lit("k"), F.col("contract").cast("string"), F.lit("/"), "topic", F.lit("?ttl=1h"))
    requests = events_as_messages(spark, d).select("contract", "seq", raw.alias("raw")).select("contract", "seq", key.alias("key"), topic.alias("topic"))
    keys = spark.createDataFrame([(0, "k0", "...", READ + WRITE), (1, "k1", "app.u1.click", READ), (2, "k2", "...", WRITE), (3, "k9", "...", READ)], "contract long, key string, target string, mask int")
    return pubsub.authorised(requests, keys, READ)


def message_ids(spark: SparkSession, d: str) -> DataFrame:
    return pubsub.message_ids(_deliveries(spark, d), 1000).select("conn_id", "seq", "sub_id", "message_id")


def get_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """What a static topic finds where every fifth message is stored under a pattern."""
    e = events_as_messages(spark, d)
    stored = F.when(F.col("seq") % 20 == 0, "...").when(F.col("seq") % 20 == 5, "app...").when(F.col("seq") % 20 == 10, "app.*.click").when(F.col("seq") % 20 == 15, "*.u2.*").otherwise(F.col("topic"))
    return reads.get(e.withColumn("topic", stored), reads.Query("app.u2.click", contract=2, limit=200), NOW).select("seq", "topic")


def kv_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log with many entries of a key in one block: puts replace, deletes remove, later puts stand."""
    e = events_as_messages(spark, d)
    op = F.when(F.col("seq") % 7 == 0, "del").otherwise("put")
    block = F.floor(F.col("seq") / 100)
    return kv.latest(e.select(block.alias("time_id"), F.col("user_id").alias("key"), op.alias("op"), F.when(op == "del", block).alias("ref_time_id"), F.col("payload").alias("value"), F.col("seq").alias("ord")))


def kv_varz(spark: SparkSession, d: str) -> DataFrame:
    log = conversations_as_log(spark, d)
    return kv.varz(log.unionByName(kv.delete_newest(log, log.where("key % 3 = 0"))))


def stddev_large(spark: SparkSession, d: str) -> DataFrame:
    """Durations beside a large offset."""
    return metrics.statistics(_samples(spark, d).withColumn("duration_ns", F.lit(10**12) + F.col("ord") % 1000)).select("metric", "n", "avg", "stddev")


def session_log(spark: SparkSession, d: str) -> DataFrame:
    return pubsub.session_log(_packets(spark, d))


def session_resume(spark: SparkSession, d: str) -> DataFrame:
    return pubsub.resumed(pubsub.session_log(_packets(spark, d)), spark.createDataFrame([(1,), (3,), (5,)], "session_id long")).select("key", "message_id")


def session_reset(spark: SparkSession, d: str) -> DataFrame:
    return pubsub.reset(pubsub.session_log(_packets(spark, d)), spark.createDataFrame([(1,), (3,), (5,)], "session_id long")).select("key", "kind")


def _packets(spark: SparkSession, d: str) -> DataFrame:
    kinds, ways = F.array(*map(F.lit, ("PUBLISH", "NOTIFY", "RECEIPT", "COMPLETE", "PUBLISH"))), F.array(*map(F.lit, ("out", "out", "in", "out", "in")))
    at = (F.col("seq") % 5 + 1).cast("int")
    return events_as_messages(spark, d).select(F.col("user_id").alias("session_id"), (F.col("seq") % 11).alias("message_id"), F.col("seq").alias("ord"), F.element_at(ways, at).alias("way"), F.element_at(kinds, at).alias("kind"))


def server_varz(spark: SparkSession, d: str) -> DataFrame:
    connections = spark.createDataFrame([(100,), (102,)], "conn_id long")
    return pubsub.server_varz(connections, _subscriptions(spark), events_as_messages(spark, d), _deliveries(spark, d))


def keygen(spark: SparkSession, d: str) -> DataFrame:
    access = F.element_at(F.array(*map(F.lit, ("r", "w", "rw", "o"))), (F.col("seq") % 4 + 1).cast("int"))
    return pubsub.generate_keys(events_as_messages(spark, d).select("contract", "topic", access.alias("access")).distinct(), "secret")


def publish_allowed(spark: SparkSession, d: str) -> DataFrame:
    """A wildcard key may read and not publish."""
    keys = spark.createDataFrame([(0, "k0", "...", READ + WRITE), (1, "k1", "app.u1.click", WRITE)], "contract long, key string, target string, mask int")
    requests = events_as_messages(spark, d).select("contract", F.concat(F.lit("k"), F.col("contract").cast("string")).alias("key"), "topic", "seq")
    return pubsub.authorised(requests, keys, WRITE, publish=True).select("contract", "key", "seq")


def message_id_codec(spark: SparkSession, d: str) -> DataFrame:
    raw = message_id(F.col("contract"), F.col("seq"), F.unix_seconds(F.col("created_at").cast("timestamp")))
    return events_as_messages(spark, d).select("seq", F.lower(F.hex(raw)).alias("id"), message_id_parts(raw).alias("p")).select("seq", "id", F.col("p.contract").alias("contract"), F.col("p.seq").alias("again"), F.col("p.seconds").alias("seconds"))


def seq_ranges(spark: SparkSession, d: str) -> DataFrame:
    return reads.ranges(events_as_messages(spark, d).withColumn("contract", F.lit(0).cast("long")).where("seq % 13 <> 0"))


def seq_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    return reads.by_seq(e, e.where("seq % 250 = 1").select("contract", "seq")).select("contract", "seq", "payload")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of event time by topic."""
    return ingest.tumbling(events_as_messages(spark, d), "1 hour")


NODES = ["north", "east", "south"]


def contract_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Which node owns each number taken as a contract."""
    return cluster.routed(events_as_messages(spark, d).select(F.col("seq").alias("contract")), NODES, "east").select("contract", "node", "remote")


def option_numbers(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("seq") % 3 == 0, F.lit("2h")).otherwise(F.col("seq").cast("string"))
    raw = F.concat("topic", F.lit("?last="), last, F.lit("&last=7"))
    return events_as_messages(spark, d).select("seq", option_number(raw, "last").alias("last_number"), option_number(raw, "ttl").alias("ttl_number"))


def base32_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = F.unhex(F.lpad(F.hex(F.col("seq") * 2654435761), 16, "0"))
    ids = events_as_messages(spark, d).select("seq", base32(raw).alias("id"))
    return ids.select("seq", "id", F.conv(F.hex(unbase32(F.col("id"))), 16, 10).cast("long").alias("again"))


def publish_replies(spark: SparkSession, d: str) -> DataFrame:
    """What publishers hear: some rows have no payload, one key is static and one a wildcard."""
    keys = spark.createDataFrame([(0, "k0", "...", READ + WRITE), (1, "k1", "app.u1.click", WRITE), (1, "k1", "app.u5.view", READ)], "contract long, key string, target string, mask int")
    e = events_as_messages(spark, d).withColumn("payload", F.when(F.col("seq") % 11 > 0, F.col("payload")))
    requests = e.select("contract", F.concat(F.lit("k"), F.col("contract").cast("string")).alias("key"), "topic", "seq", "payload")
    return pubsub.acknowledged(requests, keys, store.valid(requests)).select("contract", "seq", "reply")


def connect_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions 1 and 2 connect twice: the last connect of 1 is clean, that of 2 is not."""
    connects = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (2, 2, False)], "session_id long, ord long, clean boolean")
    return pubsub.connected(pubsub.session_log(_packets(spark, d)), connects).select("key", "kind", "notify")


def db_varz(spark: SparkSession, d: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("put", "put", "get", "put", "del", "sync", "put", "lease", "abort", "recover"))), (F.col("seq") % 10 + 1).cast("int"))
    return metrics.db_varz(events_as_messages(spark, d).select(op.alias("op"), "seq", F.octet_length("payload").cast("long").alias("bytes"), F.floor(F.col("value") * 1000).alias("duration_ns")))


def bloom_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_messages(spark, d)
    return reads.filtered_by_seq(e, e.where("seq % 97 = 1").select("contract", "seq")).select("contract", "seq", "topic")


_ALL = (
    contract_nodes, option_numbers, base32_ids, publish_replies, connect_sessions, db_varz, bloom_lookup,
    get_wildcard, kv_ordered, kv_varz, stddev_large, session_log, session_resume, session_reset, server_varz, keygen, publish_allowed, message_id_codec, seq_ranges, seq_lookup, event_windows,
    get_last_topk, get_contract, parse_topics, live_at_now, not_deleted, match_patterns, topic_latest_k, topic_dictionary, relay, fanout, delivery_plan, batch_windows, kv_latest, kv_lookup, kv_keys,
    kv_size, kv_delete_replay, sample_stats, bounded_sample, counters, gauges, varz, uptime, flow_state, key_access_mask, dedup_seq, session_refcount, connected_deliveries, second_buckets,
    kv_live_keys, statsd, varz_json, sync_totals, sync_new, memory_first, expired_by_minute, ttl_expiry, encrypted_payloads, secure_topics, message_ids,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_M = """with m as (select user_id % 4 as contract, event_id + 1 as seq, 'app.u' || user_id || '.' || event_type as topic, props as payload, ts as created_at,
  case when event_id % 3 = 0 then ts + to_hours(floor(value)::int) end as expires_at, value, event_type, user_id from events)"""
_NOW = "timestamp '2024-01-31'"


def _regex(pattern: str) -> str:
    levels = [x for x in pattern.removesuffix("...").split(".") if x]
    body = "\\.".join("[^.]+" if x == "*" else x for x in levels)
    if not pattern.endswith("..."):
        return f"^{body}$"
    return f"^{body}(\\.[^.]+)+$" if body else "^[^.]+(\\.[^.]+)*$"


_P = ", p(contract, pattern, conn_id, delivery_mode, delay_ms, sub_id, re) as (values " + ", ".join(f"({c}, '{p}', {n}, {dm}, {dl}, {s}, '{_regex(p)}')" for c, p, n, dm, dl, s in SUBSCRIPTIONS) + "), f as (select m.*, pattern, conn_id, delivery_mode, delay_ms, sub_id from m join p on m.contract = p.contract and regexp_matches(topic, re))"
_S = ", s as (select event_type as metric, seq as ord, floor(value * 1000)::bigint as x from m)"


def _stats(of: str) -> str:
    return f"""{of}, r as (select metric, x, row_number() over (partition by metric order by x) - 1 as i, count(*) over (partition by metric) as n from q),
a as (select metric, max(n) as n, sum(x)::bigint as cumulative, case when min(abs(x)) > 0 then floor(max(n) / sum(1.0::double / nullif(x, 0)))::bigint end as hmean, floor(sum(x)::double / max(n))::bigint as avg,
 max(case when i = n // 2 then x end) as p50, max(case when i = floor(n * 0.75::double + 0.5) - 1 then x end) as p75, max(case when i = floor(n * 0.95::double + 0.5) - 1 then x end) as p95,
 max(case when i = floor(n * 0.99::double + 0.5) - 1 then x end) as p99, max(case when i = floor(n * 0.999::double + 0.5) - 1 then x end) as p999,
 count(case when i >= floor(n * 0.95::double + 0.5) then 1 end) as ln, sum(case when i >= floor(n * 0.95::double + 0.5) then x end) as ls,
 count(case when i < floor(n * 0.05::double + 0.5) then 1 end) as sn, sum(case when i < floor(n * 0.05::double + 0.5) then x end) as ss, min(x) as min, max(x) as max from r group by metric),
d as (select r.metric, floor(sqrt(sum(((x - avg) * (x - avg))::double) / max(r.n)))::bigint as stddev from r join a using (metric) group by r.metric)"""


def oracle_sql() -> dict:
    rank = "row_number() over (partition by {} order by seq desc)::int"
    pk = f"{_M}, k as (select user_id as session_id, seq % 11 as message_id, ['PUBLISH', 'NOTIFY', 'RECEIPT', 'COMPLETE', 'PUBLISH'][seq % 5 + 1] as kind, seq from m where seq % 5 in (0, 2, 3)), l as (select session_id, message_id, arg_max(kind, seq) as kind from k group by all having arg_max(kind, seq) <> 'COMPLETE'), s as (select message_id * 4294967296 + session_id as key, * from l)"
    mid = "lower(concat(b[7:8], b[5:6], b[3:4], b[1:2], c[7:8], c[5:6], c[3:4], c[1:2], q[15:16], q[13:14], q[11:12], q[9:10], q[7:8], q[5:6], q[3:4], q[1:2]))"
    fnv = lambda s: f"list_reduce(list_prepend(2166136261::ubigint, list_transform(range(length({s})), lambda i: ascii(substr({s}, i + 1, 1))::ubigint)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"
    ops = "['put', 'put', 'get', 'put', 'del', 'sync', 'put', 'lease', 'abort', 'recover'][seq % 10 + 1]"
    n = lambda op: f"count_if(op = '{op}')::bigint"
    return {
        "contract_nodes": f"{_M}, n(node) as (values {', '.join(f"('{x}')" for x in NODES)}), r as (select node, {fnv('k')} as h from (select node, i || node as k from n, range(20) t(i))), c as (select distinct seq as contract, seq::varchar as k from m), g as (select contract, k, {fnv('k')} as h from c), f as (select contract, arg_min(r.node, (r.h, r.node)) as node from g join r on r.h > g.h or (r.h = g.h and r.node >= k) group by contract), o as (select contract, coalesce(f.node, (select arg_min(node, (h, node)) from r)) as node from g left join f using (contract)) select contract, node, node <> 'east' as remote from o",
        "option_numbers": f"{_M} select seq, case when seq % 3 <> 0 then seq end as last_number, null::bigint as ttl_number from m",
        "base32_ids": f"{_M}, x as (select seq, seq * 2654435761 as v from m) select seq, array_to_string(list_transform(range(12), lambda i: substr('{DIGITS}', ((v >> (59 - 5 * i)) & 31)::int + 1, 1)), '') || substr('{DIGITS}', ((v & 15) * 2)::int + 1, 1) as id, v as again from x",
        "publish_replies": f"{_M} select contract, seq, case when seq % 11 = 0 then 'BAD_REQUEST' when contract = 1 and topic = 'app.u1.click' then 'ACKNOWLEDGE' else 'FORBIDDEN' end as reply from m",
        "connect_sessions": f"{pk} select key, kind, session_id = 2 and kind = 'PUBLISH' as notify from s where session_id <> 1",
        "db_varz": _stats(f"{_M}, o as (select {ops} as op, seq, octet_length(payload::blob) as bytes, floor(value * 1000)::bigint as x from m), q as (select 'db' as metric, x from o)") + f", c as (select max(case when op = 'put' then seq end) as seq, {n('put')} - {n('del')} as count, {', '.join(f'{n(op)} as {name}' for name, op in metrics.OPERATIONS.items())}, {n('put')} as in_msgs, {n('get')} as out_msgs, coalesce(sum(case when op = 'put' then bytes end), 0)::bigint as in_bytes, coalesce(sum(case when op = 'get' then bytes end), 0)::bigint as out_bytes from o) select c.*, hmean, p50, p75, p95, p99, p999, case when ln <= 1 then max else floor(ls::double / ln)::bigint end as long5p, case when sn <= 1 then min else floor(ss::double / sn)::bigint end as short5p, max, min, stddev from c, a join d using (metric)",
        "bloom_lookup": f"{_M} select contract, seq, topic from m where seq % 97 = 1",
        "get_wildcard": f"{_M}, w as (select *, case seq % 20 when 0 then '...' when 5 then 'app...' when 10 then 'app.*.click' when 15 then '*.u2.*' else topic end as t from m) select seq, t as topic from w where contract = 2 and (seq % 20 in (0, 5, 10, 15) or t = 'app.u2.click') and (expires_at is null or expires_at > {_NOW}) order by seq desc limit 200",
        "kv_ordered": f"{_M}, l as (select seq // 100 as time_id, user_id as key, arg_max(payload, seq) as value, arg_max(seq % 7 = 0, seq) as gone from m group by all) select key, max(time_id) as time_id, arg_max(value, time_id) as value from l where not gone group by key",
        "kv_varz": "with n as (select distinct conv_id as k, max(turn) over (partition by conv_id) as t from conversations where conv_id % 3 = 0), p as (select distinct turn, conv_id from conversations) select (select count(*) from p) - (select count(*) from n) as count, (select count(*) from conversations) as puts, (select count(*) from n) as dels, (select count(distinct turn) from conversations) as blocks",
        "stddev_large": f"{_M}, x as (select event_type as metric, seq % 1000 as x from m), a as (select metric, count(*) as n, floor(avg(x))::bigint as a from x group by metric) select metric, any_value(n) as n, any_value(a) + 1000000000000 as avg, floor(sqrt(sum((x - a) * (x - a)) / any_value(n)))::bigint as stddev from x join a using (metric) group by metric",
        "session_log": f"{pk} select key, session_id, message_id, kind from s",
        "session_resume": f"{pk} select key, message_id from s where kind = 'PUBLISH' and session_id in (1, 3, 5)",
        "session_reset": f"{pk} select key, kind from s where session_id not in (1, 3, 5)",
        "server_varz": f"{_M}{_P} select 2::bigint as connections, {len(SUBSCRIPTIONS)}::bigint as subscriptions, (select count(*) from m) as in_msgs, (select sum(octet_length(payload::blob)) from m)::bigint as in_bytes, (select count(*) from f) as out_msgs, (select sum(octet_length(payload::blob)) from f)::bigint as out_bytes",
        "keygen": f"{_M}, k as (select distinct contract, topic as target, [8, 16, 24, 2][seq % 4 + 1] as mask from m) select contract, substr(sha256(concat_ws(chr(0), 'secret', contract, target, mask)), 1, 26) as key, target, mask from k",
        "publish_allowed": f"{_M} select contract, 'k1' as key, seq from m where contract = 1 and topic = 'app.u1.click'",
        "message_id_codec": f"{_M}, h as (select seq, contract, floor(epoch(created_at))::bigint as seconds, printf('%08X', 4294967295 - (floor(epoch(created_at))::bigint - 1555770000)) as b, printf('%08X', contract) as c, printf('%016X', seq) as q from m) select seq, {mid} as id, contract, seq as again, seconds from h",
        "seq_ranges": f"{_M}, g as (select seq, seq - row_number() over (order by seq) as g from m where seq % 13 <> 0) select 0::bigint as contract, min(seq) as first_seq, max(seq) as last_seq from g group by g",
        "seq_lookup": f"{_M} select contract, seq, payload from m where seq % 250 = 1",
        "event_windows": f"{_M} select date_trunc('hour', created_at) as start, topic, count(*) as messages from m group by all",
        "kv_live_keys": "select distinct turn as time_id, conv_id as key from conversations",
        "statsd": f"{_M} select event_type as metric, sum(case when seq % 5 = 0 then -1 else 1 end)::bigint as total, count(*) as timings, floor(sum(floor(value * 1000)::bigint)::double / count(*))::bigint as mean_ns, count(distinct user_id) as members from m group by event_type",
        "varz_json": f"{_M} select to_json({{'contract': contract, 'seq': max(seq), 'puts': count(*)}})::varchar as json from m group by contract",
        "sync_totals": f"{_M} select contract, count_if(seq % 11 > 0)::bigint as messages, sum(case when seq % 11 > 0 then octet_length(payload::blob) end)::bigint as bytes, count_if(seq % 11 = 0)::bigint as invalid, max(case when seq % 11 > 0 then seq end) as upper_seq from m group by contract",
        "sync_new": f"{_M} select contract, seq, topic from m where seq % 3 <> 0",
        "memory_first": f"{_M} select contract, seq, case when seq % 10 = 0 then 'newer' else payload end as payload from m",
        "expired_by_minute": f"{_M} select contract, date_trunc('minute', expires_at) as minute, count(*) as messages from m where expires_at <= {_NOW} group by all",
        "ttl_expiry": f"{_M} select seq, topic, 3::int as depth, coalesce(expires_at, {_NOW} + to_hours((seq % 48)::int)) as expires_at from m",
        "encrypted_payloads": f"{_M} select contract, seq, payload, true as changed from m",
        "secure_topics": f"{_M} select contract, seq, 'k' || contract as key, topic, contract = 0 as wildcard from m where contract = 0 or (contract = 1 and topic = 'app.u1.click')",
        "message_ids": f"{_M}{_P} select conn_id::bigint as conn_id, seq, sub_id::bigint as sub_id, row_number() over (partition by conn_id order by seq, sub_id) as message_id from f",
        "get_last_topk": f"{_M} select seq, payload, created_at from m where contract = 1 and topic = 'app.u1.click' and (expires_at is null or expires_at > {_NOW}) and date_trunc('second', created_at) >= {_NOW} - interval 360 hour order by seq desc limit 50",
        "get_contract": f"{_M} select seq, topic from m where contract = 1 order by seq desc limit 100",
        "parse_topics": f"{_M} select seq, topic || case when seq % 2 = 0 then '...' else '.*' end as topic, (3 + seq % 2)::bigint as levels, 4::bigint as depth, seq % 2 = 0 as multi, true as wildcard, '1h' as ttl, seq::varchar as last_n from m",
        "live_at_now": f"{_M} select topic, count(*) as messages from m where expires_at is null or expires_at > {_NOW} group by topic",
        "not_deleted": f"{_M} select contract, seq from m where (seq - 1) % 17 <> 0",
        "match_patterns": f"{_M}{_P} select contract, pattern, seq from f",
        "topic_latest_k": f"{_M} select contract, topic, seq, {rank.format('contract, topic')} as rank from m qualify rank <= 3",
        "topic_dictionary": f"{_M} select contract, topic, count(*) as messages, min(seq) as first_seq, max(seq) as last_seq from m group by all",
        "relay": f"""{_M}, q(request_id, contract, re, secs) as (values (1, 0, '{_regex("app...")}', 86400), (2, 1, '{_regex("app.u1.*")}', 864000), (3, 2, '{_regex("...")}', 3600000), (4, 3, '{_regex("app.u3.click")}', 3600))
          select request_id::bigint as request_id, seq, {rank.format("request_id")} as rank from m join q on m.contract = q.contract and regexp_matches(topic, re)
          where (expires_at is null or expires_at > {_NOW}) and date_trunc('second', created_at) >= {_NOW} - to_seconds(secs) qualify rank <= 1000""",
        "fanout": f"{_M}{_P} select sub_id::bigint as sub_id, conn_id::bigint as conn_id, count(*) as messages, max(seq) as last_seq from f group by all",
        "delivery_plan": f"{_M}{_P} select sub_id::bigint as sub_id, case when seq % 3 in (1, 2) and delivery_mode in (1, 2) then 'NOTIFY' when delivery_mode = 2 or delay_ms > 0 then 'BATCH' else 'DIRECT' end as delivery, count(*) as messages from f group by all",
        "batch_windows": f"{_M}{_P}, b as (select *, epoch_ms(created_at) + 3600000 + delay_ms as ms from f) select conn_id::bigint as conn_id, ms - ms % 3600000 as bucket_ms, count(*) as messages, min(seq) as first_seq, max(seq) as last_seq from b group by all",
        "kv_latest": "select conv_id as key, max(turn) as time_id, arg_max(text, turn) as value from conversations group by conv_id",
        "kv_lookup": "select turn as time_id, conv_id as key, text as value from conversations where turn = 1 and conv_id = 3",
        "kv_keys": "select turn as time_id, count(distinct conv_id) as keys from conversations group by turn",
        "kv_size": "select count(distinct (turn, conv_id)) as size from conversations where turn <> 0",
        "kv_delete_replay": "select conv_id as key, max(turn) as time_id, arg_max(text, turn) as value from (select *, max(turn) over (partition by conv_id) as top from conversations) where conv_id % 2 = 1 or turn < top group by conv_id",
        "sample_stats": _stats(f"{_M}{_S}, q as (select metric, x from s)") + " select metric, n, cumulative, hmean, avg, p50, p75, p95, p99, p999, stddev, case when ln <= 1 then max else floor(ls::double / ln)::bigint end as long5p, case when sn <= 1 then min else floor(ss::double / sn)::bigint end as short5p, min, max, max - min as range from a join d using (metric)",
        "bounded_sample": _stats(f"{_M}{_S}, q as (select metric, x from s qualify row_number() over (partition by metric order by ord desc) <= 50)") + " select metric, n, avg, p50, p95, min, max from a",
        "counters": f"{_M} select event_type as metric, sum(case when seq % 5 = 0 then -1 else 1 end)::bigint as count from m group by event_type",
        "gauges": f"{_M} select topic as metric, arg_max(value, seq) as value from m group by topic",
        "varz": f"{_M} select max(seq) as seq, count(*) as puts, count(case when expires_at is null or expires_at > {_NOW} then 1 end) as live, sum(octet_length(payload::blob))::bigint as in_bytes, count(distinct (contract, topic)) as topics from m",
        "uptime": f"{_M}, u as (select seq, seq * 37 as s from m) select seq, case when s >= 31536000 then (s // 31536000) || 'y' || (s // 86400 % 365) || 'd' || (s // 3600 % 24) || 'h' || (s // 60 % 60) || 'm' || (s % 60) || 's' when s >= 86400 then (s // 86400) || 'd' || (s // 3600 % 24) || 'h' || (s // 60 % 60) || 'm' || (s % 60) || 's' when s >= 3600 then (s // 3600) || 'h' || (s // 60 % 60) || 'm' || (s % 60) || 's' when s >= 60 then (s // 60) || 'm' || (s % 60) || 's' else s || 's' end as uptime from u",
        "flow_state": f"{_M}, c as (select user_id as session_id, seq % 7 as message_id, arg_max(['NOTIFY', 'RECEIVE', 'PUBLISH', 'RECEIPT', 'COMPLETE'][seq % 5 + 1], seq) as control from m group by all) select * from c where control <> 'COMPLETE'",
        "key_access_mask": f"{_M}, k as (select seq, [8, 16, 24, 28, 2, 0][seq % 6 + 1] as mask from m) select * from k where mask & 16 = 16",
        "dedup_seq": f"{_M} select contract, seq, payload from m",
        "session_refcount": f"{_M} select user_id as conn_id, event_type as pattern, sum(case when seq % 3 = 0 then -1 else 1 end)::bigint as refs from m group by all having refs > 0",
        "connected_deliveries": f"{_M}{_P} select conn_id::bigint as conn_id, count(*) as messages from f where conn_id in (100, 102) group by all",
        "second_buckets": f"{_M} select date_trunc('second', created_at) as bucket, count(*) as messages from m group by all",
    }
