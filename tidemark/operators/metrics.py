"""Counters, gauges and duration statistics."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counters(samples: DataFrame) -> DataFrame:
    """metric, count: the sum of signed deltas (metric, delta)."""
    return samples.groupBy("metric").agg(F.sum("delta").alias("count"))


def gauges(samples: DataFrame) -> DataFrame:
    """metric, value: the last by ord (metric, ord, value)."""
    return samples.groupBy("metric").agg(F.max_by("value", "ord").alias("value"))


def statsd(samples: DataFrame) -> DataFrame:
    """metric, total (of delta), timings, mean_ns (of duration_ns, rounded down) and members (distinct): the client's counters, timers and sets."""
    x = F.col("duration_ns")
    return samples.groupBy("metric").agg(F.sum("delta").alias("total"), F.count(x).alias("timings"), F.floor(F.sum(x) / F.count(x)).alias("mean_ns"), F.count_distinct("member").alias("members"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object in the order of its columns."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def bounded(samples: DataFrame, size: int = 50) -> DataFrame:
    """The last ``size`` samples of each metric by ord."""
    return samples.withColumn("_rn", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("ord")))).where(F.col("_rn") <= size).drop("_rn")


def ranked(samples: DataFrame) -> DataFrame:
    """samples with rank (0-based, by duration_ns) and n of their metric, without a sort of a whole metric in one task.

    Equal durations are counted first; durations fall into buckets by their leading bits, so ranks add up from counts of
    buckets, of durations in a bucket, and one row a distinct duration is left: (metric, duration_ns, times, before, n).
    """
    counted = samples.groupBy("metric", "duration_ns").agg(F.count("*").alias("times")).withColumn("_b", F.floor(F.col("duration_ns") / 1024))
    buckets = counted.groupBy("metric", "_b").agg(F.sum("times").alias("_t"))
    upto = F.coalesce(F.sum("_t").over(W.partitionBy("metric").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("_p", upto).withColumn("n", F.sum("_t").over(W.partitionBy("metric")))
    inner = F.coalesce(F.sum("times").over(W.partitionBy("metric", "_b").orderBy("duration_ns").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("_i", inner).join(buckets, ["metric", "_b"]).select("metric", "duration_ns", "times", (F.col("_p") + F.col("_i")).alias("before"), "n")


def statistics(samples: DataFrame) -> DataFrame:
    """One row a metric (metric, duration_ns): cumulative, hmean, avg, p50 to p999, stddev, long5p, short5p, min, max, range.

    Whole numbers, rounded down. p50 is the element at n div 2; the others at floor(n * p + 0.5) - 1. A metric that holds a
    zero has no harmonic mean. long5p is the mean from floor(0.95 n + 0.5) on and short5p that below floor(0.05 n + 0.5); with
    one element or fewer they are max and min.
    """
    x = F.col("duration_ns")
    r = ranked(samples)
    at = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("times"))
    pick = lambda k: F.max(F.when(at(k), x))
    place = lambda p: F.floor(F.col("n") * p + 0.5) - 1
    from_, below = F.floor(F.col("n") * 0.95 + 0.5), F.floor(F.col("n") * 0.05 + 0.5)

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("before") + F.col("times"), high) - F.greatest(F.col("before"), low))

    long_n, short_n = overlap(from_, F.col("n")), overlap(F.lit(0), below)
    out = r.groupBy("metric").agg(
        F.max("n").alias("n"), F.sum(x * F.col("times")).alias("cumulative"),
        F.when(F.min(F.abs(x)) > 0, F.floor(F.max("n") / F.sum(F.col("times") / F.when(x != 0, x)))).alias("hmean"),
        pick(F.floor(F.col("n") / 2)).alias("p50"), pick(place(0.75)).alias("p75"), pick(place(0.95)).alias("p95"), pick(place(0.99)).alias("p99"), pick(place(0.999)).alias("p999"),
        F.sum(long_n * x).alias("_ls"), F.sum(long_n).alias("_ln"), F.sum(short_n * x).alias("_ss"), F.sum(short_n).alias("_sn"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    n, total = F.col("n"), F.col("cumulative")
    avg = F.floor(total / n)
    # squares around the whole-number mean, from the variance around the exact one: no difference of large sums
    spread = F.col("_var") + F.pow((total - avg * n) / n, 2)
    out = out.join(samples.groupBy("metric").agg(F.var_pop(x).alias("_var")), "metric")
    return out.select(
        "metric", "n", "cumulative", "hmean", avg.alias("avg"), "p50", "p75", "p95", "p99", "p999", F.floor(F.sqrt(spread)).alias("stddev"),
        F.when(F.col("_ln") <= 1, F.col("max")).otherwise(F.floor(F.col("_ls") / F.greatest(F.col("_ln"), F.lit(1)))).alias("long5p"),
        F.when(F.col("_sn") <= 1, F.col("min")).otherwise(F.floor(F.col("_ss") / F.greatest(F.col("_sn"), F.lit(1)))).alias("short5p"),
        "min", "max", (F.col("max") - F.col("min")).alias("range"),
    )


#: What a store counts, by operation.
OPERATIONS = {"gets": "get", "puts": "put", "leases": "lease", "syncs": "sync", "recovers": "recover", "aborts": "abort", "dels": "del"}


def db_varz(operations: DataFrame) -> DataFrame:
    """One row for a store's operations (op, seq, bytes, duration_ns): the highest seq put, live messages (puts less deletes),
    each kind of operation, messages and bytes in (put) and out (got), and the statistics of the durations."""
    of = lambda op: F.count_if(F.col("op") == op)
    size = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("bytes"))), F.lit(0))
    counts = operations.agg(
        F.max(F.when(F.col("op") == "put", F.col("seq"))).alias("seq"), (of("put") - of("del")).alias("count"), *(of(op).alias(name) for name, op in OPERATIONS.items()),
        of("put").alias("in_msgs"), of("get").alias("out_msgs"), size("put").alias("in_bytes"), size("get").alias("out_bytes"),
    )
    spans = statistics(operations.select(F.lit("db").alias("metric"), "duration_ns")).select("hmean", "p50", "p75", "p95", "p99", "p999", "long5p", "short5p", "max", "min", "stddev")
    return counts.join(spans, F.lit(True), "left")  # one row each


def uptime(seconds: Column) -> Column:
    """1y2d3h4m5s; parts before the first that is not 0 are left out."""
    y, d, h, m, s = F.floor(seconds / 31_536_000), F.floor(seconds / 86400) % 365, F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60
    out = F.when(y > 0, F.format_string("%dy%dd%dh%dm%ds", y, d, h, m, s)).when(d > 0, F.format_string("%dd%dh%dm%ds", d, h, m, s))
    return out.when(h > 0, F.format_string("%dh%dm%ds", h, m, s)).when(m > 0, F.format_string("%dm%ds", m, s)).otherwise(F.format_string("%ds", s))


def timed(call, *args, metric: str, into: list) -> object:
    """Run ``call`` and add (metric, ord, duration_ns) to ``into``, samples for ``statistics``."""
    began = time.perf_counter_ns()
    try:
        return call(*args)
    finally:
        into.append((metric, len(into), time.perf_counter_ns() - began))
