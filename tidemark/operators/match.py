"""Topics against patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.topics import is_multi, levels_of, pattern_regex


def match_by_regex(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """messages (contract, topic, ...) x patterns (contract, pattern, ...) by regular expression: the definition, and slow."""
    p = patterns.withColumn("_regex", pattern_regex(F.col("pattern")))
    return messages.join(p, (messages["contract"] == p["contract"]) & F.expr("topic rlike _regex")).drop(p["contract"]).drop("_regex")


def match(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same rows as match_by_regex through an equi-join.

    A pattern's shape is its number of fixed levels, the places of ``*`` among them, and whether it ends in ``...``. There
    are few shapes; a topic gets one key for each shape of its contract's patterns that its depth allows (its first levels
    with ``*`` at the shape's places), and keys are joined for equality.
    """
    lv = levels_of(F.col("pattern"))
    stars = F.array_join(F.transform(lv, lambda x: F.when(x == "*", "1").otherwise("0")), "")
    p = patterns.withColumns({"_multi": is_multi(F.col("pattern")), "_stars": stars, "_key": F.array_join(lv, ".")})
    shapes = p.select(F.col("contract").alias("_c"), "_multi", "_stars").distinct().groupBy("_c").agg(F.collect_set(F.struct("_multi", "_stars")).alias("_shapes"))
    m = messages.join(shapes, messages["contract"] == shapes["_c"]).drop("_c").withColumn("_levels", levels_of(F.col("topic")))
    n = F.size("_levels")
    fits = F.filter("_shapes", lambda s: F.when(s["_multi"], n > F.length(s["_stars"])).otherwise(n == F.length(s["_stars"])))
    m = m.withColumn("_s", F.explode(fits)).drop("_shapes")
    key = F.array_join(F.transform(F.slice("_levels", F.lit(1), F.length("_s._stars")), lambda x, i: F.when(F.substr(F.col("_s._stars"), i + 1, F.lit(1)) == "1", "*").otherwise(x)), ".")
    m = m.withColumns({"_key": key, "_multi": F.col("_s._multi"), "_stars": F.col("_s._stars")}).drop("_s", "_levels")
    return m.join(p, ["contract", "_multi", "_stars", "_key"]).drop("_multi", "_stars", "_key")
