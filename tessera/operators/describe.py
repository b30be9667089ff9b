"""A corpus in shares of a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def shares(events: DataFrame, queries: DataFrame, selections: DataFrame) -> DataFrame:
    """first_month, last_month, percent_never (events that no query selects), percent_training (queries), percent_selected (of all pairs): one row."""
    e = events.agg(F.count("*").alias("n"))
    q = queries.agg(F.count("*").alias("q"), F.count_if(F.col("set_name") == "training").alias("t"), F.date_format(F.min("query_time"), "yyyy-MM").alias("first_month"), F.date_format(F.max("query_time"), "yyyy-MM").alias("last_month"))
    s = selections.groupBy("record_id").agg(F.count("*").alias("d")).agg(F.count("*").alias("touched"), F.coalesce(F.sum("d"), F.lit(0)).alias("s"))
    percent = lambda part, whole: F.lit(100.0) * part / whole
    n, k = F.col("n"), F.col("q")
    return e.join(F.broadcast(q)).join(F.broadcast(s)).select(
        "first_month", "last_month", percent(n - F.col("touched"), n).alias("percent_never"), percent(F.col("t"), k).alias("percent_training"), percent(F.col("s"), n * k).alias("percent_selected")
    )


def bucket_shares(buckets: DataFrame, selections: DataFrame) -> DataFrame:
    """bucket, population, selected: percentages of the events, and of the rows of the log, in each bucket. buckets: record_id, bucket."""
    d = selections.groupBy("record_id").agg(F.count("*").alias("d"))
    each = buckets.join(d, "record_id", "left").groupBy("bucket").agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    whole = each.agg(F.sum("n").alias("all_n"), F.sum("d").alias("all_d"))
    return each.join(F.broadcast(whole)).select("bucket", (F.lit(100.0) * F.col("n") / F.col("all_n")).alias("population"), (F.lit(100.0) * F.col("d") / F.col("all_d")).alias("selected"))
