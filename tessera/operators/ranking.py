"""Dense positions over whole tables without a task that sees the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .settled import settled

BUCKET = 100_000


def position(df: DataFrame, group: list, identity: str = "record_id", name: str = "position", bucket: int = BUCKET, within: list | None = None) -> DataFrame:
    """0-based place of each row in the order of ``group`` columns, then ``identity`` (unique integers).

    Rows are numbered in (group, range of ids), and those counts, a row each, are summed up before. With
    ``within``, a prefix of ``group``, numbering starts anew in each value of it.
    """
    within = within or []
    part = F.floor(F.col(identity) / bucket)
    marked = df.withColumn("__part", part)
    key = [*group, "__part"]
    counts = marked.groupBy(*key).agg(F.count("*").alias("__n"))
    if within:
        running = W.partitionBy(*within).orderBy(*[c for c in key if c not in within]).rowsBetween(W.unboundedPreceding, -1)
        summed = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(running), F.lit(0)))
    else:
        summed = prefix_sums(counts, key, "__n", "__offset")
    offset = summed.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], "__offset")
    own = F.row_number().over(W.partitionBy(*key).orderBy(identity)) - 1
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)]
    out = marked.withColumn("__row", own).join(offset, on)
    return out.select(*df.columns, (F.col("__row") + F.col("__offset")).cast("long").alias(name))


def prefix_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in ``order``: ranges of rows are summed each in its task, and one row a range is summed up before."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = totals.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(before), F.col("__range") == F.col("__r")).withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__r", "__own", "__before")


def file_order(df: DataFrame, name: str = "record_id") -> DataFrame:
    """0-based number of each row in the order of its files and of the rows in them."""
    place = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    split = place.groupBy("__f", "__b").agg(F.count("*").alias("__n"))
    before = split.withColumn("__offset", F.coalesce(F.sum("__n").over(W.orderBy("__f", "__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    row = F.row_number().over(W.partitionBy("__f", "__b").orderBy("__m")) - 1
    return place.withColumn("__row", row).join(before, ["__f", "__b"]).select((F.col("__row") + F.col("__offset")).cast("long").alias(name), *df.columns)
