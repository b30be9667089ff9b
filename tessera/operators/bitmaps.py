"""Supports as packed bitmaps: one binary per event and bucket of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def support(selections: DataFrame, key: str = "record_id") -> DataFrame:
    """key, bucket, bits: queries of each event, up to the last byte that isn't zero. Positions are 1-based in Spark's bitmaps.

    The log is dealt by key once; bytes are made before bitmaps, so that no task sorts or moves a whole bucket's 4 kB for each event."""
    q = F.col("query_id") + 1
    at = F.bitmap_bit_position(q)
    dealt = selections.select(key, F.bitmap_bucket_number(q).alias("bucket"), F.floor(at / 8).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), (at % 8).cast("int")).alias("bit")).repartition(key)
    bytes_ = dealt.groupBy(key, "bucket", "byte").agg(F.bit_or("bit").alias("bit"))
    rows = bytes_.groupBy(key, "bucket").agg(F.sort_array(F.collect_list(F.struct("byte", "bit"))).alias("b"))
    before = F.concat(F.array(F.lit(-1)), F.col("b.byte"))  # the byte before each
    digits = F.zip_with("b", F.slice(before, F.lit(1), F.size("b")), lambda x, low: F.concat(F.repeat(F.lit("00"), x["byte"] - low - 1), F.lpad(F.hex(x["bit"]), 2, "0")))
    return rows.select(key, "bucket", F.unhex(F.array_join(digits, "")).alias("bits"))


def size(bits: DataFrame, key: str = "record_id") -> DataFrame:
    return bits.groupBy(key).agg(F.sum(F.bitmap_count("bits")).alias("demand"))


def union(bits: DataFrame, layout: DataFrame) -> DataFrame:
    """container_id, bucket, bits: the queries that need any event of a container; containers without any have no bits."""
    joined = layout.join(bits, "record_id").groupBy("container_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return layout.select("container_id").distinct().join(joined, "container_id", "left")


def words(query_count: int, width: int = 64) -> int:
    """Machine words that hold a bit per query."""
    return -(-query_count // width)


def restrict(selections: DataFrame, visible: DataFrame) -> DataFrame:
    """The support as if only ``visible`` queries existed."""
    return selections.join(visible.select("query_id"), "query_id", "left_semi")


def unpack(selections: DataFrame, queries: list[int]) -> DataFrame:
    """record_id and a 0/1 column per query of a short list."""
    chosen = selections.where(F.col("query_id").isin(*queries))
    return chosen.groupBy("record_id").pivot("query_id", queries).agg(F.lit(1)).na.fill(0)


def unpack_all(bits: DataFrame, key: str = "record_id") -> DataFrame:
    """key, query_id: a row per bit that is set, of all queries. Bytes after the last one that isn't zero aren't looked at."""
    used = bits.select(key, "bucket", F.expr("trim(TRAILING '0' FROM hex(bits))").alias("h")).where(F.length("h") > 0)
    digits = F.rpad("h", (F.ceil(F.length("h") / 2) * 2).cast("int"), F.lit("0"))
    byte = lambda p: F.conv(F.substring("h", F.lit(1) + 2 * F.floor(p / 8).cast("int"), F.lit(2)), 16, 10).cast("int")
    on = F.filter(F.sequence(F.lit(0), 4 * F.length("h") - 1), lambda p: F.getbit(byte(p), p % 8) == 1)
    at = used.withColumn("h", digits).select(key, "bucket", F.explode(on).alias("p"))
    size = F.lit(32768).cast("long")  # bits of a bucket; those below 1 count down from 0
    place = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * size + F.col("p")).otherwise(F.col("bucket") * size - F.col("p") - 1)
    return at.select(key, place.alias("query_id"))
