"""The fixture workload on the driver's tables: parts are events, order months and priorities are queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import layouts, replay

TRAINING_QUERIES = 200
BROADCAST_ROWS = 200_000  # rows up to which a table may be broadcast; its file's size tells little about them


class Workload:
    """Lazy tables of the fixture: events, selections, queries, and two layouts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def _merged(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, of at most the rows of table ``name``, to be merged in a join unless they are few."""
        return df if self.table(name).count() <= BROADCAST_ROWS else df.hint("merge")

    @cached_property
    def events(self) -> DataFrame:
        size = 100 * F.col("p_size") + F.round(F.col("p_retailprice") * 10).cast("long")
        return self.table("part").select(
            F.col("p_partkey").cast("long").alias("record_id"), F.col("p_brand").alias("brand_id"), F.col("p_type").alias("feature_type"), F.col("p_size").alias("feature_size"),
            size.cast("long").alias("compressed"), (4 * size).cast("long").alias("decompressed"),
        )

    @cached_property
    def selections(self) -> DataFrame:
        priority = F.substring("o_orderpriority", 1, 1).cast("int")
        query = ((F.year("o_orderdate") - 1995) * 60 + (F.month("o_orderdate") - 1) * 5 + priority - 1).cast("long")
        orders = self.table("orders").select("o_orderkey", query.alias("query_id"), priority.alias("priority"))
        part = self.table("part").where("p_size <= 30").select("p_partkey", (F.substring("p_brand", 7, 10).cast("int") % 5).alias("fifth"))
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        joined = lines.join(self._merged(orders, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self._merged(part, "part"), F.col("l_partkey") == F.col("p_partkey"))
        return joined.where(F.col("fifth") == F.col("priority") - 1).select(F.col("l_partkey").cast("long").alias("record_id"), "query_id").distinct()

    @cached_property
    def queries(self) -> DataFrame:
        month = F.floor(F.col("query_id") / 5).cast("int")
        kind = F.when(F.col("query_id") < TRAINING_QUERIES, "training").otherwise("validation")
        return self.selections.select("query_id").distinct().select("query_id", F.add_months(F.lit("1995-01-01").cast("date"), month).alias("query_time"), kind.alias("set_name"))

    @property
    def training(self) -> DataFrame:
        return self.selections.where(F.col("query_id") < TRAINING_QUERIES)

    @property
    def validation(self) -> DataFrame:
        return self.selections.where(F.col("query_id") >= TRAINING_QUERIES)

    @cached_property
    def n_events(self) -> int:
        return self.table("part").count()

    @cached_property
    def n_training(self) -> int:
        return self.training.select("query_id").distinct().count()

    @cached_property
    def size(self) -> int:
        """Events of a container."""
        return max(10, self.n_events // 40)

    @cached_property
    def insertion(self) -> DataFrame:
        return self.events.select(F.lit("insertion").alias("layout"), "record_id", layouts.insertion(self.size).alias("container_id"))

    @cached_property
    def by_brand(self) -> DataFrame:
        return layouts.sorted_packing(self.events, ["brand_id"], self.size).select(F.lit("brand").alias("layout"), "record_id", "container_id")

    @property
    def both(self) -> DataFrame:
        return self.insertion.unionByName(self.by_brand)

    @cached_property
    def containers(self) -> DataFrame:
        return replay.stats(self.both, self.events)

    @cached_property
    def activation(self) -> DataFrame:
        return replay.activation(self.both, self.selections)

    @cached_property
    def per_query(self) -> DataFrame:
        return replay.by_query(self.activation, self.containers, self.selections, self.events)
