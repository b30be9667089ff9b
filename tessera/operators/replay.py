"""Replaying a workload against a layout: activation, materialised volume, skipping and waste.

Layouts are (record_id, container_id); several are compared in one plan as rows with a ``layout`` column,
so the log is joined once. Nothing is made dense: a container and a query that don't meet have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CELL_QUERIES = 4096  # query ids that one array of a container's queries spans


def stats(layout: DataFrame, events: DataFrame) -> DataFrame:
    """layout, container_id, n_events, compressed, decompressed."""
    sizes = events.select("record_id", "compressed", "decompressed")
    return layout.join(sizes, "record_id").groupBy("layout", "container_id").agg(
        F.count("*").alias("n_events"), F.sum("compressed").alias("compressed"), F.sum("decompressed").alias("decompressed")
    )


def size_range(layout: DataFrame, events: DataFrame) -> DataFrame:
    """layout, container_id, least, most: compressed sizes of a container's smallest and largest event."""
    return layout.join(events.select("record_id", "compressed"), "record_id").groupBy("layout", "container_id").agg(F.min("compressed").alias("least"), F.max("compressed").alias("most"))


def activation(layout: DataFrame, selections: DataFrame) -> DataFrame:
    """layout, container_id, query_id, needed: which containers a query opens, and how many of their events it selects."""
    return layout.hint("merge").join(selections, "record_id").groupBy("layout", "container_id", "query_id").agg(F.count("*").alias("needed"))


def breadth(activated: DataFrame, containers: DataFrame) -> DataFrame:
    """layout, container_id, n_events, breadth, opened, needed, waste; containers that no query opens have zeros."""
    each = activated.groupBy("layout", "container_id").agg(F.count("*").alias("breadth"), F.sum("needed").alias("needed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = containers.join(each, ["layout", "container_id"], "left").select("layout", "container_id", "n_events", zero("breadth"), zero("needed"))
    opened = F.col("n_events") * F.col("breadth")
    return out.select("layout", "container_id", "n_events", "breadth", opened.alias("opened"), "needed", (opened - F.col("needed")).alias("waste"))


def by_query(activated: DataFrame, containers: DataFrame, selections: DataFrame, events: DataFrame) -> DataFrame:
    """layout, query_id, materialized, materialized_bytes, needed, needed_bytes, waste, waste_bytes."""
    opened = activated.join(containers.select("layout", "container_id", "n_events", "compressed"), ["layout", "container_id"])
    m = opened.groupBy("layout", "query_id").agg(F.sum("n_events").alias("materialized"), F.sum("compressed").alias("materialized_bytes"), F.sum("needed").alias("needed"))
    b = selections.join(events.select("record_id", "compressed"), "record_id").groupBy("query_id").agg(F.sum("compressed").alias("needed_bytes"))
    out = m.join(b, "query_id")
    return out.select(
        "layout", "query_id", "materialized", "materialized_bytes", "needed", "needed_bytes",
        (F.col("materialized") - F.col("needed")).alias("waste"), (F.col("materialized_bytes") - F.col("needed_bytes")).alias("waste_bytes"),
    )


def with_skip(per_query: DataFrame, events: DataFrame) -> DataFrame:
    """Adds skip_events and skip_bytes: the share of the corpus that a query doesn't read."""
    whole = events.agg(F.count("*").alias("n_all"), F.sum("compressed").alias("b_all"))
    out = per_query.join(F.broadcast(whole))
    return out.withColumns({"skip_events": 1 - F.col("materialized") / F.col("n_all"), "skip_bytes": 1 - F.col("materialized_bytes") / F.col("b_all")})


def cost_split(per_query: DataFrame, events: DataFrame, n_queries: DataFrame, index_ratio: float) -> DataFrame:
    """layout, index_cost, needed, waste, total: reading the index for each query, what is needed, what is wasted."""
    whole = events.agg(F.count("*").alias("n_all"))
    sums = per_query.groupBy("layout").agg(F.sum("needed").alias("needed"), F.sum("waste").alias("waste"))
    out = sums.join(F.broadcast(whole)).join(F.broadcast(n_queries))
    index = F.col("n_queries") * F.lit(index_ratio) * F.col("n_all")
    return out.select("layout", index.alias("index_cost"), "needed", "waste", (index + F.col("needed") + F.col("waste")).alias("total"))


def pays(skip: Column, index_ratio: float) -> Column:
    """Whether reading the index is worth it."""
    return skip > F.lit(index_ratio)


def net_advantage(base: DataFrame, other: DataFrame, extra_cost: Column | float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Volume that ``other`` saves against ``base`` per query (query_id, materialized and perhaps ``by``), less what it costs more to keep."""
    by = by or []
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = base.select("query_id", *by, F.col("materialized").alias("b")).join(other.select("query_id", *by, F.col("materialized").alias("o")), ["query_id", *by], "full")
    cost = extra_cost if isinstance(extra_cost, Column) else F.lit(extra_cost)
    return both.groupBy(*by).agg((F.sum(zero("b")) - F.sum(zero("o"))).alias("saved")).withColumn("net_advantage", F.col("saved") - cost)


def waste_cells(layout: DataFrame, selections: DataFrame, activated: DataFrame) -> DataFrame:
    """layout, container_id, record_id, query_id read but not selected: the materialised matrix less the support. As many rows as waste.

    An event's own queries go along with it as one array, and its container's come as arrays of bounded length; cells are made last, and none is shuffled."""
    own = selections.groupBy("record_id").agg(F.collect_set("query_id").alias("own"))
    placed = layout.select("layout", "container_id", "record_id").hint("merge").join(own.hint("merge"), "record_id", "left")
    part = F.floor(F.col("query_id") / CELL_QUERIES)
    read = activated.groupBy("layout", "container_id", part.alias("part")).agg(F.collect_list("query_id").alias("read")).drop("part")
    left = F.when(F.col("own").isNull(), F.col("read")).otherwise(F.array_except("read", "own"))
    return placed.join(read, ["layout", "container_id"]).select("layout", "container_id", "record_id", F.explode(left).alias("query_id"))


def health(containers: DataFrame, least: int, most: int) -> DataFrame:
    """Sizes of a layout's containers against bounds."""
    return containers.groupBy("layout").agg(
        F.count("*").alias("n_containers"), F.percentile("n_events", F.lit(0.5)).alias("median_events"),
        F.count_if(F.col("n_events") < least).alias("below"), F.count_if(F.col("n_events") > most).alias("above"),
    )
