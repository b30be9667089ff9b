"""Small scenarios in one JSON document: events, queries, a log, and layouts with containers.

``{"events": [{"id", "attrs": [...]}], "queries": [{"id", "label"}], "selection_log": [{"record_id", "query_id"}],
"layouts": [{"key", "name", "caption", "containers": [{"tag", "labels": [...], "events": [...]}]}]}``
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import Provider

SCHEMA = (
    "events array<struct<id string, attrs array<string>>>, queries array<struct<id int, label string>>, selection_log array<struct<record_id string, query_id int>>, "
    "layouts array<struct<key string, name string, caption string, containers array<struct<tag int, labels array<string>, events array<string>>>>>"
)


@dataclass
class Scenario:
    events: DataFrame  # id, attrs
    queries: DataFrame  # id, label
    selections: DataFrame  # record_id, query_id
    layouts: DataFrame  # layout, container_id, labels, record_id


def from_document(doc: DataFrame) -> Scenario:
    """doc: one row, columns as in SCHEMA."""
    containers = doc.select(F.inline("layouts")).select(F.col("key").alias("layout"), F.inline("containers"))
    return Scenario(
        doc.select(F.inline("events")), doc.select(F.inline("queries")), doc.select(F.inline("selection_log")).distinct(),
        containers.select("layout", F.col("tag").alias("container_id"), "labels", F.explode("events").alias("record_id")),
    )


class Curated(Provider):
    """Settings: path of the JSON document."""

    kind = "curated"

    def make(self, spark: SparkSession) -> Scenario:
        return from_document(spark.read.schema(SCHEMA).json(self.settings["path"], multiLine=True))


def evaluate(s: Scenario) -> DataFrame:
    """layout, container_id, n_events, breadth, opened, needed, wasted per container, and a row per layout (container_id null) with its total and amplification."""
    size = s.layouts.groupBy("layout", "container_id").agg(F.count("*").alias("n_events"))
    met = s.layouts.join(s.selections, "record_id").groupBy("layout", "container_id").agg(F.countDistinct("query_id").alias("breadth"), F.count("*").alias("needed"))
    each = size.join(met, ["layout", "container_id"], "left").na.fill(0, ["breadth", "needed"])
    each = each.withColumn("opened", F.col("n_events") * F.col("breadth"))
    sums = each.groupBy("layout").agg(*[F.sum(c).alias(c) for c in ("n_events", "breadth", "opened", "needed")]).withColumn("container_id", F.lit(None).cast("int"))
    both = each.unionByName(sums)
    amp = F.when(F.col("needed") > 0, F.col("opened") / F.col("needed")).otherwise(0.0)
    return both.select("layout", "container_id", "n_events", "breadth", "opened", "needed", (F.col("opened") - F.col("needed")).alias("wasted"), amp.alias("amplification"))


def cell_states(s: Scenario) -> DataFrame:
    """layout, container_id, record_id, query_id, state of every cell: needed, wasted or skipped. For scenarios, which are small by nature."""
    grid = s.layouts.select("layout", "container_id", "record_id").join(F.broadcast(s.queries.select(F.col("id").alias("query_id"))))
    opened = s.layouts.join(s.selections, "record_id").select("layout", "container_id", "query_id", F.lit(True).alias("open")).distinct()
    needed = s.selections.withColumn("need", F.lit(True))
    out = grid.join(opened, ["layout", "container_id", "query_id"], "left").join(needed, ["record_id", "query_id"], "left")
    state = F.when(F.col("need").isNotNull(), "needed").when(F.col("open").isNotNull(), "wasted").otherwise("skipped")
    return out.select("layout", "container_id", "record_id", "query_id", state.alias("state"))
