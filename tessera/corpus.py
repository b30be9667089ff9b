"""A corpus: events, queries and the selection log, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from . import contract


@dataclass
class Corpus:
    """events: record_id, features, sizes and the totals ``compressed`` and ``decompressed``; queries: query_id, query_time, set_name; selections: a set of (record_id, query_id)."""

    events: DataFrame
    queries: DataFrame
    selections: DataFrame
    roles: contract.Roles
    dataset_id: str = ""
    features: tuple = ()

    @property
    def feature_summary(self) -> list:
        return list(self.features)

    def features_only(self) -> DataFrame:
        return self.events.select("record_id", *self.roles.feature)

    def query_sets(self, name: str) -> DataFrame:
        """Queries of ``training`` or ``validation``, or ``all``."""
        if name == "all":
            return self.queries
        if name not in contract.SETS:
            raise ValueError(f"{name!r} is neither all nor one of {contract.SETS}")
        return self.queries.where(F.col("set_name") == name)

    def visible(self, name: str) -> DataFrame:
        """Selections of the queries of a set."""
        return self.selections.join(self.query_sets(name).select("query_id"), "query_id", "left_semi")

    def query_period(self) -> DataFrame:
        return self.queries.select("query_id", F.date_format("query_time", "yyyy-MM").alias("month"))


def total(columns: tuple[str, ...]):
    """Row-wise sum of size columns."""
    return reduce(add, [F.col(c).cast("long") for c in columns], F.lit(0).cast("long"))


def corpus(events: DataFrame, queries: DataFrame, selections: DataFrame, check: bool = True, **kept) -> Corpus:
    """Casts keys, sums sizes and makes the log a set."""
    for table, df in (("events", events), ("queries", queries), ("selections", selections)):
        contract.check_columns(table, df.columns)
    events = events.withColumn("record_id", F.col("record_id").cast("long"))
    queries = queries.withColumn("query_id", F.col("query_id").cast("long")).withColumn("query_time", F.to_date("query_time"))
    selections = selections.select(F.col("record_id").cast("long").alias("record_id"), F.col("query_id").cast("long").alias("query_id")).dropDuplicates()
    roles = contract.validate(events, queries, selections) if check else contract.classify(events.columns)
    return Corpus(events.withColumns({"compressed": total(roles.compressed), "decompressed": total(roles.decompressed)}), queries, selections, roles, **kept)


def fingerprint(c: Corpus) -> tuple:
    """Equal for corpora that hold the same data in any order and under any event ids that keep supports."""
    demand = c.events.select("record_id").join(c.selections, "record_id", "left").groupBy("record_id").agg(F.count("query_id").alias("d"))
    per_query = c.queries.join(c.selections.join(c.events, "record_id"), "query_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("compressed"), F.lit(0)).alias("b"))
    size = c.events.agg(F.count("*"), F.sum("compressed"), F.sum("decompressed")).first()
    by_demand = demand.groupBy("d").count().agg(F.sum(F.xxhash64("d", "count").cast("decimal(38,0)")), F.count("*")).first()
    by_bytes = per_query.groupBy("b").count().agg(F.sum(F.xxhash64("b", "count").cast("decimal(38,0)")), F.count("*")).first()
    return (*size, *by_demand, *by_bytes)
