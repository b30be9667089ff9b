"""Foreign corpora: string keys, own features, some blob pairs. Ids are minted in table order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import contract
from ..corpus import Corpus, corpus
from . import files
from .registry import Provider


def _minted(df: DataFrame, key: str, table: str) -> DataFrame:
    """Rows with dense ids for ``key``, which stays as ``_source_<key>``. df: with __row."""
    if key not in df.columns:
        raise contract.ContractViolation(f"{table}: column {key} is missing")
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).orderBy(key).limit(1).collect()
    if bad:
        raise contract.ContractViolation(f"{table}: duplicate or missing {key} {bad[0][0]!r}")
    hidden = "_source_record_key" if key == "record_id" else "_source_query_key"
    return df.select(F.col("__row").alias(key), F.col(key).cast("string").alias(hidden), *[c for c in df.columns if c not in (key, "__row")])


def rekey(events: DataFrame, queries: DataFrame, selections: DataFrame) -> Corpus:
    """events and queries have ``__row``, their place in the table; the log refers to foreign keys.

    A log row whose event or query isn't there is a violation.
    """
    for table, df in (("events", events), ("queries", queries), ("selections", selections)):
        contract.check_columns(table, df.columns)
    e, q = _minted(events, "record_id", "events"), _minted(queries, "query_id", "queries")
    log = selections.select(F.col("record_id").cast("string").alias("__e"), F.col("query_id").cast("string").alias("__q")).distinct()
    joined = log.join(e.select("record_id", "_source_record_key"), F.col("__e") == F.col("_source_record_key"), "left").join(
        q.select("query_id", "_source_query_key"), F.col("__q") == F.col("_source_query_key"), "left"
    )
    lost = joined.where("record_id IS NULL OR query_id IS NULL").limit(1).collect()
    if lost:
        raise contract.ContractViolation(f"selections: ({lost[0]['__e']}, {lost[0]['__q']}) isn't a known event and query")
    return corpus(e, q, joined.select("record_id", "query_id"))


class External(Provider):
    """Settings: source (folder with events, queries and selections as CSV or Parquet) and format."""

    kind = "external"

    def make(self, spark: SparkSession) -> Corpus:
        source, form = self.settings["source"], self.settings.get("format", "csv")
        suffix = f".{form}" if files.exists(spark, f"{source}/events.{form}") else ""
        for name in files.TABLES:
            if not files.exists(spark, f"{source}/{name}{suffix}"):
                raise contract.ContractViolation(f"{name}: {source}/{name}{suffix} is missing")
        e, q = (files.numbered(spark, f"{source}/{n}{suffix}", form) for n in ("events", "queries"))
        log = spark.read.option("header", True).csv(f"{source}/selections{suffix}") if form == "csv" else spark.read.parquet(f"{source}/selections{suffix}")
        return rekey(e, q, log)
