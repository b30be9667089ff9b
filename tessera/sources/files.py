"""Corpora on disk: tables of events, queries and selections, and a manifest written last.

The manifest marks a corpus as complete and keeps what is dear to compute: the selected bytes of each query,
the profile of the features as the *written* table has them, and a hash of each table.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import contract
from ..corpus import Corpus, corpus
from ..operators import bitmaps
from ..operators.ranking import file_order

TABLES = ("events", "queries", "selections")


def dataset_id(config: dict) -> str:
    """The same for the same parameters, in any order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def content_hash(spark: SparkSession, path: str) -> str:
    """Of all files below a table's folder, in order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    each = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: x["h"]), ""), 256).alias("h")).first().h[:16]


def selected_bytes(c: Corpus) -> DataFrame:
    """query_id, n_selected, compressed, decompressed; queries that select nothing have zeros."""
    sums = c.selections.join(c.events.select("record_id", "compressed", "decompressed"), "record_id").groupBy("query_id")
    sums = sums.agg(F.count("*").alias("n_selected"), F.sum("compressed").alias("compressed"), F.sum("decompressed").alias("decompressed"))
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_selected", "compressed", "decompressed")]
    return c.queries.select("query_id").join(sums, "query_id", "left").select("query_id", *zero)


def save(c: Corpus, path: str, provider: str, config: dict, form: str = "parquet") -> str:
    """Writes a corpus; its manifest comes last. Returns the path."""
    spark = c.events.sparkSession
    plain = c.events.drop("compressed", "decompressed")
    for name, df in (("events", plain), ("queries", c.queries), ("selections", c.selections)):
        w = df.write.mode("overwrite")
        (w.option("header", True).csv if form == "csv" else w.parquet)(f"{path}/{name}")
    written = load(spark, path, form, check=False, manifest=False)
    selected_bytes(written).write.mode("overwrite").parquet(f"{path}/selected_bytes")
    counts = {name: getattr(written, name).count() for name in TABLES}
    manifest = {
        "dataset_id": dataset_id({"provider": provider, **config}), "provider": provider, "config": config, "format": form,
        "event_count": counts["events"], "query_count": counts["queries"], "selection_log_rows": counts["selections"],
        "feature_columns": [r.asDict(recursive=True) for r in contract.profile(written.events, written.roles.feature).orderBy("name").collect()],
        "file_hashes": {name: content_hash(spark, f"{path}/{name}") for name in TABLES},
    }
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1, default=str))
    return path


def _table(spark: SparkSession, path: str, name: str, form: str) -> DataFrame:
    full = f"{path}/{name}"
    if not exists(spark, full):
        raise contract.ContractViolation(f"{name}: {full} is missing")
    if form == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(full)
    return spark.read.parquet(full)


def load(spark: SparkSession, path: str, form: str | None = None, check: bool = True, manifest: bool = True) -> Corpus:
    """Reads and checks a corpus. CSV types are those of the file: a date written as text is temporal again."""
    about: dict = {}
    if manifest:
        if not exists(spark, f"{path}/manifest.json"):
            raise contract.ContractViolation(f"manifest: {path}/manifest.json is missing")
        about = json.loads(read_text(spark, f"{path}/manifest.json"))
    form = form or about.get("format", "parquet")
    events, queries, selections = (_table(spark, path, name, form) for name in TABLES)
    return corpus(events, queries, selections, check, dataset_id=about.get("dataset_id", ""), features=tuple(about.get("feature_columns", [])))


def selected_bytes_of(spark: SparkSession, path: str, c: Corpus) -> DataFrame:
    """The cached table if there is one, else computed."""
    return spark.read.parquet(f"{path}/selected_bytes") if exists(spark, f"{path}/selected_bytes") else selected_bytes(c)


def support_of(spark: SparkSession, path: str, selections: DataFrame) -> DataFrame:
    """The packed supports that are stored beside a corpus; built from the log and stored if there are none, or none whole."""
    full = f"{path}/support"
    if not exists(spark, f"{full}/_SUCCESS"):
        bitmaps.support(selections).write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)


def numbered(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """A foreign table and ``__row``, its rows' number in the order of its files."""
    reader = spark.read.option("header", True).option("inferSchema", True)
    return file_order(reader.csv(path) if form == "csv" else spark.read.parquet(path), "__row")
