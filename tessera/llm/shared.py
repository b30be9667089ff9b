"""Tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so
a lost executor costs the reading of some files and not the work behind them. Only where that
setting is missing and the master is local (tests, a laptop) a temporary folder takes its place; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    return _fallback


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_late(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        pass


class SharedTable:
    """A Parquet table written once; ``read`` scans it, ``drop`` removes its files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/tessera/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema
        atexit.register(_delete_late, self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Only for tables that no returned DataFrame reads any more."""
        _delete(self.spark, self.path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once an application, so that they need no installed copy."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
