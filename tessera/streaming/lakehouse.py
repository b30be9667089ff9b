"""A layout in production: landing, splitting, container slots, an index, pruned reads and compaction.

Plain Parquet folders with a commit log. Every micro-batch writes its rows under ``batch_id=`` folders that it overwrites when it is
replayed, and its commit row comes last; readers only see committed batches, so a batch counts once however often it runs.

    root/landing                      every row, unsplit
    root/sink/batch_id=/partition_id= rows by container
    root/index/batch_id=              leaf features, group_key, partition_id, n
    root/tracker/batch_id=            group_key, k, s_1 after the batch
    root/landed/batch_id=             landing files whose rows the batch holds
    root/log/batch_id=                the commit
    root/compact/v=/bucket=           compacted containers; root/compact/current names the version and the batches in it

Reads take the compacted version and the batches committed since, so compaction is what a read meets; landed rows count as recent
until a committed batch names their file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.files import _fs, exists, read_text, write_text


LANDING = "__landing_file"


def slots(batch: DataFrame, tracker: DataFrame, capacity: int, identity: Column | None = None) -> DataFrame:
    """Adds n_batch, slot and seq. tracker: group_key, k, s_1; new groups start at k = 1, s_1 = 0.

    A row's slot is s_1 plus its identity's hash modulo the group's rows in the batch; rows may share a slot, so containers
    meet ``capacity`` on average only. Counts by group are summed map-side and joined, so a common group isn't one task.
    """
    identity = F.xxhash64("record_id") if identity is None else identity
    n = batch.groupBy("group_key").agg(F.count("*").alias("n_batch"))
    state = n.join(tracker.select("group_key", "k", "s_1"), "group_key", "left").select("group_key", "n_batch", F.coalesce("k", F.lit(1)).alias("k"), F.coalesce("s_1", F.lit(0)).alias("s_1"))
    slot = F.col("s_1") + F.pmod(identity, F.col("n_batch"))
    out = batch.join(state, "group_key").withColumn("slot", slot.cast("long"))
    return out.withColumn("seq", (F.col("k") + F.floor(F.col("slot") / capacity)).cast("long")).drop("k", "s_1")


def advanced(batch: DataFrame, tracker: DataFrame, capacity: int) -> DataFrame:
    """The tracker after a batch: k + (s_1 + N) div T, (s_1 + N) mod T."""
    n = batch.groupBy("group_key").agg(F.count("*").alias("n"))
    both = tracker.select("group_key", "k", "s_1").join(n, "group_key", "full")
    s = F.coalesce("s_1", F.lit(0)) + F.coalesce("n", F.lit(0))
    return both.select("group_key", (F.coalesce("k", F.lit(1)) + F.floor(s / capacity)).cast("long").alias("k"), (s % capacity).cast("long").alias("s_1"))


@dataclass
class Lakehouse:
    spark: SparkSession
    root: str
    key: Column  # leaf of the frozen tree: a Column of a row
    capacity: int
    features: tuple[str, ...] = ()

    def _committed(self) -> list[int]:
        return sorted(r.batch_id for r in self.spark.read.parquet(f"{self.root}/log").select("batch_id").distinct().collect()) if exists(self.spark, f"{self.root}/log") else []

    def _part(self, table: str, batches: list[int] | None = None) -> DataFrame | None:
        batches = self._committed() if batches is None else batches
        if not batches:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/batch_id={b}" for b in batches])

    def tracker(self) -> DataFrame:
        done = self._committed()
        if not done:
            return self.spark.createDataFrame([], "group_key string, k long, s_1 long")
        return self._part("tracker", [done[-1]]).select("group_key", "k", "s_1")

    def land(self, stream: DataFrame, checkpoint: str):
        """Appends every micro-batch unsplit, then stops: one tick of a scheduler."""
        return stream.writeStream.format("parquet").option("path", f"{self.root}/landing").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Splits, allocates and fans out one micro-batch; does nothing if it is committed already."""
        done = self._committed()
        if batch_id in done:
            return
        before = self.tracker()
        to = lambda table: f"{self.root}/{table}/batch_id={batch_id}"
        if LANDING in batch.columns:
            batch.select(F.element_at(F.split(F.col(LANDING), "/"), -1).alias("file")).distinct().write.mode("overwrite").parquet(to("landed"))
            batch = batch.drop(LANDING)
        keyed = batch.withColumn("group_key", self.key)
        placed = slots(keyed, before, self.capacity).withColumn("partition_id", F.concat_ws("-", "group_key", "seq"))
        rows = placed.drop("n_batch", "slot", "seq")
        rows.repartition("partition_id").write.mode("overwrite").partitionBy("partition_id").parquet(to("sink"))
        placed.groupBy(*self.features, "group_key", "partition_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(to("index"))
        advanced(keyed, before, self.capacity).write.mode("overwrite").parquet(to("tracker"))
        self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(to("log"))

    def run(self, stream: DataFrame, checkpoint: str):
        """One tick of the writer over a stream of landed rows. If it reads files as they are, batches name those that they hold."""
        self.clean()
        try:
            stream = stream.select("*", F.col("_metadata.file_path").alias(LANDING))
        except AnalysisException:
            pass  # no plain scan of files: ``recent`` tells rows apart by their identity then
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def clean(self) -> list[int]:
        """Drops what batches without a commit have left; returns their ids."""
        done, lost = set(self._committed()), set()
        for table in ("sink", "index", "tracker", "landed"):
            fs, p = _fs(self.spark, f"{self.root}/{table}")
            if fs.exists(p):
                for s in fs.listStatus(p):
                    name = s.getPath().getName()
                    if name.startswith("batch_id=") and int(name[9:]) not in done:
                        fs.delete(s.getPath(), True)
                        lost.add(int(name[9:]))
        return sorted(lost)

    def index(self) -> DataFrame:
        return self._part("index")

    def _pointer(self) -> dict | None:
        now = f"{self.root}/compact/current"
        return json.loads(read_text(self.spark, now)) if exists(self.spark, now) else None

    def sink(self) -> DataFrame | None:
        """All committed rows: the compacted version, if there is one, and the batches since."""
        now = self._pointer()
        if now is None:
            return self._part("sink")
        later = [b for b in self._committed() if b not in set(now["batches"])]
        old = self.compacted().drop("bucket")
        return old.unionByName(self._part("sink", later).drop("batch_id")) if later else old

    def read(self, predicate: Column) -> DataFrame:
        """Rows for which ``predicate`` (of indexed features) holds. The index gives the containers, and partition pruning at run time reads no other."""
        return self.scanned(predicate).where(predicate)

    def scanned(self, predicate: Column) -> DataFrame:
        """All rows of the containers that a read with ``predicate`` opens, those that it then throws away too."""
        hits = self.index().where(predicate).select("partition_id").distinct()
        return self.sink().join(hits, "partition_id", "left_semi")

    def recent(self) -> DataFrame:
        """Two tiers as one table: landed rows that no committed batch holds yet, and the sink."""
        landed = self.spark.read.parquet(f"{self.root}/landing")
        sunk = self.sink()
        if sunk is None:
            return landed
        known = [b for b in self._committed() if exists(self.spark, f"{self.root}/landed/batch_id={b}")]
        if not known:  # batches that were written by hand name no files
            new = landed.join(sunk.select("record_id"), "record_id", "left_anti")
        else:
            done = {r.file for r in self._part("landed", known).select("file").distinct().toLocalIterator()}
            files = [f for f in landed.inputFiles() if f.rpartition("/")[2] not in done]  # writers give files names that are unique
            new = self.spark.read.schema(landed.schema).parquet(*files) if files else landed.limit(0)
        return new.unionByName(sunk.select(*landed.columns))

    def compact(self, buckets: int = 8) -> int:
        """Rewrites all committed rows with one file per container, in disjoint buckets and one job, then points to the new version."""
        now = self._pointer()
        version = now["version"] + 1 if now else 1
        batches = self._committed()
        rows = self.sink()
        rows = rows.drop("batch_id") if "batch_id" in rows.columns else rows
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("partition_id"), F.lit(buckets)).cast("int"))
        rows.repartition("bucket", "partition_id").write.mode("overwrite").partitionBy("bucket", "partition_id").parquet(f"{self.root}/compact/v={version}")
        write_text(self.spark, f"{self.root}/compact/current", json.dumps({"version": version, "batches": batches}))
        return version

    def compacted(self) -> DataFrame:
        version = self._pointer()["version"]
        return self.spark.read.option("basePath", f"{self.root}/compact/v={version}").parquet(f"{self.root}/compact/v={version}")

    def vacuum(self) -> list[int]:
        """Deletes the sink's folders of batches that the compacted version holds, so that the cost of a read doesn't grow with the batches of all time; returns their ids."""
        now = self._pointer()
        gone = []
        for b in now["batches"] if now else []:
            fs, p = _fs(self.spark, f"{self.root}/sink/batch_id={b}")
            if fs.exists(p):
                fs.delete(p, True)
                gone.append(b)
        return gone


def file_ranges(df: DataFrame, column: str) -> DataFrame:
    """path, low, high, n of each file: a minimum and maximum index for any Parquet table."""
    return df.select(F.col("_metadata.file_path").alias("path"), column).groupBy("path").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))


def may_hold(ranges: DataFrame, low, high) -> DataFrame:
    """Containers whose range meets [low, high]: never fewer than those that hold a row."""
    return ranges.where((F.col("high") >= low) & (F.col("low") <= high))


def observed(df: DataFrame, kept: Column) -> DataFrame:
    """files, read, kept, waste of the files that hold a row that is kept: what an index that is never wrong would open."""
    return _cost(df.select(F.col("_metadata.file_path").alias("path"), kept.cast("long").alias("kept")), True)


def observed_scan(scanned: DataFrame, path: Column, kept: Column) -> DataFrame:
    """files, read, kept, waste of a scan as it was: every file that it opened counts, those too that hold no row that is kept (false positives)."""
    return _cost(scanned.select(path.alias("path"), kept.cast("long").alias("kept")), False)


def _cost(rows: DataFrame, only_kept: bool) -> DataFrame:
    each = rows.groupBy("path").agg(F.count("*").alias("read"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    return (each.where("kept > 0") if only_kept else each).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("read"), F.lit(0)).alias("read"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("read") - F.sum("kept"), F.lit(0)).alias("waste")
    )


def collect_usage(result: DataFrame, query_id: int, log_path: str, identity: str = "record_id") -> None:
    """Appends a query's result to the selection log; a query that is collected again replaces its rows."""
    result.select(F.col(identity).cast("long").alias("record_id")).distinct().write.mode("overwrite").parquet(f"{log_path}/query_id={query_id}")
