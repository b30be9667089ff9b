import json

from pyspark.sql import functions as F

from tessera.sources import registry, scenario
from tessera.streaming.lakehouse import Lakehouse, advanced, collect_usage, file_ranges, may_hold, observed, observed_scan, slots


def rows(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("record_id"), (F.col("id") % 3).cast("string").alias("kind"), (F.col("id") * 2).alias("x"))


def test_slots_and_tracker(spark):
    batch = rows(spark, 0, 90).withColumn("group_key", F.col("kind"))
    before = spark.createDataFrame([("0", 4, 7)], "group_key string, k long, s_1 long")
    got = slots(batch, before, 10, F.col("record_id")).collect()
    for r in got:
        k, s = (4, 7) if r.kind == "0" else (1, 0)
        assert r.slot == s + r.record_id % 30 and r.seq == k + r.slot // 10
    after = {r.group_key: (r.k, r.s_1) for r in advanced(batch, before, 10).collect()}
    assert after == {"0": (7, 7), "1": (4, 0), "2": (4, 0)}


def test_batches_count_once_and_reads_are_pruned(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path), F.col("kind"), 20, ("kind",))
    lake.write(rows(spark, 0, 90), 0)
    lake.write(rows(spark, 90, 150), 1)
    n = lake.sink().count()
    lake.write(rows(spark, 90, 150), 1)
    assert n == lake.sink().count() == 150 == lake.index().agg(F.sum("n")).first()[0]
    assert {r.group_key: r.k * 20 + r.s_1 for r in lake.tracker().collect()} == {k: 20 + 50 for k in "012"}
    read = lake.read(F.col("kind") == "1")
    assert read.count() == 50
    assert "dynamicpruning" in read._jdf.queryExecution().toString().lower()
    rows(spark, 500, 510).write.parquet(f"{tmp_path}/sink/batch_id=9")
    assert lake.sink().count() == 150 and lake.clean() == [9]
    assert lake.compact(3) == 1 and lake.compacted().count() == 150
    files = lake.compacted().select("partition_id", F.col("_metadata.file_path").alias("f")).distinct().groupBy("partition_id").count()
    assert files.where("count > 1").count() == 0
    # reads go through the compacted version and what came after it
    lake.write(rows(spark, 150, 180), 2)
    assert lake.vacuum() == [0, 1] and lake.sink().count() == 180 and lake.read(F.col("kind") == "1").count() == 60
    files = lake.sink().inputFiles()
    assert any("/compact/v=1/" in f for f in files) and any("/sink/batch_id=2/" in f for f in files)
    assert lake.compact(3) == 2 and lake.sink().count() == 180 and lake.vacuum() == [2]


def test_stream_lands_and_splits(spark, tmp_path):
    src = rows(spark, 0, 60)
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    lake = Lakehouse(spark, f"{tmp_path}/lake", F.col("kind"), 10, ("kind",))
    lake.land(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/c1").awaitTermination()
    assert lake.recent().count() == 60
    read = lambda: spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/lake/landing")
    lake.run(read(), f"{tmp_path}/c2").awaitTermination()
    lake.run(read(), f"{tmp_path}/c2").awaitTermination()
    assert lake.sink().count() == 60 and lake.recent().count() == 60
    rows(spark, 60, 75).write.mode("append").parquet(f"{tmp_path}/in")
    lake.land(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/c1").awaitTermination()
    plan = lake.recent()
    assert sorted(r.record_id for r in plan.collect()) == list(range(75)) and "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_file_index_and_usage(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows(spark, 0, 100).repartitionByRange(5, "x").write.parquet(path)
    df = spark.read.parquet(path)
    ranges = file_ranges(df, "x")
    assert ranges.count() == 5 and may_hold(ranges, 10, 12).count() == 1 and may_hold(ranges, 0, 500).count() == 5
    o = observed(df, F.col("x") == 10).first()
    assert (o.files, o.kept, o.waste) == (1, 1, o["read"] - 1)
    opened = df.where(F.col("x") < 80)
    o = observed_scan(df, F.col("_metadata.file_path"), F.col("x") == 10).first()
    assert (o.files, o["read"], o.kept, o.waste) == (5, 100, 1, 99) and opened.count() == 40
    collect_usage(df.where("x < 10"), 3, f"{tmp_path}/log")
    collect_usage(df.where("x < 10"), 3, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 5


def test_scenarios(spark, tmp_path):
    doc = {
        "events": [{"id": x, "attrs": ["k"]} for x in "abcd"], "queries": [{"id": 0, "label": "p"}, {"id": 1, "label": "q"}],
        "selection_log": [{"record_id": "a", "query_id": 0}, {"record_id": "b", "query_id": 0}, {"record_id": "c", "query_id": 1}],
        "layouts": [{"key": "l", "name": "", "caption": "", "containers": [{"tag": 1, "labels": [], "events": ["a", "c"]}, {"tag": 2, "labels": [], "events": ["b", "d"]}]}],
    }
    (tmp_path / "s.json").write_text(json.dumps(doc))
    s = registry.provide(spark, "curated", {"path": str(tmp_path / "s.json")})
    got = {r.container_id: (r.breadth, r.opened, r.needed, r.wasted, r.amplification) for r in scenario.evaluate(s).collect()}
    assert got == {1: (2, 4, 2, 2, 2.0), 2: (1, 2, 1, 1, 2.0), None: (3, 6, 3, 3, 2.0)}
    states = {r.state: r.n for r in scenario.cell_states(s).groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert states == {"needed": 3, "wasted": 3, "skipped": 2}
