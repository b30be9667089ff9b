import os

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tessera.operators import bitmaps
from tessera.plans import catalog
from tessera.sources import synthetic

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: Golden values of the fixture workload at the smallest scale: volume read, waste in events and bytes, mean skipping.
GOLDEN = {"insertion": (7140, 6393, 73176599, 0.878983), "brand": (6530, 5783, 66581347, 0.889322)}


def test_fixture_workload(spark):
    rows = {r.layout: r for r in catalog.QUERIES["layout_compare"](spark, SF).collect()}
    waste = {r.layout: r for r in catalog.QUERIES["aggregate_waste"](spark, SF).collect()}
    for name, (m, w, b, skip) in GOLDEN.items():
        assert (rows[name].materialized, rows[name].waste, waste[name].waste, waste[name].waste_bytes) == (m, w, w, b)
        assert rows[name].mean_skip == pytest.approx(skip, abs=1e-6)
    d = catalog.QUERIES["corpus_describe"](spark, SF).first()
    assert (d.n_events, d.n_queries, d.n_selections, d.n_never, d.n_cold) == (200, 295, 747, 67, 10)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_or_is_known_to_have_none():
    none = {"greedy_tree", "greedy_alloc", "mckp_trace", "synthetic_profile", "stream_landing"}
    assert set(catalog.QUERIES) - set(catalog.SQL) == none and set(catalog.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["waste_by_query", "waste_by_container", "skip_ratio", "v_query_exact", "weighted_gini", "cut_statistics", "holdout_gate", "upgrade_edges", "usage_map", "bitmap_union", "feature_summary"])
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(cell(r[x]) for x in cols) for r in df.collect())
    want = sorted(tuple(map(cell, r)) for r in c.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize(
    "name",
    ["guarded_ladder", "spend_curve", "multiway_cuts", "cuts_by_gini", "cuts_by_query_skip", "corpus_shares", "arrival_ids", "arrival_faults", "rekeyed_log", "csv_corpus", "stored_support", "container_size_range", "top_values_shares", "tracker_carried", "observed_cost", "compacted_read", "two_tier_read", "stream_types"],
)
def test_further_queries_agree_with_their_sql(spark, name):
    test_queries_agree_with_their_sql(spark, name)


@pytest.mark.parametrize("name", ["scenario_evaluate_all", "bitmap_unpack_all"])
def test_whole_queries_leave_no_id_out(spark, name):
    test_queries_agree_with_their_sql(spark, name)
    d = catalog.QUERIES["corpus_describe"](spark, SF).first()
    df = catalog.QUERIES[name](spark, SF)
    if name == "bitmap_unpack_all":
        assert df.count() == d.n_selections and df.select("query_id").distinct().count() == d.n_queries
    else:
        total = df.where("container_id IS NULL").first()
        assert (total.n_events, total.needed) == (d.n_events, d.n_selections)


def test_bits_of_all_buckets_are_unpacked(spark):
    rows = [(i, q) for i in (1, 2) for q in (-40000, -2, -1, 0, 1, 7, 8, 63, 32767, 32768, 70000) if (i + q) % 3]
    s = spark.createDataFrame(rows, "record_id long, query_id long")
    assert sorted(tuple(r) for r in bitmaps.unpack_all(bitmaps.support(s)).collect()) == sorted(rows)


def test_synthetic_profile_is_of_the_default_corpus(spark, monkeypatch):
    seen, made = [], synthetic.events
    monkeypatch.setattr(synthetic, "events", lambda s, c: seen.append(c) or made(s, c))
    catalog.QUERIES["synthetic_profile"](spark, SF)
    assert seen == [synthetic.Config()]


def test_replay_plans_prune_columns(spark):
    plan = catalog.QUERIES["never_selected"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "p_comment" not in plan and "CartesianProduct" not in plan


def test_no_table_of_events_is_broadcast(spark, monkeypatch):
    """Small files can hold more rows than the driver: cuts merge events with the log, and so does the log itself beyond a number of rows."""
    from tessera.operators import search
    from tessera.plans import workload

    monkeypatch.setattr(workload, "BROADCAST_ROWS", 0)
    w = workload.Workload(spark, SF)
    events = w.events.withColumn("leaf", F.lit("r"))
    for df in (w.selections, search.cut_statistics(events, w.training, catalog.FEATURES), search.query_gains(events, w.training, catalog.FEATURES, 10).where("n > 0")):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "[leaf" not in x]
        assert not joins


def test_cells_are_made_after_the_last_shuffle(spark, monkeypatch):
    from tessera.operators import replay

    monkeypatch.setattr(replay, "CELL_QUERIES", 2)  # a container's queries in several arrays
    layout = spark.createDataFrame([("x", i % 2, i) for i in range(6)], "layout string, container_id long, record_id long")
    log = {(0, 0), (0, 5), (2, 1), (1, 3), (3, 3), (5, 9)}
    s = spark.createDataFrame(sorted(log), "record_id long, query_id long")
    cells = replay.waste_cells(layout, s, replay.activation(layout, s))
    opened = {(i % 2, q) for i, q in log}
    assert sorted((r.record_id, r.query_id) for r in cells.collect()) == sorted((i, q) for i in range(6) for c, q in opened if i % 2 == c and (i, q) not in log)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.index("Generate explode") < plan.index("Exchange")


def test_supports_end_with_their_last_query(spark):
    """4 kB for each event would be sorted and moved otherwise, whatever it holds."""
    rows = [(i, q) for i in range(50) for q in {i, 3 * i, 40000 + i}]
    s = spark.createDataFrame(rows * 2, "record_id long, query_id long")
    got = {(r.record_id, r.bucket): bytes(r.bits) for r in bitmaps.support(s).collect()}
    q = F.col("query_id") + 1
    whole = s.groupBy("record_id", F.bitmap_bucket_number(q).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(q)).alias("bits"))
    assert got == {(r.record_id, r.bucket): bytes(r.bits).rstrip(b"\0") for r in whole.collect()}
    assert max(len(b) for (_, bucket), b in got.items() if bucket == 1) == 147 // 8 + 1
