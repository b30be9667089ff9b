import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import allocate, bitmaps, fitness, kpi, layouts, replay, search
from tessera.operators.ranking import position

random.seed(7)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, random.choice("abc"), random.randrange(6), 10 + i % 7, 50) for i in range(120)]
    log = {(random.randrange(120), q) for q in range(12) for _ in range(9)}
    e = spark.createDataFrame(rows, "record_id long, kind string, size int, compressed long, decompressed long").cache()
    s = spark.createDataFrame(sorted(log), "record_id long, query_id long").cache()
    return e, s, rows, log


def test_waste_is_the_same_three_ways(spark, small):
    e, s, rows, log = small
    lay = e.select(F.lit("x").alias("layout"), "record_id", layouts.insertion(7).alias("container_id")).unionByName(
        layouts.sorted_packing(e, ["kind"], 7).select(F.lit("y").alias("layout"), "record_id", "container_id")
    )
    c, a = replay.stats(lay, e), replay.activation(lay, s)
    per = replay.by_query(a, c, s, e)
    one = {r.layout: r.w for r in per.groupBy("layout").agg(F.sum("waste").alias("w")).collect()}
    two = {r.layout: r.w for r in replay.breadth(a, c).groupBy("layout").agg(F.sum("waste").alias("w")).collect()}
    three = {r.layout: r.w for r in replay.waste_cells(lay, s, a).groupBy("layout").agg(F.count("*").alias("w")).collect()}
    where = {"x": {r[0]: r[0] // 7 for r in rows}, "y": {i: k // 7 for k, i in enumerate(sorted(range(120), key=lambda i: (rows[i][1], i)))}}
    brute = {n: sum(1 for q in range(12) for i in range(120) if (i, q) not in log and any((j, q) in log for j in range(120) if m[j] == m[i])) for n, m in where.items()}
    assert one == two == three == brute
    assert c.agg(F.sum("n_events")).first()[0] == 240
    assert per.where("materialized < needed").count() == 0
    skip = replay.with_skip(per, e).first()
    assert skip.skip_events == pytest.approx(1 - skip.materialized / 120)
    split = replay.cost_split(per, e, spark.range(1).select(F.lit(12).alias("n_queries")), 0.1).where("layout = 'x'").first()
    assert split.total == pytest.approx(12 * 0.1 * 120 + len(log) + brute["x"])


def test_positions_and_packings(spark, small):
    e, _, rows, _ = small
    got = {r.record_id: r.position for r in position(e.select("record_id", "kind"), ["kind"], bucket=13).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(120), key=lambda i: (rows[i][1], i)))}
    each = layouts.equal_size(e, "kind", 10).groupBy("kind", "container").count().collect()
    assert all(r["count"] == 10 for r in each if r.container < max(x.container for x in each if x.kind == r.kind))
    even = layouts.split_evenly(e, "kind", e.select("kind").distinct().withColumn("k", F.lit(4))).groupBy("kind").agg(F.countDistinct("container").alias("n")).collect()
    assert all(r.n == 4 for r in even)
    cap = {r.record_id: r.container_id for r in layouts.byte_capped(e, 100, bucket=11).collect()}
    total = 0
    for i in range(120):
        assert cap[i] == total // 100
        total += rows[i][3]


def test_trees_are_columns(spark, small):
    e, *_ = small
    tree = layouts.Tree().replaced("r", layouts.Cut("size", ">", 2)).replaced("r0", layouts.Cut("kind", "=", "a"))
    assert sorted(tree.leaves()) == ["r00", "r01", "r1"]
    for r in e.withColumn("leaf", tree.column()).collect():
        assert r.leaf == ("r1" if r["size"] > 2 else "r01" if r.kind == "a" else "r00")
    assert e.select(layouts.ladder("size", [2, 4], ["low", "mid", "top"]).alias("x")).distinct().count() == 3
    with pytest.raises(ValueError):
        layouts.ladder("size", [2, 4], ["low", "mid"])
    multi = layouts.Tree(layouts.Cut("kind", "*"))
    assert {r.x for r in e.select(multi.column().alias("x")).distinct().collect()} == {"r/a", "r/b", "r/c"}


#: Goldens: groups as (events, usage), with their weighted Gini coefficient. Fixed values.
GINI = [
    ([(14, 15), (13, 14), (11, 12), (10, 10), (7, 7), (45, 42)], 0.0357),
    ([(8, 22), (7, 18), (7, 8), (6, 14), (6, 5), (66, 33)], 0.3782),
    ([(2, 12), (6, 10), (2, 12), (5, 6), (7, 8), (6, 14), (6, 5), (66, 33)], 0.4102),
    ([(24, 2), (20, 2), (18, 2), (16, 2), (12, 2), (10, 90)], 0.8112),
]


@pytest.mark.parametrize("groups, want", GINI)
def test_weighted_gini(spark, groups, want):
    df = spark.createDataFrame([(i, n, u) for i, (n, u) in enumerate(groups)], "g int, n long, usage long")
    assert fitness.weighted_gini(df).first().g == pytest.approx(want, abs=5e-5)


def test_gini_of_one_group_is_zero_and_lorenz_ends_at_one(spark):
    one = spark.createDataFrame([(0, 5, 9)], "g int, n long, usage long")
    assert fitness.weighted_gini(one).first().g == pytest.approx(0)
    df = spark.createDataFrame([(i, n, u) for i, (n, u) in enumerate(GINI[3][0])], "g int, n long, usage long")
    pts = fitness.lorenz(df, "g").orderBy("rank").collect()
    assert pts[-1].population == pytest.approx(1) and [round(100 * p.share) for p in pts] == [2, 4, 6, 8, 10, 100]


def test_scores_equal_dense_sums(spark, small):
    e, s, rows, log = small
    n, k = fitness.group_counts(e, s, "kind")
    kinds = {g: [r[0] for r in rows if r[1] == g] for g in "abc"}
    dense = [(len(m), sum((i, q) in log for i in m)) for m in kinds.values() for q in range(12)]
    for term, want in (
        (fitness.exact_term(5), lambda m, c: (1 - c / m) ** 5), (fitness.poisson_term(), lambda m, c: math.exp(-c)),
        (fitness.hypergeometric_term(5), lambda m, c: math.comb(m - c, 5) / math.comb(m, 5)),
    ):
        assert fitness.query_skip(n, k, "kind", 12, term).first().v == pytest.approx(sum(m / 120 * want(m, c) for m, c in dense) / 12)
    rated = fitness.rates(n, k, "kind", 12)
    p = rated.agg(F.sum(F.col("n") * F.col("p")) / 120).first()[0]
    assert p == pytest.approx(len(log) / 12 / 120)
    v = fitness.marginal_skip(rated, 5).first()
    assert v.v_exact == pytest.approx(sum(r.n / 120 * (1 - r.p) ** 5 for r in rated.collect()))


#: Goldens of the container ladders: group, events, selections of six queries, benefits. Fixed values.
LADDERS = [("yes", 80000, 2, [57323, 73604, 78351, 79584], [5427, 396, 26]), ("no", 400000, 9, [89252, 274916, 364204, 390734], [61888, 7441, 553])]


def test_ladders(spark):
    groups = spark.createDataFrame([(g, n, sum_k / 6 / n) for g, n, sum_k, _, _ in LADDERS], "group_id string, n long, p double")
    rungs = allocate.ladder(groups, 1000, options=[1, 4, 16, 64])
    steps = allocate.edges(rungs)
    for g, _, _, v, e in LADDERS:
        assert [round(r.v) for r in rungs.where(F.col("group_id") == g).orderBy("j").collect()] == pytest.approx(v, abs=1)
        assert [round(r.e) for r in steps.where(F.col("group_id") == g).orderBy("j").collect()] == pytest.approx(e, abs=1)
    taken = allocate.greedy(steps, 2, 96).orderBy("step").collect()
    assert [(r.group_id, r.j) for r in taken] == [("no", 0), ("no", 1), ("yes", 0), ("no", 2), ("yes", 1)] and taken[-1].spent == 80
    with pytest.raises(ValueError):
        allocate.greedy(steps, 2, 1)
    ratio = allocate.trace(steps, allocate.greedy(steps, 2, 96), rungs).orderBy("step").collect()
    assert all(a.skip_ratio < b.skip_ratio for a, b in zip(ratio, ratio[1:]))


def test_guardrails(spark):
    """Golden: 1600 events, 21 selected a query, floor 80, bar one half."""
    g = spark.createDataFrame([("g", 1600, 21 / 1600)], "group_id string, n long, p double")
    r = allocate.guarded(g, 80).first()
    assert (round(r.np), r.k_inflection, r.k_start, r.k_max) == (21, 10.5, 11, 20) and r.k_bar == pytest.approx(30.3, abs=0.05)
    assert r.skip_at_max == pytest.approx(0.350, abs=5e-4) and not r.allowed
    rungs = {x.k: x.v for x in allocate.ladder(g, 80, ratio=None).collect()}
    assert max(rungs) == 20 and rungs[11] == pytest.approx(237.1, abs=0.05) and rungs[20] == pytest.approx(559.9, abs=0.05)
    steps = allocate.edges(allocate.ladder(g, 80, ratio=None)).collect()
    assert max(steps, key=lambda s: s.e).k == 10
    assert allocate.concavity(allocate.edges(allocate.ladder(g, 80, ratio=None))).first().rising == 9


def test_greedy_never_beats_brute_force_and_meets_it_on_concave_unit_steps(spark):
    rnd = random.Random(3)
    groups = [(f"g{i}", rnd.randrange(20, 60), rnd.random() * 0.02) for i in range(3)]
    df = spark.createDataFrame(groups, "group_id string, n long, p double")
    rungs = allocate.ladder(df, 8, ratio=None)
    ladders = {}
    for r in rungs.orderBy("group_id", "j").collect():
        ladders.setdefault(r.group_id, []).append((r.k, r.v))
    for budget in (3, 5, 8):
        total = allocate.chosen(rungs, allocate.greedy(allocate.edges(rungs), 3, budget)).agg(F.sum("v")).first()[0]
        best = max(sum(v for _, v in c) for c in itertools.product(*ladders.values()) if sum(k for k, _ in c) <= budget)
        assert total <= best + 1e-9 and best == pytest.approx(allocate.brute_force(ladders, budget))
        if all(b - a >= c - b for vs in ladders.values() for (_, a), (_, b), (_, c) in zip(vs, vs[1:], vs[2:])):
            assert total == pytest.approx(best)


def test_search_finds_a_planted_cut(spark):
    e = spark.createDataFrame([(i, "hot" if i % 10 == 0 else "cold", i % 3) for i in range(200)], "record_id long, kind string, noise int").withColumn("compressed", F.lit(100).cast("long"))
    s = spark.createDataFrame([(i, q) for q in range(8) for i in range(0, 200, 10) if (i // 10 + q) % 2], "record_id long, query_id long")
    tree, cuts = search.greedy(e, s, ["kind", "noise"], 8, search.Bounds(max_leaves=3))
    assert cuts[0][2].column == "kind" and len(tree.leaves()) <= 3
    assert all(a[0] > 0 for a in cuts)
    no = search.Bounds(max_leaves=2, failed={cuts[0][2]})
    assert search.greedy(e, s, ["kind", "noise"], 8, no)[1][0][2] != cuts[0][2]
    beams = search.beam(e, s, ["kind", "noise"], 8, 2, search.Bounds(max_leaves=3))
    assert len(beams) == 2 and beams[0][0] >= beams[1][0] >= 0
    assert beams[0][0] >= sum(c[0] for c in cuts) - 1e-9
    gate = search.holdout(e, s, tree.column(), search.container_events(e, 2000), 0.5).first()
    assert gate.passed == (gate.mean_skip >= 0.5) and gate.mean_skip > 0.7
    rows = [r.asDict() for r in e.join(s.groupBy("record_id").count(), "record_id", "left").na.fill(0).collect()]
    value = lambda x: math.exp(-sum(r["count"] for r in x) / 8)
    assert search.optimum(rows, value, [layouts.Cut("kind", "=", "hot")], 1) > value(rows)


def test_failed_cuts_leave_room_in_every_leaf(spark):
    e = spark.createDataFrame([(i, "ab"[i % 2], "hot" if i % 10 < 2 else "cold", "xyz"[i // 10 % 3]) for i in range(240)], "record_id long, side string, kind string, noise string").withColumn("compressed", F.lit(100).cast("long"))
    s = spark.createDataFrame([(i, q) for q in range(8) for i in range(240) if i % 10 < 2 and i // 10 % 3 != q % 2], "record_id long, query_id long")
    tree = layouts.Tree()
    tree = tree.replaced(tree.leaves()[0], layouts.Cut("side", "=", "a"))
    failed = {layouts.Cut("kind", "=", v) for v in ("hot", "cold")}
    found = search.candidates(e, s, tree, ["kind", "noise"], 8, search.Bounds(failed=failed), 2)
    assert len(found) == 2 and {c.column for _, _, c in found} == {"noise"}


def test_bitmaps(spark, small):
    e, s, rows, log = small
    b = bitmaps.support(s)
    assert {r.record_id: r.demand for r in bitmaps.size(b).collect()} == {i: sum(x == i for x, _ in log) for i, _ in log}
    lay = e.select("record_id", layouts.insertion(7).alias("container_id"))
    got = {r.container_id: r.n or 0 for r in bitmaps.union(b, lay).groupBy("container_id").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    assert got == {c: len({q for i, q in log if i // 7 == c}) for c in range(18)}
    assert bitmaps.words(64) == 1 and bitmaps.words(65) == 2 and bitmaps.words(0) == 0
    assert bitmaps.restrict(s, spark.createDataFrame([(3,)], "query_id long")).select("query_id").distinct().count() == 1


def test_usage_map_has_totals(spark):
    tiles = spark.createDataFrame([("d", "a", 10, 1.0), ("d", "b", 30, 20.0), ("f", "c", 60, 5.0)], "grp string, tile_id string, size long, demand double")
    m = {(r.grp, r.tile_id): r for r in kpi.usage_map(tiles, 2.0, 11.7).collect()}
    assert len(m) == 6 and m[(None, None)]["size"] == 100 and m[("d", None)].kpi == pytest.approx(15.25)
    assert [m[k].band for k in (("d", "a"), ("d", "b"), ("f", "c"))] == ["cold", "hot", "warm"]


def test_net_advantage_counts_missing_queries(spark):
    base = spark.createDataFrame([(0, 10), (1, 5)], "query_id long, materialized long")
    other = spark.createDataFrame([(0, 4), (2, 1)], "query_id long, materialized long")
    r = replay.net_advantage(base, other, 2.0).first()
    assert (r.saved, r.net_advantage) == (10, 8.0)
