"""Search for a split tree: all candidate cuts of all leaves are scored in one job a round."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from ..contract import admits
from .layouts import Cut, Tree, equal_size
from .settled import settled


def cut_statistics(events: DataFrame, selections: DataFrame, features: list[str], leaf: str = "leaf") -> DataFrame:
    """leaf, feature, value, n, k_total, touch and, by query, what scoring needs: one unpivot, one join, for every multi-way and equality cut."""
    n = unpivoted(events, features, leaf).groupBy(leaf, "feature", "value").agg(F.count("*").alias("n"))
    per_query = met(events, selections, features, leaf).groupBy(leaf, "feature", "value", "query_id").agg(F.count("*").alias("k"))
    k = per_query.groupBy(leaf, "feature", "value").agg(F.sum("k").alias("k_total"), F.count("*").alias("touch"))
    return n.join(k.hint("merge"), [leaf, "feature", "value"], "left").select(leaf, "feature", "value", "n", F.coalesce("k_total", F.lit(0)).alias("k_total"), F.coalesce("touch", F.lit(0)).alias("touch"))


def unpivoted(events: DataFrame, features: list[str], leaf: str = "leaf", key: str = "record_id") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    return events.select(key, leaf, F.inline(cells))


def met(events: DataFrame, selections: DataFrame, features: list[str], leaf: str = "leaf") -> DataFrame:
    """query_id, leaf, feature, value: a row for each selection and feature. Events are unpivoted after the join, and merged with the log: their file's size
    tells little about their number, so a broadcast that is planned by it may not fit the driver."""
    return unpivoted(selections.join(events.select("record_id", leaf, *features).hint("merge"), "record_id"), features, leaf, "query_id")


def equality_gains(stats: DataFrame, n_queries: int, leaf: str = "leaf") -> DataFrame:
    """leaf, feature, value, n, gain: rise of the group-wide Poisson skip if ``feature = value`` is cut off from its leaf's rest.

    With w = n/N and rate k/Q, a side contributes ``n exp(-k / Q)``, in events.
    """
    q = F.lit(float(n_queries))
    whole = W.partitionBy(leaf, "feature")
    s = stats.withColumns({"n_leaf": F.sum("n").over(whole), "k_leaf": F.sum("k_total").over(whole)})
    side = lambda n, k: n * F.exp(-k / q)
    n, k, nl, kl = (F.col(c) for c in ("n", "k_total", "n_leaf", "k_leaf"))
    return s.where(n < nl).select(leaf, "feature", "value", "n", (side(n, k) + side(nl - n, kl - k) - side(nl, kl)).alias("gain"))


def threshold_gains(stats: DataFrame, n_queries: int, leaf: str = "leaf") -> DataFrame:
    """leaf, feature, value, n, gain of ``feature > value`` for numeric features: running sums over the ordered values."""
    q = F.lit(float(n_queries))
    whole = W.partitionBy(leaf, "feature")
    upto = whole.orderBy(F.col("value").cast("double")).rowsBetween(W.unboundedPreceding, W.currentRow)
    s = stats.withColumns({"n_leaf": F.sum("n").over(whole), "k_leaf": F.sum("k_total").over(whole), "n_low": F.sum("n").over(upto), "k_low": F.sum("k_total").over(upto)})
    side = lambda n, k: n * F.exp(-k / q)
    nl, kl, n0, k0 = (F.col(c) for c in ("n_leaf", "k_leaf", "n_low", "k_low"))
    return s.where(n0 < nl).select(leaf, "feature", "value", (nl - n0).alias("n"), (side(n0, k0) + side(nl - n0, kl - k0) - side(nl, kl)).alias("gain"))


def multiway_gains(stats: DataFrame, n_queries: int, leaf: str = "leaf") -> DataFrame:
    """leaf, feature, n_children, n, gain of cutting a leaf into one child for each value of a feature. n: the smallest child."""
    q = F.lit(float(n_queries))
    children = stats.groupBy(leaf, "feature").agg(
        F.count("*").alias("n_children"), F.min("n").alias("n"), F.sum(F.col("n") * F.exp(-F.col("k_total") / q)).alias("v"), F.sum("n").alias("nl"), F.sum("k_total").alias("kl")
    )
    return children.where("n_children > 1").select(leaf, "feature", "n_children", "n", (F.col("v") - F.col("nl") * F.exp(-F.col("kl") / q)).alias("gain"))


def gini_gains(stats: DataFrame, leaf: str = "leaf") -> DataFrame:
    """leaf, feature, value, n, gain: the weighted Gini coefficient of ``feature = value`` and its leaf's rest. Of two groups it is |w - q|, the shares of events and of usage."""
    whole = W.partitionBy(leaf, "feature")
    s = stats.withColumns({"n_leaf": F.sum("n").over(whole), "k_leaf": F.sum("k_total").over(whole)})
    gain = F.when(F.col("k_leaf") > 0, F.abs(F.col("n") / F.col("n_leaf") - F.col("k_total") / F.col("k_leaf"))).otherwise(0.0)
    return s.where("n < n_leaf").select(leaf, "feature", "value", "n", gain.alias("gain"))


def query_gains(events: DataFrame, selections: DataFrame, features: list[str], n_queries: int, leaf: str = "leaf") -> DataFrame:
    """leaf, feature, value, n, gain by the query-conditional Poisson skip: a side of n events contributes ``n`` times the mean over queries of ``exp(-k)``.

    Queries that don't touch a value keep their leaf's term, so only pairs of a value and a query that meet are made.
    """
    q = F.lit(float(n_queries))
    n = unpivoted(events, features, leaf).groupBy(leaf, "feature", "value").agg(F.count("*").alias("n"))
    of_leaf = selections.join(events.select("record_id", leaf).hint("merge"), "record_id").groupBy(leaf, "query_id").agg(F.count("*").alias("kq"))
    base = of_leaf.groupBy(leaf).agg((q - F.count("*") + F.sum(F.exp(-F.col("kq").cast("double")))).alias("s_leaf"))
    each = met(events, selections, features, leaf).groupBy(leaf, "feature", "value", "query_id").agg(F.count("*").alias("k")).join(of_leaf.hint("merge"), [leaf, "query_id"])
    k, kq = F.col("k").cast("double"), F.col("kq").cast("double")
    sums = each.groupBy(leaf, "feature", "value").agg(F.count("*").alias("touch"), F.sum(F.exp(-k)).alias("inside"), F.sum(F.exp(k - kq) - F.exp(-kq)).alias("more"))
    whole = W.partitionBy(leaf, "feature")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = n.withColumn("n_leaf", F.sum("n").over(whole)).join(sums.hint("merge"), [leaf, "feature", "value"], "left").join(base, leaf, "left")
    s_leaf = F.coalesce("s_leaf", q)
    gain = (F.col("n") * (zero("inside") + q - zero("touch")) + (F.col("n_leaf") - F.col("n")) * (s_leaf + zero("more")) - F.col("n_leaf") * s_leaf) / q
    return s.where("n < n_leaf").select(leaf, "feature", "value", "n", gain.alias("gain"))


@dataclass
class Bounds:
    max_leaves: int = 16
    min_events: int = 2
    min_gain: float = 0.0
    max_jobs: int = 100
    max_seconds: float = float("inf")
    failed: set[Cut] = field(default_factory=set)  # cuts that a holdout gate turned down
    scorer: str = "rate"  # or "gini", "query": by which formula cuts are scored
    multiway: bool = False  # whether a leaf may be cut into one child a value; such children aren't cut further


def candidates(events: DataFrame, selections: DataFrame, tree: Tree, features: list[str], n_queries: int, bounds: Bounds, most: int) -> list[tuple[float, str, Cut]]:
    """The ``most`` best cuts of any leaf: gain, leaf, cut."""
    kinds = {f.name: f.dataType for f in events.schema}
    tagged = events.withColumn("leaf", tree.column()).where(F.col("leaf").isin(*tree.leaves()))
    numeric = [f for f in features if admits(kinds[f], ">")]
    if bounds.scorer == "query":
        all_cuts = query_gains(tagged, selections, features, n_queries).withColumn("op", F.lit("="))
    else:
        stats = cut_statistics(tagged, selections, features)
        all_cuts = (gini_gains(stats) if bounds.scorer == "gini" else equality_gains(stats, n_queries)).withColumn("op", F.lit("="))
        if numeric and bounds.scorer == "rate":
            all_cuts = all_cuts.unionByName(threshold_gains(stats.where(F.col("feature").isin(*numeric)), n_queries).withColumn("op", F.lit(">")))
        if bounds.multiway and bounds.scorer == "rate":
            all_cuts = all_cuts.unionByName(multiway_gains(stats, n_queries).select("leaf", "feature", F.lit("").alias("value"), "n", "gain", F.lit("*").alias("op")))
    good = all_cuts.where((F.col("gain") > bounds.min_gain) & (F.col("n") >= bounds.min_events) & F.col("value").isNotNull())
    rows = good.orderBy(F.desc("gain"), "leaf", "feature", "op", "value").limit(most + len(bounds.failed) * len(tree.leaves())).collect()  # a failed cut may have a row in each leaf
    cuts = [(r.gain, r.leaf, Cut(r.feature, r.op, None if r.op == "*" else float(r.value) if r.feature in numeric else r.value)) for r in rows]
    return [c for c in cuts if c[2] not in bounds.failed][:most]


def greedy(events: DataFrame, selections: DataFrame, features: list[str], n_queries: int, bounds: Bounds | None = None) -> tuple[Tree, list[tuple[float, str, Cut]]]:
    """Best cut first, one job a round, until a bound stops it."""
    found = beam(events, selections, features, n_queries, 1, bounds)
    return found[0][1], found[0][2]


def beam(events: DataFrame, selections: DataFrame, features: list[str], n_queries: int, width: int = 3, bounds: Bounds | None = None) -> list[tuple[float, Tree, list]]:
    """The ``width`` best trees, each with its total gain and its cuts. The log is written once, so that a round doesn't derive it anew."""
    bounds, selections = bounds or Bounds(), settled(selections)
    began, jobs = time.monotonic(), 0
    held: list[tuple[float, Tree, list]] = [(0.0, Tree(), [])]
    while True:
        grown, kept = [], []
        for total, tree, cuts in held:
            if len(tree.leaves()) >= bounds.max_leaves or jobs >= bounds.max_jobs or time.monotonic() - began > bounds.max_seconds:
                kept.append((total, tree, cuts))
                continue
            jobs += 1
            new = candidates(events, selections, tree, features, n_queries, bounds, width)
            grown += [(total + g, tree.replaced(leaf, cut), [*cuts, (g, leaf, cut)]) for g, leaf, cut in new]
            if not new:
                kept.append((total, tree, cuts))
        if not grown:
            return sorted(kept, key=lambda x: -x[0])[:width]
        seen: dict = {}
        for t in sorted(grown + kept, key=lambda x: -x[0]):
            seen.setdefault(frozenset((leaf, cut) for _, leaf, cut in t[2]), t)
        held = list(seen.values())[:width]


def optimum(rows: list[dict], leaf_value, cuts: list[Cut], depth: int) -> float:
    """The recurrence for tiny inputs: the best of stopping and of any cut, children weighed by their share. ``leaf_value(rows)``."""
    best = leaf_value(rows)
    if depth:
        for c in cuts:
            test = {"=": lambda r: r[c.column] == c.value, ">": lambda r: r[c.column] > c.value, "<=": lambda r: r[c.column] <= c.value}[c.op]
            yes = [r for r in rows if test(r)]
            no = [r for r in rows if not test(r)]
            if yes and no:
                best = max(best, sum(len(p) / len(rows) * optimum(p, leaf_value, cuts, depth - 1) for p in (yes, no)))
    return best


def container_events(events: DataFrame, target_bytes: int) -> int:
    """Events of a container of about ``target_bytes``, by the mean compressed event."""
    mean = events.agg(F.avg("compressed").alias("m")).first().m
    return max(1, int(target_bytes // mean)) if mean else 1


def holdout(events: DataFrame, validation: DataFrame, key, size: int, bar: float) -> DataFrame:
    """n_containers, mean_skip, passed: the leaves of ``key`` packed in containers of ``size`` and replayed against queries that the search didn't see."""
    packed = equal_size(events.withColumn("leaf", key), "leaf", size)
    sizes = packed.groupBy("leaf", "container").agg(F.count("*").alias("n"))
    opened = packed.hint("merge").join(validation, "record_id").select("leaf", "container", "query_id").distinct().join(sizes, ["leaf", "container"])
    per_query = opened.groupBy("query_id").agg(F.sum("n").alias("m"))
    whole = sizes.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_all"))
    mean = per_query.join(F.broadcast(whole)).agg(F.avg(1 - F.col("m") / F.col("n_all")).alias("mean_skip"), F.max("n_containers").alias("n_containers"))
    return mean.select("n_containers", "mean_skip", (F.col("mean_skip") >= bar).alias("passed"))
