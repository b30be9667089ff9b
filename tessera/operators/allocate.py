"""Containers for groups under a budget: a multiple-choice knapsack on ladders of container counts.

groups: group_id, n (events), p (share that a query selects). A group's benefit with K containers is
``n exp(-n p / K)``, the events that a query is expected to skip.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def benefit(k: Column) -> Column:
    return F.col("n") * F.exp(-F.col("n") * F.col("p") / k)


def ladder(groups: DataFrame, least_events: int, ratio: int | None = 4, options: list[int] | None = None) -> DataFrame:
    """group_id, n, p, j, k, v: offered counts 1, r, r**2, ... (or every integer with ratio None, or ``options``), up to n / least_events."""
    most = F.greatest(F.floor(F.col("n") / least_events), F.lit(1))
    if options is not None:
        ks = F.array(*[F.lit(o).cast("long") for o in options])
    elif ratio is None:
        ks = F.sequence(F.lit(1).cast("long"), most)
    else:
        ks = F.array(*[F.lit(ratio**i).cast("long") for i in range(int(math.log(2**62, ratio)) + 1)])
    offered = groups.withColumn("k", F.explode(F.filter(ks, lambda k: k <= most)))
    j = F.row_number().over(W.partitionBy("group_id").orderBy("k")) - 1
    return offered.select("group_id", "n", "p", j.cast("long").alias("j"), "k", benefit(F.col("k")).alias("v"))


def edges(rungs: DataFrame) -> DataFrame:
    """group_id, j, k, v, dk, dv, e: each step up a ladder and what it brings per container."""
    w = W.partitionBy("group_id").orderBy("j")
    up = rungs.withColumns({"dk": F.lead("k").over(w) - F.col("k"), "dv": F.lead("v").over(w) - F.col("v")}).where(F.col("dk").isNotNull())
    return up.select("group_id", "j", "k", "v", "dk", "dv", (F.col("dv") / F.col("dk")).alias("e"))


def concavity(steps: DataFrame) -> DataFrame:
    """group_id, n_edges, rising: how many steps bring more per container than the one before."""
    before = F.lag("e").over(W.partitionBy("group_id").orderBy("j"))
    return steps.withColumn("up", (F.col("e") > before).cast("long")).groupBy("group_id").agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("up"), F.lit(0)).alias("rising"))


def guarded(groups: DataFrame, least_events: int, bar: float = 0.5) -> DataFrame:
    """group_id, np, k_inflection, k_start, k_max, k_bar, skip_at_max, allowed: what the guardrails say.

    A count may be offered from the inflection on (below it a step brings ever more, so greedy steps mislead), up to the size
    floor, and only if a container is then skipped with probability ``bar`` at least.
    """
    np_ = F.col("n") * F.col("p")
    most = F.greatest(F.floor(F.col("n") / least_events), F.lit(1)).cast("long")
    out = groups.select("group_id", "n", "p", np_.alias("np"), (np_ / 2).alias("k_inflection"), F.greatest(F.ceil(np_ / 2), F.lit(1)).cast("long").alias("k_start"), most.alias("k_max"), (np_ / F.lit(-1.0) / F.log(F.lit(bar))).alias("k_bar"))
    skip = F.exp(-F.col("np") / F.col("k_max"))
    return out.withColumns({"skip_at_max": skip, "allowed": (F.col("k_start") <= F.col("k_max")) & (skip >= bar)})


def guarded_ladder(groups: DataFrame, least_events: int, bar: float = 0.5, ratio: int | None = 4, options: list[int] | None = None) -> DataFrame:
    """The ladder with the guardrails applied: besides one container, a group is offered counts from the inflection on that are skipped with
    probability ``bar`` at least. A group that can't reach any of these stays at one."""
    np_ = F.col("n") * F.col("p")
    open_ = (F.col("k") >= F.greatest(F.ceil(np_ / 2), F.lit(1))) & (F.exp(-np_ / F.col("k")) >= bar)
    kept = ladder(groups, least_events, ratio, options).where((F.col("k") == 1) | open_)
    j = F.row_number().over(W.partitionBy("group_id").orderBy("k")) - 1
    return kept.withColumn("j", j.cast("long"))


def acceptance(steps: DataFrame) -> DataFrame:
    """Adds ``bound``, the least e up to each step: in the order (bound descending, group, j) every step follows its predecessors, and that is the order in which a greedy scan takes them."""
    w = W.partitionBy("group_id").orderBy("j").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn("bound", F.min("e").over(w))


def greedy(steps: DataFrame, n_groups: int, budget: int) -> DataFrame:
    """group_id, j, step, spent: the steps taken, best first, among those exposed that still fit; one container per group is spent at the start.

    Raises ValueError if the groups outnumber the budget. Ladders are those of a tree's leaves, bounded by the
    leaf cap, so the scan over the sorted steps is the driver's.
    """
    if n_groups > budget:
        raise ValueError(f"{n_groups} groups need a container each; the budget is {budget}")
    chains: dict = {}
    for r in steps.select("group_id", "j", "dk", "e").orderBy("group_id", "j").toLocalIterator():
        chains.setdefault(r.group_id, []).append((r.j, r.dk, r.e))
    heap = [(-c[0][2], g, 0) for g, c in chains.items()]
    heapq.heapify(heap)
    spent, taken = n_groups, []
    while heap:
        _, g, i = heapq.heappop(heap)
        j, dk, _ = chains[g][i]
        if spent + dk > budget:
            continue
        spent += dk
        taken.append((g, j, len(taken) + 1, spent))
        if i + 1 < len(chains[g]):
            heapq.heappush(heap, (-chains[g][i + 1][2], g, i + 1))
    kind = steps.schema["group_id"].dataType.simpleString()
    return steps.sparkSession.createDataFrame(taken, f"group_id {kind}, j long, step long, spent long")


def trace(steps: DataFrame, taken: DataFrame, rungs: DataFrame) -> DataFrame:
    """step, group_id, k, e, spent, skip_ratio after each step taken. Steps are those of few leaves."""
    base = rungs.where("j = 0").agg(F.sum("v").alias("v0"), F.sum("n").alias("n_all"))
    each = taken.join(steps, ["group_id", "j"]).join(F.broadcast(base))
    so_far = F.sum("dv").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow))
    return each.select("step", "group_id", (F.col("k") + F.col("dk")).alias("k"), "e", "spent", ((F.col("v0") + so_far) / F.col("n_all")).alias("skip_ratio"))


def spend_curve(steps: DataFrame, rungs: DataFrame, budget: int) -> DataFrame:
    """step, group_id, k, e, spent, skip_ratio, metadata_cost, affordable of all steps in the order of a scan without a limit, so that the curve goes on past the budget.

    metadata_cost: the share of containers spent of those that the whole ladder could have. Steps are those of few leaves.
    """
    base = rungs.where("j = 0").agg(F.sum("v").alias("v0"), F.sum("n").alias("n_all"), F.sum("k").alias("k0"))
    most = steps.agg(F.sum("dk").alias("all_dk"))
    order = W.orderBy(F.desc("bound"), "group_id", "j")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    run = acceptance(steps).withColumns({"step": F.row_number().over(order).cast("long"), "run": F.sum("dk").over(upto), "gained": F.sum("dv").over(upto)})
    spent = F.col("k0") + F.col("run")
    return run.join(F.broadcast(base)).join(F.broadcast(most)).select(
        "step", "group_id", (F.col("k") + F.col("dk")).alias("k"), "e", spent.alias("spent"), ((F.col("v0") + F.col("gained")) / F.col("n_all")).alias("skip_ratio"),
        (spent / (F.col("k0") + F.col("all_dk"))).alias("metadata_cost"), (spent <= budget).alias("affordable"),
    )


def chosen(rungs: DataFrame, taken: DataFrame) -> DataFrame:
    """group_id, k, v: what each group gets."""
    last = taken.groupBy("group_id").agg((F.max("j") + 1).alias("top"))
    return rungs.join(last, "group_id", "left").where(F.col("j") == F.coalesce("top", F.lit(0))).select("group_id", "k", "v")


def brute_force(ladders: dict, budget: int) -> float:
    """Best total benefit over all choices: for comparison on tiny instances. ladders: group to [(k, v)]."""
    best = {0: 0.0}
    for rungs in ladders.values():
        new: dict = {}
        for spent, v in best.items():
            for k, gain in rungs:
                if spent + k <= budget and new.get(spent + k, float("-inf")) < v + gain:
                    new[spent + k] = v + gain
        best = new
    return max(best.values(), default=float("-inf"))
