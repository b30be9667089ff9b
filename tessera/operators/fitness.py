"""Scores of a grouping of events, from counts by group and by (group, query).

Pairs of a group and a query that don't meet are never made: their share is a closed term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def group_counts(events: DataFrame, selections: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(group, n) and (group, query_id, k)."""
    n = events.groupBy(group).agg(F.count("*").alias("n"))
    k = selections.join(events.select("record_id", group), "record_id").groupBy(group, "query_id").agg(F.count("*").alias("k"))
    return n, k


def rates(n: DataFrame, k: DataFrame, group: str, n_queries: int) -> DataFrame:
    """group, n, k_total, p: the share of a group that a query selects, averaged over queries (those that select nothing too)."""
    total = k.groupBy(group).agg(F.sum("k").alias("k_total"))
    out = n.join(total, group, "left").withColumn("k_total", F.coalesce("k_total", F.lit(0)))
    return out.withColumn("p", F.col("k_total") / (F.lit(float(n_queries)) * F.col("n")))


def marginal_skip(rated: DataFrame, size: int) -> DataFrame:
    """v_exact, v_poisson: expected share of containers of ``size`` that a query skips, by group-wide rates. The second takes a group as one container."""
    weighted = rated.join(F.broadcast(rated.agg(F.sum("n").alias("all_n")))).withColumn("w", F.col("n") / F.col("all_n"))
    return weighted.agg(F.sum(F.col("w") * F.pow(1 - F.col("p"), F.lit(float(size)))).alias("v_exact"), F.sum(F.col("w") * F.exp(-F.col("n") * F.col("p"))).alias("v_poisson"))


def query_skip(n: DataFrame, k: DataFrame, group: str, n_queries: int, term: Column) -> DataFrame:
    """v: mean over queries and groups (by weight) of ``term``, a Column of n and k that is 1 at k = 0."""
    whole = n.agg(F.sum("n").alias("all_n"))
    touched = k.join(n, group).groupBy(group).agg(F.count("*").alias("touch"), F.sum(term).alias("s"))
    each = n.join(touched, group, "left").join(F.broadcast(whole))
    part = (F.coalesce("s", F.lit(0.0)) + F.lit(n_queries) - F.coalesce("touch", F.lit(0))) * F.col("n") / F.col("all_n")
    return each.agg((F.sum(part) / F.lit(float(n_queries))).alias("v"))


def exact_term(size: int) -> Column:
    return F.pow(1 - F.col("k") / F.col("n"), F.lit(float(size)))


def poisson_term() -> Column:
    return F.exp(-F.col("k").cast("double"))


def hypergeometric_term(size: int) -> Column:
    """Chance that a container of ``size`` drawn from n events holds none of k: 0 where k > n - size; a product of ``size`` or k factors, the fewer."""
    n, k = F.col("n"), F.col("k")
    few, many = F.least(k, F.lit(size)), F.greatest(k, F.lit(size))
    product = F.aggregate(F.sequence(F.lit(0).cast("long"), few.cast("long") - 1), F.lit(1.0), lambda a, j: a * (n - many - j) / (n - j))
    return F.when(k > n - size, 0.0).when(few < 1, 1.0).otherwise(product)


def usage(n: DataFrame, k: DataFrame, group: str) -> DataFrame:
    """group, n, usage: rows of the log that fall on each group."""
    u = k.groupBy(group).agg(F.sum("k").alias("usage"))
    return n.join(u, group, "left").withColumn("usage", F.coalesce("usage", F.lit(0)))


def lorenz(groups: DataFrame, group: str) -> DataFrame:
    """group, rank, population, share: cumulative shares of events and of usage from the least to the most used per event. Groups are leaves of a layout: few."""
    order = W.orderBy(F.col("usage") / F.col("n"), F.col(group))
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = groups.agg(F.sum("n").alias("all_n"), F.sum("usage").alias("all_u"))
    return groups.join(F.broadcast(whole)).select(
        group, F.row_number().over(order).cast("long").alias("rank"), (F.sum("n").over(so_far) / F.col("all_n")).alias("population"), (F.sum("usage").over(so_far) / F.col("all_u")).alias("share")
    )


def weighted_gini(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """g and n_groups per ``by``: 1 - sum of w (2 cum - q), groups in order of usage per event."""
    by = by or []
    whole = W.partitionBy(*by)
    shares = groups.withColumns({"w": F.col("n") / F.sum("n").over(whole), "q": F.col("usage") / F.sum("usage").over(whole)})
    cum = F.sum("q").over(whole.orderBy(F.col("usage") / F.col("n"), F.col("w")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return shares.withColumn("cum", cum).groupBy(*by).agg((1 - F.sum(F.col("w") * (2 * F.col("cum") - F.col("q")))).alias("g"), F.count("*").alias("n_groups"))


def patternless(containers: DataFrame, rate: DataFrame) -> DataFrame:
    """layout, skip, skip_poisson: expected skipping if selection had no pattern. containers: layout, n_events; rate: one row, p."""
    return containers.join(F.broadcast(rate)).groupBy("layout").agg(
        F.avg(F.pow(1 - F.col("p"), F.col("n_events").cast("double"))).alias("skip"), F.avg(F.exp(-F.col("p") * F.col("n_events"))).alias("skip_poisson")
    )


def allocated(rated: DataFrame, k: Column) -> DataFrame:
    """skipped, skipped_poisson: containers that a query is expected to skip if each group gets ``k``."""
    rows = rated.withColumn("kg", k)
    return rows.agg(
        F.sum(F.col("kg") * F.pow(1 - F.col("p"), F.col("n") / F.col("kg"))).alias("skipped"), F.sum(F.col("kg") * F.exp(-F.col("n") * F.col("p") / F.col("kg"))).alias("skipped_poisson")
    )


def poisson_error(p: Column, mu: Column) -> tuple[Column, Column]:
    """What the Poisson form adds to (1 - p) ** (mu / p), and its leading term."""
    return F.exp(-mu) - F.pow(1 - p, mu / p), mu * p / 2 * F.exp(-mu)
