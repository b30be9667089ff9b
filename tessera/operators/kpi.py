"""Usage summaries and the map of demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usage_summary(log: DataFrame, row: str, ts: str, query: str, queries: list[str], grain: str = "hour") -> DataFrame:
    """row, bin and a boolean per query of the list: whether it selected the row in that bin."""
    out = log.groupBy(row, F.date_trunc(grain, ts).alias("bin")).pivot(query, queries).agg(F.lit(True))
    return out.na.fill(False)


def band(kpi: Column, cold: float, hot: float) -> Column:
    return F.when(kpi <= cold, "cold").when(kpi >= hot, "hot").otherwise("warm")


def usage_map(tiles: DataFrame, cold: float, hot: float) -> DataFrame:
    """grp, tile_id, size, kpi, share, band per tile; totals per group and over all have null ids. tiles: grp, tile_id, size, demand."""
    whole = tiles.agg(F.sum("size").alias("all_size"))
    rolled = tiles.rollup("grp", "tile_id").agg(F.sum("size").alias("size"), (F.sum(F.col("size") * F.col("demand")) / F.sum("size")).alias("kpi"))
    return rolled.join(F.broadcast(whole)).select("grp", "tile_id", "size", "kpi", (F.col("size") / F.col("all_size")).alias("share"), band(F.col("kpi"), cold, hot).alias("band"))
