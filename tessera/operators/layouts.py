"""Layouts: which container an event goes to.

``routed`` layouts are a Column of one row, so a stream can use them; ``packed`` ones number rows and are for
batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .ranking import position, prefix_sums


def insertion(size: int) -> Column:
    """Containers of ``size`` events in order of arrival (routed)."""
    return F.floor(F.col("record_id") / size).cast("long")


def sorted_packing(events: DataFrame, columns: list[str], size: int) -> DataFrame:
    """record_id, container_id: containers of ``size`` events in the order of ``columns``."""
    return position(events.select("record_id", *columns), columns).select("record_id", F.floor(F.col("position") / size).cast("long").alias("container_id"))


def equal_size(events: DataFrame, group: str, size: int) -> DataFrame:
    """record_id, group, container: each group on its own, in containers of ``size`` (the last may be short)."""
    return position(events.select("record_id", group), [group], within=[group]).select("record_id", group, F.floor(F.col("position") / size).cast("long").alias("container"))


def split_evenly(events: DataFrame, group: str, counts: DataFrame) -> DataFrame:
    """record_id, group, container: group g in its ``k`` containers (counts: group, k) of nearly equal size."""
    numbered = position(events.select("record_id", group), [group], within=[group])
    n = events.groupBy(group).agg(F.count("*").alias("n"))
    return numbered.join(n.join(counts, group), group).select("record_id", group, F.floor(F.col("position") * F.col("k") / F.col("n")).cast("long").alias("container"))


def byte_capped(events: DataFrame, target: int, bytes_column: str = "compressed", bucket: int = 100_000) -> DataFrame:
    """record_id, container_id: order of arrival, a new container whenever the bytes before pass a multiple of ``target``."""
    part = F.floor(F.col("record_id") / bucket)
    marked = events.select("record_id", F.col(bytes_column).cast("long").alias("b"), part.alias("part"))
    sums = marked.groupBy("part").agg(F.sum("b").alias("s"))
    offset = prefix_sums(sums, ["part"], "s", "offset").select("part", "offset")
    before = F.coalesce(F.sum("b").over(W.partitionBy("part").orderBy("record_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("before", before).join(offset, "part").select("record_id", F.floor((F.col("offset") + F.col("before")) / target).cast("long").alias("container_id"))


def top_values(column: str, values: list[str], rest: str = "Rest combined") -> Column:
    return F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.lit(rest))


def ladder(column: str, bounds: list, labels: list[str]) -> Column:
    """Ranges that meet at ``bounds``; the first is open below, the last above. len(labels) = len(bounds) + 1."""
    if len(labels) != len(bounds) + 1 or list(bounds) != sorted(bounds):
        raise ValueError("bounds have to rise, with one label more than bounds")
    out = F.when(F.col(column) < bounds[0], F.lit(labels[0])) if bounds else None
    for b, name in zip(bounds[1:], labels[1:-1]):
        out = out.when(F.col(column) < b, F.lit(name))
    return out.otherwise(F.lit(labels[-1])) if bounds else F.lit(labels[0])


@dataclass(frozen=True)
class Cut:
    """A predicate ``column op value``, or (op ``*``) one child for each value."""

    column: str
    op: str
    value: object = None

    def test(self) -> Column:
        c = F.col(self.column)
        return {"=": lambda: c == self.value, ">": lambda: c > self.value, "<=": lambda: c <= self.value, "IN": lambda: c.isin(*self.value)}[self.op]()


@dataclass
class Tree:
    """A split tree: a leaf, or a cut with a child for its truth and one for the rest."""

    cut: Cut | None = None
    yes: Tree | None = None
    no: Tree | None = None
    path: str = field(default="")

    def column(self, path: str = "r") -> Column:
        """The leaf of a row, as text: routed, one CASE expression."""
        if self.cut is None:
            return F.lit(path)
        if self.cut.op == "*":
            return F.concat(F.lit(path + "/"), F.coalesce(F.col(self.cut.column).cast("string"), F.lit("null")))
        yes, no = self.yes or Tree(), self.no or Tree()
        return F.when(self.cut.test(), yes.column(path + "1")).otherwise(no.column(path + "0"))

    def leaves(self, path: str = "r") -> list[str]:
        if self.cut is None:
            return [path]
        if self.cut.op == "*":
            return []  # its children are whole: one a value
        return (self.yes or Tree()).leaves(path + "1") + (self.no or Tree()).leaves(path + "0")

    def replaced(self, leaf: str, cut: Cut, path: str = "r") -> Tree:
        """The tree with ``leaf`` cut in two."""
        if path == leaf:
            return Tree(cut, Tree(), Tree())
        if self.cut is None:
            return self
        return Tree(self.cut, (self.yes or Tree()).replaced(leaf, cut, path + "1"), (self.no or Tree()).replaced(leaf, cut, path + "0"))


def with_time(key: Column, ts: str, grain: str) -> Column:
    """Ingestion time as the last cut."""
    return F.concat_ws("@", key, F.date_trunc(grain, F.col(ts)).cast("string"))
