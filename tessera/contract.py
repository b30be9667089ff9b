"""Roles, families and checks of a corpus's tables.

A column's role follows from its name alone, its family from its type. Checks run as Spark aggregations and
name the table and the column that break the contract.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

IDENTITY = "record_id"
HIDDEN_PREFIX = "_"
SIZE_PREFIX = "blob_"
SIZE_SUFFIXES = {"compressed": "_compressed_bytes", "decompressed": "_decompressed_bytes"}
SETS = ("training", "validation")
VALUES_LISTED = 50

REQUIRED = {"events": ("record_id",), "queries": ("query_id", "query_time", "set_name"), "selections": ("record_id", "query_id")}


class ContractViolation(ValueError):
    """A table that isn't what the contract says."""


@dataclass(frozen=True)
class Roles:
    identity: tuple[str, ...] = ()
    compressed: tuple[str, ...] = ()
    decompressed: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    feature: tuple[str, ...] = ()

    def of(self) -> dict[str, str]:
        return {c: role for role in ("identity", "compressed", "decompressed", "hidden", "feature") for c in getattr(self, role)}


def is_hidden(column: str) -> bool:
    return column.startswith(HIDDEN_PREFIX)


def size_kind(column: str) -> str | None:
    """``decompressed`` or ``compressed`` for a size column, else None."""
    if not column.startswith(SIZE_PREFIX):
        return None
    return next((kind for kind in ("decompressed", "compressed") if column.endswith(SIZE_SUFFIXES[kind])), None)


def is_size(column: str) -> bool:
    return size_kind(column) is not None


def role_of(column: str) -> str:
    if column == IDENTITY:
        return "identity"
    if is_hidden(column):
        return "hidden"
    return size_kind(column) or "feature"


def classify(columns: list[str]) -> Roles:
    """The role of every column, in the order given."""
    return Roles(**{role: tuple(c for c in columns if role_of(c) == role) for role in Roles.__dataclass_fields__})


def family(kind: T.DataType) -> str:
    """temporal, numeric (booleans too) or text."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "numeric" if isinstance(kind, (T.NumericType, T.BooleanType)) else "text"


#: Which cuts a family admits: ranges need an order.
OPERATORS = {"numeric": ("=", ">", "<="), "temporal": ("=", ">", "<="), "text": ("=", "IN")}


def admits(kind: T.DataType, op: str) -> bool:
    """Whether a column of this type can be cut by ``op``."""
    return op in OPERATORS[family(kind)] and not (op == ">" and family(kind) == "temporal")  # times are cut by their own ladder


def is_missing(column: Column, kind: T.DataType) -> Column:
    return column.isNull() | F.isnan(column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column.isNull()


def profile(events: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per feature: name, family, cardinality, minimum, maximum (numeric and temporal only, as text), values (sorted, if at most fifty).

    One unpivot and one aggregation for all features. Values are counted as distinct before they
    are listed, so a list never holds more than a feature's distinct values.
    """
    columns = classify(events.columns).feature if columns is None else columns
    kinds = {f.name: f.dataType for f in events.schema}
    if not columns:
        return events.sparkSession.createDataFrame([], "name string, family string, cardinality long, minimum string, maximum string, values array<string>")
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("name"), F.lit(family(kinds[c])).alias("family"), F.when(~is_missing(F.col(c), kinds[c]), F.col(c).cast("string")).alias("value"),
            (F.when(~is_missing(F.col(c), kinds[c]), F.col(c).cast("double")) if family(kinds[c]) == "numeric" else F.lit(None).cast("double")).alias("number"),
        )
        for c in columns
    ])
    each = events.select(F.inline(cells)).groupBy("name", "family", "value", "number").agg(F.lit(1).alias("one"))
    whole = each.groupBy("name", "family").agg(
        F.count("value").alias("cardinality"),
        F.when(F.first("family") == "numeric", F.min_by("value", "number")).when(F.first("family") == "temporal", F.min("value")).alias("minimum"),
        F.when(F.first("family") == "numeric", F.max_by("value", "number")).when(F.first("family") == "temporal", F.max("value")).alias("maximum"),
    )
    few = whole.where(F.col("cardinality") <= VALUES_LISTED).select("name")
    listed = each.where(F.col("value").isNotNull()).join(F.broadcast(few), "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("v"))
    return whole.join(listed, "name", "left").select("name", "family", "cardinality", "minimum", "maximum", F.col("v.value").alias("values"))


def check_columns(table: str, columns: list[str]) -> None:
    for c in REQUIRED[table]:
        if c not in columns:
            raise ContractViolation(f"{table}: column {c} is missing")


def check_arrival(events: DataFrame, source: str = "events") -> None:
    """record_id is 0..N-1, each once. A table has no row order, so this is a check of the set."""
    r = events.agg(F.count("*").alias("n"), F.count("record_id").alias("k"), F.min("record_id").alias("low"), F.max("record_id").alias("high")).first()
    if r.n == 0:
        return
    if r.k != r.n:
        raise ContractViolation(f"{source}: record_id is missing in {r.n - r.k} rows")
    twice = events.groupBy("record_id").count().where("count > 1").orderBy("record_id").limit(1).collect()
    if twice:
        raise ContractViolation(f"{source}: duplicate record_id {twice[0].record_id}")
    if r.low != 0 or r.high != r.n - 1:
        raise ContractViolation(f"{source}: record_id isn't the sequence 0..{r.n - 1} (it spans {r.low}..{r.high})")


def check_monotone(events: DataFrame, arrival: str, source: str = "events") -> None:
    """A later record_id never arrives earlier. Checked by ranges of ids, so no task holds the table."""
    size = 100_000
    part = F.floor(F.col("record_id") / size)
    near = events.withColumn("before", F.max(arrival).over(W.partitionBy(part).orderBy("record_id").rowsBetween(W.unboundedPreceding, -1))).where(F.col("before") > F.col(arrival))
    bad = near.orderBy("record_id").limit(1).collect()
    if bad:
        raise ContractViolation(f"{source}: row {bad[0].record_id} arrives before an earlier one ({arrival})")
    ends = events.groupBy(part.alias("part")).agg(F.min(arrival).alias("low"), F.max(arrival).alias("high"))
    across = ends.withColumn("before", F.max("high").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).where("before > low").limit(1).collect()
    if across:
        raise ContractViolation(f"{source}: rows from {int(across[0].part) * size} on arrive before an earlier one ({arrival})")


def arrival_faults(events: DataFrame, arrival: str) -> DataFrame:
    """fault, n: rows without a record_id, rows that share one, rows whose id isn't below their number, and rows that arrive before one with a smaller id.

    The last are found by ranges of ids: a row is late against the rows before it in its range, or against the latest arrival of all ranges before.
    """
    from .operators.settled import settled

    size = 100_000
    rows = events.select("record_id", F.col(arrival).alias("t"), F.floor(F.col("record_id") / size).alias("part"))
    plain = rows.agg(F.count("*").alias("m"), F.count_if(F.col("record_id").isNull()).alias("missing"))
    twice = rows.where("record_id IS NOT NULL").groupBy("record_id").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate"))
    outside = rows.join(F.broadcast(plain)).agg(F.count_if((F.col("record_id") < 0) | (F.col("record_id") >= F.col("m"))).alias("outside"))
    ends = settled(rows.where("record_id IS NOT NULL").groupBy("part").agg(F.max("t").alias("high")))  # one row for 100,000 ids
    before = ends.select("part", F.max("high").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    own = F.max("t").over(W.partitionBy("part").orderBy("record_id").rowsBetween(W.unboundedPreceding, -1))
    late = rows.where("record_id IS NOT NULL").withColumn("own", own).join(before, "part").agg(F.count_if(F.greatest("own", "earlier") > F.col("t")).alias("early"))
    one = plain.join(twice).join(outside).join(late)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(c).cast("long").alias("n")) for c in ("missing", "duplicate", "outside", "early")])))


def validate(events: DataFrame, queries: DataFrame, selections: DataFrame) -> Roles:
    """Raises ContractViolation, or returns the roles of the events' columns."""
    for table, df in (("events", events), ("queries", queries), ("selections", selections)):
        check_columns(table, df.columns)
    roles = classify(events.columns)
    for kind in ("compressed", "decompressed"):
        if not getattr(roles, kind):
            raise ContractViolation(f"events: no column {SIZE_PREFIX}*{SIZE_SUFFIXES[kind]}")
    other = queries.where(~F.col("set_name").isin(*SETS) | F.col("set_name").isNull()).select("set_name").limit(1).collect()
    if other:
        raise ContractViolation(f"queries: set_name {other[0].set_name!r} is neither {SETS[0]} nor {SETS[1]}")
    check_arrival(events)
    return roles
