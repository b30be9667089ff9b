"""Every registered query of the layout engine, with SQL that says the same.

A query is a thin use of an operator on the fixture workload (or on the driver's tables themselves);
its SQL is written against the tables, apart from common table expressions that spell out the fixture.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from .. import contract
from ..functions import model
from ..operators import allocate, bitmaps, describe, fitness, kpi, layouts, replay, search
from ..operators.settled import shared_folder
from .workload import Workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = """
WITH E AS (SELECT CAST(p_partkey AS BIGINT) AS record_id, p_brand AS brand_id, p_type AS feature_type, p_size AS feature_size,
    CAST(100 * p_size + CAST(round(p_retailprice * 10) AS BIGINT) AS BIGINT) AS compressed, CAST(4 * (100 * p_size + CAST(round(p_retailprice * 10) AS BIGINT)) AS BIGINT) AS decompressed FROM part),
L AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS record_id, CAST((year(o_orderdate) - 1995) * 60 + (month(o_orderdate) - 1) * 5 + CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS BIGINT) AS query_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 30 AND CAST(substr(p_brand, 7) AS INT) % 5 = CAST(substr(o_orderpriority, 1, 1) AS INT) - 1),
Q AS (SELECT query_id, CASE WHEN query_id < 200 THEN 'training' ELSE 'validation' END AS set_name, strftime(DATE '1995-01-01' + to_months(CAST(query_id // 5 AS INT)), '%Y-%m') AS month FROM (SELECT DISTINCT query_id FROM L)),
T AS (SELECT * FROM L WHERE query_id < 200),
P AS (SELECT count(*) AS n, greatest(10, count(*) // 40) AS s, CAST(sum(compressed) AS BIGINT) AS b FROM E),
K AS (SELECT count(DISTINCT query_id) AS q FROM T),
lay AS (SELECT 'insertion' AS layout, record_id, record_id // s AS container_id FROM E, P UNION ALL SELECT 'brand', record_id, (row_number() OVER (ORDER BY brand_id, record_id) - 1) // s FROM E, P),
C AS (SELECT layout, container_id, count(*) AS n_events, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(sum(decompressed) AS BIGINT) AS decompressed FROM lay JOIN E USING (record_id) GROUP BY ALL),
A AS (SELECT layout, container_id, query_id, count(*) AS needed FROM lay JOIN L USING (record_id) GROUP BY ALL),
B AS (SELECT query_id, CAST(sum(compressed) AS BIGINT) AS needed_bytes FROM L JOIN E USING (record_id) GROUP BY ALL),
M0 AS (SELECT layout, query_id, CAST(sum(n_events) AS BIGINT) AS materialized, CAST(sum(compressed) AS BIGINT) AS materialized_bytes, CAST(sum(needed) AS BIGINT) AS needed FROM A JOIN C USING (layout, container_id) GROUP BY ALL),
M AS (SELECT *, materialized - needed AS waste, materialized_bytes - needed_bytes AS waste_bytes, 1 - materialized / n AS skip_events, 1 - materialized_bytes / b AS skip_bytes FROM M0 JOIN B USING (query_id), P),
G0 AS (SELECT brand_id, count(*) AS n FROM E GROUP BY ALL),
GK AS (SELECT brand_id, query_id, count(*) AS k FROM T JOIN E USING (record_id) GROUP BY ALL),
G AS (SELECT G0.brand_id, n, CAST(coalesce(kt, 0) AS BIGINT) AS k_total, coalesce(kt, 0) / (q * CAST(n AS DOUBLE)) AS p FROM G0 LEFT JOIN (SELECT brand_id, sum(k) AS kt FROM GK GROUP BY ALL) USING (brand_id), K),
GR AS (SELECT brand_id AS group_id, n, p FROM G),
lad AS (SELECT group_id, x.n, p, CAST(row_number() OVER (PARTITION BY group_id ORDER BY k) - 1 AS BIGINT) AS j, k, x.n * exp(-x.n * p / k) AS v FROM (SELECT group_id, n, p, CAST(pow(4, i) AS BIGINT) AS k FROM GR, range(0, 12) t(i)) x, P WHERE k <= greatest(x.n // greatest(2, s // 10), 1)),
ed AS (SELECT group_id, j, k, v, lead(k) OVER w - k AS dk, lead(v) OVER w - v AS dv, (lead(v) OVER w - v) / (lead(k) OVER w - k) AS e FROM lad WINDOW w AS (PARTITION BY group_id ORDER BY j) QUALIFY lead(k) OVER w IS NOT NULL)
"""


def query(sql: str | None = None, base: bool = True) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Workload(spark, sf_dir)))
        if sql is not None:
            SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


# -- contract and profile


@query("SELECT * FROM (VALUES ('record_id', 'identity', 'numeric'), ('brand_id', 'feature', 'text'), ('feature_type', 'feature', 'text'), ('feature_size', 'feature', 'numeric'), ('blob_detail_compressed_bytes', 'compressed', 'numeric'), ('blob_detail_decompressed_bytes', 'decompressed', 'numeric'), ('_source_record_key', 'hidden', 'text')) t(name, role, family)", base=False)
def role_profile(w: Workload) -> DataFrame:
    """Roles by name and families by type of the fixture's columns as a corpus has them."""
    named = w.events.withColumnsRenamed({"compressed": "blob_detail_compressed_bytes", "decompressed": "blob_detail_decompressed_bytes"}).withColumn("_source_record_key", F.lit(""))
    roles = contract.classify(named.columns).of()
    return w.spark.createDataFrame([(f.name, roles[f.name], contract.family(f.dataType)) for f in named.schema], "name string, role string, family string")


@query("""
SELECT 'brand_id' AS name, 'text' AS family, count(DISTINCT brand_id) AS cardinality, CAST(NULL AS VARCHAR) AS minimum, CAST(NULL AS VARCHAR) AS maximum, CASE WHEN count(DISTINCT brand_id) <= 50 THEN string_agg(DISTINCT brand_id, ',' ORDER BY brand_id) END AS listed FROM E
UNION ALL SELECT 'feature_type', 'text', count(DISTINCT feature_type), NULL, NULL, CASE WHEN count(DISTINCT feature_type) <= 50 THEN string_agg(DISTINCT feature_type, ',' ORDER BY feature_type) END FROM E
UNION ALL SELECT 'feature_size', 'numeric', count(DISTINCT feature_size), CAST(min(feature_size) AS VARCHAR), CAST(max(feature_size) AS VARCHAR), (SELECT CASE WHEN count(*) <= 50 THEN string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) END FROM (SELECT DISTINCT feature_size AS x FROM E)) FROM E
""")
def feature_summary(w: Workload) -> DataFrame:
    p = contract.profile(w.events, ("brand_id", "feature_type", "feature_size"))
    return p.select("name", "family", "cardinality", "minimum", "maximum", F.array_join("values", ",").alias("listed"))


@query("""
, cold AS (SELECT record_id FROM L GROUP BY 1 HAVING bool_or(query_id >= 200) AND NOT bool_or(query_id < 200))
SELECT (SELECT n FROM P) AS n_events, (SELECT count(*) FROM Q) AS n_queries, (SELECT count(*) FROM L) AS n_selections, (SELECT count(*) FROM E ANTI JOIN L USING (record_id)) AS n_never,
  (SELECT count(*) FROM cold) AS n_cold, CAST(sum(compressed) AS BIGINT) AS compressed, round(avg(compressed), 6) AS mean_compressed, round(quantile_cont(compressed, 0.99), 6) AS p99_compressed FROM E
""")
def corpus_describe(w: Workload) -> DataFrame:
    sizes = w.events.agg(F.count("*").alias("n_events"), F.sum("compressed").alias("compressed"), r6(F.avg("compressed")).alias("mean_compressed"), r6(F.percentile("compressed", F.lit(0.99))).alias("p99_compressed"))
    flags = w.selections.groupBy("record_id").agg(F.count("*").alias("d"), F.bool_or(F.col("query_id") < 200).alias("t"), F.bool_or(F.col("query_id") >= 200).alias("v"))
    log = flags.agg(F.count("*").alias("touched"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_selections"), F.count_if(F.col("v") & ~F.col("t")).alias("n_cold"))
    n = w.queries.agg(F.count("*").alias("n_queries"))
    out = sizes.join(F.broadcast(log)).join(F.broadcast(n))
    return out.select("n_events", "n_queries", "n_selections", (F.col("n_events") - F.col("touched")).alias("n_never"), "n_cold", "compressed", "mean_compressed", "p99_compressed")


@query("""
SELECT (SELECT min(month) FROM Q) AS first_month, (SELECT max(month) FROM Q) AS last_month, round(100.0 * (SELECT count(*) FROM E ANTI JOIN L USING (record_id)) / (SELECT n FROM P), 6) AS percent_never,
  round(100.0 * (SELECT count(*) FROM Q WHERE set_name = 'training') / (SELECT count(*) FROM Q), 6) AS percent_training, round(100.0 * (SELECT count(*) FROM L) / ((SELECT n FROM P) * (SELECT count(*) FROM Q)), 6) AS percent_selected
""")
def corpus_shares(w: Workload) -> DataFrame:
    """The corpus in percentages, and the time that its queries span."""
    return describe.shares(w.events, w.queries, w.selections).select("first_month", "last_month", *[r6(F.col(c)).alias(c) for c in ("percent_never", "percent_training", "percent_selected")])


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS record_id FROM events", base=False)
def arrival_ids(w: Workload) -> DataFrame:
    """Dense ids in order of time; ties by the key."""
    from ..operators.ranking import position

    return position(w.table("events").select("event_id", "ts"), ["ts"], "event_id", "record_id").select("event_id", "record_id")


@query("""
SELECT 'missing' AS fault, count(*) FILTER (WHERE event_id IS NULL) AS n FROM events
UNION ALL SELECT 'duplicate', CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM events WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) > 1)
UNION ALL SELECT 'outside', count(*) FROM events, (SELECT count(*) AS m FROM events) WHERE event_id < 0 OR event_id >= m
UNION ALL SELECT 'early', count(*) FROM (SELECT ts, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before > ts
""", base=False)
def arrival_faults(w: Workload) -> DataFrame:
    """How many rows break the order of arrival, by kind of fault."""
    return contract.arrival_faults(w.table("events").select(F.col("event_id").alias("record_id"), "ts"), "ts")


@query("""
, KE AS (SELECT 'p' || CAST(record_id AS VARCHAR) AS key, brand_id, row_number() OVER (ORDER BY 'p' || CAST(record_id AS VARCHAR)) - 1 AS id FROM E),
KQ AS (SELECT 'v' || CAST(query_id AS VARCHAR) AS key, row_number() OVER (ORDER BY 'v' || CAST(query_id AS VARCHAR)) - 1 AS id FROM Q)
SELECT CAST(KE.id AS BIGINT) AS record_id, CAST(KQ.id AS BIGINT) AS query_id, KE.key AS source_key, KE.brand_id FROM L JOIN KE ON KE.key = 'p' || CAST(L.record_id AS VARCHAR) JOIN KQ ON KQ.key = 'v' || CAST(L.query_id AS VARCHAR)
""")
def rekeyed_log(w: Workload) -> DataFrame:
    """The log of a foreign corpus with string keys, under the ids minted for it."""
    from ..sources import external

    at = lambda c: (F.row_number().over(W.orderBy(c)) - 1).cast("long").alias("__row")  # noqa: E731  a fixture's order of keys
    key = F.concat(F.lit("p"), F.col("record_id").cast("string"))
    visit = F.concat(F.lit("v"), F.col("query_id").cast("string"))
    e = w.events.select(key.alias("record_id"), "brand_id", F.col("compressed").alias("blob_x_compressed_bytes"), F.col("decompressed").alias("blob_x_decompressed_bytes")).select("*", at("record_id"))
    q = w.queries.select(visit.alias("query_id"), "query_time", "set_name").select("*", at("query_id"))
    c = external.rekey(e, q, w.selections.select(key.alias("record_id"), visit.alias("query_id")))
    return c.selections.join(c.events, "record_id").select("record_id", "query_id", F.col("_source_record_key").alias("source_key"), "brand_id")


def _corpus(w: Workload):
    from ..corpus import corpus

    e = w.events.withColumnsRenamed({"compressed": "blob_x_compressed_bytes", "decompressed": "blob_x_decompressed_bytes"}).withColumn("record_id", F.col("record_id") - 1)
    return corpus(e, w.queries, w.selections.withColumn("record_id", F.col("record_id") - 1), check=False)


@query("SELECT query_id, count(*) AS n_selected, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(sum(decompressed) AS BIGINT) AS decompressed FROM L JOIN E USING (record_id) GROUP BY ALL")
def csv_corpus(w: Workload) -> DataFrame:
    """Selected bytes of the fixture, saved as a CSV corpus and read back through its manifest."""
    from ..sources import files

    top = files.save(_corpus(w), _folder(w), "fixture", {"rows": "all"}, "csv")
    return files.selected_bytes_of(w.spark, top, files.load(w.spark, top, check=False))


@query("SELECT record_id, count(*) AS demand FROM L GROUP BY ALL")
def stored_support(w: Workload) -> DataFrame:
    """Demand from supports that were stored beside the corpus and are loaded, not built, the second time."""
    from ..sources import files

    top, log = _folder(w), w.selections
    files.support_of(w.spark, top, log)
    return bitmaps.size(files.support_of(w.spark, top, log))


@query("SELECT set_name, count(DISTINCT Q.query_id) AS n_queries, count(*) AS n_selections FROM Q JOIN L USING (query_id) GROUP BY ALL")
def query_set_counts(w: Workload) -> DataFrame:
    per = w.selections.groupBy("query_id").agg(F.count("*").alias("n"))
    return per.join(w.queries, "query_id").groupBy("set_name").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_selections"))


@query("SELECT month, count(*) AS n_queries FROM Q GROUP BY ALL")
def queries_by_month(w: Workload) -> DataFrame:
    return w.queries.groupBy(F.date_format("query_time", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_queries"))


@query("SELECT record_id, count(query_id) AS demand FROM E LEFT JOIN L USING (record_id) GROUP BY ALL")
def selection_demand(w: Workload) -> DataFrame:
    d = w.selections.groupBy("record_id").agg(F.count("*").alias("demand"))
    return w.events.select("record_id").join(d, "record_id", "left").select("record_id", F.coalesce("demand", F.lit(0)).alias("demand"))


@query("SELECT record_id FROM E ANTI JOIN L USING (record_id)")
def never_selected(w: Workload) -> DataFrame:
    return w.events.select("record_id").join(w.selections, "record_id", "left_anti")


@query("SELECT record_id FROM L GROUP BY ALL HAVING bool_or(query_id >= 200) AND NOT bool_or(query_id < 200)")
def cold_events(w: Workload) -> DataFrame:
    seen = w.selections.groupBy("record_id").agg(F.max("query_id").alias("high"), F.min("query_id").alias("low"))
    return seen.where("high >= 200 AND low >= 200").select("record_id")


@query("SELECT query_id, count(*) AS n_selected, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(sum(decompressed) AS BIGINT) AS decompressed FROM L JOIN E USING (record_id) GROUP BY ALL")
def selected_bytes_by_query(w: Workload) -> DataFrame:
    return w.selections.join(w.events, "record_id").groupBy("query_id").agg(F.count("*").alias("n_selected"), F.sum("compressed").alias("compressed"), F.sum("decompressed").alias("decompressed"))


@query("SELECT query_id, count(*) AS n FROM L WHERE query_id < 200 GROUP BY ALL")
def holdout_restriction(w: Workload) -> DataFrame:
    visible = w.queries.where("set_name = 'training'")
    return bitmaps.restrict(w.selections, visible).groupBy("query_id").agg(F.count("*").alias("n"))


# -- replay


@query("SELECT layout, container_id, n_events, compressed, decompressed, round(compressed / n_events, 6) AS mean_compressed FROM C")
def container_stats(w: Workload) -> DataFrame:
    return w.containers.withColumn("mean_compressed", r6(F.col("compressed") / F.col("n_events")))


@query("SELECT layout, container_id, query_id, needed FROM A")
def activation(w: Workload) -> DataFrame:
    return w.activation


@query("SELECT C.layout, C.container_id, count(query_id) AS breadth FROM C LEFT JOIN A USING (layout, container_id) GROUP BY ALL")
def demand_breadth(w: Workload) -> DataFrame:
    return replay.breadth(w.activation, w.containers).select("layout", "container_id", "breadth")


@query("SELECT layout, query_id, materialized, materialized_bytes FROM M")
def materialized_by_query(w: Workload) -> DataFrame:
    return w.per_query.select("layout", "query_id", "materialized", "materialized_bytes")


@query("SELECT layout, query_id, materialized, needed, waste FROM M")
def waste_by_query(w: Workload) -> DataFrame:
    return w.per_query.select("layout", "query_id", "materialized", "needed", "waste")


@query("SELECT layout, query_id, needed_bytes, waste_bytes FROM M")
def waste_bytes(w: Workload) -> DataFrame:
    return w.per_query.select("layout", "query_id", "needed_bytes", "waste_bytes")


@query("SELECT layout, CAST(sum(waste) AS BIGINT) AS waste, CAST(sum(waste_bytes) AS BIGINT) AS waste_bytes FROM M GROUP BY ALL")
def aggregate_waste(w: Workload) -> DataFrame:
    return w.per_query.groupBy("layout").agg(F.sum("waste").alias("waste"), F.sum("waste_bytes").alias("waste_bytes"))


@query("SELECT C.layout, C.container_id, n_events, count(query_id) AS breadth, n_events * count(query_id) AS opened, CAST(coalesce(sum(needed), 0) AS BIGINT) AS needed, n_events * count(query_id) - CAST(coalesce(sum(needed), 0) AS BIGINT) AS waste FROM C LEFT JOIN A USING (layout, container_id) GROUP BY C.layout, C.container_id, n_events")
def waste_by_container(w: Workload) -> DataFrame:
    return replay.breadth(w.activation, w.containers)


@query("SELECT lay.layout, count(*) AS waste FROM A JOIN lay USING (layout, container_id) LEFT JOIN L ON L.record_id = lay.record_id AND L.query_id = A.query_id WHERE L.record_id IS NULL GROUP BY ALL")
def waste_by_cell(w: Workload) -> DataFrame:
    return replay.waste_cells(w.both, w.selections, w.activation).groupBy("layout").agg(F.count("*").alias("waste"))


@query("SELECT layout, query_id, round(skip_events, 6) AS skip_events, round(skip_bytes, 6) AS skip_bytes FROM M")
def skip_ratio(w: Workload) -> DataFrame:
    return replay.with_skip(w.per_query, w.events).select("layout", "query_id", r6(F.col("skip_events")).alias("skip_events"), r6(F.col("skip_bytes")).alias("skip_bytes"))


@query("SELECT layout, round((SELECT count(*) FROM Q) * 0.01 * (SELECT n FROM P), 6) AS index_cost, CAST(sum(needed) AS BIGINT) AS needed, CAST(sum(waste) AS BIGINT) AS waste, round((SELECT count(*) FROM Q) * 0.01 * (SELECT n FROM P) + sum(needed) + sum(waste), 6) AS total FROM M GROUP BY ALL")
def cost_split(w: Workload) -> DataFrame:
    out = replay.cost_split(w.per_query, w.events, w.queries.agg(F.count("*").alias("n_queries")), 0.01)
    return out.select("layout", r6(F.col("index_cost")).alias("index_cost"), "needed", "waste", r6(F.col("total")).alias("total"))


@query("SELECT layout, query_id, skip_events > 0.5 AS pays FROM M")
def index_pays(w: Workload) -> DataFrame:
    return replay.with_skip(w.per_query, w.events).select("layout", "query_id", replay.pays(F.col("skip_events"), 0.5).alias("pays"))


@query("SELECT layout, CAST(sum(materialized) AS BIGINT) AS materialized, CAST(sum(waste) AS BIGINT) AS waste, round(avg(skip_events), 6) AS mean_skip FROM M GROUP BY ALL")
def layout_compare(w: Workload) -> DataFrame:
    s = replay.with_skip(w.per_query, w.events)
    return s.groupBy("layout").agg(F.sum("materialized").alias("materialized"), F.sum("waste").alias("waste"), r6(F.avg("skip_events")).alias("mean_skip"))


@query("SELECT set_name, CAST(sum(CASE layout WHEN 'insertion' THEN materialized ELSE -materialized END) AS BIGINT) AS saved, round(sum(CASE layout WHEN 'insertion' THEN materialized ELSE -materialized END) - 1000.0, 6) AS net_advantage FROM M JOIN Q USING (query_id) GROUP BY ALL")
def net_advantage(w: Workload) -> DataFrame:
    m = w.per_query.join(w.queries, "query_id").select("layout", "query_id", "set_name", "materialized")
    out = replay.net_advantage(m.where("layout = 'insertion'"), m.where("layout = 'brand'"), 1000.0, ["set_name"])
    return out.withColumn("net_advantage", r6(F.col("net_advantage")))


@query("SELECT *, round(mean_skip - lag(mean_skip) OVER (PARTITION BY layout ORDER BY month), 5) AS change FROM (SELECT layout, month, round(avg(skip_events), 6) AS mean_skip, CAST(sum(waste) AS BIGINT) AS waste FROM M JOIN Q USING (query_id) GROUP BY ALL)")
def drift_by_month(w: Workload) -> DataFrame:
    s = replay.with_skip(w.per_query, w.events).join(w.queries, "query_id").groupBy("layout", F.date_format("query_time", "yyyy-MM").alias("month"))
    s = s.agg(r6(F.avg("skip_events")).alias("mean_skip"), F.sum("waste").alias("waste"))
    return s.withColumn("change", F.round(F.col("mean_skip") - F.lag("mean_skip").over(W.partitionBy("layout").orderBy("month")), 5))


@query("SELECT layout, count(*) AS n_containers, round(median(n_events), 6) AS median_events, count(*) FILTER (WHERE n_events < 10) AS below, count(*) FILTER (WHERE n_events > 100) AS above FROM C GROUP BY ALL")
def size_health(w: Workload) -> DataFrame:
    return replay.health(w.containers, 10, 100).withColumn("median_events", r6(F.col("median_events")))


@query("SELECT layout, container_id, min(compressed) AS least, max(compressed) AS most FROM lay JOIN E USING (record_id) GROUP BY ALL")
def container_size_range(w: Workload) -> DataFrame:
    """The smallest and the largest event of each container."""
    return replay.size_range(w.both, w.events)


# -- fitness


@query("SELECT brand_id, n, k_total, round(p, 9) AS p FROM G")
def group_rates(w: Workload) -> DataFrame:
    return _rates(w).withColumn("p", F.round("p", 9))


def _counts(w: Workload) -> tuple[DataFrame, DataFrame]:
    return fitness.group_counts(w.events, w.training, "brand_id")


def _rates(w: Workload) -> DataFrame:
    n, k = _counts(w)
    return fitness.rates(n, k, "brand_id", w.n_training)


@query("SELECT round(sum(G.n / CAST(P.n AS DOUBLE) * pow(1 - p, s)), 6) AS v FROM G, P")
def v_marg_exact(w: Workload) -> DataFrame:
    return fitness.marginal_skip(_rates(w), w.size).select(r6(F.col("v_exact")).alias("v"))


@query("SELECT round(sum(G.n / CAST(P.n AS DOUBLE) * exp(-G.n * p)), 6) AS v FROM G, P")
def v_marg_poisson(w: Workload) -> DataFrame:
    return fitness.marginal_skip(_rates(w), w.size).select(r6(F.col("v_poisson")).alias("v"))


_DENSE = ", D AS (SELECT G.brand_id, G.n, x.query_id, coalesce(k, 0) AS k FROM G CROSS JOIN (SELECT DISTINCT query_id FROM T) x LEFT JOIN GK ON GK.brand_id = G.brand_id AND GK.query_id = x.query_id)\n"


def _query_v(w: Workload, term) -> DataFrame:
    n, k = _counts(w)
    return fitness.query_skip(n, k, "brand_id", w.n_training, term).select(r6(F.col("v")).alias("v"))


@query(_DENSE + "SELECT round(sum(D.n / CAST(P.n AS DOUBLE) * pow(1 - k / CAST(D.n AS DOUBLE), s)) / (SELECT q FROM K), 6) AS v FROM D, P")
def v_query_exact(w: Workload) -> DataFrame:
    return _query_v(w, fitness.exact_term(w.size))


@query(_DENSE + "SELECT round(sum(D.n / CAST(P.n AS DOUBLE) * exp(-k)) / (SELECT q FROM K), 6) AS v FROM D, P")
def v_query_poisson(w: Workload) -> DataFrame:
    return _query_v(w, fitness.poisson_term())


@query(_DENSE + "SELECT round(sum(D.n / CAST(P.n AS DOUBLE) * CASE WHEN k > D.n - 5 THEN 0 ELSE (D.n - k) * (D.n - k - 1.0) * (D.n - k - 2.0) * (D.n - k - 3.0) * (D.n - k - 4.0) / (D.n * (D.n - 1.0) * (D.n - 2.0) * (D.n - 3.0) * (D.n - 4.0)) END) / (SELECT q FROM K), 6) AS v FROM D, P")
def hypergeometric_skip(w: Workload) -> DataFrame:
    return _query_v(w, fitness.hypergeometric_term(5))


_USAGE = ", U AS (SELECT brand_id AS g, n, k_total AS u FROM G), X AS (SELECT g, n / sum(n) OVER () AS w, u / sum(u) OVER () AS q, u / n AS d FROM U), Y AS (SELECT *, sum(w) OVER (ORDER BY d, g ROWS UNBOUNDED PRECEDING) AS cw, sum(q) OVER (ORDER BY d, g ROWS UNBOUNDED PRECEDING) AS cq, row_number() OVER (ORDER BY d, g) AS r FROM X)\n"


@query(_USAGE + "SELECT round(1 - sum(w * (2 * cq - q)), 6) AS g, count(*) AS n_groups FROM Y")
def weighted_gini(w: Workload) -> DataFrame:
    n, k = _counts(w)
    return fitness.weighted_gini(fitness.usage(n, k, "brand_id")).select(r6(F.col("g")).alias("g"), "n_groups")


@query(_USAGE + "SELECT g AS brand_id, r AS rank, round(cw, 6) AS population, round(cq, 6) AS share FROM Y")
def lorenz(w: Workload) -> DataFrame:
    n, k = _counts(w)
    out = fitness.lorenz(fitness.usage(n, k, "brand_id"), "brand_id")
    return out.select("brand_id", "rank", r6(F.col("population")).alias("population"), r6(F.col("share")).alias("share"))


@query("""
, S AS (SELECT 'brand' AS grouping, brand_id AS g, record_id FROM E UNION ALL SELECT 'tree', CASE WHEN feature_size > 30 THEN 'large' ELSE brand_id END, record_id FROM E UNION ALL SELECT 'start', 'all', record_id FROM E),
U AS (SELECT grouping, g, count(DISTINCT S.record_id) AS n, count(T.query_id) AS u FROM S LEFT JOIN T USING (record_id) GROUP BY ALL),
X AS (SELECT *, n / sum(n) OVER (PARTITION BY grouping) AS w, u / sum(u) OVER (PARTITION BY grouping) AS q FROM U),
Y AS (SELECT *, sum(q) OVER (PARTITION BY grouping ORDER BY u / n, w ROWS UNBOUNDED PRECEDING) AS c FROM X),
Z AS (SELECT grouping, 1 - sum(w * (2 * c - q)) AS g, count(*) AS k FROM Y GROUP BY ALL)
SELECT z.grouping, round(z.g, 6) AS gini, z.k AS n_groups, round((z.g - s.g) / nullif(z.k - s.k, 0), 6) AS gain_per_group, round(z.g / z.k, 6) AS per_group FROM Z z, Z s WHERE s.grouping = 'start'
""")
def gini_gain(w: Workload) -> DataFrame:
    keys = {"start": F.lit("all"), "brand": F.col("brand_id"), "tree": F.when(F.col("feature_size") > 30, "large").otherwise(F.col("brand_id"))}
    each = w.events.select("record_id", F.inline(F.array(*[F.struct(F.lit(n).alias("grouping"), c.alias("g")) for n, c in keys.items()])))
    n = each.groupBy("grouping", "g").agg(F.count("*").alias("n"))
    u = w.training.join(each, "record_id").groupBy("grouping", "g").agg(F.count("*").alias("usage"))
    scored = fitness.weighted_gini(n.join(u, ["grouping", "g"], "left").na.fill(0, ["usage"]), ["grouping"])
    start = scored.where("grouping = 'start'").select(F.col("g").alias("g0"), F.col("n_groups").alias("k0"))
    more = F.col("n_groups") - F.col("k0")
    out = scored.join(F.broadcast(start))
    return out.select("grouping", r6(F.col("g")).alias("gini"), "n_groups", r6(F.when(more != 0, (F.col("g") - F.col("g0")) / more)).alias("gain_per_group"), r6(F.col("g") / F.col("n_groups")).alias("per_group"))


@query(", R AS (SELECT (SELECT count(*) FROM T) / (q * CAST(n AS DOUBLE)) AS p FROM K, P) SELECT layout, round(avg(pow(1 - p, n_events)), 6) AS skip, round(avg(exp(-p * n_events)), 6) AS skip_poisson FROM C, R GROUP BY ALL")
def patternless_baseline(w: Workload) -> DataFrame:
    rate = w.training.agg((F.count("*") / F.lit(float(w.n_training) * w.n_events)).alias("p"))
    return fitness.patternless(w.containers.select("layout", "n_events"), rate).select("layout", r6(F.col("skip")).alias("skip"), r6(F.col("skip_poisson")).alias("skip_poisson"))


@query("SELECT round(sum(kg * pow(1 - p, n / kg)), 6) AS skipped, round(sum(kg * exp(-n * p / kg)), 6) AS skipped_poisson FROM (SELECT G.n, p, CAST(ceil(G.n / CAST(s AS DOUBLE)) AS BIGINT) AS kg FROM G, P)")
def allocation_expected(w: Workload) -> DataFrame:
    out = fitness.allocated(_rates(w), F.ceil(F.col("n") / F.lit(float(w.size))))
    return out.select(r6(F.col("skipped")).alias("skipped"), r6(F.col("skipped_poisson")).alias("skipped_poisson"))


@query("SELECT brand_id, round(exp(-p * s) - pow(1 - p, s), 9) AS error, round(p * s * p / 2 * exp(-p * s), 9) AS leading FROM G, P WHERE p > 0")
def poisson_error(w: Workload) -> DataFrame:
    exact, leading = fitness.poisson_error(F.col("p"), F.col("p") * w.size)
    return _rates(w).where("p > 0").select("brand_id", F.round(exact, 9).alias("error"), F.round(leading, 9).alias("leading"))


@query("SELECT round(sum(n * p) / sum(n), 9) AS p, (SELECT round(count(*) / (q * CAST(P.n AS DOUBLE)), 9) FROM T, K, P GROUP BY q, P.n) AS overall FROM G")
def rate_invariance(w: Workload) -> DataFrame:
    whole = w.training.agg(F.round(F.count("*") / F.lit(float(w.n_training) * w.n_events), 9).alias("overall"))
    return _rates(w).agg(F.round(F.sum(F.col("n") * F.col("p")) / F.sum("n"), 9).alias("p")).join(F.broadcast(whole))


# -- trees and search

_TREE = "CASE WHEN feature_size > 30 THEN 'r1' WHEN brand_id = 'Brand#11' THEN 'r01' ELSE 'r00' END"
TREE = layouts.Tree(layouts.Cut("feature_size", ">", 30), layouts.Tree(), layouts.Tree(layouts.Cut("brand_id", "=", "Brand#11"), layouts.Tree(), layouts.Tree()))


@query(f", S AS (SELECT record_id, {_TREE} AS leaf FROM E) SELECT leaf, count(DISTINCT S.record_id) AS n, count(T.query_id) AS usage FROM S LEFT JOIN T USING (record_id) GROUP BY ALL")
def split_tree_groups(w: Workload) -> DataFrame:
    tagged = w.events.withColumn("leaf", TREE.column())
    n, k = fitness.group_counts(tagged, w.training, "leaf")
    return fitness.usage(n, k, "leaf")


@query("SELECT CASE WHEN brand_id IN ('Brand#11', 'Brand#12', 'Brand#13') THEN brand_id ELSE 'Rest combined' END AS bucket, count(*) AS n, round(100.0 * count(*) / (SELECT n FROM P), 6) AS percent FROM E GROUP BY ALL")
def top_values_rollup(w: Workload) -> DataFrame:
    bucket = layouts.top_values("brand_id", ["Brand#11", "Brand#12", "Brand#13"])
    return w.events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("percent", r6(F.lit(100.0) * F.col("n") / w.n_events))


@query("""
, TB AS (SELECT record_id, CASE WHEN brand_id IN ('Brand#11', 'Brand#12', 'Brand#13') THEN brand_id ELSE 'Rest combined' END AS bucket FROM E)
SELECT bucket, round(100.0 * count(DISTINCT TB.record_id) / (SELECT n FROM P), 6) AS population, round(100.0 * count(query_id) / (SELECT count(*) FROM L), 6) AS selected FROM TB LEFT JOIN L USING (record_id) GROUP BY ALL
""")
def top_values_shares(w: Workload) -> DataFrame:
    """Each bucket's share of the events and of what is selected."""
    bucket = layouts.top_values("brand_id", ["Brand#11", "Brand#12", "Brand#13"])
    return describe.bucket_shares(w.events.select("record_id", bucket.alias("bucket")), w.selections).select("bucket", r6(F.col("population")).alias("population"), r6(F.col("selected")).alias("selected"))


@query("SELECT CASE WHEN feature_size < 10 THEN 'small' WHEN feature_size < 30 THEN 'middle' ELSE 'large' END AS range, count(*) AS n, CAST(sum(compressed) AS BIGINT) AS compressed FROM E GROUP BY ALL")
def range_ladder(w: Workload) -> DataFrame:
    return w.events.groupBy(layouts.ladder("feature_size", [10, 30], ["small", "middle", "large"]).alias("range")).agg(F.count("*").alias("n"), F.sum("compressed").alias("compressed"))


FEATURES = ["brand_id", "feature_type", "feature_size"]
_STATS = """
, V AS (SELECT record_id, 'brand_id' AS feature, brand_id AS value FROM E UNION ALL SELECT record_id, 'feature_type', feature_type FROM E UNION ALL SELECT record_id, 'feature_size', CAST(feature_size AS VARCHAR) FROM E),
SN AS (SELECT feature, value, count(*) AS n FROM V GROUP BY ALL), SK AS (SELECT feature, value, count(*) AS k_total, count(DISTINCT query_id) AS touch FROM V JOIN T USING (record_id) GROUP BY ALL),
ST AS (SELECT feature, value, n, coalesce(k_total, 0) AS k_total, coalesce(touch, 0) AS touch FROM SN LEFT JOIN SK USING (feature, value)),
CG AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nl, sum(k_total) OVER (PARTITION BY feature) AS kl FROM ST),
GA AS (SELECT feature, value, n, n * exp(-k_total / CAST(q AS DOUBLE)) + (nl - n) * exp(-(kl - k_total) / CAST(q AS DOUBLE)) - nl * exp(-kl / CAST(q AS DOUBLE)) AS gain FROM CG, K WHERE n < nl)
"""


def _gains(w: Workload) -> DataFrame:
    stats = search.cut_statistics(w.events.withColumn("leaf", F.lit("r")), w.training, FEATURES)
    return search.equality_gains(stats, w.n_training)


@query(_STATS + "SELECT 'r' AS leaf, feature, value, n, k_total, touch FROM ST")
def cut_statistics(w: Workload) -> DataFrame:
    return search.cut_statistics(w.events.withColumn("leaf", F.lit("r")), w.training, FEATURES)


@query(_STATS + "SELECT feature, value, n, round(gain, 6) AS gain FROM GA ORDER BY round(gain, 6) DESC, feature, value LIMIT 1")
def best_cut(w: Workload) -> DataFrame:
    return _gains(w).select("feature", "value", "n", r6(F.col("gain")).alias("gain")).orderBy(F.desc("gain"), "feature", "value").limit(1)


@query(_STATS + "SELECT feature, value, n, round(gain, 6) AS gain FROM GA ORDER BY round(gain, 6) DESC, feature, value LIMIT 5")
def beam_top(w: Workload) -> DataFrame:
    return _gains(w).select("feature", "value", "n", r6(F.col("gain")).alias("gain")).orderBy(F.desc("gain"), "feature", "value").limit(5)


@query("""
, F0 AS (SELECT feature_size AS value, count(*) AS n FROM E GROUP BY ALL), FK AS (SELECT feature_size AS value, count(*) AS k FROM T JOIN E USING (record_id) GROUP BY ALL),
FS AS (SELECT value, sum(n) OVER w AS n0, sum(coalesce(k, 0)) OVER w AS k0, sum(n) OVER () AS nl, sum(coalesce(k, 0)) OVER () AS kl FROM F0 LEFT JOIN FK USING (value) WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING))
SELECT CAST(value AS VARCHAR) AS value, CAST(nl - n0 AS BIGINT) AS n, round(n0 * exp(-k0 / CAST(q AS DOUBLE)) + (nl - n0) * exp(-(kl - k0) / CAST(q AS DOUBLE)) - nl * exp(-kl / CAST(q AS DOUBLE)), 6) AS gain FROM FS, K WHERE n0 < nl
""")
def threshold_cuts(w: Workload) -> DataFrame:
    stats = search.cut_statistics(w.events.withColumn("leaf", F.lit("r")), w.training, ["feature_size"])
    return search.threshold_gains(stats, w.n_training).select("value", "n", r6(F.col("gain")).alias("gain"))


@query(_STATS + """
SELECT feature, CAST(count(*) AS BIGINT) AS n_children, min(n) AS n, round(sum(n * exp(-k_total / CAST(q AS DOUBLE))) - sum(n) * exp(-sum(k_total) / CAST(q AS DOUBLE)), 6) AS gain
FROM ST, K GROUP BY feature, q HAVING count(*) > 1
""")
def multiway_cuts(w: Workload) -> DataFrame:
    """Each feature as a cut into one child a value."""
    stats = search.cut_statistics(w.events.withColumn("leaf", F.lit("r")), w.training, FEATURES)
    return search.multiway_gains(stats, w.n_training).select("feature", "n_children", "n", r6(F.col("gain")).alias("gain"))


@query(_STATS + "SELECT feature, value, n, round(abs(n / nl - k_total / kl), 6) AS gain FROM CG WHERE n < nl")
def cuts_by_gini(w: Workload) -> DataFrame:
    """Cuts scored by the inequality of use that they uncover."""
    stats = search.cut_statistics(w.events.withColumn("leaf", F.lit("r")), w.training, FEATURES)
    return search.gini_gains(stats).select("feature", "value", "n", r6(F.col("gain")).alias("gain"))


@query(_STATS + """
, KQ AS (SELECT query_id, count(*) AS kq FROM T GROUP BY ALL), VQ AS (SELECT feature, value, query_id, count(*) AS k FROM V JOIN T USING (record_id) GROUP BY ALL),
DQ AS (SELECT s.feature, s.value, s.n, KQ.query_id, kq, coalesce(k, 0) AS k FROM SN s CROSS JOIN KQ LEFT JOIN VQ ON VQ.feature = s.feature AND VQ.value = s.value AND VQ.query_id = KQ.query_id)
SELECT feature, value, DQ.n, round(sum(DQ.n * exp(-k) + (P.n - DQ.n) * exp(-(kq - k)) - P.n * exp(-kq)) / (SELECT q FROM K), 6) AS gain FROM DQ, P WHERE DQ.n < P.n GROUP BY feature, value, DQ.n
""")
def cuts_by_query_skip(w: Workload) -> DataFrame:
    """Cuts scored by the skip that each query is expected to have."""
    out = search.query_gains(w.events.withColumn("leaf", F.lit("r")), w.training, FEATURES, w.n_training)
    return out.select("feature", "value", "n", r6(F.col("gain")).alias("gain"))


@query()
def greedy_tree(w: Workload) -> DataFrame:
    """Cuts of a greedy search, in order."""
    _, cuts = search.greedy(w.events, w.training, FEATURES, w.n_training, search.Bounds(max_leaves=5))
    return w.spark.createDataFrame([(i, leaf, c.column, c.op, str(c.value), round(g, 6)) for i, (g, leaf, c) in enumerate(cuts)], "step int, leaf string, feature string, op string, value string, gain double")


@query(f"""
, S AS (SELECT record_id, {_TREE} AS leaf FROM E), Z AS (SELECT record_id, leaf, (row_number() OVER (PARTITION BY leaf ORDER BY record_id) - 1) // s AS c FROM S, P), ZN AS (SELECT leaf, c, count(*) AS n FROM Z GROUP BY ALL),
O AS (SELECT query_id, sum(n) AS m FROM (SELECT DISTINCT leaf, c, query_id FROM Z JOIN L USING (record_id) WHERE query_id >= 200) JOIN ZN USING (leaf, c) GROUP BY ALL)
SELECT (SELECT count(*) FROM ZN) AS n_containers, round(avg(1 - m / n), 6) AS mean_skip, avg(1 - m / n) >= 0.3 AS passed FROM O, P
""")
def holdout_gate(w: Workload) -> DataFrame:
    return search.holdout(w.events, w.validation, TREE.column(), w.size, 0.3).withColumn("mean_skip", r6(F.col("mean_skip")))


# -- allocation


def _groups(w: Workload) -> DataFrame:
    return _rates(w).select(F.col("brand_id").alias("group_id"), "n", "p")


def _floor(w: Workload) -> int:
    return max(2, w.size // 10)


def _ladder(w: Workload) -> DataFrame:
    return allocate.ladder(_groups(w), _floor(w))


@query("SELECT group_id, j, k, round(v, 6) AS v FROM lad")
def ladder(w: Workload) -> DataFrame:
    return _ladder(w).select("group_id", "j", "k", r6(F.col("v")).alias("v"))


@query("SELECT group_id, j, k, dk, round(dv, 6) AS dv, round(e, 6) AS e FROM ed")
def upgrade_edges(w: Workload) -> DataFrame:
    return allocate.edges(_ladder(w)).select("group_id", "j", "k", "dk", r6(F.col("dv")).alias("dv"), r6(F.col("e")).alias("e"))


@query("SELECT group_id, count(*) AS n_edges, CAST(coalesce(sum(CASE WHEN up THEN 1 ELSE 0 END), 0) AS BIGINT) AS rising FROM (SELECT group_id, e > lag(e) OVER (PARTITION BY group_id ORDER BY j) AS up FROM ed) GROUP BY ALL")
def concavity(w: Workload) -> DataFrame:
    return allocate.concavity(allocate.edges(_ladder(w)))


@query("SELECT group_id, GR.n, round(p, 9) AS p, round(GR.n * p, 6) AS np, round(GR.n * p / 2, 6) AS k_inflection, CAST(greatest(ceil(GR.n * p / 2), 1) AS BIGINT) AS k_start, CAST(greatest(GR.n // greatest(2, s // 10), 1) AS BIGINT) AS k_max, round(-GR.n * p / ln(0.5), 6) AS k_bar, round(exp(-GR.n * p / greatest(GR.n // greatest(2, s // 10), 1)), 6) AS skip_at_max, greatest(ceil(GR.n * p / 2), 1) <= greatest(GR.n // greatest(2, s // 10), 1) AND exp(-GR.n * p / greatest(GR.n // greatest(2, s // 10), 1)) >= 0.5 AS allowed FROM GR, P")
def guardrails(w: Workload) -> DataFrame:
    g = allocate.guarded(_groups(w), _floor(w))
    return g.select("group_id", "n", F.round("p", 9).alias("p"), *[r6(F.col(c)).alias(c) for c in ("np", "k_inflection")], "k_start", "k_max", *[r6(F.col(c)).alias(c) for c in ("k_bar", "skip_at_max")], "allowed")


@query("""
, gl AS (SELECT * FROM lad WHERE k = 1 OR k >= greatest(ceil(n * p / 2), 1) AND exp(-n * p / k) >= 0.5)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY k) - 1 AS BIGINT) AS j, k, round(v, 6) AS v FROM gl
""")
def guarded_ladder(w: Workload) -> DataFrame:
    """What each group is offered once the guardrails are applied."""
    return allocate.guarded_ladder(_groups(w), _floor(w)).select("group_id", "j", "k", r6(F.col("v")).alias("v"))


_ACCEPT = ", bo AS (SELECT *, min(e) OVER (PARTITION BY group_id ORDER BY j) AS bound FROM ed), ac AS (SELECT *, row_number() OVER (ORDER BY bound DESC, group_id, j) AS step, sum(dk) OVER (ORDER BY bound DESC, group_id, j ROWS UNBOUNDED PRECEDING) + (SELECT count(*) FROM GR) AS spent FROM bo)\n"


@query(_ACCEPT + "SELECT group_id, j, step, CAST(spent AS BIGINT) AS spent FROM ac")
def greedy_order(w: Workload) -> DataFrame:
    """The order in which a scan without a limit takes the steps."""
    steps = allocate.acceptance(allocate.edges(_ladder(w)))
    order = W.orderBy(F.desc("bound"), "group_id", "j")
    m = _groups(w).agg(F.count("*").alias("m"))
    out = steps.withColumn("step", F.row_number().over(order).cast("long")).withColumn("run", F.sum("dk").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.join(F.broadcast(m)).select("group_id", "j", "step", (F.col("run") + F.col("m")).alias("spent"))


@query(_ACCEPT + """
SELECT CAST(step AS BIGINT) AS step, group_id, CAST(k + dk AS BIGINT) AS k, CAST(spent AS BIGINT) AS spent,
  round((SELECT sum(v) FROM lad WHERE j = 0) / (SELECT sum(n) FROM GR) + sum(dv) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM GR), 6) AS skip_ratio,
  round(spent / ((SELECT count(*) FROM GR) + (SELECT sum(dk) FROM ed)), 6) AS metadata_cost, spent <= 4 * (SELECT count(*) FROM GR) AS affordable FROM ac
""")
def spend_curve(w: Workload) -> DataFrame:
    """What each further container brings, past a budget of four a group too."""
    rungs = _ladder(w)
    n = rungs.select("group_id").distinct().count()
    out = allocate.spend_curve(allocate.edges(rungs), rungs, 4 * n)
    return out.select("step", "group_id", "k", "spent", r6(F.col("skip_ratio")).alias("skip_ratio"), r6(F.col("metadata_cost")).alias("metadata_cost"), "affordable")


@query()
def greedy_alloc(w: Workload) -> DataFrame:
    """What each group gets under a budget of four containers a group."""
    rungs = _ladder(w)
    n = rungs.select("group_id").distinct().count()
    return allocate.chosen(rungs, allocate.greedy(allocate.edges(rungs), n, 4 * n)).withColumn("v", r6(F.col("v")))


@query()
def mckp_trace(w: Workload) -> DataFrame:
    rungs = _ladder(w)
    steps, n = allocate.edges(rungs), rungs.select("group_id").distinct().count()
    out = allocate.trace(steps, allocate.greedy(steps, n, 4 * n), rungs)
    return out.select("step", "group_id", "k", "spent", r6(F.col("e")).alias("e"), r6(F.col("skip_ratio")).alias("skip_ratio"))


# -- packing, tracking, reading


@query("SELECT brand_id, (row_number() OVER (PARTITION BY brand_id ORDER BY record_id) - 1) // s AS container, record_id FROM E, P")
def equal_size_packing(w: Workload) -> DataFrame:
    return layouts.equal_size(w.events, "brand_id", w.size)


@query("SELECT brand_id, (row_number() OVER (PARTITION BY brand_id ORDER BY record_id) - 1) * 3 // count(*) OVER (PARTITION BY brand_id) AS container, record_id FROM E")
def even_packing(w: Workload) -> DataFrame:
    return layouts.split_evenly(w.events, "brand_id", w.events.select("brand_id").distinct().withColumn("k", F.lit(3)))


@query("SELECT record_id, CAST((sum(compressed) OVER (ORDER BY record_id) - compressed) // 1000000 AS BIGINT) AS container_id FROM E")
def byte_capped_packing(w: Workload) -> DataFrame:
    return layouts.byte_capped(w.events, 1_000_000)


@query("SELECT event_id, event_type AS group_key, event_id % n AS slot, 1 + (event_id % n) // 100 AS seq FROM (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n FROM events)", base=False)
def tracker_slots(w: Workload) -> DataFrame:
    from ..streaming.lakehouse import slots

    batch = w.table("events").select("event_id", F.col("event_type").alias("group_key"))
    empty = w.spark.createDataFrame([], "group_key string, k long, s_1 long")
    return slots(batch, empty, 100, F.col("event_id")).select("event_id", "group_key", "slot", "seq")


@query("SELECT event_type AS group_key, CAST(1 + count(*) // 100 AS BIGINT) AS k, CAST(count(*) % 100 AS BIGINT) AS s_1 FROM events GROUP BY ALL", base=False)
def tracker_advance(w: Workload) -> DataFrame:
    from ..streaming.lakehouse import advanced

    batch = w.table("events").select("event_id", F.col("event_type").alias("group_key"))
    return advanced(batch, w.spark.createDataFrame([], "group_key string, k long, s_1 long"), 100)


@query("""
WITH B AS (SELECT event_id, event_type AS group_key, event_id % 2 AS batch FROM events), N AS (SELECT group_key, batch, count(*) AS n FROM B GROUP BY ALL),
S1 AS (SELECT group_key, CAST(1 + n // 100 AS BIGINT) AS k, CAST(n % 100 AS BIGINT) AS s_1 FROM N WHERE batch = 0)
SELECT event_id, B.group_key, coalesce(s_1, 0) + event_id % n AS slot, coalesce(k, 1) + (coalesce(s_1, 0) + event_id % n) // 100 AS seq
FROM B JOIN N USING (group_key, batch) LEFT JOIN S1 USING (group_key) WHERE batch = 1
""", base=False)
def tracker_carried(w: Workload) -> DataFrame:
    """Slots of a second batch, after the state that the first has left."""
    from ..streaming.lakehouse import advanced, slots

    both = w.table("events").select("event_id", F.col("event_type").alias("group_key"))
    empty = w.spark.createDataFrame([], "group_key string, k long, s_1 long")
    state = advanced(both.where("event_id % 2 = 0"), empty, 100)
    return slots(both.where("event_id % 2 = 1"), state, 100, F.col("event_id")).select("event_id", "group_key", "slot", "seq")


@query("""
, R AS (SELECT container_id, min(feature_size) AS low, max(feature_size) AS high, count(*) AS n, count(*) FILTER (WHERE feature_size BETWEEN 49 AND 50) AS kept FROM lay JOIN E USING (record_id) WHERE layout = 'brand' GROUP BY ALL)
SELECT count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS read, CAST(coalesce(sum(kept), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n - kept), 0) AS BIGINT) AS waste FROM R WHERE high >= 49 AND low <= 50
""")
def observed_cost(w: Workload) -> DataFrame:
    """What a read through a minimum and maximum index opened, with the files that held nothing it wanted."""
    from ..streaming.lakehouse import may_hold, observed_scan

    rows = w.by_brand.join(w.events.select("record_id", "feature_size"), "record_id")
    ranges = rows.groupBy("container_id").agg(F.min("feature_size").alias("low"), F.max("feature_size").alias("high"))
    return observed_scan(rows.join(may_hold(ranges, 49, 50), "container_id", "left_semi"), F.col("container_id"), F.col("feature_size").between(49, 50))


@query("SELECT DISTINCT container_id FROM lay JOIN E USING (record_id) WHERE layout = 'brand' AND brand_id = 'Brand#23' AND feature_size > 40")
def index_activation(w: Workload) -> DataFrame:
    index = w.by_brand.join(w.events.select("record_id", "brand_id", "feature_size"), "record_id").select("brand_id", "feature_size", "container_id").distinct()
    return index.where("brand_id = 'Brand#23' AND feature_size > 40").select("container_id").distinct()


@query("SELECT container_id, min(feature_size) AS low, max(feature_size) AS high FROM lay JOIN E USING (record_id) WHERE layout = 'brand' GROUP BY ALL HAVING max(feature_size) >= 49 AND min(feature_size) <= 50")
def minmax_activation(w: Workload) -> DataFrame:
    from ..streaming.lakehouse import may_hold

    ranges = w.by_brand.join(w.events.select("record_id", "feature_size"), "record_id").groupBy("container_id").agg(F.min("feature_size").alias("low"), F.max("feature_size").alias("high"))
    return may_hold(ranges, 49, 50)


@query("SELECT user_id, date_trunc('hour', ts) AS bin, bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase, bool_or(event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY ALL", base=False)
def usage_summary_hourly(w: Workload) -> DataFrame:
    names = ["click", "purchase", "view"]
    log = w.table("events").where(F.col("event_type").isin(*names))
    return kpi.usage_summary(log, "user_id", "ts", "event_type", names)


@query("""
, TI AS (SELECT brand_id AS grp, feature_type AS tile_id, count(*) AS size, avg(coalesce(d, 0)) AS demand FROM E LEFT JOIN (SELECT record_id, count(*) AS d FROM L GROUP BY ALL) USING (record_id) GROUP BY ALL),
RO AS (SELECT grp, tile_id, sum(size) AS size, sum(size * demand) / sum(size) AS kpi FROM TI GROUP BY ROLLUP (grp, tile_id))
SELECT grp, tile_id, CAST(size AS BIGINT) AS size, round(kpi, 6) AS kpi, round(size / (SELECT n FROM P), 6) AS share, CASE WHEN round(kpi, 6) <= 2.0 THEN 'cold' WHEN round(kpi, 6) >= 5.0 THEN 'hot' ELSE 'warm' END AS band FROM RO
""")
def usage_map(w: Workload) -> DataFrame:
    d = w.selections.groupBy("record_id").agg(F.count("*").alias("d"))
    tiles = w.events.join(d, "record_id", "left").groupBy(F.col("brand_id").alias("grp"), F.col("feature_type").alias("tile_id")).agg(F.count("*").alias("size"), F.avg(F.coalesce("d", F.lit(0))).alias("demand"))
    m = kpi.usage_map(tiles, 2.0, 5.0).withColumns({"kpi": r6(F.col("kpi")), "share": r6(F.col("share"))})
    return m.withColumn("band", kpi.band(F.col("kpi"), 2.0, 5.0))


# -- workload model


@query("SELECT DISTINCT feature_size, round(feature_size / 50.0 / (feature_size / 50.0 + 0.25), 9) AS saturation FROM E")
def saturation_curve(w: Workload) -> DataFrame:
    return w.events.select("feature_size", F.round(model.saturation(F.col("feature_size") / F.lit(50.0), 0.25), 9).alias("saturation")).distinct()


@query("SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, round(pow(2, -date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') / 91.0), 9) AS recency FROM orders", base=False)
def recency_decay(w: Workload) -> DataFrame:
    day = F.to_date("o_orderdate")
    return w.table("orders").select(F.date_format(day, "yyyy-MM-dd").alias("day"), F.round(model.recency(F.datediff(F.lit("2001-12-31").cast("date"), day), 91.0), 9).alias("recency")).distinct()


@query("SELECT record_id, round(least(greatest(x * 0.05 * n / t, 0), 1), 9) AS p FROM (SELECT record_id, feature_size / 50.0 / (feature_size / 50.0 + 0.25) AS x, sum(feature_size / 50.0 / (feature_size / 50.0 + 0.25)) OVER () AS t FROM E), P")
def selection_probability(w: Workload) -> DataFrame:
    x = w.events.select("record_id", model.saturation(F.col("feature_size") / F.lit(50.0), 0.25).alias("x"))
    total = x.agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    return x.join(F.broadcast(total)).select("record_id", F.round(model.inclusion(F.col("x"), F.col("t"), F.lit(0.05) * F.col("n")), 9).alias("p"))


@query("SELECT record_id, count(*) AS demand FROM L GROUP BY ALL")
def bitmap_demand(w: Workload) -> DataFrame:
    return bitmaps.size(bitmaps.support(w.selections))


@query("SELECT C.container_id, count(query_id) AS breadth FROM C LEFT JOIN A USING (layout, container_id) WHERE C.layout = 'brand' GROUP BY ALL")
def bitmap_union(w: Workload) -> DataFrame:
    u = bitmaps.union(bitmaps.support(w.selections), w.by_brand.select("record_id", "container_id"))
    return u.groupBy("container_id").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("breadth"))


@query("SELECT record_id, CAST(bool_or(query_id = 10) AS INT) AS \"10\", CAST(bool_or(query_id = 11) AS INT) AS \"11\", CAST(bool_or(query_id = 12) AS INT) AS \"12\" FROM L WHERE query_id IN (10, 11, 12) GROUP BY ALL")
def bitmap_unpack(w: Workload) -> DataFrame:
    return bitmaps.unpack(w.selections, [10, 11, 12])


@query("SELECT record_id, query_id FROM L")
def bitmap_unpack_all(w: Workload) -> DataFrame:
    """The whole log, from its packed supports."""
    return bitmaps.unpack_all(bitmaps.support(w.selections))


_DOC = """
, SC AS (SELECT CAST(record_id AS VARCHAR) AS id, record_id // 3 AS c FROM E WHERE record_id < 12), LO AS (SELECT CAST(record_id AS VARCHAR) AS record_id, query_id FROM L WHERE record_id < 12),
SZ AS (SELECT c, count(*) AS n FROM SC GROUP BY ALL), ME AS (SELECT c, count(DISTINCT query_id) AS d, count(*) AS k FROM SC JOIN LO ON id = record_id GROUP BY ALL),
EA AS (SELECT SZ.c, n, coalesce(d, 0) AS d, coalesce(k, 0) AS k FROM SZ LEFT JOIN ME USING (c)),
AL AS (SELECT CAST(c AS INT) AS container_id, n AS n_events, d AS breadth, n * d AS opened, k AS needed FROM EA UNION ALL SELECT NULL, sum(n), sum(d), sum(n * d), sum(k) FROM EA)
SELECT 'threes' AS layout, container_id, CAST(n_events AS BIGINT) AS n_events, CAST(breadth AS BIGINT) AS breadth, CAST(opened AS BIGINT) AS opened, CAST(needed AS BIGINT) AS needed, CAST(opened - needed AS BIGINT) AS wasted, round(CASE WHEN needed > 0 THEN opened / needed ELSE 0 END, 6) AS amplification FROM AL
"""


@query(_DOC)
def scenario_evaluate(w: Workload) -> DataFrame:
    """A scenario document of twelve events, made with nested functions and read back as one."""
    from ..sources import scenario

    few = w.events.where("record_id < 12")
    log = w.selections.where("record_id < 12")
    part = few.groupBy(F.floor(F.col("record_id") / 3).cast("int").alias("tag")).agg(F.array_sort(F.collect_list(F.col("record_id").cast("string"))).alias("events"))
    doc = (
        few.agg(F.collect_list(F.struct(F.col("record_id").cast("string").alias("id"), F.array("brand_id").alias("attrs"))).alias("events"))
        .join(log.select("query_id").distinct().agg(F.collect_list(F.struct(F.col("query_id").cast("int").alias("id"), F.lit("").alias("label"))).alias("queries")))
        .join(log.agg(F.collect_list(F.struct(F.col("record_id").cast("string").alias("record_id"), F.col("query_id").cast("int").alias("query_id"))).alias("selection_log")))
        .join(part.agg(F.array(F.struct(F.lit("threes").alias("key"), F.lit("").alias("name"), F.lit("").alias("caption"), F.collect_list(F.struct("tag", F.array(F.lit("")).alias("labels"), "events")).alias("containers"))).alias("layouts")))
    )
    return scenario.evaluate(scenario.from_document(doc)).withColumn("amplification", r6(F.col("amplification")))


@query("""
, SC AS (SELECT record_id, record_id // 3 AS c FROM E), SZ AS (SELECT c, count(*) AS n FROM SC GROUP BY ALL),
ME AS (SELECT c, count(DISTINCT query_id) AS d, count(*) AS k FROM SC JOIN L USING (record_id) GROUP BY ALL),
EA AS (SELECT SZ.c, n, coalesce(d, 0) AS d, coalesce(k, 0) AS k FROM SZ LEFT JOIN ME USING (c)),
AL AS (SELECT CAST(c AS INT) AS container_id, n AS n_events, d AS breadth, n * d AS opened, k AS needed FROM EA UNION ALL SELECT NULL, sum(n), sum(d), sum(n * d), sum(k) FROM EA)
SELECT 'threes' AS layout, container_id, CAST(n_events AS BIGINT) AS n_events, CAST(breadth AS BIGINT) AS breadth, CAST(opened AS BIGINT) AS opened, CAST(needed AS BIGINT) AS needed, CAST(opened - needed AS BIGINT) AS wasted, round(CASE WHEN needed > 0 THEN opened / needed ELSE 0 END, 6) AS amplification FROM AL
""")
def scenario_evaluate_all(w: Workload) -> DataFrame:
    """The scenario's relations over all events and the whole log; the round trip by one document is that of ``scenario_evaluate``."""
    from ..sources import scenario

    key = F.col("record_id").cast("string")
    s = scenario.Scenario(
        w.events.select(key.alias("id"), F.array("brand_id").alias("attrs")), w.queries.select(F.col("query_id").cast("int").alias("id"), F.lit("").alias("label")),
        w.selections.select(key.alias("record_id"), F.col("query_id").cast("int").alias("query_id")),
        w.events.select(F.lit("threes").alias("layout"), F.floor(F.col("record_id") / 3).cast("int").alias("container_id"), F.array(F.lit("")).alias("labels"), key.alias("record_id")),
    )
    return scenario.evaluate(s).withColumn("amplification", r6(F.col("amplification")))


@query()
def synthetic_profile(w: Workload) -> DataFrame:
    """Queries of the default synthetic corpus and what they select."""
    from ..sources import synthetic

    c = synthetic.Config()
    e, q = synthetic.events(w.spark, c), synthetic.queries(w.spark, c)
    n = synthetic.selections(e, q, c).groupBy("query_id").agg(F.count("*").alias("n_selected"))
    return q.join(n, "query_id", "left").select("query_id", "query_time", "set_name", F.col("_query_type").alias("query_type"), "n_selected")


def _folder(w: Workload) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(w.spark)}/lake-{uuid.uuid4().hex}"


@query()
def stream_landing(w: Workload) -> DataFrame:
    """The events table as a stream, landed, split by type, allocated and committed; rows by container."""
    return _streamed(w).sink().groupBy("partition_id").agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"))


def _streamed(w: Workload):
    from ..streaming.lakehouse import Lakehouse

    top = _folder(w)
    source = w.table("events").select(F.col("event_id").alias("record_id"), "ts", "event_type", "value")
    source.write.mode("overwrite").parquet(f"{top}/in")
    lake = Lakehouse(w.spark, top, F.col("event_type"), 500, ("event_type",))
    lake.land(w.spark.readStream.schema(source.schema).parquet(f"{top}/in"), f"{top}/cp1").awaitTermination()
    lake.run(w.spark.readStream.schema(source.schema).parquet(f"{top}/landing"), f"{top}/cp2").awaitTermination()
    return lake


@query()
def dpp_read(w: Workload) -> DataFrame:
    """A read through the index, which prunes containers at run time."""
    from ..streaming.lakehouse import Lakehouse

    top = _folder(w)
    lake = Lakehouse(w.spark, top, F.col("brand_id"), w.size, ("brand_id", "feature_size"))
    lake.write(w.events, 0)
    return lake.read((F.col("brand_id") == "Brand#23") & (F.col("feature_size") > 40)).select("record_id", "brand_id", "feature_size", "compressed")


SQL["dpp_read"] = BASE + "SELECT record_id, brand_id, feature_size, compressed FROM E WHERE brand_id = 'Brand#23' AND feature_size > 40"


@query("SELECT record_id, brand_id FROM E WHERE brand_id = 'Brand#23' AND feature_size > 40")
def compacted_read(w: Workload) -> DataFrame:
    """A pruned read over a compacted version and a batch that came after it."""
    from ..streaming.lakehouse import Lakehouse

    lake = Lakehouse(w.spark, _folder(w), F.col("brand_id"), w.size, ("brand_id", "feature_size"))
    for k in range(2):
        lake.write(w.events.where(F.col("record_id") % 3 == k), k)
    lake.compact()
    lake.vacuum()
    lake.write(w.events.where(F.col("record_id") % 3 == 2), 2)
    return lake.read((F.col("brand_id") == "Brand#23") & (F.col("feature_size") > 40)).select("record_id", "brand_id")


@query("SELECT event_id AS record_id, event_type, event_id % 2 = 0 AS committed FROM events", base=False)
def two_tier_read(w: Workload) -> DataFrame:
    """Rows that a batch has committed and rows that have only landed, as one table."""
    from ..streaming.lakehouse import Lakehouse

    top = _folder(w)
    source = w.table("events").select(F.col("event_id").alias("record_id"), "event_type")
    lake = Lakehouse(w.spark, top, F.col("event_type"), 500, ("event_type",))
    source.where("record_id % 2 = 0").write.parquet(f"{top}/landing")
    lake.run(w.spark.readStream.schema(source.schema).parquet(f"{top}/landing"), f"{top}/cp").awaitTermination()
    source.where("record_id % 2 = 1").write.mode("append").parquet(f"{top}/landing")
    sunk = lake.sink().select("record_id", F.lit(True).alias("committed"))
    return lake.recent().join(sunk, "record_id", "left").select("record_id", "event_type", F.coalesce("committed", F.lit(False)).alias("committed"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL", base=False)
def stream_types(w: Workload) -> DataFrame:
    """The events table as a stream, landed, split, allocated and committed: what each type's containers hold."""
    rows = _streamed(w).sink()
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
