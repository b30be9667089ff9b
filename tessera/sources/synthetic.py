"""A synthetic corpus and workload, drawn by hashes of a seed and row ids: the same on any partitioning."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..corpus import Corpus, corpus
from ..functions.model import inclusion, normal, pick, recency, saturation, uniform
from . import files
from .registry import Provider


@dataclass(frozen=True)
class Config:
    """Fixed values of the workload model are the defaults here and the constants below."""

    events: int = 600_000
    seed: int = 20260809
    days: int = 1095
    start: str = "2023-01-01"
    query_days: int = 180
    brands: int = 40
    tiers: int = 10
    warranties: int = 6
    half_life_days: float = 91.0
    profitability_rate: float = 0.05
    complaint_rate: float = 0.005
    training_share: float = 0.5


#: Fixed values of the workload model.
BRAND_DECAY, TIER_DECAY = 0.93, 0.85
WARRANTY_FIRST, WARRANTY_LAST = 1.0, 0.35
HALF_LOW, HALF_HIGH = 0.15, 0.35
MEDIAN_BYTES, SIGMA, TIER_GROWTH = 23200.0, 0.9, 0.06
RATIO_LOW, RATIO_HIGH = 3.0, 6.0
LEAST_BYTES, LEAST_COMPRESSED = 64, 32

#: The categories, the share of events that each has, and the factor of its sizes.
CATEGORIES = {
    "brakes": (0.14, 1.0), "batteries": (0.11, 0.7), "filters": (0.13, 0.5), "tires": (0.10, 1.2), "suspension": (0.06, 1.6), "belts_and_hoses": (0.07, 0.6), "lighting": (0.06, 0.8),
    "exhaust": (0.04, 1.5), "cooling": (0.05, 1.1), "steering": (0.04, 1.7), "sensors": (0.06, 0.9), "wipers": (0.06, 0.4), "body": (0.04, 2.2), "drivetrain": (0.04, 2.6),
}


def events(spark: SparkSession, c: Config) -> DataFrame:
    """Events in order of arrival: record_id is the rank of the date, by construction."""
    u = lambda s, *k: uniform(c.seed, s, *(k or (F.col("record_id"),)))
    rows = spark.range(c.events).select(F.col("id").alias("record_id"))
    # The r-th of n sorted uniform draws lies near (r + u) / n: monotone in the id, without a sort.
    day = F.floor((F.col("record_id") + u("day")) / F.lit(float(c.events)) * c.days).cast("int")
    step = (WARRANTY_LAST - WARRANTY_FIRST) / max(1, c.warranties - 1)
    rows = rows.select(
        "record_id", pick(u("brand"), [BRAND_DECAY**i for i in range(c.brands)]).alias("b"), pick(u("tier"), [TIER_DECAY**i for i in range(c.tiers)]).alias("t"),
        (pick(u("warranty"), [WARRANTY_FIRST + step * i for i in range(c.warranties)]) + 1).alias("w"), pick(u("category"), [share for share, _ in CATEGORIES.values()]).alias("k"), day.alias("day"),
        normal(u("size"), u("size2")).alias("z"), u("ratio").alias("ratio"),
    )
    factor = F.element_at(F.array(*[F.lit(m) for _, m in CATEGORIES.values()]), F.col("k") + 1)
    big = F.greatest(F.lit(MEDIAN_BYTES) * F.exp(F.lit(SIGMA) * F.col("z")) * factor * (1 + TIER_GROWTH * F.col("t")), F.lit(float(LEAST_BYTES))).cast("long")
    small = F.greatest(big / (RATIO_LOW + (RATIO_HIGH - RATIO_LOW) * F.col("ratio")), F.lit(float(LEAST_COMPRESSED))).cast("long")
    return rows.select(
        "record_id", F.format_string("brand-%03d", "b").alias("brand_id"), F.date_add(F.to_date(F.lit(c.start)), F.col("day")).alias("feature_transaction_date"),
        F.col("t").cast("short").alias("feature_price_tier"), F.col("w").cast("short").alias("feature_warranty_years"), F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("k") + 1).alias("feature_category"),
        small.alias("blob_detail_compressed_bytes"), big.alias("blob_detail_decompressed_bytes"),
        (F.floor(uniform(c.seed, "demand", F.col("b")) * 10) + 1).cast("short").alias("_brand_demand_multiplier"),
    )


def queries(spark: SparkSession, c: Config) -> DataFrame:
    """Two queries a day over the last ``query_days``; the first half of the days is for training."""
    rows = spark.range(2 * c.query_days).select(F.col("id").alias("query_id"), F.floor(F.col("id") / 2).cast("int").alias("i"), F.when(F.col("id") % 2 == 0, "profitability").otherwise("complaint").alias("_query_type"))
    first = c.days - c.query_days
    half = lambda s: HALF_LOW + (HALF_HIGH - HALF_LOW) * uniform(c.seed, s, F.col("query_id"))
    return rows.select(
        "query_id", F.date_add(F.to_date(F.lit(c.start)), F.col("i") + first).alias("query_time"),
        F.when(F.col("i") < round(c.query_days * c.training_share), "training").otherwise("validation").alias("set_name"), "_query_type", half("half").cast("float").alias("_half_saturation"), half("half2").alias("_half2"),
    )


def selections(e: DataFrame, q: DataFrame, c: Config) -> DataFrame:
    """record_id, query_id: each existing event with its weight's chance, at a rate of the whole corpus; a query that would select nothing selects one existing event.

    The days are few, so they are broadcast, and an event meets those after it. Weights are summed per query before the draw, map-side first.
    """
    own = e.select("record_id", "feature_transaction_date", "feature_price_tier", "feature_warranty_years", "_brand_demand_multiplier")
    days = F.broadcast(q.select("query_id", "query_time", "_query_type", F.col("_half_saturation").cast("double").alias("h"), F.col("_half2").alias("h2")))
    pairs = own.join(days, F.col("feature_transaction_date") <= F.col("query_time"))
    age = F.datediff("query_time", "feature_transaction_date")
    tier = F.col("feature_price_tier") / F.lit(float(c.tiers - 1))
    short = (F.lit(float(c.warranties)) - F.col("feature_warranty_years")) / F.lit(float(c.warranties - 1))
    curve = F.when(F.col("_query_type") == "profitability", saturation(tier, F.col("h"))).otherwise(saturation(1 - tier, F.col("h")) * saturation(short, F.col("h2")))
    rate = F.when(F.col("_query_type") == "profitability", c.profitability_rate).otherwise(c.complaint_rate)
    weighed = pairs.select("record_id", "query_id", (recency(age, c.half_life_days) * curve * F.col("_brand_demand_multiplier")).alias("w"), (rate * c.events).alias("wanted"))
    total = weighed.groupBy("query_id").agg(F.sum("w").alias("all_w"), F.min_by("record_id", uniform(c.seed, "fallback", F.col("record_id"), F.col("query_id"))).alias("fallback"))
    drawn = weighed.where("w > 0").join(F.broadcast(total.select("query_id", "all_w")), "query_id")
    drawn = drawn.where(uniform(c.seed, "draw", F.col("record_id"), F.col("query_id")) < inclusion(F.col("w"), F.col("all_w"), F.col("wanted"))).select("record_id", "query_id")
    none = total.join(drawn.select("query_id").distinct(), "query_id", "left_anti").select(F.col("fallback").alias("record_id"), "query_id")
    return drawn.unionByName(none)


class Synthetic(Provider):
    """Settings: fields of Config. With ``out_dir`` the log is computed once, and events keep the size of their support."""

    kind = "synthetic"

    def __init__(self, settings: dict | None = None):
        super().__init__(settings)
        self.config = Config(**self.settings)

    def recorded(self) -> dict:
        return asdict(self.config)

    def make(self, spark: SparkSession) -> Corpus:
        e, q = events(spark, self.config), queries(spark, self.config)
        log = selections(e, q, self.config)
        if self.out_dir:
            support = log.groupBy("record_id").agg(F.count("*").cast("short").alias("_support_size_full"))
            e = e.join(support, "record_id", "left").withColumn("_support_size_full", F.coalesce("_support_size_full", F.lit(0).cast("short")))
        return corpus(e, q.drop("_half2"), log, check=False, dataset_id=files.dataset_id(self.recorded()))
