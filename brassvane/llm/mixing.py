"""Mixing sources to target weights with capped repetition.

Sizes per source are summed first; one row per target goes through capped water-filling: a source whose share would
need more than its cap of repetitions is clamped there, and the excess is spread over the others in proportion to their
shares, until none exceeds its cap. A source's allocation is a whole number of passes and a fraction of one; the
fraction is the documents that come first by a seeded hash, up to the size needed. The cut is found
from sizes per hash bucket, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
MAX_SOURCES = 100_000  # targets are configuration, one row a source; more than this is refused, not cut


@dataclass
class Share:
    source: str
    target: float
    cap: float  # size at the greatest number of repetitions
    size: float
    given: float = 0.0
    capped: bool = False


def water_fill(shares: list[Share], total: float) -> list[Share]:
    """Sets `given` and `capped`. The sum of `given` is `total`, or less where all sources with a target are capped."""
    free = [s for s in shares if s.target > 0 and s.cap > 0]
    for s in shares:
        s.given, s.capped = 0.0, s.target > 0 and s.cap <= 0
    left = total
    while free and left > 0:
        weight = sum(s.target for s in free)
        over = [s for s in free if left * s.target / weight > s.cap]
        if not over:
            for s in free:
                s.given = left * s.target / weight
            break
        for s in over:
            s.given, s.capped = s.cap, True
        left -= sum(s.cap for s in over)
        free = [s for s in free if not s.capped]
    return shares


def feasible_total(shares: list[Share]) -> float:
    """The greatest total at which every source that has documents gets its share of those sources' targets."""
    own = [s for s in shares if s.target > 0 and s.cap > 0]
    weight = sum(s.target for s in own)
    return min((s.cap * weight / s.target for s in own), default=0.0)


def plan(docs: DataFrame, targets: DataFrame, source: str, size: str, total: float | str | None = None) -> tuple[list[Share], float]:
    """Allocations per target source. `total`: the size wanted; None, one pass over all targeted sources; "feasible", feasible_total.

    Targets of one source are added up with the greatest of their caps; null and negative shares count as 0, a null cap as 1.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("repeat")
    )
    sizes = docs.groupBy(F.col(source).alias("_s")).agg(F.sum(size).cast("double").alias("size"))
    rows = t.join(sizes, t["source"] == sizes["_s"], "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    shares = [Share(r["source"], r["target"], (r["size"] or 0.0) * max(0, r["repeat"]), r["size"] or 0.0) for r in rows]
    if total == "feasible":
        total = feasible_total(shares)
    elif total is None:
        total = sum(s.size for s in shares if s.target > 0)
    return water_fill(shares, float(total)), float(total)


def mix(docs: DataFrame, shares: list[Share], key: str, source: str, size: str, seed: int = 17) -> DataFrame:
    """`docs` with `copies` BIGINT, how often each document is used; rows with 0 copies are left out.

    Documents of size 0 or null, of null sources and of sources without a target aren't used. No document is used more
    than its source's cap. Ties of the hash are ordered by `key`; each row counts by itself.
    """
    spark = docs.sparkSession
    docs = docs.drop("copies")
    rows = [(s.source, int(s.given // s.size), float(s.given - (s.given // s.size) * s.size)) for s in shares if s.size > 0 and s.given > 0]
    passes = spark.createDataFrame(rows, "_src string, _whole bigint, _need double")
    d = docs.where(F.col(size) > 0).join(passes, F.col(source) == F.col("_src"))
    d = d.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 52))
    by_bucket = d.groupBy("_src", "_b").agg(F.sum(size).alias("_n"), F.max("_need").alias("_need"))
    up = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    by_bucket = by_bucket.withColumn("_to", F.sum("_n").over(up)).withColumn("_before", F.col("_to") - F.col("_n"))
    edge = by_bucket.where((F.col("_before") < F.col("_need")) & (F.col("_to") >= F.col("_need"))).select(F.col("_src").alias("_es"), F.col("_b").alias("_eb"), F.col("_before"))
    d = d.join(edge, F.col("_src") == F.col("_es"), "left").drop("_es")
    inside = Window.partitionBy("_src", "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    cut = d.where(F.col("_b") == F.col("_eb")).withColumn("_at", F.col("_before") + F.sum(size).over(inside) - F.col(size) / 2)
    cut = cut.withColumn("_extra", F.when(F.col("_at") <= F.col("_need"), 1).otherwise(0)).drop("_at")
    rest = d.where(F.col("_eb").isNull() | (F.col("_b") != F.col("_eb"))).withColumn("_extra", F.when(F.col("_b") < F.col("_eb"), 1).otherwise(0))
    out = cut.unionByName(rest).withColumn("copies", F.col("_whole") + F.col("_extra"))
    return out.where("copies > 0").select(*docs.columns, "copies")


def report(mixed: DataFrame, shares: list[Share], source: str, size: str) -> DataFrame:
    """Per target source: target and reached share, size used, passes over the source, and whether the target is met within half a percent point."""
    spark = mixed.sparkSession
    t = spark.createDataFrame([(s.source, s.target, s.size, s.capped) for s in shares], "source string, target_share double, source_size double, capped boolean")
    used = mixed.groupBy(F.col(source).alias("_s")).agg(F.sum(F.col(size) * F.col("copies")).cast("double").alias("used"), F.max("copies").alias("most_copies"))
    r = t.join(used, t["source"] == used["_s"], "left").drop("_s").withColumns({"used": F.coalesce("used", F.lit(0.0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
    r = r.withColumn("reached_share", F.coalesce(F.try_divide("used", F.sum("used").over(Window.partitionBy())), F.lit(0.0)))  # one row a target
    return r.select(
        "source", "target_share", "reached_share", F.col("used").cast("bigint").alias("used"), "most_copies", F.coalesce(F.try_divide("used", "source_size"), F.lit(0.0)).alias("passes"),
        "capped", (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.005).alias("met"),
    )
