"""Attributes as known at event time.

Knowledge about an entity changes only when a record is published. The operator turns the
publications into half-open validity intervals [known_from, known_to), each carrying the best
record known in it, cuts the intervals into time buckets and equi-joins events on
(entity, bucket). There is no inequality join, and one entity with most of the events is spread
over its buckets; adaptive execution splits what remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(records: DataFrame, entity: str, known: str, rank: list[Column], payload: list[str]) -> DataFrame:
    """(entity, known_from, known_to, payload...): the best record known in each interval.

    `known` is the DATE column a record becomes known on, `rank` are expressions compared in turn,
    larger wins. Rows with a null entity or null `known` are left out. A record that doesn't beat
    what was known before changes nothing; records of one day count together. known_to is null
    for the last interval. An empty table gives an empty one.
    """
    w = Window.partitionBy("_e")
    best = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *[F.col(p).alias(f"p{i}") for i, p in enumerate(payload)])
    per_day = (
        records.where(F.col(entity).isNotNull() & F.col(known).isNotNull())
        .select(F.col(entity).alias("_e"), F.col(known).alias("_k"), best.alias("_b"))
        .groupBy("_e", "_k").agg(F.max("_b").alias("_b"))
    )
    running = per_day.withColumn("_run", F.max("_b").over(w.orderBy("_k")))
    changed = running.where(F.col("_run") == F.col("_b"))
    out = changed.withColumn("known_to", F.lead("_k").over(w.orderBy("_k")))
    return out.select(F.col("_e").alias(entity), F.col("_k").alias("known_from"), "known_to", *[F.col(f"_run.p{i}").alias(p) for i, p in enumerate(payload)])


def _bucket(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / days).cast("int")


def as_known(events: DataFrame, intervals: DataFrame, entity: str, at: str, payload: list[str], bucket_days: int = 128, how: str = "inner") -> DataFrame:
    """Each event with the payload of the interval of its entity that holds its date `at`.

    With how="inner", events with a null entity or date, or before anything was known, don't appear; with
    how="left" they keep a null payload.
    Event columns keep their names; payload columns that clash with them get the suffix `_known`.
    Open intervals are carried to the latest event date, so intervals explode into at most
    (events' time span / bucket_days) + 1 rows each.
    """
    horizon = events.agg(F.max(at).alias("_last"))
    iv = (
        intervals.crossJoin(F.broadcast(horizon))  # one row, an aggregate without keys
        .withColumn("_end", F.date_sub(F.coalesce(F.least("known_to", F.date_add("_last", 1)), F.date_add("_last", 1)), 1))
        .where(F.col("_end") >= F.col("known_from"))
        .select(
            F.col(entity).alias("_e"), "known_from", "known_to", *[F.col(p).alias(f"_p{i}") for i, p in enumerate(payload)],
            F.explode(F.sequence(_bucket(F.col("known_from"), bucket_days), _bucket(F.col("_end"), bucket_days))).alias("_bk"),
        )
    )
    ev = events if how == "left" else events.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    ev = ev.withColumn("_bk", _bucket(F.col(at), bucket_days))
    hit = (ev[entity] == iv["_e"]) & (ev["_bk"] == iv["_bk"]) & (ev[at] >= iv["known_from"]) & (iv["known_to"].isNull() | (ev[at] < iv["known_to"]))
    names = [p if p not in events.columns else f"{p}_known" for p in payload]
    return ev.join(iv, hit, how).select(*[ev[c] for c in events.columns], *[iv[f"_p{i}"].alias(n) for i, n in enumerate(names)])


def forward_fill(events: DataFrame, changes: DataFrame, keys: list[str], at: str, value: str, default: float | None = None) -> DataFrame:
    """Backward as-of: for each event the last non-null `value` with `changes.at` <= event `at`.

    Both sides hold `keys` and `at`; null keys or dates match nothing and get `default`, as do events before the first change.
    Several changes of one date: the largest value counts. Changes become intervals and join like as_known, so one key with most
    of the events is spread over its buckets. A column of the events with the value's name stays; the value gets the suffix `_asof`.
    """
    entity = F.struct(*[F.col(k) for k in keys]) if len(keys) > 1 else F.col(keys[0])
    whole = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        whole = whole & F.col(k).isNotNull()
    known = changes.where(F.col(value).isNotNull()).select(F.when(whole, entity).alias("_key"), F.col(at).alias("_at"), F.col(value).cast("double").alias("_value"))
    iv = validity_intervals(known, "_key", "_at", [F.col("_at"), F.col("_value")], ["_value"])
    out = as_known(events.withColumn("_key", F.when(whole, entity)), iv, "_key", at, ["_value"], how="left").drop("_key")
    name = value if value not in events.columns else f"{value}_asof"
    return out.withColumn(name, F.coalesce("_value", F.lit(default)) if default is not None else F.col("_value")).drop("_value")
