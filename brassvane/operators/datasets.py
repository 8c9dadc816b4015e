"""Stratified samples, quotas, splits and classification and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import ranked_values


def hash_order(key: str, seed: int) -> Column:
    """A pseudo-random but reproducible order of rows."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def stratified_sample(df: DataFrame, label: str, key: str, total: int, floor: int = 30, seed: int = 42) -> DataFrame:
    """About `total` rows, per label in proportion to its rows but at least `floor` (or all it has), by hash order.

    The cut of a label is found from counts per hash prefix, so a label with most of the rows isn't sorted as a whole.
    """
    d = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    per = d.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_pb")).agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows a label
    w = Window.partitionBy("_l")
    up = w.orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_before": F.coalesce(F.sum("_n").over(up), F.lit(0)), "_own": F.sum("_n").over(w), "_every": F.sum("_n").over(Window.partitionBy())})
    per = per.withColumn("_q", F.greatest(F.lit(floor), F.floor(F.lit(total) * F.col("_own") / F.col("_every")))).where(F.col("_before") < F.col("_q"))
    d = d.join(per, d[label].eqNullSafe(per["_l"]) & (d["_b"] == per["_pb"]))
    rn = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    return d.withColumn("_rn", rn).where(F.col("_rn") <= F.col("_q")).select(*df.columns)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash order: the same ones for the same seed, however the table is laid out. Each task keeps n rows."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def pools(df: DataFrame, label: str, confidence: str, sure: float, unsure: float) -> DataFrame:
    """`df` with `pool`: the label where it is at least `sure` of it, "hard" below `unsure`, else "middle"; null without a confidence."""
    c = F.col(confidence)
    return df.withColumn("pool", F.when(c.isNull(), None).when(c >= sure, F.col(label)).when(c < unsure, "hard").otherwise("middle"))


def quotas(counts: DataFrame, label: str, n: str, total: int, shares: dict[str, float]) -> DataFrame:
    """(label, n, quota): total x share rounded, the remainder to the class with the most rows, capped by its rows."""
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col(label)), F.lit(0.0))
    w = Window.partitionBy()  # one row a label
    c = counts.withColumn("_q", F.floor(share * total + 0.5).cast("bigint"))
    big = F.row_number().over(w.orderBy(F.col(n).desc(), F.col(label))) == 1
    c = c.withColumn("_q", F.col("_q") + F.when(big, F.lit(total) - F.sum("_q").over(w)).otherwise(0))
    return c.select(label, n, F.greatest(F.lit(0), F.least(F.col(n), F.col("_q"))).alias("quota"))


def train_val(df: DataFrame, key: str, val_share: float = 0.02, least: int = 200, seed: int = 42) -> DataFrame:
    """`df` with `split`: the max(least, share) first rows by hash order are "val". The cut is found from counts per hash
    prefix, so the table isn't sorted as a whole."""
    d = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    per = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows
    up = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_before": F.coalesce(F.sum("_n").over(up), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    d = d.join(per, "_b")
    want = F.greatest(F.lit(least), F.floor(F.col("_all") * val_share))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return d.withColumn("split", F.when(at <= want, "val").otherwise("train")).select(*df.columns, "split")


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(truth, one column per label): counts; rows and columns for every label, other values left out."""
    c = df.where(F.col(truth).isin(*labels)).groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(guess) == x).alias(x) for x in labels])
    all_ = df.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    return all_.join(c, "truth", "left").select("truth", *[F.coalesce(x, F.lit(0)).alias(x) for x in labels])


def class_metrics(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(label, n, precision, recall, f1) and a row `all` with accuracy in recall and macro-F1 in f1; 0 where a denominator is 0."""
    aggs = []
    for x in labels:
        t, g = F.col(truth) == x, F.col(guess) == x
        aggs += [F.count_if(t & g).alias(f"tp_{x}"), F.count_if(t).alias(f"t_{x}"), F.count_if(g).alias(f"g_{x}")]
    one = df.agg(*aggs, F.count(F.col(truth)).alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("ok"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows, f1s = [], []
    for x in labels:
        p, r = ratio(F.col(f"tp_{x}"), F.col(f"g_{x}")), ratio(F.col(f"tp_{x}"), F.col(f"t_{x}"))
        f1 = ratio(2 * p * r, p + r)
        f1s.append(f1)
        rows.append(F.struct(F.lit(x).alias("label"), F.col(f"t_{x}").alias("n"), p.alias("precision"), r.alias("recall"), f1.alias("f1")))
    acc = ratio(F.col("ok"), F.col("n"))
    rows.append(F.struct(F.lit("all").alias("label"), F.col("n").alias("n"), acc.alias("precision"), acc.alias("recall"), (sum(f1s[1:], f1s[0]) / len(labels)).alias("f1")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ranking_metrics(hits: DataFrame, queries: DataFrame, query: str, rank: str, relevant: str, k: int = 5, depth: int = 10) -> DataFrame:
    """One row: queries, recall@k, MRR@depth, share with the first relevant at rank 1. Every row of `queries` counts, found or not."""
    q, first = first_relevant(hits, queries, query, rank, relevant), F.col("first_rank")
    return q.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.avg(F.when(first <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(first <= depth, 1.0 / first).otherwise(0.0)), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(first == 1, 1.0).otherwise(0.0)), F.lit(0.0)).alias("first_at_1"),
    )


def first_relevant(hits: DataFrame, queries: DataFrame, query: str, rank: str, relevant: str) -> DataFrame:
    """(query, first_rank): rank of each query's first relevant hit, null for none."""
    first = hits.groupBy(F.col(query).alias("_q")).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first_rank"))
    q = queries.select(query).distinct()
    return q.join(first, F.col(query) == F.col("_q"), "left").select(query, "first_rank")


def rate(hit: Column, n: Column) -> Column:
    """hit / n to four digits, 0 for nothing."""
    return F.round(F.coalesce(F.try_divide(hit, n), F.lit(0.0)), 4)


def mean(c: Column) -> Column:
    """The mean to two digits, 0 for nothing."""
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """(by, n, mean, at_share): the value at place max(1, floor(n x share)) of the ascending order."""
    f = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    v = ranked_values(f, by, {"at_share": F.greatest(F.lit(1), F.floor(F.col("_all") * share))}).toDF(*[f"_g{i}" for i in range(len(by))], "at_share")
    m = f.groupBy(*by).agg(F.sum("n").alias("_n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")).withColumnRenamed("_n", "n")
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return m.join(v, on).select(*by, "n", "mean", "at_share")


def top_terms(df: DataFrame, by: str, terms: str, order: str, k: int = 5) -> DataFrame:
    """(by, rank, term, n): each group's k most frequent terms of an array column, ties by first appearance (`order`, then place)."""
    t = df.select(by, F.col(order).alias("_o"), F.posexplode(terms).alias("_p", "term"))
    c = t.groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "_p")).alias("_first"))
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "_first", "term"))
    return c.withColumn("rank", rn).where(F.col("rank") <= k).select(by, "rank", "term", "n")


def net_sentiment(df: DataFrame, by: list[str], label: str, confidence: str) -> DataFrame:
    """(by, n, shares of the three labels, net): net is positive less negative confidence over n."""
    n = F.count(F.lit(1))
    share = [F.avg((F.col(label) == x).cast("int")).alias(x) for x in ("positive", "negative", "neutral")]
    net = F.sum(F.when(F.col(label) == "positive", F.col(confidence)).when(F.col(label) == "negative", -F.col(confidence)).otherwise(0.0)) / n
    return df.groupBy(*by).agg(n.alias("n"), *share, net.alias("net"))


def related_counts(queries: DataFrame, items: DataFrame, key: str, codes: str = "codes", title: str = "title") -> DataFrame:
    """(key, n_related): per query with a code, the items that share one with it, without those of its own trimmed title.

    `codes` holds arrays. Items are counted per set of codes and per (title, set) first, so no pair of rows is made; an
    item counts once however many codes it shares. Queries that find nothing have 0; an unknown title equals none.
    """
    bare = F.regexp_replace(title, r"^[\s　]+|[\s　]+$", "")
    one = lambda d, *k: d.select(*k, F.array_sort(F.array_distinct(codes)).alias("_set"), bare.alias("_t")).where(F.size("_set") > 0)
    q = one(queries, key)
    n = one(items).groupBy("_t", "_set").agg(F.count(F.lit(1)).alias("_n"))
    sets = n.groupBy(F.col("_set").alias("_iset")).agg(F.sum("_n").alias("_n"))
    wanted = q.select("_set").distinct()
    pairs = wanted.withColumn("_c", F.explode("_set")).join(sets.withColumn("_c", F.explode("_iset")), "_c").select("_set", "_iset", "_n").distinct()
    every = pairs.groupBy("_set").agg(F.sum("_n").alias("_all"))
    own = q.join(n.select("_t", F.col("_set").alias("_iset"), "_n"), "_t").where(F.arrays_overlap("_set", "_iset")).groupBy(key).agg(F.sum("_n").alias("_own"))
    out = q.join(every, "_set", "left").join(own, key, "left")
    return out.select(key, (F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("n_related"))
