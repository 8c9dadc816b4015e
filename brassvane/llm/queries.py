"""The training-data queries p1, p7, p8 and p9 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from ..functions.codes import six_digit
from . import content, mixing, overlap, tokens

MAX_NAMES = 1_000_000  # companies; more than that are refused, as they are sent to every task


def company_names(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    rows = table(spark, sf_dir, "stock_list").select("name", six_digit(F.col("code")).alias("code")).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    return {r["name"]: r["code"] for r in rows if r["name"] and r["code"]}


def _title_pairs(spark: SparkSession, sf_dir: str, keep_e: list[str], keep_t: list[str]) -> DataFrame:
    golden, news = table(spark, sf_dir, "golden_set_200"), table(spark, sf_dir, "news")
    return overlap.overlapping_rows(golden, news, "golden_id", "news_id", "title", "title", company_names(spark, sf_dir), keep_e, keep_t)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _title_pairs(spark, sf_dir, [], []).select("golden_id", "news_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and news source: pairs, distinct evaluation rows, distinct training rows."""
    pairs = _title_pairs(spark, sf_dir, ["eval_split"], ["source"])
    return pairs.groupBy("eval_split", "source").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("golden_id").alias("n_eval"), F.countDistinct("news_id").alias("n_training"), F.count_if(F.col("cover") >= 1).alias("n_fully_covered")
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; null becomes empty."""
    return tokens.decode(p7_ids(spark, sf_dir), "doc_id", "ids")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens): written once to shared storage, as sizes are used twice."""
    return cut(table(spark, sf_dir, "documents").select("doc_id", "source", tokens.counter(spark)(F.col("text")).cast("bigint").alias("n_tokens")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their number of copies; its size is one pass over the targeted sources."""
    docs = sized_documents(spark, sf_dir)
    shares, _ = mixing.plan(docs, table(spark, sf_dir, "mix_targets"), "source", "n_tokens")
    return mixing.mix(docs, shares, "doc_id", "source", "n_tokens")


def p8_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What water-filling gives each target source, in characters: the measure that SQL has too."""
    docs = table(spark, sf_dir, "documents").select("source", F.length("text").cast("bigint").alias("n_chars"))
    shares, _ = mixing.plan(docs, table(spark, sf_dir, "mix_targets"), "source", "n_chars")
    rows = [(s.source, s.target, int(s.size), s.capped, s.given) for s in shares]
    return spark.createDataFrame(rows, "source string, target_share double, n_chars bigint, capped boolean, given double").withColumn("given", F.round("given", 2))


def _shares(spark: SparkSession, sf_dir: str, total) -> DataFrame:
    docs = sized_documents(spark, sf_dir)
    shares, _ = mixing.plan(docs, table(spark, sf_dir, "mix_targets"), "source", "n_tokens", total)
    return mixing.report(mixing.mix(docs, shares, "doc_id", "source", "n_tokens"), shares, "source", "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of p8_mix."""
    return _shares(spark, sf_dir, None)


def p8_shares_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the greatest size at which every source that has documents gets its share."""
    return _shares(spark, sf_dir, "feasible")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = content.train(docs, table(spark, sf_dir, "doc_labels"))
    return content.score(docs.select("doc_id", "source", "text"), model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("flagged").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, flagged ones and their rate, mean score."""
    s = p9_scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.avg("score").alias("mean_score"))
    return s.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p7_ids, p7_round_trip, p8_mix, p8_allocation, p8_shares, p8_shares_feasible, p9_found, p9_scores, p9_rates)}
SQL: dict[str, str] = {
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_allocation": """WITH s AS (SELECT source, sum(greatest(coalesce(target_share, 0), 0)) AS target, max(coalesce(max_repeat, 1)) AS times FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
z AS (SELECT source, sum(length(text))::DOUBLE AS size FROM documents GROUP BY 1),
j AS (SELECT s.source, target, coalesce(size, 0) AS size, coalesce(size, 0) * greatest(times, 0) AS cap, sum(coalesce(size, 0)) FILTER (target > 0) OVER () AS total FROM s LEFT JOIN z ON s.source = z.source),
o AS (SELECT *, cap / target AS r, coalesce(sum(cap) OVER (ORDER BY cap / target, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(target) OVER (ORDER BY cap / target, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM j WHERE target > 0 AND cap > 0),
l AS (SELECT source, cap, (total - before) / rest > r AS capped, (total - before) / rest AS level, r FROM o),
m AS (SELECT min_by(level, r) FILTER (NOT capped) AS level FROM l)
SELECT j.source, target AS target_share, CAST(size AS BIGINT) AS n_chars, coalesce(l.capped, target > 0) AS capped, round(coalesce(CASE WHEN l.capped THEN l.cap ELSE target * m.level END, 0) * (l.source IS NOT NULL)::INT, 2) AS given FROM j LEFT JOIN l ON j.source = l.source, m""",
}
