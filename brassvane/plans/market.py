"""Queries over bars, reports and news, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, lexicon_words as lw, text
from ..functions.numbers import turnover
from ..functions.times import day_of, quarter_end, second_of
from ..operators import asof, bars as B, datasets, dedup, lexicon, profile as prof, vectors
from ..session import table
from ..streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def day(c: str = "date"):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


def r7(c):
    """Seven digits: enough to compare, and sums of prices have no ties there."""
    return F.round(c, 7)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return B.clean_bars(table(spark, sf, "daily_hfq"))


_NAN = lambda c: f"CASE WHEN CAST({c} AS VARCHAR) IN ('nan', 'inf', '-inf') THEN NULL ELSE {c} END"
_BARS = (
    "b AS (SELECT * FROM (SELECT regexp_extract(code, '(\\d{6})', 1) AS symbol, date, bar_id, source, tradestatus, "
    + ", ".join(f"{_NAN(c)} AS {c}" for c in B.NUMBERS)
    + ", row_number() OVER (PARTITION BY regexp_extract(code, '(\\d{6})', 1), date ORDER BY bar_id) AS rn FROM daily_hfq) WHERE rn = 1)"
)
_FIN = "fin AS (SELECT *, lpad(regexp_extract(code, '(\\d+)', 1), 6, '0') AS symbol FROM financials_yjbb)"
_Q = "CAST(coalesce(try_strptime(report_date, '%Y%m%d'), try_strptime(report_date, '%Y-%m-%d'), try_strptime(report_date, '%Y/%m/%d'), CASE right(report_date, 2) WHEN 'Q1' THEN try_strptime(left(report_date, 4) || '0331', '%Y%m%d') WHEN 'Q2' THEN try_strptime(left(report_date, 4) || '0630', '%Y%m%d') WHEN 'Q3' THEN try_strptime(left(report_date, 4) || '0930', '%Y%m%d') WHEN 'Q4' THEN try_strptime(left(report_date, 4) || '1231', '%Y%m%d') END) AS DATE)"
_D = "strftime(date, '%Y-%m-%d') AS day"


@query("SELECT bar_id, strftime(date, '%Y-%m-%d') AS day, close FROM daily_hfq WHERE regexp_extract(code, '(\\d{6})', 1) = '680963' AND date BETWEEN DATE '2020-01-01' AND DATE '2024-12-31'")
def bars_range(spark, sf):
    out = B.bar_range(table(spark, sf, "daily_hfq"), "sh.680963", "2020-01-01", "2024-12-31", ["bar_id", "date", "close"])
    return out.select("bar_id", day(), "close")


@query(f"WITH {_BARS} SELECT symbol, {_D}, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM b) WHERE k <= 5")
def bars_latest(spark, sf):
    return B.latest(clean(spark, sf), ["symbol"], [F.col("date").desc()], 5).select("symbol", day(), "close", "volume")


@query(f"WITH {_FIN}, f AS (SELECT *, {_Q} AS q FROM fin) SELECT symbol, fin_id, strftime(q, '%Y-%m-%d') AS quarter FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY q DESC, pub_date DESC, fin_id) AS k FROM f WHERE pub_date <= DATE '2024-06-30' AND q IS NOT NULL) WHERE k = 1")
def financial_as_of(spark, sf):
    """The latest quarter published by 2024-06-30, per stock."""
    f = table(spark, sf, "financials_yjbb").withColumns({"symbol": codes.six_digit(F.col("code")), "q": quarter_end(F.col("report_date"))})
    f = f.where((F.col("pub_date") <= F.lit("2024-06-30").cast("date")) & F.col("q").isNotNull())
    best = f.groupBy("symbol").agg(F.max(F.struct("q", "pub_date", (-F.col("fin_id")).alias("n"))).alias("m"))
    return best.select("symbol", (-F.col("m.n")).alias("fin_id"), F.date_format("m.q", "yyyy-MM-dd").alias("quarter"))


@query(f"WITH {_FIN}, f AS (SELECT *, {_Q} AS q FROM fin) SELECT symbol, fin_id, strftime(q, '%Y-%m-%d') AS quarter FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY q DESC, pub_date DESC NULLS LAST, fin_id) AS k FROM f WHERE q IS NOT NULL) WHERE k <= 4")
def financial_history(spark, sf):
    f = table(spark, sf, "financials_yjbb").withColumns({"symbol": codes.six_digit(F.col("code")), "q": quarter_end(F.col("report_date"))}).where("q is not null")
    return B.latest(f, ["symbol"], [F.col("q").desc(), F.col("pub_date").desc_nulls_last(), F.col("fin_id")], 4).select("symbol", "fin_id", F.date_format("q", "yyyy-MM-dd").alias("quarter"))


@query("SELECT stock_code, news_id, publish_time FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY publish_time DESC, news_id) AS k FROM news WHERE regexp_full_match(stock_code, '\\d{6}') AND publish_time >= '2024-01-01' AND publish_time < '2025-01-01') WHERE k <= 10")
def news_recent(spark, sf):
    n = table(spark, sf, "news").where(F.col("stock_code").rlike(r"^\d{6}$") & (F.col("publish_time") >= "2024-01-01") & (F.col("publish_time") < "2025-01-01"))
    return B.latest(n, ["stock_code"], [F.col("publish_time").desc(), F.col("news_id")], 10).select("stock_code", "news_id", "publish_time")


@query("""WITH raw AS (SELECT news_id, stock_code, trim(regexp_replace(publish_time, '[\\s　]+', ' ', 'g')) AS t FROM news),
p AS (SELECT news_id, stock_code, CASE
  WHEN regexp_matches(t, '^\\d{13}$') THEN make_timestamp(CAST(t AS BIGINT) // 1000 * 1000000) + INTERVAL 8 HOUR
  WHEN regexp_matches(t, '^\\d{14}$') THEN try_strptime(t, '%Y%m%d%H%M%S')
  WHEN regexp_matches(t, '^\\d{8}$') THEN try_strptime(t, '%Y%m%d')
  WHEN t LIKE '%Z' THEN try_strptime(t, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 8 HOUR
  ELSE coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d'),
    try_strptime(t, '%Y/%m/%d %H:%M'), try_strptime(t, '%Y/%m/%d %H:%M:%S'), try_strptime(t, '%Y年%m月%d日 %H:%M'), try_strptime(t, '%Y年%m月%d日')) END AS ts FROM raw),
c AS (SELECT news_id, ts, unnest(list_distinct(regexp_extract_all(stock_code, '\\d{6}'))) AS code FROM p WHERE year(ts) = 2024)
SELECT code, news_id, strftime(ts, '%Y-%m-%d') AS day, (epoch(ts)::BIGINT % 86400)::INT AS second FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC, news_id) AS k FROM c) WHERE k <= 10""")
def news_recent_by_code(spark, sf):
    """Latest ten articles of 2024 per stock, whatever the writing of code and time; news_recent takes both as they stand."""
    at = F.col("publish_time")
    n = table(spark, sf, "news").withColumns({"_day": day_of(at), "second": second_of(at)}).where(F.year("_day") == 2024)
    n = n.withColumn("code", F.explode(codes.all_codes(F.col("stock_code"))))
    return B.latest(n, ["code"], [F.col("_day").desc(), F.col("second").desc(), F.col("news_id")], 10).select("code", "news_id", F.date_format("_day", "yyyy-MM-dd").alias("day"), "second")


_TABLES = ["daily_hfq", "financials_yjbb", "news", "stock_list", "documents"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def table_counts(spark, sf):
    out = None
    for t in _TABLES:
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT stock_code, count(*) AS n FROM news WHERE stock_code IS NOT NULL AND stock_code <> '' GROUP BY 1 ORDER BY n DESC, stock_code LIMIT 20")
def busiest_codes(spark, sf):
    n = table(spark, sf, "news").where(F.col("stock_code").isNotNull() & (F.col("stock_code") != "")).groupBy("stock_code").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "stock_code").limit(20)


@query(f"WITH {_FIN} SELECT symbol, arg_max(name, {{'p': pub_date, 'n': -fin_id}}) AS name FROM fin WHERE name IS NOT NULL AND pub_date IS NOT NULL GROUP BY 1")
def latest_names(spark, sf):
    f = table(spark, sf, "financials_yjbb").where("name is not null and pub_date is not null").withColumn("symbol", codes.six_digit(F.col("code")))
    return f.groupBy("symbol").agg(F.max_by("name", F.struct("pub_date", -F.col("fin_id"))).alias("name"))


@query("SELECT left(publish_time, 10) AS day, count(*) FILTER (human_label = 'positive') AS positive, count(*) FILTER (human_label = 'negative') AS negative, count(*) FILTER (human_label = 'neutral') AS neutral, count(*) AS n, (count(*) FILTER (human_label = 'positive') - count(*) FILTER (human_label = 'negative')) AS net FROM golden_set_200 WHERE publish_time IS NOT NULL GROUP BY 1")
def labels_per_day(spark, sf):
    g = table(spark, sf, "golden_set_200").where("publish_time is not null").groupBy(F.substring("publish_time", 1, 10).alias("day"))
    out = g.agg(*[F.count_if(F.col("human_label") == x).alias(x) for x in ("positive", "negative", "neutral")], F.count(F.lit(1)).alias("n"))
    return out.withColumn("net", F.col("positive") - F.col("negative"))


@query("SELECT human_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 7) AS share FROM golden_set_200 GROUP BY 1")
def label_shares(spark, sf):
    g = table(spark, sf, "golden_set_200").groupBy("human_label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", r7(F.col("n") / F.sum("n").over(Window.partitionBy())))  # one row a label


@query(f"WITH {_BARS} SELECT source, round(quantile_cont(turn, 0.1), 7) AS p10, round(quantile_cont(turn, 0.5), 7) AS p50, round(quantile_cont(turn, 0.9), 7) AS p90, count(turn) AS n FROM (SELECT *, lower(trim(source)) AS s FROM b) GROUP BY s, source".replace("SELECT source, round", "SELECT s AS source, round").replace("GROUP BY s, source", "GROUP BY s"))
def turn_quantiles(spark, sf):
    f = clean(spark, sf).where("turn is not null").groupBy(F.lower(F.trim("source")).alias("source"), F.col("turn").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    q = prof.quantiles(f, ["source"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    n = f.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("n"))
    return q.join(n, q["source"] == n["_s"]).select("source", *[r7(c).alias(c) for c in ("p10", "p50", "p90")], "n")


@query(f"WITH {_BARS}, n AS (SELECT symbol, count(*) AS k FROM b GROUP BY 1) SELECT count(*) AS n_symbols, min(k) AS least, round(median(k), 7) AS middle, max(k) AS most, round(avg(k), 7) AS mean FROM n")
def rows_per_symbol(spark, sf):
    n = clean(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("k"))
    return n.agg(F.count(F.lit(1)).alias("n_symbols"), F.min("k").alias("least"), r7(F.percentile("k", F.lit(0.5))).alias("middle"), F.max("k").alias("most"), r7(F.avg("k")).alias("mean"))


@query(f"WITH {_BARS} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day, round(avg((close IS NULL)::INT), 7) AS close_missing, round(avg((volume = 0)::INT), 7) AS volume_zero, count(DISTINCT lower(trim(source))) AS n_sources FROM b")
def bars_quality(spark, sf):
    return clean(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"),
        r7(F.avg(F.col("close").isNull().cast("int"))).alias("close_missing"), r7(F.avg((F.col("volume") == 0).cast("int"))).alias("volume_zero"), F.countDistinct(F.lower(F.trim("source"))).alias("n_sources"),
    )


@query("SELECT source, count(*) AS n, count(DISTINCT url) AS n_urls, CAST(trunc(avg(length(text))) AS BIGINT) AS mean_length, min(publish_time) AS first_time, max(publish_time) AS last_time FROM news GROUP BY 1")
def news_quality(spark, sf):
    return table(spark, sf, "news").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"), F.avg(F.length("text")).cast("bigint").alias("mean_length"), F.min("publish_time").alias("first_time"), F.max("publish_time").alias("last_time"))


@query(f"WITH {_FIN} SELECT industry, count(*) AS n, count(DISTINCT symbol) AS n_symbols, count(DISTINCT report_date) AS n_reports, round(avg((pub_date IS NULL)::INT), 7) AS pub_missing FROM fin GROUP BY 1")
def financial_quality(spark, sf):
    f = table(spark, sf, "financials_yjbb").withColumn("symbol", codes.six_digit(F.col("code")))
    return f.groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("report_date").alias("n_reports"), r7(F.avg(F.col("pub_date").isNull().cast("int"))).alias("pub_missing"))


LABELS = ["positive", "negative", "neutral"]


@query("SELECT t.truth, " + ", ".join(f"count(g.golden_id) FILTER (g.lexicon_label_v3 = '{x}') AS {x}" for x in LABELS) + " FROM (VALUES ('positive'), ('negative'), ('neutral')) t(truth) LEFT JOIN golden_set_200 g ON g.human_label = t.truth GROUP BY 1")
def confusion_matrix(spark, sf):
    return datasets.confusion(table(spark, sf, "golden_set_200"), "human_label", "lexicon_label_v3", LABELS)


@query("""WITH l AS (SELECT unnest(['positive', 'negative', 'neutral']) AS label), c AS (SELECT label, count(*) FILTER (human_label = label) AS n,
  coalesce(count(*) FILTER (human_label = label AND lexicon_label_v3 = label) / nullif(count(*) FILTER (lexicon_label_v3 = label), 0), 0) AS p,
  coalesce(count(*) FILTER (human_label = label AND lexicon_label_v3 = label) / nullif(count(*) FILTER (human_label = label), 0), 0) AS r FROM l, golden_set_200 GROUP BY label),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM c)
SELECT label, n, round(p, 7) AS precision, round(r, 7) AS recall, round(f, 7) AS f1 FROM f
UNION ALL SELECT 'all', (SELECT count(human_label) FROM golden_set_200), round(a, 7), round(a, 7), round((SELECT avg(f) FROM f), 7) FROM (SELECT count(*) FILTER (human_label = lexicon_label_v3) / count(human_label) AS a FROM golden_set_200)""")
def label_metrics(spark, sf):
    m = datasets.class_metrics(table(spark, sf, "golden_set_200"), "human_label", "lexicon_label_v3", LABELS)
    return m.select("label", "n", *[r7(c).alias(c) for c in ("precision", "recall", "f1")])


def _neighbours(spark, sf, k):
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", k)


_COS = """s AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS ql, e.label AS el, list_cosine_similarity(q.embedding, e.embedding)::DOUBLE AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {_COS} SELECT query_id, rank::INT AS rank, vec_id, round(score, 4) AS score FROM t WHERE rank <= 10")
def vector_top_k(spark, sf):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return _neighbours(spark, sf, 10).withColumn("score", F.round("score", 4))


@query(f"WITH {_COS}, f AS (SELECT query_id, min(rank) FILTER (ql = el AND rank <= 10) AS r FROM t GROUP BY 1) SELECT count(*) AS n_queries, round(avg(coalesce(r <= 5, false)::INT), 7) AS recall_at_k, round(avg(coalesce(1.0 / r, 0)), 7) AS mrr, round(avg(coalesce(r = 1, false)::INT), 7) AS first_at_1 FROM f")
def retrieval_metrics(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    h = _neighbours(spark, sf, 10).join(e, "vec_id").withColumnRenamed("label", "el")
    h = h.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("hit", F.col("el") == F.col("ql"))
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"))
    m = datasets.ranking_metrics(h, asked, "query_id", "rank", "hit")
    return m.select("n_queries", *[r7(c).alias(c) for c in ("recall_at_k", "mrr", "first_at_1")])


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding, e.embedding)::DOUBLE AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id AND q.label = e.label AND lpad(e.vec_id::VARCHAR, 12, '0') <= lpad(q.vec_id::VARCHAR, 12, '0'))
SELECT query_id, rank::INT AS rank, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def vector_top_k_until(spark, sf):
    """The three nearest of the same label that are not later than the query; the id stands for the time."""
    e = table(spark, sf, "embeddings").withColumn("at", F.lpad(F.col("vec_id").cast("string"), 12, "0"))
    return vectors.top_k(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 3, group="label", until="at").withColumn("score", F.round("score", 4))


@query("""WITH t AS (SELECT stock_code, news_id, unnest(regexp_extract_all(title, '[一-鿿]{2,6}')) AS term, generate_subscripts(regexp_extract_all(title, '[一-鿿]{2,6}'), 1) AS p FROM news WHERE title IS NOT NULL AND stock_code IS NOT NULL),
c AS (SELECT stock_code, term, count(*) AS n, min({'o': news_id, 'p': p}) AS f FROM t GROUP BY 1, 2)
SELECT stock_code, rank::INT AS rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, f, term) AS rank FROM c) WHERE rank <= 5""")
def theme_words(spark, sf):
    n = table(spark, sf, "news").where("title is not null and stock_code is not null").select("stock_code", "news_id", text.keywords(F.col("title")).alias("k"))
    return datasets.top_terms(n, "stock_code", "k", "news_id")


@query("WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, round(avg(value), 7) AS mean, min(value) FILTER (i >= greatest(1, floor(n * 0.95))) AS at_share FROM t GROUP BY 1")
def value_p95(spark, sf):
    """Mean and nearest-rank 95 % value per event type."""
    return datasets.nearest_rank(table(spark, sf, "events"), ["event_type"], "value").withColumn("mean", r7("mean"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 7) AS total FROM events GROUP BY 1, 2")
def events_per_hour(spark, sf):
    """The batch form of the stream's windowed counts."""
    e = incremental.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"], "value")
    return e.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r7("total").alias("total"))


_W = lambda n: f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_ROLL = (
    f"{_BARS}, r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date)), "
    + "ind AS (SELECT symbol, date, i, "
    + ", ".join(f"CASE WHEN i >= {n} THEN avg(close) OVER {_W(n)} END AS sma{n}" for n in (5, 20, 60))
    + f", avg(close) OVER {_W(7)} AS ma7_open, CASE WHEN i >= 5 THEN avg(volume) OVER {_W(5)} / nullif(CASE WHEN i >= 65 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 64 PRECEDING AND 5 PRECEDING) ELSE avg(volume) OVER (PARTITION BY symbol ORDER BY date) END, 0) END AS volume_ratio"
    + f", CASE WHEN i >= 21 THEN stddev_samp(ret) OVER {_W(20)} * sqrt(244) END AS volatility, min(low) OVER {_W(60)} AS support, max(high) OVER {_W(60)} AS resistance"
    + ", (close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) * 100 AS ret_5d, (close / nullif(lag(close, 20) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) * 100 AS ret_20d, (close / nullif(lag(close, 60) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) * 100 AS ret_60d, close FROM r)"
)
_IND = ["sma5", "sma20", "sma60", "ma7_open", "volume_ratio", "volatility", "support", "resistance", "ret_5d", "ret_20d", "ret_60d"]


@query(f"WITH {_ROLL} SELECT symbol, {_D}, " + ", ".join(f"round({c}, 7) AS {c}" for c in _IND) + " FROM ind")
def rolling_indicators(spark, sf):
    return B.rolling_indicators(clean(spark, sf)).select("symbol", day(), *[r7(c).alias(c) for c in _IND])


_FOLD = lambda xs, a: f"list_reduce({xs}, lambda acc, x: acc * (1 - {a}) + x * {a})"
_SMOOTH = f"""{_BARS}, p AS (SELECT symbol, date, close, high, low, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM b WHERE close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL),
l AS (SELECT symbol, count(*) AS n_bars, list(close ORDER BY date) AS c, list(greatest(close - pc, 0) ORDER BY date) FILTER (pc IS NOT NULL) AS u, list(greatest(pc - close, 0) ORDER BY date) FILTER (pc IS NOT NULL) AS d,
  list(greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) ORDER BY date) AS t FROM p GROUP BY 1),
sm AS (SELECT symbol, n_bars, {_FOLD('c', '(2.0 / 13)')} AS ema, CASE WHEN n_bars > 1 THEN {_FOLD('u', '(1.0 / 14)')} END AS up, CASE WHEN n_bars > 1 THEN {_FOLD('d', '(1.0 / 14)')} END AS dn, {_FOLD('t', '(1.0 / 14)')} AS atr FROM l),
smooth AS (SELECT symbol, n_bars, CASE WHEN n_bars >= 12 THEN ema END AS ema, CASE WHEN n_bars >= 15 THEN CASE WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END END AS rsi, CASE WHEN n_bars >= 15 THEN atr END AS atr FROM sm)"""


@query(f"WITH {_SMOOTH} SELECT symbol, n_bars, round(ema, 7) AS ema, round(rsi, 7) AS rsi, round(atr, 7) AS atr FROM smooth")
def smoothed_indicators(spark, sf):
    return B.smoothed_indicators(clean(spark, sf)).select("symbol", "n_bars", *[r7(c).alias(c) for c in ("ema", "rsi", "atr")])


_SNAP = [*_IND, "ema", "rsi", "atr", "atr_pct"]


@query(f"WITH {_ROLL}, {_SMOOTH.split(', p AS', 1)[1].join(['p AS', ''])} SELECT i.symbol, {_D}, close, i AS n_bars, " + ", ".join(f"round({c}, 7) AS {c}" for c in [*_IND, "ema", "rsi", "atr"]) + ", round(atr / nullif(close, 0) * 100, 7) AS atr_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM ind) i LEFT JOIN smooth s ON i.symbol = s.symbol WHERE k = 1")
def market_snapshot(spark, sf):
    return B.snapshot(clean(spark, sf)).select("symbol", day(), "close", "n_bars", *[r7(c).alias(c) for c in _SNAP])


@query(f"WITH {_BARS} SELECT symbol, {_D}, gap_days::INT AS gap_days FROM (SELECT symbol, date, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap_days FROM b) WHERE gap_days > 4")
def bar_gaps(spark, sf):
    """More than four days instead of fifteen: no stock of the tables pauses that long."""
    return B.gaps(clean(spark, sf), 4).select("symbol", day(), "gap_days")


@query(f"SELECT regexp_extract(code, '(\\d{{6}})', 1) AS symbol, {_D}, count(*) AS n FROM daily_hfq GROUP BY 1, date HAVING count(*) > 1")
def bar_copies(spark, sf):
    b = table(spark, sf, "daily_hfq").select(codes.six_digit(F.col("code")).alias("symbol"), "date")
    return b.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol", day(), "n")


@query(f"WITH {_BARS}, r AS (SELECT symbol, date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM b), m AS (SELECT *, avg(ret) OVER w AS a, stddev_samp(ret) OVER w AS s FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, {_D}, round(ret, 7) AS ret FROM m WHERE abs(ret - a) > 3 * s")
def return_outliers(spark, sf):
    """Three deviations instead of the usual five: a window of 20 that holds the value itself seldom reaches five."""
    return B.return_outliers(clean(spark, sf), 3.0).select("symbol", day(), r7("ret").alias("ret"))


_RULES_SQL = " UNION ALL ".join(f"SELECT '{r}' AS rule, symbol, date FROM b WHERE {e}" for r, e in B.RULES.items())


@query(f"WITH {_BARS}, v AS ({_RULES_SQL}) SELECT rule, symbol, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day FROM v GROUP BY 1, 2")
def bar_violations(spark, sf):
    v = B.violations(clean(spark, sf))
    return v.select("rule", "symbol", "n", F.date_format("first_date", "yyyy-MM-dd").alias("first_day"), F.date_format("last_date", "yyyy-MM-dd").alias("last_day"))


@query(f"WITH {_BARS}, v AS (SELECT DISTINCT symbol FROM ({_RULES_SQL})) SELECT b.symbol, count(v.symbol) = 0 AS passed FROM (SELECT DISTINCT symbol FROM b) b LEFT JOIN v ON b.symbol = v.symbol GROUP BY 1")
def symbols_passed(spark, sf):
    b = clean(spark, sf)
    bad = B.any_of([F.expr(e) for e in B.RULES.values()])
    return b.groupBy("symbol").agg((F.count_if(bad) == 0).alias("passed"))


@query(f"""WITH {_BARS}, d AS (SELECT symbol, count(DISTINCT date) AS n_days, min(date) AS a, max(date) AS z FROM b GROUP BY 1),
c AS (SELECT symbol, count(*) FILTER (isodow(x) < 6) AS n_business_days FROM (SELECT symbol, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS x FROM d) GROUP BY 1)
SELECT symbol, n_days, n_business_days, round(n_days / n_business_days, 7) AS coverage FROM d JOIN c USING (symbol)""")
def coverage(spark, sf):
    return B.coverage(clean(spark, sf)).withColumn("coverage", r7("coverage"))


_SHARES = "cap AS (SELECT regexp_extract(code, '(\\d{6})', 1) AS symbol, date, outstanding_share FROM share_capital)"


@query(f"WITH {_BARS}, {_SHARES} SELECT b.symbol, strftime(b.date, '%Y-%m-%d') AS day, b.bar_id, cap.outstanding_share, round(b.volume / (cap.outstanding_share * 10000) * 100, 7) AS turn_calc FROM b ASOF LEFT JOIN cap ON b.symbol = cap.symbol AND b.date >= cap.date")
def turnover_as_of(spark, sf):
    """Turnover by the outstanding shares valid on the day."""
    cap = table(spark, sf, "share_capital").select(codes.six_digit(F.col("code")).alias("symbol"), "date", "outstanding_share")
    b = clean(spark, sf).select("symbol", "date", "bar_id", "volume")
    out = asof.forward_fill(b, cap, ["symbol"], "date", "outstanding_share")
    return out.select("symbol", day(), "bar_id", "outstanding_share", r7(turnover(F.col("volume"), F.col("outstanding_share"))).alias("turn_calc"))


@query(f"WITH {_BARS} SELECT symbol, {_D}, round(close / hfq_factor, 7) AS raw_close, round((close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) * 100, 7) AS pct_calc, coalesce(pct_chg, (close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) * 100) IS NULL AS no_change, close >= open AS up FROM b")
def derived_prices(spark, sf):
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    pct = (F.try_divide("close", prev) - 1) * 100
    return clean(spark, sf).select("symbol", day(), r7(F.try_divide("close", "hfq_factor")).alias("raw_close"), r7(pct).alias("pct_calc"), F.coalesce("pct_chg", pct).isNull().alias("no_change"), (F.col("close") >= F.col("open")).alias("up"))


@query("SELECT news_id, title FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY news_id) AS k2 FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY news_id) AS k1 FROM news) WHERE k1 = 1) WHERE k2 = 1")
def news_first_by_url_text(spark, sf):
    """Keep-first by url, then by text."""
    n = table(spark, sf, "news").select("news_id", "title", "text", "url").withColumns({"_u": F.md5("url"), "_t": F.md5("text")}).drop("url", "text")
    return B.keep_first(B.keep_first(n, ["_u"], "news_id"), ["_t"], "news_id").select("news_id", "title")


@query("SELECT title, min(news_id) AS news_id FROM news WHERE title IS NOT NULL GROUP BY 1")
def news_first_by_title(spark, sf):
    return B.keep_first(table(spark, sf, "news").where("title is not null").select("title", "news_id", F.col("news_id").alias("_o")), ["title"], "_o").select("title", "news_id")


@query("SELECT DISTINCT text, lang, source FROM documents")
def documents_distinct(spark, sf):
    return table(spark, sf, "documents").select("text", "lang", "source").distinct()


@query("SELECT n.news_id FROM news n WHERE n.title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM golden_set_200 g WHERE trim(g.title) = trim(n.title))")
def news_outside_golden(spark, sf):
    g = table(spark, sf, "golden_set_200").select(F.trim("title").alias("_g")).distinct()
    return table(spark, sf, "news").where("title is not null").withColumn("_g", F.trim("title")).join(g, "_g", "left_anti").select("news_id")


@query("SELECT s.code, s.board, s.in_hist AND NOT s.in_now AS delisted, s.in_now AND NOT s.in_hist AS new, regexp_matches(s.code, '^(sh\\.(60|68)|sz\\.(00|30))') AS main, EXISTS (SELECT 1 FROM daily_hfq d WHERE regexp_extract(d.code, '(\\d{6})', 1) = s.symbol) AS has_bars FROM stock_list s")
def stock_flags(spark, sf):
    have = table(spark, sf, "daily_hfq").select(codes.six_digit(F.col("code")).alias("symbol")).distinct().withColumn("_h", F.lit(True))
    s = table(spark, sf, "stock_list").join(have, "symbol", "left")
    return s.select("code", "board", (F.col("in_hist") & ~F.col("in_now")).alias("delisted"), (F.col("in_now") & ~F.col("in_hist")).alias("new"), F.col("code").rlike(r"^(sh\.(60|68)|sz\.(00|30))").alias("main"), F.coalesce("_h", F.lit(False)).alias("has_bars"))


@query("SELECT DISTINCT code, regexp_extract(code, '(\\d{6})', 1) AS six, CASE WHEN instr(trim(code), '.') > 0 THEN lower(trim(code)) WHEN left(lower(trim(code)), 1) IN ('5', '6', '9') THEN 'sh.' || lower(trim(code)) ELSE 'sz.' || lower(trim(code)) END AS dotted, CASE WHEN left(regexp_extract(code, '(\\d{6})', 1), 2) IN ('60', '68') THEN 'sh' ELSE 'sz' END AS exchange FROM daily_hfq WHERE code IS NOT NULL")
def code_forms(spark, sf):
    c = table(spark, sf, "daily_hfq").where("code is not null").select("code").distinct()
    return c.select("code", codes.six_digit(F.col("code")).alias("six"), codes.market_code(F.col("code")).alias("dotted"), codes.exchange(F.col("code")).alias("exchange"))


@query("SELECT title, arg_max(human_label, golden_id) AS label FROM golden_set_200 GROUP BY 1")
def title_labels(spark, sf):
    """The last label of each title."""
    return table(spark, sf, "golden_set_200").groupBy("title").agg(F.max_by("human_label", "golden_id").alias("label"))


@query("WITH c AS (SELECT news_id, unnest(list_distinct(regexp_extract_all(stock_code, '\\d{6}'))) AS c FROM news) SELECT c AS symbol, count(*) AS n, count(DISTINCT news_id) AS n_news FROM c GROUP BY 1")
def news_per_code(spark, sf):
    """Articles per code, an article with several codes counting for each."""
    c = table(spark, sf, "news").select("news_id", F.explode(codes.all_codes(F.col("stock_code"))).alias("symbol"))
    return c.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("news_id").alias("n_news"))


@query("SELECT news_id, 'news_' || left(md5(CASE WHEN coalesce(url, '') = '' THEN coalesce(title, '') || '|' || coalesce(stock_code, '') || '|' || coalesce(publish_time, '') ELSE url END), 16) AS id, md5(coalesce(title, '') || coalesce(text, '')) AS content_md5 FROM news")
def news_ids(spark, sf):
    return table(spark, sf, "news").select("news_id", text.stable_id(F.col("url"), F.col("title"), F.col("stock_code"), F.col("publish_time")).alias("id"), F.md5(F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("content_md5"))


@query("WITH t AS (SELECT news_id, trim(regexp_replace(translate(regexp_replace(text, '<[^>]+>', '', 'g'), '　' || chr(13) || chr(10), '   '), '\\s+', ' ', 'g')) AS t FROM news WHERE text IS NOT NULL) SELECT news_id, t AS body, CASE WHEN length(t) <= 30 THEN t ELSE left(t, 30) || '…' END AS snippet FROM t WHERE length(t) >= 20")
def news_clean(spark, sf):
    t = table(spark, sf, "news").where("text is not null").select("news_id", text.clean(F.col("text")).alias("body")).where(F.length("body") >= 20)
    return t.withColumn("snippet", text.snippet(F.col("body"), 30))


@query("SELECT strftime(last_day(make_date(y, m, 1)), '%Y%m%d') AS quarter FROM (SELECT unnest(range(2016, 2026)) AS y), (SELECT unnest([3, 6, 9, 12]) AS m)")
def quarter_ends(spark, sf):
    s = spark.range(1).select(F.explode(F.expr("sequence(date'2016-03-01', date'2025-12-01', interval 3 months)")).alias("d"))
    return s.select(F.date_format(F.last_day("d"), "yyyyMMdd").alias("quarter"))


@query("SELECT max(calendar_date) AS day FROM trade_calendar WHERE is_trading_day = '1' AND calendar_date <= '2025-06-01'")
def latest_trade_day(spark, sf):
    return table(spark, sf, "trade_calendar").where("is_trading_day = '1' and calendar_date <= '2025-06-01'").agg(F.max("calendar_date").alias("day"))


_HASH = "md5(CAST({k} AS VARCHAR) || ':42')"


@query(f"WITH n AS (SELECT human_label AS l, count(*) AS c, greatest(30, floor(100 * count(*) / sum(count(*)) OVER ())) AS q FROM golden_set_200 GROUP BY 1) SELECT golden_id, human_label FROM (SELECT g.golden_id, g.human_label, q, row_number() OVER (PARTITION BY human_label ORDER BY {_HASH.format(k='golden_id')}, golden_id) AS k FROM golden_set_200 g JOIN n ON g.human_label IS NOT DISTINCT FROM n.l) WHERE k <= q")
def stratified_sample(spark, sf):
    return datasets.stratified_sample(table(spark, sf, "golden_set_200").select("golden_id", "human_label"), "human_label", "golden_id", 100)


@query("""WITH c AS (SELECT human_label, count(*) AS n FROM golden_set_200 WHERE human_label IS NOT NULL GROUP BY 1),
q AS (SELECT *, CAST(floor(CASE human_label WHEN 'positive' THEN 0.4 WHEN 'negative' THEN 0.35 WHEN 'neutral' THEN 0.25 ELSE 0 END * 150 + 0.5) AS BIGINT) AS a, row_number() OVER (ORDER BY n DESC, human_label) AS k FROM c)
SELECT human_label, n, greatest(0, least(n, a + CASE WHEN k = 1 THEN 150 - (SELECT sum(a) FROM q) ELSE 0 END))::BIGINT AS quota FROM q""")
def label_quotas(spark, sf):
    c = table(spark, sf, "golden_set_200").where("human_label is not null").groupBy("human_label").agg(F.count(F.lit(1)).alias("n"))
    return datasets.quotas(c, "human_label", "n", 150, {"positive": 0.4, "negative": 0.35, "neutral": 0.25})


@query(f"SELECT news_id, CASE WHEN row_number() OVER (ORDER BY {_HASH.format(k='news_id')}, news_id) <= greatest(200, floor((SELECT count(*) FROM news) * 0.02)) THEN 'val' ELSE 'train' END AS split FROM news")
def train_val_split(spark, sf):
    return datasets.train_val(table(spark, sf, "news").select("news_id"), "news_id")


@query("""SELECT golden_id, to_json([{'role': 'system', 'content': '判断新闻情感'}, {'role': 'user', 'content': '标题：' || coalesce(title, '') || chr(10) || '正文：' || coalesce(text, '')}, {'role': 'assistant', 'content': human_label}])::VARCHAR AS messages FROM golden_set_200 WHERE human_label IS NOT NULL""")
def chat_messages(spark, sf):
    g = table(spark, sf, "golden_set_200").where("human_label is not null")
    return g.select("golden_id", F.to_json(text.messages(F.col("title"), F.col("text"), F.col("human_label"), "判断新闻情感")).alias("messages"))


@query("SELECT coalesce(a.x, b.x) AS label, coalesce(a.n, 0) AS n_human, coalesce(b.n, 0) AS n_lexicon FROM (SELECT human_label AS x, count(*) AS n FROM golden_set_200 WHERE human_label IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT lexicon_label_v3 AS x, count(*) AS n FROM golden_set_200 WHERE lexicon_label_v3 IS NOT NULL GROUP BY 1) b ON a.x = b.x")
def label_histograms(spark, sf):
    g = table(spark, sf, "golden_set_200")
    one = lambda c, n: g.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias(n))
    out = one("human_label", "n_human").join(one("lexicon_label_v3", "n_lexicon"), "label", "full_outer")
    return out.select("label", F.coalesce("n_human", F.lit(0)).alias("n_human"), F.coalesce("n_lexicon", F.lit(0)).alias("n_lexicon"))


@query("SELECT g.golden_id, count(DISTINCT n.news_id) AS n_related FROM (SELECT golden_id, unnest(list_distinct(regexp_extract_all(stock_code, '\\d{6}'))) AS c, left(publish_time, 10) AS d FROM golden_set_200) g JOIN (SELECT news_id, unnest(list_distinct(regexp_extract_all(stock_code, '\\d{6}'))) AS c, left(publish_time, 10) AS d FROM news) n ON g.c = n.c AND g.d = n.d GROUP BY 1")
def related_news(spark, sf):
    """News that share a code and a day with an evaluation row: explode and equi-join instead of testing set overlap per pair.

    The day is the first ten characters as they stand, as in its SQL; related_news_all_days is the reference's relevance."""
    one = lambda t, k: table(spark, sf, t).select(k, F.explode(codes.all_codes(F.col("stock_code"))).alias("c"), F.substring("publish_time", 1, 10).alias("d"))
    return one("golden_set_200", "golden_id").join(one("news", "news_id"), ["c", "d"]).groupBy("golden_id").agg(F.countDistinct("news_id").alias("n_related"))


_OF = "list_distinct(regexp_extract_all(stock_code, '\\d{6}')) AS c, regexp_replace(title, '^[\\s　]+|[\\s　]+$', '', 'g') AS t"


@query(f"WITH g AS (SELECT golden_id, {_OF} FROM golden_set_200), n AS (SELECT {_OF} FROM news) SELECT golden_id, count(n.c) AS n_related FROM g LEFT JOIN n ON list_has_any(g.c, n.c) AND coalesce(n.t <> g.t, true) WHERE len(g.c) > 0 GROUP BY 1")
def related_news_all_days(spark, sf):
    """News of any day that share a code with an evaluation row and have another title."""
    g, n = (table(spark, sf, t).withColumn("codes", codes.all_codes(F.col("stock_code"))) for t in ("golden_set_200", "news"))
    return datasets.related_counts(g, n, "golden_id")


def _sentiment_sql() -> str:
    """Hits by joining all substrings of the lexicon's lengths to the words, patterns by counting matches."""
    words = ", ".join(f"('{w}', {x}, {sign}, {i})" for sign, d in ((1, lw.POSITIVE), (-1, lw.NEGATIVE)) for i, (w, x) in enumerate(d.items()))
    near = lambda n: f"substring(t, greatest(1, p - {n}), least(p - 1, {n}))"
    holds = lambda ws, n: "(" + " OR ".join(f"contains({near(n)}, '{w}')" for w in ws) + ")"
    degree = "CASE " + " ".join(f"WHEN contains({near(lw.DEGREE_WINDOW)}, '{w}') THEN {x}" for w, x in lw.DEGREES.items()) + " ELSE 1.0 END"
    parts = []
    for i, (pattern, name, x) in enumerate(lw.PATTERNS):
        if "(?!" in pattern:  # RE2 has no look-ahead: subtract what it forbids
            stem, barred = re.match(r"(.+)\(\?!\[(.+)\]\)", pattern).groups()
            n = f"len(regexp_extract_all(t, '{stem}'))" + "".join(f" - len(regexp_extract_all(t, '{stem}{c}'))" for c in barred)
        else:
            n = "len(regexp_extract_all(t, '" + pattern.replace("\\s", "[\\s　]").replace("[\\d.]", "[0-9０-９.]") + "'))"
        parts.append(f"SELECT id, f, wt, {i} AS o, '{name}' AS w, {x} AS x, {n} AS n FROM t")
    return f"""WITH w(word, x, sign, o) AS (VALUES {words}),
t AS (SELECT news_id AS id, 0 AS f, 2.0::DOUBLE AS wt, coalesce(title, '') AS t FROM news UNION ALL SELECT news_id, 1, 1.0::DOUBLE, coalesce(text, '') FROM news),
pos AS (SELECT id, f, wt, t, unnest(range(1, length(t) + 1)) AS p FROM t),
sub AS (SELECT *, unnest([2, 3, 4, 5]) AS n FROM pos),
hit AS (SELECT id, f, wt, t, p, word, x, sign, o FROM sub JOIN w ON substring(t, p, n) = word AND n = length(word)),
m AS (SELECT *, {degree} AS d, {holds(lw.NEGATIONS, lw.NEGATION_WINDOW)} AS neg, sign < 0 AND {holds(lw.CANCELS, lw.CANCEL_WINDOW)} AS can FROM hit),
a AS (SELECT id, f, 0 AS kind, -length(word) AS k1, o AS k2, p AS k3, sign > 0 AS good, word || CASE WHEN neg THEN '(否定)' WHEN can THEN '(撤销)' ELSE '' END AS term, x::DOUBLE * wt * sign * d::DOUBLE * CASE WHEN neg THEN -0.9 ELSE 1 END * CASE WHEN can THEN -0.9 ELSE 1 END AS s FROM m
  UNION ALL SELECT id, f, 1, 0, o, 0, x > 0, w || '×' || n, x::DOUBLE * wt * n FROM ({" UNION ALL ".join(parts)}) WHERE n > 0),
r AS (SELECT id, round(sum(s), 9) AS s, string_agg(term, ';' ORDER BY f, kind, k1, k2, k3) FILTER (good) AS pos, string_agg(term, ';' ORDER BY f, kind, k1, k2, k3) FILTER (NOT good) AS neg FROM a GROUP BY 1)
SELECT news_id, CASE WHEN s >= 1 THEN 'positive' WHEN s <= -1 THEN 'negative' ELSE 'neutral' END AS label, round(coalesce(s, 0), 3) AS score, round(least(1, abs(coalesce(s, 0)) / 3), 3) AS confidence, coalesce(pos, '') AS pos_terms, coalesce(neg, '') AS neg_terms FROM news LEFT JOIN r ON news_id = id"""


@query(_sentiment_sql())
def news_sentiment(spark, sf):
    n = table(spark, sf, "news").select("news_id", lexicon.sentiment(F.col("title"), F.col("text")).alias("s"))
    return n.select("news_id", "s.label", "s.score", "s.confidence", F.concat_ws(";", "s.pos_terms").alias("pos_terms"), F.concat_ws(";", "s.neg_terms").alias("neg_terms"))


@query(f"WITH z AS ({_sentiment_sql()}) SELECT label, count(*) AS n, round(avg((confidence >= 0.5)::INT), 7) AS sure, round(quantile_cont(score, 0.1), 7) AS p10, round(quantile_cont(score, 0.5), 7) AS p50, round(quantile_cont(score, 0.9), 7) AS p90, round(count(*) / sum(count(*)) OVER (), 7) AS share FROM z GROUP BY 1")
def sentiment_summary(spark, sf):
    """Per label: articles, share, and deciles of the score."""
    f = news_sentiment(spark, sf).groupBy("label", F.col("score").alias("value"), (F.col("confidence") >= 0.5).alias("_sure")).agg(F.count(F.lit(1)).alias("n"))
    s = f.groupBy("label").agg(F.sum("n").alias("_n"), (F.sum(F.when(F.col("_sure"), F.col("n")).otherwise(0)) / F.sum("n")).alias("sure")).withColumnRenamed("_n", "n")
    q = prof.quantiles(f, ["label"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}).withColumnRenamed("label", "_l")
    s = s.join(q, s["label"] == q["_l"]).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a label
    return s.select("label", "n", *[r7(c).alias(c) for c in ("sure", "p10", "p50", "p90", "share")])


@query(f"WITH z AS ({_sentiment_sql()}) SELECT stock_code, count(*) AS n, round(avg((label = 'positive')::INT), 7) AS positive, round(avg((label = 'negative')::INT), 7) AS negative, round(avg((label = 'neutral')::INT), 7) AS neutral, round(sum(CASE label WHEN 'positive' THEN confidence WHEN 'negative' THEN -confidence ELSE 0 END) / count(*), 7) AS net FROM z JOIN news USING (news_id) GROUP BY 1")
def net_sentiment(spark, sf):
    n = table(spark, sf, "news").select("stock_code", lexicon.sentiment(F.col("title"), F.col("text")).alias("s")).select("stock_code", "s.label", "s.confidence")
    out = datasets.net_sentiment(n, ["stock_code"], "label", "confidence")
    return out.select("stock_code", "n", *[r7(c).alias(c) for c in ("positive", "negative", "neutral", "net")])


_LINE = "coalesce(title, '') || coalesce(text, '')"
_PRINTS = f"""t AS (SELECT news_id, {_LINE} AS s FROM news),
han AS (SELECT news_id, regexp_extract_all(s, '[\\x{{4e00}}-\\x{{9fff}}]') AS h, regexp_extract_all(s, '[a-zA-Z0-9]{{2,}}') AS w FROM t),
tok AS (SELECT news_id, unnest(list_concat(list_transform(range(1, len(h)), lambda i: h[i] || h[i + 1]), list_transform(w, lambda x: lower(x)))) AS k FROM han),
freq AS (SELECT news_id, k, count(*) AS n FROM tok GROUP BY 1, 2),
hash AS (SELECT k, ('0x' || left(md5(k), 16))::UBIGINT AS v FROM (SELECT DISTINCT k FROM freq)),
votes AS (SELECT news_id, {", ".join(f"sum(CASE WHEN (v >> {b}) & 1 = 1 THEN n ELSE -n END) AS b{b}" for b in range(64))} FROM freq JOIN hash USING (k) GROUP BY 1),
raw AS (SELECT news_id, ({" + ".join(f"(CASE WHEN b{b} > 0 THEN {1 << b}::HUGEINT ELSE 0 END)" for b in range(64))}) AS u FROM votes),
prints AS (SELECT n.news_id, CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN (u - 18446744073709551616)::BIGINT ELSE coalesce(u, 0)::BIGINT END AS fp FROM news n LEFT JOIN raw USING (news_id))"""
_NEAR = f"""{_PRINTS}, d AS (SELECT fp, min(news_id) AS k FROM prints WHERE fp <> 0 GROUP BY 1),
near AS (SELECT a.k AS early, b.k AS late, a.fp AS fa, b.fp AS fb, bit_count(xor(a.fp, b.fp))::INT AS dist FROM d a JOIN d b ON a.k < b.k AND bit_count(xor(a.fp, b.fp)) <= 3)"""


def _prints(spark, sf):
    line = F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return table(spark, sf, "news").select("news_id", dedup.simhash(line).alias("fp"))


@query(f"WITH {_PRINTS} SELECT news_id, fp FROM prints")
def news_simhash(spark, sf):
    """The 64-bit fingerprint of every article, 0 for one without tokens."""
    return _prints(spark, sf)


@query(f"WITH {_NEAR} SELECT least(fa, fb) AS a, greatest(fa, fb) AS b, dist FROM near")
def simhash_pairs(spark, sf):
    """Pairs of different fingerprints within three bits, one row for all their copies."""
    p = dedup.near_pairs(_prints(spark, sf).where("fp <> 0").select("fp").distinct())
    return p.select("a", "b", F.col("dist").cast("int").alias("dist"))


# The scan in key order, over the articles that have a neighbour at all: one step a row.
_SCAN = f"""WITH RECURSIVE {_NEAR},
node AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT early AS k FROM near UNION SELECT late FROM near)),
before AS (SELECT node.i, node.k, list(early) FILTER (early IS NOT NULL) AS e FROM node LEFT JOIN near ON late = k GROUP BY ALL),
scan AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT b.i, CASE WHEN coalesce(list_has_any(scan.kept, b.e), false) THEN scan.kept ELSE list_append(scan.kept, b.k) END FROM scan JOIN before b ON b.i = scan.i + 1),
kept AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM scan ORDER BY i DESC LIMIT 1)),
owner AS (SELECT k, CASE WHEN k IN (SELECT k FROM kept) THEN k ELSE (SELECT min(early) FROM near WHERE late = before.k AND early IN (SELECT k FROM kept)) END AS c FROM before),
classes AS (SELECT p.news_id, p.fp, CASE WHEN p.fp = 0 THEN p.news_id ELSE coalesce(o.c, d.k) END AS class_id FROM prints p LEFT JOIN d ON p.fp = d.fp LEFT JOIN owner o ON o.k = d.k)"""


@query(f"{_SCAN} SELECT news_id, fp, class_id, class_id = news_id AS keep FROM classes")
def news_near_duplicates(spark, sf):
    """Each article's near-duplicate class; the earliest of a class is kept."""
    return dedup.near_duplicates(_prints(spark, sf), "news_id", "fp")


@query(f"{_SCAN}, z AS (SELECT class_id, count(*) AS size FROM classes GROUP BY 1) SELECT size, count(*) AS n_classes FROM z GROUP BY 1")
def near_duplicate_classes(spark, sf):
    """Class sizes: how many articles a kept one stands for, and how many classes there are of each size."""
    c = news_near_duplicates(spark, sf).groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    return c.groupBy("size").agg(F.count(F.lit(1)).alias("n_classes"))


@query(f"{_SCAN}, kept_rows AS (SELECT n.* FROM news n JOIN classes c ON n.news_id = c.news_id AND c.class_id = c.news_id), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY news_id) AS k1 FROM kept_rows) SELECT news_id, title, NULL::VARCHAR AS label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY news_id) AS k2 FROM u WHERE k1 = 1) WHERE k2 = 1")
def news_corpus(spark, sf):
    """The news pipeline: one article of each near-duplicate class, then of each url, then of each text, with the empty label column of the export."""
    return dedup.corpus(table(spark, sf, "news"), "news_id", "title", "text", "url").select("news_id", "title", F.lit(None).cast("string").alias("label"))
