"""The general training-data queries p2 - p6 over the project's tables, and their SQL where it can say them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import all_codes, six_digit
from ..functions.times import day_of, is_standard_time, quarter_end
from ..operators import anomalies, asof, profile as prof, rolling, units
from ..session import cut, table


def known_reports(fin: DataFrame) -> DataFrame:
    """Validity intervals of reports per six-digit code: latest quarter, then latest pub_date, then smallest fin_id."""
    f = fin.withColumn("_code", six_digit(F.col("code"))).withColumn("_q", quarter_end(F.col("report_date")))
    f = f.where(F.col("_q").isNotNull() & (F.col("pub_date") >= F.col("_q")))
    return asof.validity_intervals(f, "_code", "pub_date", [F.col("_q"), F.col("pub_date"), -F.col("fin_id")], ["fin_id", "_q", "pub_date", "eps", "revenue", "net_profit"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "daily_hfq").select("bar_id", six_digit(F.col("code")).alias("_code"), "date")
    iv = known_reports(table(spark, sf_dir, "financials_yjbb"))
    return asof.as_known(bars, iv, "_code", "date", ["fin_id"]).select("fin_id", "bar_id")


def p3_bars_with_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the figures of the report known on its day."""
    bars = table(spark, sf_dir, "daily_hfq").select("bar_id", six_digit(F.col("code")).alias("_code"), "date", "close")
    iv = known_reports(table(spark, sf_dir, "financials_yjbb"))
    out = asof.as_known(bars, iv, "_code", "date", ["fin_id", "_q", "eps"])
    return out.select("bar_id", "fin_id", F.col("_code").alias("symbol"), F.date_format("date", "yyyy-MM-dd").alias("day"), F.date_format("_q", "yyyy-MM-dd").alias("quarter"))


WATCHED = {"daily_hfq": ["close"], "financials_yjbb": ["eps"], "news": ["publish_time"]}
VALID = {
    "daily_hfq": {"code": lambda c: c.rlike(r"^(sh|sz)\.[0-9]{6}$"), "source": lambda c: c.rlike(r"^[a-z]+$")},
    "financials_yjbb": {"code": lambda c: c.rlike(r"^[0-9]{6}$"), "report_date": lambda c: c.rlike(r"^[0-9]{4}(0331|0630|0930|1231)$")},
    "news": {"publish_time": is_standard_time, "stock_code": lambda c: c.rlike(r"^[0-9]{6}$"), "url": lambda c: c.rlike(r"^https?://\S+$")},
}


def _watched_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = [(table(spark, sf_dir, t), t, cols, {c: r for c, r in VALID[t].items() if c in cols}) for t, cols in WATCHED.items()]
    return prof.compared_loads(prof.profile_tables(watched, "load_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _watched_loads(spark, sf_dir).where("deviates").select("table_name", "column_name", "load_id")


def p4_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every load of the watched columns with its stability index and whether it deviates."""
    return _watched_loads(spark, sf_dir).select("table_name", "column_name", "load_id", F.round("psi", 6).alias("psi"), "deviates")


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every column of the three tables, per load."""
    frames = {t: table(spark, sf_dir, t) for t in WATCHED}
    out = prof.profile_tables([(df, t, [c for c in df.columns if c != "load_id"], VALID[t]) for t, df in frames.items()], "load_id")
    return out.withColumns({c: F.round(c, 6) for c in ("least", "greatest", "median", "psi")})


def news_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_code, day, n): articles per code and Shanghai day within the trade calendar's dates."""
    cal = table(spark, sf_dir, "trade_calendar").select(F.try_to_date("calendar_date", "yyyy-MM-dd").alias("d")).agg(F.min("d").alias("_from"), F.max("d").alias("_to"))
    news = table(spark, sf_dir, "news").select(F.explode(all_codes(F.col("stock_code"))).alias("stock_code"), day_of(F.col("publish_time")).alias("day"))
    news = news.groupBy("stock_code", "day").agg(F.count(F.lit(1)).alias("n"))
    return news.crossJoin(F.broadcast(cal)).where(F.col("day").between(F.col("_from"), F.col("_to"))).select("stock_code", "day", "n")


def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling.trailing_totals(news_per_day(spark, sf_dir), "stock_code", "day", "n", (7, 30))
    return out.select("stock_code", F.date_format("day", "yyyy-MM-dd").alias("day"), "total_1d", "total_7d", F.round("avg_7d", 6).alias("avg_7d"), "total_30d", F.round("avg_30d", 6).alias("avg_30d"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling.trailing_totals(news_per_day(spark, sf_dir), "stock_code", "day", "n", (7, 30))
    return out.where("total_7d = 0 AND total_30d > 0").select("stock_code", F.date_format("day", "yyyy-MM-dd").alias("day"))


def bars_with_shares(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    """Bars with `symbol` and `shares`, the outstanding shares valid on their day (null if unknown)."""
    cols = ["bar_id", "date", "open", "high", "low", "close", "volume", "amount", "turn", "tradestatus", "source", "hfq_factor", *(extra or [])]
    bars = table(spark, sf_dir, "daily_hfq").select(*cols, six_digit(F.col("code")).alias("symbol"))
    cap = table(spark, sf_dir, "share_capital").select(six_digit(F.col("code")).alias("symbol"), "date", (F.col("outstanding_share") * 10000).alias("shares"))
    iv = asof.validity_intervals(cap, "symbol", "date", [F.col("date"), F.col("shares")], ["shares"])
    return asof.as_known(bars, iv, "symbol", "date", ["shares"], how="left")


def standard_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their units, written once: the quotes refer to them."""
    out = units.infer_units(bars_with_shares(spark, sf_dir))
    return cut(out.select("bar_id", "symbol", "date", *[f"{f}_{x}" for f in units.FIELDS for x in ("unit", "p", "std")], "unit_uncertain"))


def standard_quotes(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    q = table(spark, sf_dir, "vendor_quotes").withColumns({"symbol": six_digit(F.col("code")), "day": day_of(F.col("date"))})
    ref = bars.select("symbol", F.col("date").alias("day"), "volume_std", "amount_std", "turn_std")
    return units.quotes_to_standard(q, ref, ["symbol", "day"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of bars and quotes that are recorded in another unit than shares, yuan, percent."""
    bars = standard_bars(spark, sf_dir)
    standard = {"volume": "shares", "amount": "yuan", "turn": "percent"}
    off = F.filter(F.array(*[F.when(F.col(f"{f}_unit") != u, F.lit(f)) for f, u in standard.items()]), lambda x: x.isNotNull())
    a = bars.select(F.lit("daily_hfq").alias("table_name"), F.col("bar_id").alias("row_id"), F.explode(off).alias("field"))
    quotes = standard_quotes(spark, sf_dir, bars)
    off = F.filter(F.array(*[F.when((F.col(f"{f}_factor") != 1) & (F.col(f"{f}_number") != 0), F.lit(f)) for f in standard]), lambda x: x.isNotNull())
    return a.unionByName(quotes.select(F.lit("vendor_quotes").alias("table_name"), F.col("rec_id").alias("row_id"), F.explode(off).alias("field")))


def p5_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars and quotes in shares, yuan and percent, with the units they were recorded in."""
    bars = standard_bars(spark, sf_dir)
    keep = ["volume_std", "amount_std", "turn_std"]
    a = bars.select(F.lit("daily_hfq").alias("table_name"), F.col("bar_id").alias("row_id"), *keep, "volume_p", "amount_p", "turn_p", "unit_uncertain")
    q = standard_quotes(spark, sf_dir, bars)
    sure = F.least(*[F.coalesce(F.col(f"{f}_p"), F.lit(1.0)) for f in units.FIELDS]) >= 0.9
    return a.unionByName(q.select(F.lit("vendor_quotes").alias("table_name"), F.col("rec_id").alias("row_id"), *keep, "volume_p", "amount_p", "turn_p", (~sure).alias("unit_uncertain")))


def flagged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of all bars; volumes are brought to shares first, so a value in another unit is no fault."""
    bars = units.infer_units(bars_with_shares(spark, sf_dir, ["preclose"]))
    x1 = (F.col("_x1") - F.log10(F.col("amount") / F.col("amount_std"))) * F.lit(2.302585092994046)
    x2 = (F.col("_x2") - F.log10(F.col("turn") / F.col("turn_std"))) * F.lit(2.302585092994046)
    own = F.ln(F.when(F.col("volume_std") > 0, F.col("volume_std")))
    nearer = F.when(F.abs(own - x1) <= F.abs(own - x2), x1).otherwise(x2)  # an amount or a turnover may be the faulty one
    bars = bars.withColumns({"_vstd": F.col("volume_std"), "_vref": F.coalesce(F.when(x1.isNotNull() & x2.isNotNull() & own.isNotNull(), nearer), x1, x2)})
    keep = ["bar_id", "symbol", "date", "tradestatus", "open", "close", "high", "low", "preclose", "volume", "shares", "_src", "_vstd", "_vref"]
    return anomalies.flag_bars(cut(bars.select(*keep)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged_bars(spark, sf_dir).where("faulty").select("bar_id")


PRICES = ["close", "high", "low"]


def p2_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the flags that needs no model: impossible and stuck prices of traded bars."""
    flags = flagged_bars(spark, sf_dir)
    return flags.select("bar_id", *[f"{f}_{kind}" for kind in ("range", "stuck") for f in PRICES])


def p5_named_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and factors of the quotes whose unit stands in the text or its note, one row a field."""
    q = table(spark, sf_dir, "vendor_quotes")
    rows = []
    for f in units.FIELDS:
        number, factor = units.read_quantity(F.col(f"{f}_text"), F.col("unit_note"), f)
        rows.append(F.struct(F.lit(f).alias("field"), number.alias("number"), factor.alias("factor")))
    out = q.select("rec_id", F.explode(F.array(*rows)).alias("r")).select("rec_id", "r.*").where("factor is not null")
    return out.select("rec_id", "field", "number", "factor")


QUERIES = {"p2_found": p2_found, "p2_flags": flagged_bars, "p2_bounds": p2_bounds, "p5_named_quotes": p5_named_quotes, "p5_found": p5_found, "p5_standard": p5_standard, "p3_found": p3_found, "p3_bars_with_report": p3_bars_with_report, "p4_found": p4_found, "p4_loads": p4_loads, "p4_profile": p4_profile, "p6_found": p6_found, "p6_rolling": p6_rolling}

_DAYS = """
raw AS (SELECT stock_code, trim(regexp_replace(publish_time, '[\\s　]+', ' ', 'g')) AS t FROM news WHERE publish_time IS NOT NULL),
parsed AS (SELECT stock_code, CASE
  WHEN regexp_matches(t, '^\\d{13}$') THEN make_timestamp(CAST(t AS BIGINT) * 1000) + INTERVAL 8 HOUR
  WHEN regexp_matches(t, '^\\d{14}$') THEN try_strptime(t, '%Y%m%d%H%M%S')
  WHEN regexp_matches(t, '^\\d{8}$') THEN try_strptime(t, '%Y%m%d')
  WHEN t LIKE '%Z' THEN try_strptime(t, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 8 HOUR
  ELSE coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d'),
    try_strptime(t, '%Y/%m/%d %H:%M'), try_strptime(t, '%Y/%m/%d %H:%M:%S'), try_strptime(t, '%Y年%m月%d日 %H:%M'), try_strptime(t, '%Y年%m月%d日')) END AS ts FROM raw),
coded AS (SELECT DISTINCT ON (rid, code) code, day FROM (SELECT rid, unnest(regexp_extract_all(stock_code, '\\d{6}')) AS code, day FROM
  (SELECT row_number() OVER () AS rid, stock_code, CAST(ts AS DATE) AS day FROM parsed WHERE ts IS NOT NULL))),
daily AS (SELECT code, day, count(*) AS n FROM coded WHERE day BETWEEN (SELECT min(CAST(calendar_date AS DATE)) FROM trade_calendar) AND (SELECT max(CAST(calendar_date AS DATE)) FROM trade_calendar) GROUP BY 1, 2),
span AS (SELECT code, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY code),
rolled AS (SELECT s.code AS stock_code, s.day, coalesce(d.n, 0) AS n,
  sum(coalesce(d.n, 0)) OVER (PARTITION BY s.code ORDER BY s.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t7,
  sum(coalesce(d.n, 0)) OVER (PARTITION BY s.code ORDER BY s.day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t30
  FROM span s LEFT JOIN daily d ON s.code = d.code AND s.day = d.day)"""

_REPORTS = """
fin AS (SELECT fin_id, lpad(regexp_extract(code, '(\\d+)', 1), 6, '0') AS code, pub_date,
  CASE WHEN report_date LIKE '%Q1' THEN make_date(CAST(left(report_date, 4) AS INT), 3, 31) WHEN report_date LIKE '%Q2' THEN make_date(CAST(left(report_date, 4) AS INT), 6, 30)
       WHEN report_date LIKE '%Q3' THEN make_date(CAST(left(report_date, 4) AS INT), 9, 30) WHEN report_date LIKE '%Q4' THEN make_date(CAST(left(report_date, 4) AS INT), 12, 31)
       ELSE CAST(coalesce(try_strptime(report_date, '%Y%m%d'), try_strptime(report_date, '%Y-%m-%d'), try_strptime(report_date, '%Y/%m/%d')) AS DATE) END AS q FROM financials_yjbb),
ok AS (SELECT * FROM fin WHERE pub_date IS NOT NULL AND q IS NOT NULL AND pub_date >= q),
bars AS (SELECT bar_id, regexp_extract(code, '(\\d{6})', 1) AS code, date FROM daily_hfq),
ranked AS (SELECT b.bar_id, b.code, b.date, f.fin_id, f.q, row_number() OVER (PARTITION BY b.bar_id ORDER BY f.q DESC, f.pub_date DESC, f.fin_id) AS rn
  FROM bars b JOIN ok f ON b.code = f.code AND f.pub_date <= b.date)"""

_LOADS = """
v AS (SELECT 'daily_hfq' AS table_name, 'close' AS column_name, load_id, close AS x, (close IS NULL OR isnan(close)) AS miss, false AS bad FROM daily_hfq
  UNION ALL SELECT 'financials_yjbb', 'eps', load_id, eps, (eps IS NULL OR isnan(eps)), false FROM financials_yjbb
  UNION ALL SELECT 'news', 'publish_time', load_id, NULL, (publish_time IS NULL OR trim(publish_time, ' \t\n\r　') = ''),
    NOT (regexp_full_match(publish_time, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') AND try_strptime(publish_time, '%Y-%m-%d %H:%M:%S') IS NOT NULL) FROM news),
s AS (SELECT table_name, column_name, load_id, avg(miss::INT) AS m, avg((NOT miss AND bad)::INT) AS b, median(CASE WHEN NOT miss THEN x END) AS med FROM v GROUP BY ALL),
w AS (SELECT *, median(m) OVER p AS mm, median(b) OVER p AS mb, median(med) OVER p AS mmed FROM s WINDOW p AS (PARTITION BY table_name, column_name))"""

_NUM = "open high low close preclose volume amount turn tradestatus pct_chg pe_ttm pb_mrq ps_ttm pcf_ncf_ttm is_st hfq_factor bar_id eps revenue revenue_yoy revenue_qoq net_profit net_profit_yoy net_profit_qoq bps roe ocf_ps gross_margin fin_id news_id".split()
_COLUMNS = {
    "daily_hfq": "bar_id date code open high low close preclose volume amount turn tradestatus pct_chg pe_ttm pb_mrq ps_ttm pcf_ncf_ttm is_st source hfq_factor".split(),
    "financials_yjbb": "fin_id code name eps revenue revenue_yoy revenue_qoq net_profit net_profit_yoy net_profit_qoq bps roe ocf_ps gross_margin industry pub_date report_date".split(),
    "news": "news_id title text stock_code source publish_time url".split(),
}
_PATTERNS = {
    ("daily_hfq", "code"): "regexp_full_match(code, '(sh|sz)\\.[0-9]{6}')", ("daily_hfq", "source"): "regexp_full_match(source, '[a-z]+')",
    ("financials_yjbb", "code"): "regexp_full_match(code, '[0-9]{6}')", ("financials_yjbb", "report_date"): "regexp_full_match(report_date, '[0-9]{4}(0331|0630|0930|1231)')",
    ("news", "stock_code"): "regexp_full_match(stock_code, '[0-9]{6}')", ("news", "url"): "regexp_full_match(url, 'https?://\\S+')",
    ("news", "publish_time"): "regexp_full_match(publish_time, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') AND try_strptime(publish_time, '%Y-%m-%d %H:%M:%S') IS NOT NULL",
}


def _column_sql(t: str, c: str) -> str:
    if c in _NUM:
        x, key, miss = f"CAST({c} AS DOUBLE)", f"CAST(CASE WHEN {c} = 0 THEN 0 ELSE {c} END AS VARCHAR)", f"({c} IS NULL OR CAST({c} AS VARCHAR) = 'nan')"
    elif c in ("date", "pub_date"):
        x, key, miss = f"CAST({c} - DATE '1970-01-01' AS DOUBLE)", f"CAST({c} AS VARCHAR)", f"{c} IS NULL"
    else:
        x, key, miss = "CAST(NULL AS DOUBLE)", f"CASE WHEN length({c}) > 40 THEN md5({c}) ELSE {c} END", f"({c} IS NULL OR NOT regexp_matches({c}, '[^\\s　]'))"
    bad = f"NOT ({_PATTERNS[t, c]})" if (t, c) in _PATTERNS else "false"
    own = "NULL" if c in _NUM or c in ("date", "pub_date") else f"(unicode({c}) * 31 + unicode(right({c}, 1)) + length({c})) % 16"
    return f"SELECT '{t}' AS t, '{c}' AS c, load_id AS l, {x} AS x, {key} AS k, {miss} AS miss, {bad} AS bad, {own} AS tb FROM {t}"


_STEP = "(floor(log2(abs(x)) * 16 + 1e-9) + 20000)"
_PROFILE = f"""
v AS ({" UNION ALL ".join(_column_sql(t, c) for t, cs in _COLUMNS.items() for c in cs)}),
g AS (SELECT t, c, l, CASE WHEN miss THEN NULL ELSE x END AS x, CASE WHEN miss THEN NULL ELSE k END AS k, miss, NOT miss AND bad AS bad,
  CASE WHEN miss THEN 'missing' WHEN bad THEN 'malformed' WHEN x IS NULL THEN CAST(tb AS VARCHAR) WHEN x = 0 THEN '0' WHEN x > 0 THEN CAST(floor({_STEP} / 16) AS VARCHAR) ELSE CAST(floor(-{_STEP} / 16) AS VARCHAR) END AS b FROM v),
s AS (SELECT t, c, l, count(*) AS n_rows, count(*) FILTER (miss) AS n_missing, count(*) FILTER (bad) AS n_malformed, count(DISTINCT k) AS n_distinct, min(x) AS least, max(x) AS greatest, median(x) AS median FROM g GROUP BY ALL),
h AS (SELECT t, c, l, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
h2 AS (SELECT *, n / sum(n) OVER (PARTITION BY t, c, l) AS p, sum(n) OVER (PARTITION BY t, c, b) / sum(n) OVER (PARTITION BY t, c) AS q FROM h),
every AS (SELECT t, c, sum((q - 1e-4) * ln(q / 1e-4)) AS a FROM (SELECT DISTINCT t, c, b, q FROM h2) GROUP BY 1, 2),
own AS (SELECT t, c, l, sum((p - q) * ln(p / q)) AS i, sum((q - 1e-4) * ln(q / 1e-4)) AS z FROM h2 GROUP BY 1, 2, 3)"""

def _stuck_sql(f: str) -> str:
    """Runs of the first copies' values, and runs of any copies' values over successive dates."""
    return f"""v_{f} AS (SELECT s, k, arg_min({f}, bar_id) FILTER ({f} IS NOT NULL) AS x FROM n GROUP BY 1, 2),
e_{f} AS (SELECT *, coalesce(x = lag(x) OVER (PARTITION BY s ORDER BY k), false) AS eq FROM v_{f}),
g_{f} AS (SELECT *, sum((NOT eq)::INT) OVER (PARTITION BY s ORDER BY k) AS g FROM e_{f}),
r_{f} AS (SELECT s, k, x, eq AND count(*) OVER (PARTITION BY s, g) >= 6 AS stuck FROM g_{f}),
c_{f} AS (SELECT *, k - row_number() OVER (PARTITION BY s, v ORDER BY k) AS i FROM (SELECT DISTINCT s, k, {f} AS v FROM n WHERE {f} IS NOT NULL)),
m_{f} AS (SELECT s, k, v, count(*) OVER (PARTITION BY s, v, i) >= 6 AND k > min(k) OVER (PARTITION BY s, v, i) AS stuck FROM c_{f})"""


_BOUNDS = (
    "WITH b AS (SELECT bar_id, regexp_extract(code, '(\\d{6})', 1) AS s, date, " + ", ".join(f"CASE WHEN isnan({f}) THEN NULL ELSE {f} END AS {f}" for f in PRICES)
    + " FROM daily_hfq WHERE tradestatus = 1 AND date IS NOT NULL), n AS (SELECT *, dense_rank() OVER (PARTITION BY s ORDER BY date) AS k FROM b), " + ", ".join(map(_stuck_sql, PRICES))
    + " SELECT bar_id, coalesce(close <= 0 OR close > high OR close < low, false) AS close_range, coalesce(high <= 0 OR high < low, false) AS high_range, coalesce(low <= 0 OR high < low, false) AS low_range, "
    + ", ".join(f"coalesce(r_{f}.stuck AND abs({f} - r_{f}.x) <= 1e-3 * abs(r_{f}.x), false) OR coalesce(m_{f}.stuck, false) AS {f}_stuck" for f in PRICES)
    + " FROM n " + " ".join(f"LEFT JOIN r_{f} ON n.s = r_{f}.s AND n.k = r_{f}.k LEFT JOIN m_{f} ON n.s = m_{f}.s AND n.k = m_{f}.k AND n.{f} = m_{f}.v" for f in PRICES)
)


def _named_sql(f: str) -> str:
    wide = "translate({c}, '０１２３４５６７８９．，％：＝；－＋￥　～萬億', '0123456789.,%:=;-+¥ ~万亿')"
    plain = lambda c: f"trim(regexp_replace(lower({wide.format(c=c)}), '\\s+', ' ', 'g'))"
    digits = "regexp_replace(regexp_replace({c}, '(\\d),(\\d)', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1\\2', 'g')"
    words = "|".join(re.escape(w) for w, _ in units.WORDS[f])
    factor = lambda c: "CASE regexp_extract(" + c + f", '({words})', 1) " + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in units.WORDS[f]) + " END"
    note = f"trim(regexp_extract({plain('unit_note')}, '{units.NOTE_KEYS[f]}(?:单位)?[ :=]*([^;/|,，]+)', 1))"
    sign = "CASE WHEN contains(t, '¥') THEN 1.0::DOUBLE END" if f == "amount" else "NULL"
    return f"""SELECT rec_id, '{f}' AS field, TRY_CAST(regexp_extract(t, '([-+]?\\d+(?:\\.\\d+)?(?:e[-+]?\\d+)?)', 1) AS DOUBLE) AS number,
coalesce({factor("trim(regexp_extract(t, '\\d(?:\\.\\d+)?(?:e[-+]?\\d+)?\\s*([^\\d.]*)$', 1))")}, {factor(note)}, {sign}) AS factor FROM (SELECT *, {digits.format(c=plain(f + "_text"))} AS t FROM vendor_quotes)"""


SQL = {
    "p2_bounds": _BOUNDS,
    "p5_named_quotes": "SELECT * FROM (" + " UNION ALL ".join(map(_named_sql, units.FIELDS)) + ") WHERE number IS NOT NULL AND factor IS NOT NULL",
    "p4_profile": f"WITH {_PROFILE} SELECT s.t AS table_name, s.c AS column_name, CAST(s.l AS BIGINT) AS load_id, n_rows, n_missing, n_malformed, n_distinct, round(least, 6) AS least, round(greatest, 6) AS greatest, round(median, 6) AS median, round(i + a - z, 6) AS psi FROM s LEFT JOIN own USING (t, c, l) LEFT JOIN every USING (t, c)",
    "p3_found": f"WITH {_REPORTS} SELECT fin_id, bar_id FROM ranked WHERE rn = 1",
    "p3_bars_with_report": f"WITH {_REPORTS} SELECT bar_id, fin_id, code AS symbol, strftime(date, '%Y-%m-%d') AS day, strftime(q, '%Y-%m-%d') AS quarter FROM ranked WHERE rn = 1",
    "p4_found": f"WITH {_LOADS} SELECT table_name, column_name, CAST(load_id AS BIGINT) AS load_id FROM w WHERE m > mm + 0.10 OR b > mb + 0.10 OR coalesce(med > mmed * 3 OR med < mmed / 3, false)",
    "p6_found": f"WITH {_DAYS} SELECT stock_code, strftime(day, '%Y-%m-%d') AS day FROM rolled WHERE t7 = 0 AND t30 > 0",
    "p6_rolling": f"WITH {_DAYS} SELECT stock_code, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS total_1d, CAST(t7 AS BIGINT) AS total_7d, round(t7 / 7.0, 6) AS avg_7d, CAST(t30 AS BIGINT) AS total_30d, round(t30 / 30.0, 6) AS avg_30d FROM rolled",
}

SQL["p4_loads"] = f"""SELECT p.table_name, p.column_name, p.load_id, p.psi, f.load_id IS NOT NULL AS deviates FROM ({SQL["p4_profile"]}) p
LEFT JOIN ({SQL["p4_found"]}) f ON p.table_name = f.table_name AND p.column_name = f.column_name AND p.load_id = f.load_id
WHERE (p.table_name, p.column_name) IN (('daily_hfq', 'close'), ('financials_yjbb', 'eps'), ('news', 'publish_time'))"""
