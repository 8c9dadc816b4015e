"""Queries that run the column functions and the small operators over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, numbers, text
from ..operators import bars as B, datasets, lexicon, vectors
from ..session import table
from ..sources import files
from .market import _BARS, _D, _FIN, _sentiment_sql, clean, day, r7

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- codes, numbers, dates

@query("SELECT DISTINCT stock_code AS code, lpad(regexp_replace(stock_code, '[^0-9]', '', 'g'), 5, '0') AS hk FROM news WHERE regexp_matches(stock_code, '[0-9]')")
def hk_codes(spark, sf):
    return table(spark, sf, "news").where(F.col("stock_code").rlike("[0-9]")).select(F.col("stock_code").alias("code"), codes.hk_code(F.col("stock_code")).alias("hk")).distinct()


@query("SELECT code, split_part(code, '.', 1) AS market, split_part(code, '.', 2) AS symbol, CASE left(split_part(code, '.', 2), 2) WHEN '60' THEN '沪主板' WHEN '68' THEN '科创板' WHEN '00' THEN '深主板' WHEN '30' THEN '创业板' ELSE '其他' END AS board FROM stock_list")
def code_boards(spark, sf):
    s, c = table(spark, sf, "stock_list"), F.col("code")
    return s.select("code", F.split_part(c, F.lit("."), F.lit(1)).alias("market"), codes.six_digit(c).alias("symbol"), codes.board(c).alias("board"))


@query(f"WITH {_BARS} SELECT bar_id, " + ", ".join(f"round(CAST(CAST({c} * hfq_factor AS VARCHAR) AS DECIMAL(38, 20)), 2)::DOUBLE AS {c}" for c in ("open", "high", "low", "close", "preclose")) + " FROM b")
def adjusted_prices(spark, sf):
    """The five prices once more multiplied by the factor, to cents."""
    return clean(spark, sf).select("bar_id", *[numbers.adjusted(F.col(c), F.col("hfq_factor")).alias(c) for c in B.PRICES])


@query("""WITH t AS (SELECT rec_id, trim(turn_text) AS turn_text, TRY_CAST(trim(amount_text) AS DOUBLE) AS amount, coalesce(TRY_CAST(trim(turn_text) AS DOUBLE), 0) AS turn,
  CAST(coalesce(try_strptime(left(date, 10), '%Y-%m-%d'), try_strptime(left(date, 8), '%Y%m%d'), try_strptime(left(date, 10), '%Y/%m/%d')) AS DATE) AS d FROM vendor_quotes)
SELECT rec_id, strftime(d, '%Y-%m-%d') AS day, 'sh.000001' AS code, round(amount, 7) AS amount, round(turn, 7) AS turn, 1 AS tradestatus, 0 AS is_st FROM t WHERE d IS NOT NULL""")
def vendor_frame(spark, sf):
    """A vendor's frame under common names: texts to numbers, unreadable ones null or 0, rows without a date left out, constant columns added."""
    q = table(spark, sf, "vendor_quotes").select("rec_id", "date", F.trim("amount_text").alias("成交额"), F.trim("turn_text").alias("换手率"))
    out = files.standardise(q, "sh.000001", {"成交额": "amount", "换手率": "turn", "涨跌幅": "pct_chg"}, extra={"tradestatus": F.lit(1), "is_st": F.lit(0)})
    return out.select("rec_id", day(), "code", r7(numbers.to_number(F.col("amount"))).alias("amount"), r7(numbers.to_number(F.col("turn"), 0.0)).alias("turn"), "tradestatus", "is_st")


@query("SELECT golden_id, CASE WHEN lower(trim(human_label)) IN ('positive', 'negative') THEN lower(trim(human_label)) ELSE 'neutral' END AS label, greatest(2.0, least(6.0, length(title) / 10.0)) AS size FROM golden_set_200")
def clamped_labels(spark, sf):
    """Values outside the allowed ones fall back, numbers are held within bounds."""
    return table(spark, sf, "golden_set_200").select("golden_id", numbers.choice(F.col("human_label"), ["positive", "negative"], "neutral").alias("label"), numbers.clamp(F.length("title") / 10.0, 2.0, 6.0).alias("size"))


@query("SELECT fin_id, strftime(pub_date, '%Y-%m-%d') AS pub_date, left(report_date, 10) AS report_date, " + ", ".join(f"round(CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END, 4) AS {c}" for c in ("eps", "roe", "bps", "gross_margin")) + " FROM financials_yjbb")
def report_fields(spark, sf):
    """The fields of a report that are passed on: dates cut to the day, numbers to four digits, NaN left out."""
    f = table(spark, sf, "financials_yjbb")
    return f.select("fin_id", F.date_format("pub_date", "yyyy-MM-dd").alias("pub_date"), F.substring("report_date", 1, 10).alias("report_date"), *[F.round(numbers.finite(F.col(c)), 4).alias(c) for c in ("eps", "roe", "bps", "gross_margin")])


@query(f"WITH {_BARS} SELECT bar_id, coalesce(format('{{:,.2f}}', close), '—') AS close_text FROM b")
def number_texts(spark, sf):
    return clean(spark, sf).select("bar_id", numbers.fmt_number(F.col("close")).alias("close_text"))


@query("SELECT calendar_date AS day, strftime(CAST(calendar_date AS DATE) - 96, '%Y-%m-%d') AS look_back, strftime(CAST(calendar_date AS DATE) - 1, '%Y-%m-%d') AS day_before FROM trade_calendar WHERE is_trading_day = '1'")
def look_back_days(spark, sf):
    """From where 60 bars before a day are read, and the last day of the page before it."""
    d = F.to_date("calendar_date")
    return table(spark, sf, "trade_calendar").where("is_trading_day = '1'").select(F.col("calendar_date").alias("day"), F.date_format(B.look_back(d, 60), "yyyy-MM-dd").alias("look_back"), F.date_format(F.date_sub(d, 1), "yyyy-MM-dd").alias("day_before"))


# --- texts

@query("""WITH t AS (SELECT news_id, trim(regexp_replace(translate(regexp_replace(text, '<[^>]+>', '', 'g'), '　' || chr(13) || chr(10), '   '), '\\s+', ' ', 'g')) AS t FROM news WHERE text IS NOT NULL),
e AS (SELECT news_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM t)
SELECT news_id, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS body FROM e""")
def news_entities(spark, sf):
    return table(spark, sf, "news").where("text is not null").select("news_id", text.clean_entities(F.col("text"), 40).alias("body"))


@query("SELECT news_id, left(title, 200) AS title, left(text, 2000) AS text, left(publish_time, 19) AS publish_time FROM news WHERE length(text) >= 20")
def news_trimmed(spark, sf):
    """Title, text and time cut to what is stored; texts of fewer than 20 characters are left out."""
    return table(spark, sf, "news").where(F.length("text") >= 20).select("news_id", *[F.substring(c, 1, n).alias(c) for c, n in (("title", 200), ("text", 2000), ("publish_time", 19))])


_TOKENS = """t AS (SELECT coalesce(title, '') AS s FROM news),
h AS (SELECT regexp_extract_all(s, '[\\x{4e00}-\\x{9fff}]') AS h, regexp_extract_all(s, '[a-zA-Z0-9]{2,}') AS w FROM t),
tok AS (SELECT unnest(list_concat(list_transform(range(1, len(h)), lambda i: h[i] || h[i + 1]), list_transform(w, lambda x: lower(x)))) AS token FROM h)"""


@query(f"WITH {_TOKENS} SELECT token, count(*) AS n FROM tok GROUP BY 1 HAVING count(*) >= 3")
def title_tokens(spark, sf):
    """How often each bigram or word stands in titles, from three times on."""
    t = table(spark, sf, "news").select(F.explode(text.bigram_tokens(F.col("title"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


_CITING = "'见[证据 ' || (golden_id % 7)::VARCHAR || ']与[证据' || (golden_id % 3)::VARCHAR || ']'"


@query(f"WITH c AS (SELECT golden_id, list_distinct(list_transform(regexp_extract_all({_CITING}, '\\[证据\\s*(\\d+)\\]', 1), lambda x: x::INT)) AS c FROM golden_set_200) SELECT golden_id, len(c) AS n_cited, len(list_filter(c, lambda x: x > 3)) AS n_unknown FROM c")
def cited_evidence(spark, sf):
    """Numbers cited in a text, and how many of them aren't among the evidence (0 to 3)."""
    part = lambda n: (F.col("golden_id") % n).cast("string")
    line = F.concat(F.lit("见[证据 "), part(7), F.lit("]与[证据"), part(3), F.lit("]"))
    c = text.citations(line)
    return table(spark, sf, "golden_set_200").select("golden_id", F.size(c).cast("bigint").alias("n_cited"), F.size(text.uncited(c, F.array(*[F.lit(i) for i in range(4)]))).cast("bigint").alias("n_unknown"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS fenced, (props::JSON ->> '$.k')::BIGINT AS comma, (props::JSON ->> '$.k')::BIGINT AS quotes, (props::JSON ->> '$.k')::BIGINT AS truncated, NULL::BIGINT AS none FROM events")
def loose_objects(spark, sf):
    """JSON found in fences and prose, with a comma too many, Chinese quotes, or without its end."""
    p, schema = F.col("props"), "k bigint"
    forms = {
        "fenced": F.concat(F.lit("回答：\n```json\n"), p, F.lit("\n```")), "comma": F.concat(F.lit("ok "), F.regexp_replace(p, r"\}$", ",}")), "quotes": F.translate(p, '"', "“"),
        "truncated": F.concat(F.regexp_replace(p, r"\}$", ""), F.lit(', "note": "cut o')), "none": F.lit("no object"),
    }
    return table(spark, sf, "events").select("event_id", *[text.loose_json(f, schema)["k"].alias(n) for n, f in forms.items()])


@query("SELECT event_id, props AS body, CASE WHEN event_type = 'click' THEN 'negative' WHEN event_type = 'error' THEN 'neutral' ELSE 'positive' END AS label FROM events")
def unwrapped_replies(spark, sf):
    """The JSON inside a callback, and the first known label of a reply."""
    said = F.when(F.col("event_type") == "click", "It is Negative, I think").when(F.col("event_type") == "error", "unclear").otherwise("negative? no: POSITIVE")
    return table(spark, sf, "events").select("event_id", text.jsonp(F.concat(F.lit("cb_1("), F.col("props"), F.lit(");"))).alias("body"), text.parse_label(said, ["positive", "negative", "neutral"]).alias("label"))


@query("""WITH k AS (SELECT human_label, golden_id, title, left(publish_time, 10) AS d, row_number() OVER (PARTITION BY human_label ORDER BY golden_id) AS k FROM golden_set_200)
SELECT human_label, string_agg(k || '. [' || coalesce(d, '') || '] ' || coalesce(title, ''), chr(10) ORDER BY k) AS lines FROM k WHERE k <= 3 GROUP BY 1""")
def reference_lines(spark, sf):
    """Numbered, dated lines of the first three titles of each label."""
    g = B.latest(table(spark, sf, "golden_set_200"), ["human_label"], [F.col("golden_id")], 3)
    rows = g.groupBy("human_label").agg(F.array_sort(F.collect_list(F.struct("golden_id", F.coalesce("title", F.lit("")).alias("t"), F.coalesce(F.substring("publish_time", 1, 10), F.lit("")).alias("d")))).alias("r"))
    return rows.select("human_label", text.references(F.col("r.t"), F.col("r.d")).alias("lines"))


@query("SELECT news_id, sha256('[' || CASE WHEN stock_code IS NULL THEN 'null' ELSE to_json(stock_code)::VARCHAR END || ',' || to_json(news_id::VARCHAR)::VARCHAR || ']') AS key FROM news WHERE stock_code IS NULL OR NOT contains(stock_code, '/')")
def request_keys(spark, sf):
    """Cache keys of requests: a null differs from an empty text."""
    n = table(spark, sf, "news").where(F.col("stock_code").isNull() | ~F.contains("stock_code", F.lit("/")))
    return n.select("news_id", text.request_key(F.col("stock_code"), F.col("news_id")).alias("key"))


@query("SELECT max(length(text)) AS longest, count(*) FILTER (length(text) > 300) AS n_truncated, count(*) AS n, sum(greatest(coalesce(length(text), 0) - 300, 0))::BIGINT AS n_lost FROM documents")
def length_tail(spark, sf):
    """The longest text, and what a limit of 300 characters would cut off."""
    n = F.length("text")
    return table(spark, sf, "documents").agg(F.max(n).alias("longest"), F.count_if(n > 300).alias("n_truncated"), F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.coalesce(n, F.lit(0)) - 300, F.lit(0))).alias("n_lost"))


# --- joins and sets

@query("WITH old AS (SELECT DISTINCT url FROM news WHERE load_id = (SELECT min(load_id) FROM news)) SELECT url, min(news_id) AS news_id FROM news n WHERE url IS NOT NULL AND load_id > (SELECT min(load_id) FROM news) AND NOT EXISTS (SELECT 1 FROM old WHERE old.url = n.url) GROUP BY 1")
def news_new_urls(spark, sf):
    """Articles of later runs whose url the first run doesn't hold, one a url: what an index would be extended by."""
    n = table(spark, sf, "news").select("news_id", "url", "load_id")
    first = n.agg(F.min("load_id").alias("_f"))
    n = n.join(F.broadcast(first))  # one row
    held = n.where("load_id = _f")
    return vectors.new_rows(B.keep_first(n.where("load_id > _f and url is not null").select("url", "news_id", F.col("news_id").alias("_o")), ["url"], "_o").select("url", "news_id"), held, "url")


@query("SELECT code FROM stock_list s WHERE NOT EXISTS (SELECT 1 FROM share_capital c WHERE c.code = s.code)")
def remaining_codes(spark, sf):
    """Stocks that a run over share_capital has still to fetch."""
    return files.remaining(table(spark, sf, "stock_list").select("code"), table(spark, sf, "share_capital"), "code")


@query("SELECT symbol, strftime(date, '%Y-%m-%d') AS day, bar_id FROM (SELECT regexp_extract(code, '(\\d{6})', 1) AS symbol, date, bar_id, row_number() OVER (PARTITION BY regexp_extract(code, '(\\d{6})', 1), date ORDER BY load_id, bar_id) AS k FROM daily_hfq) WHERE k = 1")
def merged_pages(spark, sf):
    """Bars of all runs as pages of one history: the first run that has a date wins."""
    b = table(spark, sf, "daily_hfq").select(codes.six_digit(F.col("code")).alias("symbol"), "date", "bar_id", "load_id")
    return B.merge_pages(b, ["symbol", "date"], "load_id", "bar_id").select("symbol", day(), "bar_id")


@query("WITH l AS (SELECT title, arg_max(human_label, golden_id) AS label FROM golden_set_200 WHERE title IS NOT NULL GROUP BY 1) SELECT n.news_id, l.label FROM news n LEFT JOIN l ON n.title = l.title")
def news_labels(spark, sf):
    """Each article with the last label its title was given, if any."""
    last = table(spark, sf, "golden_set_200").where("title is not null").groupBy(F.col("title").alias("_t")).agg(F.max_by("human_label", "golden_id").alias("label"))
    n = table(spark, sf, "news").select("news_id", "title")
    return n.join(last, F.col("title") == F.col("_t"), "left").select("news_id", "label")


@query(f"WITH {_FIN}, f AS (SELECT symbol, arg_max(name, {{'p': pub_date, 'n': -fin_id}}) AS name FROM fin WHERE name IS NOT NULL AND pub_date IS NOT NULL GROUP BY 1), b AS (SELECT DISTINCT regexp_extract(code, '(\\d{{6}})', 1) AS symbol FROM daily_hfq) SELECT b.symbol, coalesce(f.name, s.name, '') AS name FROM b LEFT JOIN f USING (symbol) LEFT JOIN (SELECT symbol, min(name) AS name FROM stock_list GROUP BY 1) s ON s.symbol = b.symbol")
def names_by_precedence(spark, sf):
    """A stock's name from its latest report, else from the list, else empty."""
    f = table(spark, sf, "financials_yjbb").where("name is not null and pub_date is not null").withColumn("symbol", codes.six_digit(F.col("code")))
    f = f.groupBy("symbol").agg(F.max_by("name", F.struct("pub_date", -F.col("fin_id"))).alias("_first"))
    s = table(spark, sf, "stock_list").groupBy("symbol").agg(F.min("name").alias("_then"))
    b = table(spark, sf, "daily_hfq").select(codes.six_digit(F.col("code")).alias("symbol")).distinct()
    return b.join(f, "symbol", "left").join(s, "symbol", "left").select("symbol", F.coalesce("_first", "_then", F.lit("")).alias("name"))


@query("SELECT code, y::INT AS year, q::INT AS quarter FROM stock_list, (SELECT unnest(range(2023, 2026)) AS y), (SELECT unnest([1, 2, 3, 4]) AS q) WHERE in_now")
def statement_requests(spark, sf):
    """The requests of a statement fetcher: stock x year x quarter, exploded from the stocks."""
    s = table(spark, sf, "stock_list").where("in_now")
    return s.select("code", F.explode(F.sequence(F.lit(2023), F.lit(2025))).alias("year")).select("code", "year", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("quarter"))


# --- aggregates

@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)
SELECT event_type, count(*) AS n, round(coalesce(count(*) FILTER (value >= 10) / count(*), 0), 4) AS high_rate, round(coalesce(count(*) FILTER (value >= 20) / count(*), 0), 4) - round(coalesce(count(*) FILTER (value >= 10) / count(*), 0), 4) AS gain,
  round(coalesce(avg(value), 0), 2) AS mean, round(coalesce(avg(value) FILTER (k > 1), 0), 2) AS mean_steady FROM e GROUP BY 1""")
def batch_stats(spark, sf):
    """Rates, their difference, the mean, and the mean without each group's first row."""
    first = F.min(F.struct("ts", "event_id"))
    e = table(spark, sf, "events")
    f = e.groupBy(F.col("event_type").alias("_e")).agg(first["event_id"].alias("_first"))
    n, high, top = F.count(F.lit(1)), F.count_if(F.col("value") >= 10), F.count_if(F.col("value") >= 20)
    steady = F.when(F.col("event_id") != F.col("_first"), F.col("value"))
    out = e.join(f, F.col("event_type") == F.col("_e")).groupBy("event_type").agg(n.alias("n"), datasets.rate(high, n).alias("high_rate"), datasets.rate(top, n).alias("_top"), datasets.mean(F.col("value")).alias("mean"), datasets.mean(steady).alias("mean_steady"))
    return out.withColumn("gain", F.col("_top") - F.col("high_rate")).drop("_top")


@query("WITH g AS (SELECT source, avg(amount) AS m FROM (SELECT lower(trim(source)) AS source, CASE WHEN isnan(amount) THEN NULL ELSE amount END AS amount FROM daily_hfq) GROUP BY 1) SELECT bar_id FROM daily_hfq d JOIN g ON lower(trim(d.source)) = g.source WHERE m >= 1e8")
def liquid_bars(spark, sf):
    """Bars of the sources whose mean amount reaches 100 million."""
    b = table(spark, sf, "daily_hfq").select("bar_id", F.lower(F.trim("source")).alias("source"), numbers.finite(F.col("amount")).alias("amount"))
    return B.liquid(b, "source", "amount", 1e8).select("bar_id")


@query("SELECT bar_id FROM daily_hfq WHERE coalesce(is_st, 0) <> 1 AND tradestatus = 1 AND coalesce(turn, 0) >= 0.5 AND NOT isnan(coalesce(turn, 0))")
def universe_bars(spark, sf):
    """Bars of the tradable universe: no special treatment, traded, a turnover of at least half a percent as recorded."""
    b = B.without_special_treatment(table(spark, sf, "daily_hfq"))
    return b.where((F.col("tradestatus") == 1) & (F.coalesce(numbers.finite(F.col("turn")), F.lit(0.0)) >= 0.5)).select("bar_id")


@query("""WITH n AS (SELECT source, count(*) AS n, count(DISTINCT url) AS n_urls, max(publish_time) AS last_time FROM news WHERE source IS NOT NULL GROUP BY 1)
SELECT source, '{"n":' || n || ',"n_urls":' || n_urls || ',"last_time":"' || last_time || '"}' AS report FROM n""")
def news_quality_json(spark, sf):
    """The quality figures of each source as a JSON document."""
    n = table(spark, sf, "news").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"), F.max("publish_time").alias("last_time"))
    return n.select("source", F.to_json(F.struct("n", "n_urls", "last_time")).alias("report"))


@query(f"WITH z AS ({_sentiment_sql()}), p AS (SELECT news_id, CASE WHEN confidence >= 0.5 THEN label WHEN confidence < 0.1 THEN 'hard' ELSE 'middle' END AS pool FROM z) SELECT pool, count(*) AS n FROM p GROUP BY 1")
def confidence_pools(spark, sf):
    """Articles by how sure the lexicon is: its label, middle, or hard."""
    n = table(spark, sf, "news").select("news_id", lexicon.sentiment(F.col("title"), F.col("text")).alias("s")).select("news_id", "s.label", "s.confidence")
    return datasets.pools(n, "label", "confidence", 0.5, 0.1).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH z AS ({_sentiment_sql()}), ok AS (SELECT z.news_id, z.label, z.confidence FROM z JOIN news n USING (news_id) WHERE n.title IS NOT NULL AND z.confidence >= 0.3 AND NOT EXISTS (SELECT 1 FROM golden_set_200 g WHERE trim(g.title) = trim(n.title))),
q AS (SELECT label, count(*) AS c, greatest(30, floor(600 * count(*) / sum(count(*)) OVER ())) AS q FROM ok GROUP BY 1),
s AS (SELECT ok.news_id, ok.label, row_number() OVER (PARTITION BY ok.label ORDER BY md5(ok.news_id::VARCHAR || ':42'), ok.news_id) AS k, q FROM ok JOIN q ON ok.label = q.label),
kept AS (SELECT news_id, label FROM s WHERE k <= q)
SELECT news_id, label, CASE WHEN row_number() OVER (ORDER BY md5(news_id::VARCHAR || ':42'), news_id) <= greatest(50, floor((SELECT count(*) FROM kept) * 0.02)) THEN 'val' ELSE 'train' END AS split FROM kept""")
def sentiment_dataset(spark, sf):
    """The training set's driver: lexicon labels of some confidence, without evaluation titles, a stratified sample, split for validation."""
    n = table(spark, sf, "news").where("title is not null").select("news_id", F.trim("title").alias("_g"), lexicon.sentiment(F.col("title"), F.col("text")).alias("s"))
    n = n.select("news_id", "_g", "s.label", "s.confidence").where("confidence >= 0.3")
    n = n.join(table(spark, sf, "golden_set_200").select(F.trim("title").alias("_g")).distinct(), "_g", "left_anti").select("news_id", "label")
    return datasets.train_val(datasets.stratified_sample(n, "label", "news_id", 600), "news_id", least=50)


@query("SELECT golden_id, title FROM golden_set_200 ORDER BY md5(golden_id::VARCHAR || ':7'), golden_id LIMIT 25")
def sampled_titles(spark, sf):
    """Twenty-five evaluation rows drawn with a seed."""
    return datasets.seeded_sample(table(spark, sf, "golden_set_200").select("golden_id", "title"), "golden_id", 25, 7)


# --- bars

@query(f"WITH {_BARS} SELECT symbol, {_D}, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM b WHERE date <= DATE '2024-06-30') WHERE k <= 5")
def bars_until(spark, sf):
    """The last five bars up to 2024-06-30, oldest first."""
    return B.latest_ascending(clean(spark, sf), "2024-06-30", 5).select("symbol", day(), "close", "nth")


_VALID = " UNION ALL ".join(f"SELECT symbol, date, '{sev}' AS severity, '{r}' AS rule FROM v WHERE {e}" for r, (sev, e) in B.CHECKS.items())


@query(f"""WITH {_BARS}, c AS (SELECT regexp_extract(code, '(\\d{{6}})', 1) AS symbol, date, count(*) AS copies FROM daily_hfq GROUP BY 1, 2),
r AS (SELECT b.*, c.copies, date_diff('day', lag(b.date) OVER w, b.date) AS gap_days, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM b JOIN c ON b.symbol = c.symbol AND b.date = c.date WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date)),
v AS (SELECT *, abs(ret - avg(ret) OVER w) > 3 * stddev_samp(ret) OVER w AS jump FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), x AS ({_VALID}),
g AS (SELECT symbol, severity, rule, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_day FROM x GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, rule)::INT AS nth FROM g""")
def validator_issues(spark, sf):
    """All objections of the validator, errors first. Jumps from three deviations on: a window of 20 that holds the value itself can't reach five."""
    raw = table(spark, sf, "daily_hfq")
    copies = raw.groupBy(codes.six_digit(F.col("code")).alias("_s"), F.col("date").alias("_d")).agg(F.count(F.lit(1)).alias("copies"))
    b = clean(spark, sf).join(copies, (F.col("symbol") == F.col("_s")) & (F.col("date") == F.col("_d"))).drop("_s", "_d")
    return B.validate(b, 3.0).select("symbol", "severity", "rule", "n", F.date_format("first_date", "yyyy-MM-dd").alias("first_day"), "nth")


@query(f"WITH {_BARS} SELECT symbol, {_D}, round(CASE WHEN count(pct_chg) OVER (PARTITION BY symbol) > 0 THEN pct_chg ELSE (close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) * 100 END, 7) AS change FROM b")
def filled_changes(spark, sf):
    """Percent changes as recorded, or from the closes where a stock has none recorded."""
    return B.filled_change(clean(spark, sf)).select("symbol", day(), r7("change").alias("change"))


@query(f"WITH {_BARS} SELECT symbol, 'close: ' || format('{{:.2f}}', close) || coalesce(chr(10) || 'high: ' || format('{{:.2f}}', high), '') AS lines FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM b) WHERE k = 1 AND close IS NOT NULL")
def snapshot_texts(spark, sf):
    last = B.latest(clean(spark, sf), ["symbol"], [F.col("date").desc()], 1).where("close is not null")
    return last.select("symbol", text.snapshot_lines(["close", "high"]).alias("lines"))


_FACTORS = "f AS (SELECT symbol, date, hfq_factor AS factor FROM b WHERE day(date) <= 7 AND hfq_factor IS NOT NULL AND month(date) IN (1, 7)), cap AS (SELECT regexp_extract(code, '(\\d{6})', 1) AS symbol, date, outstanding_share FROM share_capital)"


@query(f"WITH {_BARS}, {_FACTORS}, x AS (SELECT b.*, coalesce(f.factor, 1.0) AS factor FROM b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.date >= f.date) SELECT x.symbol, strftime(x.date, '%Y-%m-%d') AS day, factor, round(x.volume / (cap.outstanding_share * 10000) * 100, 7) AS turn, round(CAST(CAST(x.close * factor AS VARCHAR) AS DECIMAL(38, 20)), 2)::DOUBLE AS close_adjusted FROM x ASOF LEFT JOIN cap ON x.symbol = cap.symbol AND x.date >= cap.date")
def assembled_bars(spark, sf):
    """Bars put together from prices, adjustment factors (those of early January and July) and outstanding shares."""
    b = clean(spark, sf)
    f = b.where((F.day("date") <= 7) & F.month("date").isin(1, 7)).select("symbol", "date", F.col("hfq_factor").alias("factor"))
    cap = table(spark, sf, "share_capital").select(codes.six_digit(F.col("code")).alias("symbol"), "date", "outstanding_share")
    out = B.assembled(b.select("symbol", "date", "close", "volume"), f, cap)
    return out.select("symbol", day(), "factor", r7("turn").alias("turn"), "close_adjusted")


# --- vectors

_ENCODED = "e AS (SELECT news_id, title, stock_code, publish_time, list_transform(range(64), lambda i: len(list_filter(c, lambda x: unicode(x) % 64 = i))::DOUBLE) AS v FROM (SELECT *, string_split(title, '') AS c FROM news WHERE regexp_matches(title, '[^\\s　]')))"
_BARE = "regexp_replace(coalesce({t}, ''), '^[\\s　]+|[\\s　]+$', '', 'g')"
_NEAREST = f"""{_ENCODED}, s AS (SELECT q.news_id AS query_id, e.news_id, round(list_cosine_similarity(q.v, e.v), 6) AS score, {_BARE.format(t='q.title')} AS qt, {_BARE.format(t='e.title')} AS et FROM e q, e WHERE q.news_id % 100 = 0 AND q.news_id <> e.news_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, news_id) AS rank FROM s)"""


@query(f"WITH {_NEAREST} SELECT query_id, rank::INT AS rank, news_id, score FROM t WHERE rank <= 5")
def text_search(spark, sf):
    """The five articles nearest to every title whose id is divisible by 100, by an encoder that needs no model."""
    n = table(spark, sf, "news").select("news_id", "title")
    return vectors.top_k(n, n.where(F.col("news_id") % 100 == 0), "news_id", "title", 5, encoder=vectors.hashed_characters)


@query(f"WITH {_NEAREST}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM t WHERE rank <= 5 AND qt <> et) SELECT query_id, r::INT AS rank, news_id, score FROM h WHERE r <= 3")
def retrieved_references(spark, sf):
    """Three references of five hits: those with the query's own title are left out."""
    n = table(spark, sf, "news").select("news_id", "title")
    return vectors.without_equal_titles(text_search(spark, sf), n, "news_id", "title", 3, asked=n.where(F.col("news_id") % 100 == 0))


@query(f"WITH {_NEAREST}, f AS (SELECT t.query_id, min(t.rank) FILTER (list_has_any(regexp_extract_all(q.stock_code, '\\d{{6}}'), regexp_extract_all(n.stock_code, '\\d{{6}}')) AND t.rank <= 5) AS r FROM t JOIN news q ON q.news_id = t.query_id JOIN news n ON n.news_id = t.news_id GROUP BY 1) SELECT coalesce(r, 0)::INT AS first_rank, count(*) AS n FROM f GROUP BY 1")
def first_rank_histogram(spark, sf):
    """How many queries find their first article with a shared code at which rank, 0 for not at all."""
    n = table(spark, sf, "news").select("news_id", codes.all_codes(F.col("stock_code")).alias("c"))
    h = text_search(spark, sf).join(n, "news_id").join(n.where(F.col("news_id") % 100 == 0).select(F.col("news_id").alias("query_id"), F.col("c").alias("qc")), "query_id")
    asked = table(spark, sf, "news").where(F.col("title").rlike(r"[^\s\u3000]") & (F.col("news_id") % 100 == 0)).select(F.col("news_id").alias("query_id"))
    f = datasets.first_relevant(h.withColumn("hit", F.arrays_overlap("c", "qc")), asked, "query_id", "rank", "hit")
    return f.groupBy(F.coalesce("first_rank", F.lit(0)).alias("first_rank")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys, count(*) FILTER (embedding IS NULL) AS n_missing, count(DISTINCT len(embedding)) AS n_lengths FROM embeddings")
def vector_index_check(spark, sf):
    return vectors.consistent(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("SELECT 'news' AS name, count(*) AS n_rows, 8 AS n_columns FROM news UNION ALL SELECT 'stock_list', count(*), 8 FROM stock_list UNION ALL SELECT 'no_such_table', -1, 0")
def catalogue_counts(spark, sf):
    """Rows and columns of registered tables, -1 rows for one that isn't there."""
    files.register_views(spark, sf)
    names = ["news", "stock_list", "no_such_table"]
    rows, cols = files.table_counts(spark, names), dict(files.catalogue(spark))
    return spark.createDataFrame([(n, rows[n], cols.get(n, 0)) for n in names], "name string, n_rows bigint, n_columns int")


@query("SELECT stock_code, count(*) AS n FROM news WHERE source = 'eastmoney' OR length(title) > 20 GROUP BY 1")
def views_by_sql(spark, sf):
    """SQL with parameters over the registered views."""
    files.register_views(spark, sf)
    return files.query(spark, "SELECT stock_code, count(*) AS n FROM news WHERE source = :source OR length(title) > :least GROUP BY stock_code", {"source": "eastmoney", "least": 20})
