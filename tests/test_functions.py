import datetime as dt

from pyspark.sql import functions as F

from brassvane.functions import codes, numbers, text, times


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_six_digit(spark):
    got = col(spark, ["sh.600519", "600519.SH", " SH600519", "4108", "004108 ", "", None, "market", "1234567"], codes.six_digit)
    assert got == ["600519", "600519", "600519", "004108", "004108", None, None, None, None]


def test_other_codes(spark):
    assert col(spark, ["600519", "000001", " SH.600519 ", "510300", None], codes.market_code) == ["sh.600519", "sz.000001", "sh.600519", "sh.510300", None]
    assert col(spark, ["600519", "300001", None], codes.exchange) == ["sh", "sz", None]
    assert col(spark, ["700.HK", "00005", "x"], codes.hk_code) == ["00700", "00005", None]
    assert col(spark, ["600519,000001, 600519", "market", None], codes.all_codes) == [["600519", "000001"], [], []]


def test_day_of(spark):
    cases = {
        "2024-02-29 23:59:59": "2024-02-29", "2024-02-30 00:00:00": None, "2024-01-01": "2024-01-01", "2024-01-01T16:00:00Z": "2024-01-02", "2024-01-01T15:59:59Z": "2024-01-01",
        "2024/01/05 09:30": "2024-01-05", "2024年01月05日 09:30": "2024-01-05", "20240105093000": "2024-01-05", " 2024-01-05 09:30:00\t": "2024-01-05", "2024-01-05 25:00:00": None,
        "1704067200000": "2024-01-01", "1704124800000": "2024-01-02", "": None, "刚刚": None, "0000-00-00 00:00:00": None, None: None, "20240105": "2024-01-05", "2024-13-01": None,
    }
    assert col(spark, list(cases), lambda c: times.day_of(c).cast("string")) == list(cases.values())


def test_standard_time_and_quarter(spark):
    assert col(spark, ["2024-01-01 00:00:00", "2024-01-01 24:00:00", "2023-02-29 10:00:00", "2024-01-01T00:00:00", "2024-01-01 00:00:00 ", None], times.is_standard_time) == [True, False, False, False, False, None]
    got = col(spark, ["20240331", "2024-06-30", "2024/9/30", "2024Q4", "2024Q5", "x", None], times.quarter_end)
    assert got == [dt.date(2024, 3, 31), dt.date(2024, 6, 30), dt.date(2024, 9, 30), dt.date(2024, 12, 31), None, None, None]


def test_numbers(spark):
    assert col(spark, [1.0, float("nan"), float("inf"), None], numbers.finite, "double") == [1.0, None, None, None]
    assert col(spark, ["1.5", "x", None], lambda c: numbers.to_number(c, 0.0)) == [1.5, 0.0, 0.0]
    assert col(spark, ["Long", "hold", None], lambda c: numbers.choice(c, ["long", "short"], "watch")) == ["long", "watch", "watch"]
    assert col(spark, [1234567.891, None, float("nan")], numbers.fmt_number, "double") == ["1,234,567.89", "—", "—"]
    assert col(spark, [0.0, 2.0], lambda c: numbers.pct_change(F.lit(3.0), c), "double") == [None, 50.0]
    assert col(spark, [-5.0, 5.0, 50.0], lambda c: numbers.clamp(c, 0.0, 20.0), "double") == [0.0, 5.0, 20.0]


def test_text(spark):
    assert col(spark, ["<b>甲</b>　乙\r\n 丙", None], text.clean) == ["甲 乙 丙", None]
    assert col(spark, ["a&nbsp;&amp;b"], text.clean_entities) == ["a &b"]
    assert col(spark, ["abcdef", "abc"], lambda c: text.snippet(c, 3)) == ["abc…", "abc"]
    assert col(spark, ["涨停AB，c 大", "", None, "单"], text.bigram_tokens) == [["涨停", "停大", "ab"], [], [], []]
    assert col(spark, ["见[证据 2]和[证据1][证据 2]"], text.citations) == [[2, 1]]
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', '结果：{"a": 1,} 完', "{“a”：1}", "nothing", None]
    assert [r and r["a"] for r in col(spark, cases, lambda c: text.loose_json(c, "a int"))] == [1, 1, 1, 1, None, None]
    ids = spark.createDataFrame([("u", "t", "c", "d"), ("", "t", "c", "d"), (None, "t", None, "d")], "u string, t string, c string, d string")
    got = [r[0] for r in ids.select(text.stable_id(F.col("u"), F.col("t"), F.col("c"), F.col("d"))).collect()]
    assert all(g.startswith("news_") and len(g) == 21 for g in got) and len(set(got)) == 3
