import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brassvane.operators import bars as B

SCHEMA = "bar_id bigint, code string, date date, open double, high double, low double, close double, preclose double, volume double, amount double, turn double, pct_chg double, hfq_factor double, extra string"


def ramp(n, start=100.0, step=1.0, code="sh.600000", first=0):
    d0 = dt.date(2026, 1, 1)
    return [(first + i, code, d0 + dt.timedelta(days=i), start + i * step, start + i * step + 2, start + i * step - 2, start + i * step, None, 1e6 + 1000 * i, 1.0, 1.0, None, 1.0, "x") for i in range(n)]


def clean(spark, rows):
    return B.clean_bars(spark.createDataFrame(rows, SCHEMA))


def test_ramp(spark):
    s = B.snapshot(clean(spark, ramp(80))).collect()[0]
    assert (s["sma5"], s["rsi"], s["close"], s["n_bars"]) == (177.0, 100.0, 179.0, 80)
    assert s["ret_5d"] == pytest.approx((179 / 174 - 1) * 100)
    flat = B.snapshot(clean(spark, ramp(40, step=0.0))).collect()[0]
    assert flat["atr"] == pytest.approx(4.0) and flat["rsi"] == 100.0 and flat["sma60"] is None and flat["volume_ratio"] == pytest.approx(1037 / 1019.5) and flat["n_bars"] == 40 and flat["atr_pct"] == pytest.approx(4.0)
    assert s["atr_pct"] == pytest.approx(s["atr"] / 179 * 100) and s["ret_60d"] == pytest.approx((179 / 119 - 1) * 100)
    assert B.snapshot(clean(spark, [])).count() == 0
    assert B.smoothed_indicators(clean(spark, ramp(1))).collect()[0]["rsi"] is None


def test_folds_against_pandas(spark):
    rng = random.Random(3)
    rows = [(i, "000001", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, 0.0, 0.0, 0.0, None, 1.0, 1.0, 1.0, None, 1.0, "") for i in range(120)]
    p, out = 50.0, []
    for r in rows:
        p *= 1 + rng.gauss(0, 0.02)
        out.append(r[:4] + (p * 1.01, p * 0.99, p) + r[7:])
    got = B.smoothed_indicators(clean(spark, out)).collect()[0]
    c, h, lo = (pd.Series([r[k] for r in out]) for k in (6, 4, 5))
    d = c.diff().dropna()
    u, v = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean().iloc[-1], (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean().iloc[-1]
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    assert got["ema"] == pytest.approx(c.ewm(span=12, adjust=False).mean().iloc[-1])
    assert got["rsi"] == pytest.approx(100 - 100 / (1 + u / v)) and got["atr"] == pytest.approx(tr.ewm(alpha=1 / 14, adjust=False).mean().iloc[-1])
    vol = B.rolling_indicators(clean(spark, out)).orderBy(F.col("date").desc()).first()["volatility"]
    assert vol == pytest.approx(c.pct_change().tail(20).std() * math.sqrt(244))


def test_cleaning_range_and_rules(spark):
    rows = ramp(5) + [(90, "SH600000", dt.date(2026, 1, 1), 9.0, 9.0, 9.0, 9.0, None, 1.0, 1.0, 1.0, None, 1.0, "copy"), (91, None, dt.date(2026, 1, 1), *[1.0] * 4, None, *[1.0] * 3, None, 1.0, ""), (92, "600000", None, *[1.0] * 4, None, *[1.0] * 3, None, 1.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    b = B.clean_bars(df)
    assert b.count() == 5 and b.where("extra = 'copy'").count() == 0
    assert [r["bar_id"] for r in B.bar_range(df, "600000.SH", "2026-01-02", "2026-01-03", ["bar_id"]).collect()] == [1, 2]
    with pytest.raises(ValueError):
        B.bar_range(df, "600000", fields=["nope"])
    bad = ramp(3, code="000002", first=100)
    bad[1] = bad[1][:4] + (1.0, 5.0, None) + bad[1][7:8] + (-1.0,) + bad[1][9:]
    v = {r["rule"]: r["n"] for r in B.violations(clean(spark, bad)).collect()}
    assert v == {"price_missing": 1, "volume_negative": 1, "high_below_low": 1}
    assert B.violations(clean(spark, [])).count() == 0


def test_gaps_outliers_coverage_keep_first(spark):
    rows = ramp(30)
    rows = rows[:10] + [r[:2] + (r[2] + dt.timedelta(days=20),) + r[3:] for r in rows[10:]]
    assert [(r["gap_days"]) for r in B.gaps(clean(spark, rows)).collect()] == [21]
    jump = ramp(40, step=0.1)
    jump[35] = jump[35][:6] + (150.0,) + jump[35][7:]
    assert [r["date"] for r in B.return_outliers(clean(spark, jump), 3.0).collect()] == [jump[35][2]]
    week = B.coverage(clean(spark, ramp(10))).collect()[0]  # 2026-01-01 is a Thursday
    assert (week["n_days"], week["n_business_days"]) == (10, 7)
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (3, None, "z"), (4, None, "w")], "o int, k string, v string")
    assert sorted((r["k"] or "", r["v"]) for r in B.keep_first(df, ["k"], "o").collect()) == [("", "z"), ("a", "y")]


def test_validator(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [("a", day(0), 1.0, 2.0, 0.5, 1.0, 10.0, 1.0, 1), ("a", day(1), 0.0, 2.0, 0.5, 1.0, -1.0, 101.0, 2), ("a", day(30), None, None, None, None, None, None, 1), ("a", day(31), 1.0, 1.0, 2.0, 1.0, None, -1.0, 1), ("b", day(0), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1)]
    b = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, turn double, copies int")
    got = {r["rule"]: (r["severity"], r["n"], r["nth"]) for r in B.validate(b).collect() if r["symbol"] == "a"}
    assert set(got) == {"row_empty", "price_not_positive", "price_missing", "volume_negative", "volume_missing", "high_below_low", "turn_negative", "turn_above_100", "date_repeated", "gap"}
    assert got["volume_missing"] == ("error", 2, 8) and got["turn_above_100"] == ("warning", 1, 10) and got["gap"][1] == 1
    assert B.validate(b).where("symbol = 'b'").count() == 0 and B.validate(b.limit(0)).count() == 0


def test_gates_pages_and_lots(spark):
    b = spark.createDataFrame([(1, "x", 5.0, 1), (2, "x", None, None), (3, "y", 1.0, 0), (4, None, 9.0, 0)], "i int, g string, amount double, is_st int")
    assert sorted(r["i"] for r in B.liquid(b, "g", "amount", 4.0).collect()) == [1, 2]
    assert sorted(r["i"] for r in B.without_special_treatment(b).collect()) == [2, 3, 4]
    p = spark.createDataFrame([("a", 1, 2, "late"), ("a", 1, 1, "early"), (None, 1, 3, "n")], "s string, d int, page int, v string")
    assert sorted(r["v"] for r in B.merge_pages(p, ["s", "d"], "page", "v").collect()) == ["early", "n"]
    c = spark.createDataFrame([("00700.HK",), ("9988",), (None,)], "code string")
    assert [r["lot"] for r in B.with_lots(c, {"00700": 500}).collect()] == [500, 100, 100] and B.with_lots(c, {}).first()["lot"] == 100


def test_assembled(spark):
    day = lambda i: dt.date(2020, 1, i)
    raw = spark.createDataFrame([("a", day(i), 10.0, 1000.0) for i in range(1, 8)] + [(None, day(1), 1.0, 1.0)], "symbol string, date date, close double, volume double")
    f = spark.createDataFrame([("a", day(2), 1.5), ("a", day(6), 2.0), ("a", day(6), None)], "symbol string, date date, factor double")
    sh = spark.createDataFrame([("a", day(3), 1.0)], "symbol string, date date, outstanding_share double")
    out = {(r["symbol"], r["date"].day): r for r in B.assembled(raw, f, sh).collect()}
    assert [out["a", i]["factor"] for i in range(1, 8)] == [1.0, 1.5, 1.5, 1.5, 1.5, 2.0, 2.0] and out["a", 6]["close_adjusted"] == 20.0
    assert out["a", 2]["turn"] is None and out["a", 3]["turn"] == 10.0 and out[None, 1]["factor"] == 1.0 and len(out) == 8


def test_tables_by_adjustment():
    assert B.table_of("hfq") == "daily_hfq"
    with pytest.raises(ValueError):
        B.table_of("daily; drop")
