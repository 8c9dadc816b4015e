import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brassvane.operators import anomalies, units

DAYS = [d for d in (dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(420)) if d.weekday() < 5]
SCHEMA = "bar_id bigint, symbol string, date date, open double, high double, low double, close double, preclose double, volume double, amount double, turn double, tradestatus int, source string, hfq_factor double, shares double"


def series(symbol, source, seed, first, scale=0.012):
    rng = random.Random(seed)
    price, rows = 20.0, []
    for i, d in enumerate(DAYS):
        pre = price
        op = pre * (1 + rng.gauss(0, 0.002))
        price = op * (1 + rng.gauss(0, scale))
        hi, lo = max(op, price) * (1 + abs(rng.gauss(0, 0.003))), min(op, price) * (1 - abs(rng.gauss(0, 0.003)))
        vol = round(1e9 * 0.01 * rng.lognormvariate(0, 0.5) / 100) * 100.0
        rows.append([first + i, symbol, d, op, hi, lo, price, pre, vol, vol * price / 2.0, vol / 1e9 * 100, 1, source, 2.0, 1e9])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def test_units_by_source_time_and_record(spark):
    a, b, c = series("000001", "tencent", 1, 1000), series("000002", "sina", 2, 2000), series("000003", "akshare", 3, 3000)
    for r in a:
        r[8] /= 100
        r[10] = r[10] / 100 if r[2] < dt.date(2023, 10, 1) else r[10]
    for k in (30, 60):
        b[k][8] /= 10000
    b[90][8] *= 37.7  # a fault, not a unit
    b[91][8], b[92][9], b[93][10] = None, float("nan"), 0.0
    for r in c:
        r[9] = r[9] / 1e4 if r[2] < dt.date(2023, 7, 1) else r[9]
    out = {r["bar_id"]: r for r in units.infer_units(frame(spark, a + b + c)).collect()}
    assert len(out) == 3 * len(DAYS)
    assert all(out[r[0]]["volume_unit"] == "lots" and out[r[0]]["turn_unit"] == ("fraction" if r[2] < dt.date(2023, 10, 1) else "percent") for r in a)
    assert {r[0] for r in b if out[r[0]]["volume_unit"] not in ("shares", None)} == {2030, 2060}
    assert all(out[r[0]]["amount_unit"] == ("10k yuan" if r[2] < dt.date(2023, 7, 1) else "yuan") for r in c)
    assert out[2091]["volume_std"] is None and out[2092]["amount_unit"] is None and out[2093]["turn_std"] == 0.0
    assert out[1005]["volume_std"] == pytest.approx(a[5][8] * 100)
    assert units.infer_units(frame(spark, [])).count() == 0


def test_units_without_anchors(spark):
    rows = series("000001", "x", 1, 1)
    for r in rows[:50]:
        r[12], r[14], r[2] = None, None, r[2]
    rows[60][3:8] = [None] * 5
    rows[61][2] = None
    assert units.infer_units(frame(spark, rows)).count() == len(rows)


def test_quote_texts(spark):
    cases = [
        ("200,617.0000手", None, "volume", 200617.0, 100.0), ("约155306.0000 手", None, "volume", 155306.0, 100.0), ("17.31090M shares", None, "volume", 17.3109, 1e6), ("149.56800k lots", None, "volume", 149.568, 1e5),
        ("25350800", "量:股 / 额=万", "volume", 25350800.0, 1.0), ("1867.08", "量=万股 / 换手单位%", "volume", 1867.08, 1e4), ("535  shares", None, "volume", 535.0, 1.0), ("3.5萬股", None, "volume", 3.5, 1e4),
        ("１９６，０１８，８４１．４９元", None, "amount", 196018841.49, 1.0), ("￥28371.62175万元", None, "amount", 28371.62175, 1e4), ("12.5 CNY mn", None, "amount", 12.5, 1e6), ("¥5", None, "amount", 5.0, 1.0), ("0.4亿", None, "amount", 0.4, 1e8),
        ("7", "换手：小数; 额单位千元", "amount", 7.0, 1e3), ("117.29bp", None, "turn", 117.29, 0.01), ("6.29", "换手=‰", "turn", 6.29, 0.1), ("0.007186", "换手：小数", "turn", 0.007186, 100.0), ("0.5 pct", None, "turn", 0.5, 1.0),
        ("--", "量=手", "volume", None, None), ("", None, "turn", None, None), (None, None, "amount", None, None), ("停牌", None, "volume", None, None), ("8", None, "volume", 8.0, None),
    ]
    for field in units.FIELDS:
        own = [c for c in cases if c[2] == field]
        df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(own)], "i int, t string, n string")
        n, f = units.read_quantity(F.col("t"), F.col("n"), field)
        got = [(r["a"], r["b"]) for r in df.select("i", n.alias("a"), f.alias("b")).orderBy("i").collect()]
        assert got == [(c[3], c[4]) for c in own]


def test_quote_without_unit_takes_the_reference(spark):
    q = spark.createDataFrame([("k", "1234.5", None, None, None), ("none", "5", None, None, None)], "key string, volume_text string, amount_text string, turn_text string, unit_note string")
    ref = spark.createDataFrame([("k", 12345000.0, 1.0, 1.0)], "key string, volume_std double, amount_std double, turn_std double")
    out = {r["key"]: r for r in units.quotes_to_standard(q, ref, ["key"]).collect()}
    assert out["k"]["volume_factor"] == 1e4 and out["k"]["volume_p"] > 0.9 and out["none"]["volume_factor"] == 1 and out["none"]["volume_p"] < 0.9 and out["k"]["amount_std"] is None


def flagged(spark, rows):
    b = frame(spark, rows).withColumns({"_src": F.col("source"), "_vstd": F.col("volume"), "_vref": F.ln(F.col("turn") / 100 * F.col("shares"))})
    return {r["bar_id"]: r for r in anomalies.flag_bars(b).collect()}


def faulty_rows():
    rows = series("000001", "calm", 7, 1, 0.008) + series("000002", "wild", 8, 1000, 0.03)
    by = {r[0]: r for r in rows}
    by[50][6] *= 1.2  # spike in close
    by[50][4] = by[50][6] * 1.001
    by[80][5] *= 0.85  # spike in low
    for k in range(100, 108):
        by[k][8] = by[100][8]  # stuck volume: 101..107
    for k in range(120, 125):
        by[k][4] = max(by[120][4], by[k][4])
    for k in range(120, 125):
        by[k][4] = by[124][4]  # five equal highs aren't a stuck run
    by[140][8] *= 40  # spike in volume
    by[150][8] = -5.0
    by[151][6] = 0.0
    by[152][8] = 2e9  # above the outstanding shares
    by[153][6] = float("nan")
    by[154][11] = 0
    by[154][6] = -1.0
    for k in range(200, len(DAYS) + 1):
        for j in (3, 4, 5, 6, 7):
            by[k][j] *= 0.7 if not (k == 200 and j == 7) else 1.0  # a move that stays
    copy = list(by[50])
    copy[0] = 9001
    copy[6] = round(copy[6] + 0.01, 2)
    return rows + [copy]


WANT = {50, 9001, 80, *range(101, 108), 140, 150, 151, 152}


def test_flags(spark):
    out = flagged(spark, faulty_rows())
    bad = {k for k, r in out.items() if r["faulty"]}
    assert bad == WANT
    assert out[50]["close_spike"] and out[80]["low_spike"] and out[140]["volume_spike"] and out[104]["volume_stuck"] and out[151]["close_range"]
    assert 154 not in out and not out[153]["close_spike"]
    assert flagged(spark, []) == {}


def test_flags_do_not_depend_on_chunks(spark, monkeypatch):
    monkeypatch.setattr(anomalies, "CHUNK", 64)
    monkeypatch.setattr(anomalies, "BLOCK", 2)
    assert {k for k, r in flagged(spark, faulty_rows()).items() if r["faulty"]} == WANT


def test_each_copy_is_judged_by_its_own_value(spark):
    rows = faulty_rows()
    by = {r[0]: r for r in rows}

    def copy(of, bar_id, **change):
        new = list(by[of])
        new[0] = bar_id
        for j, x in change.items():
            new[int(j[1:])] = x
        rows.append(new)

    copy(140, 9002, _8=by[140][8] / 10_000, _12="units")  # the spike in another unit, with the same shares
    copy(60, 9003, _6=by[60][6] * 1.2, _4=by[60][6] * 1.2)  # a fault of the later copy alone
    copy(170, 9004, _8=by[170][8] * 40)
    copy(80, 9005, _5=min(by[80][3], by[80][6]) * 0.999)  # a sound copy of a faulty bar
    for k in range(180, 187):
        copy(k, 9100 + k, _8=123_400.0)  # stuck in the later copies alone
    b = frame(spark, rows).withColumn("_vstd", F.col("volume") * F.when(F.col("source") == "units", 10_000).otherwise(1))
    b = b.withColumns({"_src": F.when(F.col("source") == "units", "calm").otherwise(F.col("source")), "_vref": F.ln(F.col("turn") / 100 * F.col("shares"))})
    out = {r["bar_id"]: r for r in anomalies.flag_bars(b).collect()}
    assert out[9002]["volume_spike"] and out[9003]["close_spike"] and out[9004]["volume_spike"] and not out[9005]["low_spike"]
    assert not out[60]["faulty"] and not out[170]["faulty"] and not out[9280]["volume_stuck"] and all(out[9100 + k]["volume_stuck"] for k in range(181, 187))
    assert {k for k, r in out.items() if k < 9002 and r["faulty"]} == WANT


def departures(devs, source="a", sigma=0.02):
    n = len(devs)
    d = {"dev": np.array([devs], np.float32), "sigma": np.full((1, n), sigma, np.float32), "far": np.full((1, n), 4 * sigma, np.float32), "kind": np.zeros((1, n), np.int8)}
    d.update({k: np.zeros((1, n), bool) for k in ("equal", "hard")}, there=np.ones((1, n), bool))
    return {**{k: np.repeat(v, len(anomalies.FIELDS), axis=0) for k, v in d.items()}, "source": np.array([source] * n), "own": np.ones(n, bool)}


def test_neighbours_decide_what_a_threshold_cannot():
    """The same departure is normal alone and a spike beside another: no threshold on the value tells the two apart."""
    model = anomalies.first_model(["a"])
    alone, twice = np.zeros(40), np.zeros(40)
    alone[20], twice[20:22] = 0.13, 0.13
    p = [anomalies._score([departures(x)], model)[0, 0, 20, 1] for x in (alone, twice)]
    assert p[0] < 0.5 < p[1]


def test_parameters_are_each_sources_own():
    rng = np.random.default_rng(2)
    series, model = [], anomalies.first_model(["calm", "often"])
    for source, rate in (("calm", 0.001), ("often", 0.03)):
        for _ in range(30):
            x = rng.normal(0, 0.02, 500)
            x[rng.random(500) < rate] = 0.5
            series.append(departures(x, source))
    for _ in range(8):
        sums = anomalies._sums(anomalies._stack(series, model.sources), model)
        model, change = anomalies._estimate(model, sums)
    calm, often = model.move[:, 0, 0, 1]
    assert calm < 0.003 and 0.02 < often < 0.04 and change < 0.01 and np.allclose(model.width[:, 0], 1.0, atol=0.1) and np.allclose(model.span[:, 0], 0.42, atol=0.05)


def test_empty_and_null_inputs_of_the_unit_fit(spark):
    rows = series("000001", "s", 3, 1, 0.01)[:40]
    b = frame(spark, rows)
    assert units.infer_units(b.limit(0)).count() == 0
    null = b.withColumns({"source": F.lit(None).cast("string"), "volume_unit": F.lit("old"), "_w": F.lit(1)})
    out = units.infer_units(null)
    assert out.count() == 40 and out.where("volume_unit <> 'shares'").count() == 0 and out.columns.count("volume_unit") == 1
    gone = units.infer_units(b.withColumns({c: F.lit(None).cast("double") for c in units.FIELDS}))
    assert gone.where("volume_unit is not null or amount_std is not null or turn_p is not null").count() == 0
    q = spark.createDataFrame([], "key string, volume_text string, amount_text string, turn_text string, unit_note string, source string")
    assert units.quotes_to_standard(q, spark.createDataFrame([], "key string, volume_std double, amount_std double, turn_std double"), ["key"]).count() == 0


def test_the_fit_of_factors_finds_weights_and_width():
    rng = np.random.default_rng(4)
    offsets = np.array([0.0, -2.0, -4.0])
    r = np.concatenate([rng.normal(0, 0.01, 600), rng.normal(-4, 0.01, 300), rng.uniform(-6, 6, 20)])
    w, sigma, out = units.settle_factors(r, np.ones(len(r)), offsets)
    assert np.allclose(w, [2 / 3, 0, 1 / 3], atol=0.02) and 0.005 <= sigma < 0.02 and 0.005 < out < 0.05
    period = np.array([1] * 50 + [2] * 50)
    like = np.full((100, units.CELLS), -20.0)
    like[:50, 0], like[50:, -1] = 0.0, 0.0
    periods, weights, rounds, loglik = units.settle(period, like, np.ones((100, 3), bool), np.ones(100) * 10)
    assert periods.tolist() == [1, 2] and weights[0, 0] > 0.9 and weights[1, units.SIZES[0] - 1] > 0.9 and rounds < units.MAX_ROUNDS and loglik > -1
