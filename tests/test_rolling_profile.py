import datetime as dt
import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from brassvane.operators import profile, rolling

D = dt.date


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("ab"), D(2024, 1, 1) + dt.timedelta(days=rng.randrange(90)), rng.choice([None, 1, 2])) for _ in range(150)]
    rows += [(None, D(2024, 1, 1), 1), ("a", None, 1), ("single", D(2024, 2, 2), 5)]
    got = {(r["e"], r["d"]): r.asDict() for r in rolling.trailing_totals(spark.createDataFrame(rows, "e string, d date, n int"), "e", "d", "n", (7, 30)).collect()}
    want = {}
    for e in ("hot", "a", "b", "single"):
        per = {}
        for x, d, n in rows:
            if x == e and d:
                per[d] = per.get(d, 0) + (n or 0)
        d = min(per)
        while d <= max(per):
            want[e, d] = [sum(per.get(d - dt.timedelta(days=k), 0) for k in range(p)) for p in (1, 7, 30)]
            d += dt.timedelta(days=1)
    assert got.keys() == want.keys()
    assert all([v["total_1d"], v["total_7d"], v["total_30d"]] == want[k] and math.isclose(v["avg_7d"], want[k][1] / 7) for k, v in got.items())
    assert rolling.trailing_totals(spark.createDataFrame([], "e string, d date, n int"), "e", "d", "n").count() == 0


def rows_of(n=2000, seed=2):
    rng = random.Random(seed)
    return [(i % 4, rng.choice([None, float("nan"), 0.0, -0.0, rng.gauss(0, 100), rng.gauss(5, 1)]), rng.choice(["a", "b", " ", "", None, "x" * 100, "9" * 50]), i, D(2024, 1, 1 + i % 9)) for i in range(n)]


def test_profile_against_brute_force(spark):
    data = rows_of()
    df = spark.createDataFrame(data, "load int, x double, value string, id bigint, d date")
    got = {(r["column_name"], r["load_id"]): r for r in profile.profile(df, "t", "load", None, {"value": lambda c: c.rlike("^[a-z]+$")}).collect()}
    assert len(got) == 16
    for load in range(4):
        xs = [r[1] for r in data if r[0] == load and r[1] is not None and not math.isnan(r[1])]
        r = got["x", load]
        assert (r["n_rows"], r["n_missing"], r["n_distinct"]) == (500, 500 - len(xs), len({x + 0.0 for x in xs}))
        assert r["median"] == pytest.approx(median(xs)) and (r["least"], r["greatest"]) == (min(xs), max(xs))
        ts = [r[2] for r in data if r[0] == load and r[2] and r[2].strip()]
        r = got["value", load]
        assert (r["n_missing"], r["n_distinct"], r["n_malformed"], r["median"]) == (500 - len(ts), len(set(ts)), sum(t[0] == "9" for t in ts), None)
        assert got["id", load]["n_distinct"] == 500 and got["x", load]["psi"] >= 0


def test_psi(spark):
    same = spark.createDataFrame([(i % 2, float(i // 2 % 50)) for i in range(1000)], "load int, x double")
    assert all(abs(r["psi"]) < 1e-9 for r in profile.profile(same, "t", "load").collect())
    moved = same.withColumn("x", F.when(F.col("load") == 1, F.col("x") * 1000).otherwise(F.col("x")))
    assert all(r["psi"] > 0.5 for r in profile.profile(moved, "t", "load").collect())


def test_deviating_loads_and_empty(spark):
    rng = random.Random(5)
    rows = [(k, None if rng.random() < (0.4 if k == 3 else 0.02) else rng.lognormvariate(1 + 3 * (k == 5), 0.2)) for k in range(8) for _ in range(300)]
    df = spark.createDataFrame(rows, "load int, x double")
    out = profile.compared_loads(profile.profile(df, "t", "load", ["x"])).where("deviates")
    assert sorted(r["load_id"] for r in out.collect()) == [3, 5]
    assert profile.profile(df.limit(0), "t", "load").count() == 0
    nulls = spark.createDataFrame([(None, None)], "load int, x double")
    assert profile.profile(nulls, "t", "load").collect()[0]["n_missing"] == 1


def test_profile_with_clashing_names_and_kinds(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True, 7), (1, float("nan"), " ", None, 7), (2, None, None, True, 8), (None, -0.0, "b", False, 9)], "load int, x double, k string, flag boolean, n bigint")
    got = {(r["column_name"], r["load_id"]): r for r in profile.profile(df, "t", "load").collect()}
    assert len(got) == 12 and got["x", 1]["n_missing"] == 1 and got["k", 1]["n_missing"] == 1 and got["k", 2]["n_missing"] == 1
    assert got["n", 1]["n_distinct"] == 1 and got["n", 1]["median"] == 7.0 and got["flag", 1]["n_distinct"] == 1 and got["x", None]["least"] == 0.0
