import pytest

from brassvane.llm import mixing
from brassvane.llm.mixing import Share


def test_water_fill():
    s = mixing.water_fill([Share("a", 0.5, 100, 100), Share("b", 0.3, 300, 100), Share("c", 0.2, 1000, 1000), Share("none", 0.1, 0, 0), Share("zero", 0, 50, 50)], 400)
    given = {x.source: x.given for x in s}
    assert given["a"] == 100 and s[0].capped and given["none"] == given["zero"] == 0 and s[3].capped and not s[4].capped
    assert given["b"] == pytest.approx(180) and given["c"] == pytest.approx(120)
    short = mixing.water_fill([Share("a", 0.5, 10, 10), Share("b", 0.5, 20, 10)], 100)
    assert [x.given for x in short] == [10, 20] and all(x.capped for x in short)
    assert mixing.water_fill([], 10) == []


def test_feasible_total():
    assert mixing.feasible_total([Share("a", 0.5, 100, 50), Share("b", 0.25, 30, 30), Share("x", 0.25, 0, 0)]) == pytest.approx(90)


def frame(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(3000)] + [(5000 + i, "small", 20) for i in range(40)] + [(7000, None, 5), (7001, "big", 0), (7002, "big", None), (7003, "other", 9)]
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, source string, n bigint, copies int")


def test_mixture_reaches_the_shares(spark):
    docs = frame(spark)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.2, 2), (None, 0.1, 1), ("big", -1.0, None)], "source string, target_share double, max_repeat int")
    shares, total = mixing.plan(docs, targets, "source", "n", 3000)
    out = mixing.mix(docs, shares, "doc_id", "source", "n")
    rows = out.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "small"}
    small = [r for r in rows if r["source"] == "small"]
    assert {r["copies"] for r in small} <= {1, 2} and sum(r["copies"] * r["n"] for r in small) == pytest.approx(1200, abs=20)
    assert sum(r["copies"] * r["n"] for r in rows) == pytest.approx(3000, abs=40)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows))  # seeded
    rep = {r["source"]: r for r in mixing.report(out, shares, "source", "n").collect()}
    assert rep["gone"]["reached_share"] == 0 and rep["gone"]["capped"] and not rep["gone"]["met"]
    assert rep["big"]["reached_share"] == pytest.approx(0.6, abs=0.02)


def test_caps_and_empty(spark):
    docs = frame(spark)
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], "source string, target_share double, max_repeat int")
    shares, _ = mixing.plan(docs, targets, "source", "n")
    out = mixing.mix(docs, shares, "doc_id", "source", "n")
    assert max(r["copies"] for r in out.where("source = 'small'").collect()) == 2 and out.where("source = 'big'").groupBy().max("copies").collect()[0][0] == 1
    empty = docs.limit(0)
    shares, total = mixing.plan(empty, targets, "source", "n")
    assert total == 0 and mixing.mix(empty, shares, "doc_id", "source", "n").count() == 0
    assert mixing.report(mixing.mix(empty, shares, "doc_id", "source", "n"), shares, "source", "n").count() == 2
