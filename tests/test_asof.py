import datetime as dt
import random

from pyspark.sql import functions as F

from brassvane.operators import asof

D = dt.date


def test_known_reports_against_brute_force(spark):
    rng = random.Random(4)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rng.randrange(800))
    recs = [(i, rng.choice("ABC"), day(), rng.randrange(6)) for i in range(60)] + [(90, None, day(), 1), (91, "A", None, 1)]
    # One entity holds most events; one event has no entity, one no date.
    evs = [(i, "A" if rng.random() < 0.7 else rng.choice("BCZ"), day()) for i in range(400)] + [(900, None, day()), (901, "A", None)]
    r = spark.createDataFrame(recs, "rid int, e string, pub date, q int")
    e = spark.createDataFrame(evs, "ev int, e string, at date").withColumn("rid", F.lit(7))  # clashing name
    iv = asof.validity_intervals(r, "e", "pub", [F.col("q"), F.col("pub"), -F.col("rid")], ["rid", "q"])
    for bucket in (1, 30, 10_000):
        got = {x["ev"]: x["rid_known"] for x in asof.as_known(e, iv, "e", "at", ["rid", "q"], bucket).collect()}
        want = {}
        for ev, ent, at in evs:
            best = [(q, pub, -rid) for rid, en, pub, q in recs if en is not None and pub is not None and at is not None and en == ent and pub <= at]
            if best:
                want[ev] = -max(best)[2]
        assert got == want
    left = asof.as_known(e, iv, "e", "at", ["q"], how="left")
    assert left.count() == len(evs) and left.where("q is null").count() == len(evs) - len(want)


def test_boundaries_and_empty(spark):
    r = spark.createDataFrame([(1, "A", D(2024, 1, 10), 1), (2, "A", D(2024, 1, 20), 2), (3, "A", D(2024, 1, 20), 2), (4, "A", D(2024, 1, 15), 0)], "rid int, e string, pub date, q int")
    iv = asof.validity_intervals(r, "e", "pub", [F.col("q"), F.col("pub"), -F.col("rid")], ["rid"])
    e = spark.createDataFrame([(i, "A", D(2024, 1, d)) for i, d in enumerate([9, 10, 19, 20, 31])], "ev int, e string, at date")
    assert {x["ev"]: x["rid"] for x in asof.as_known(e, iv, "e", "at", ["rid"]).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}
    assert asof.as_known(e.limit(0), iv, "e", "at", ["rid"]).count() == 0
    assert asof.as_known(e, iv.limit(0), "e", "at", ["rid"]).count() == 0


def test_forward_fill(spark):
    f = spark.createDataFrame([("A", D(2020, 1, 2), 1.5), ("A", D(2020, 1, 6), 2.0), ("A", None, 9.0)], "k string, d date, factor double")
    e = spark.createDataFrame([(i, "A", D(2020, 1, i)) for i in range(1, 8)] + [(8, None, D(2020, 1, 3)), (9, "B", D(2020, 1, 3))], "i int, k string, d date")
    got = {r["i"]: r["factor"] for r in asof.forward_fill(e, f, ["k"], "d", "factor", 1.0).collect()}
    assert got == {1: 1.0, 2: 1.5, 3: 1.5, 4: 1.5, 5: 1.5, 6: 2.0, 7: 2.0, 8: 1.0, 9: 1.0}
