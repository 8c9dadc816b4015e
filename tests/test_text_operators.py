import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brassvane.functions import lexicon_words as lw
from brassvane.operators import datasets, dedup, lexicon, vectors


def greedy(prints, threshold=3):
    kept, out = [], {}
    for k, fp in sorted(prints):
        near = [c for c, g in kept if fp and bin((fp ^ g) & (2**64 - 1)).count("1") <= threshold]
        out[k] = min(near) if near else k
        if not near and fp:
            kept.append((k, fp))
    return out


def test_chain_and_zero(spark):
    rows = [(1, 0xF), (2, 0x8), (3, 0x78), (4, 0), (5, 0), (6, None), (7, 0xF)]
    got = {r["k"]: (r["class_id"], r["keep"]) for r in dedup.near_duplicates(spark.createDataFrame(rows, "k bigint, fp bigint"), "k", "fp").collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (1, False)}
    assert dedup.near_duplicates(spark.createDataFrame([], "k bigint, fp bigint"), "k", "fp").count() == 0


def test_near_duplicates_against_greedy(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for k in range(240):
        fp = rng.choice(base)
        for _ in range(rng.randrange(5)):
            fp ^= 1 << rng.randrange(64)
        prints.append((k, fp - 2**64 if fp >= 2**63 else fp))
    prints += [(500 + i, prints[0][1]) for i in range(100)]  # a third are copies
    rng.shuffle(prints)
    df = spark.createDataFrame(prints, "k bigint, fp bigint").withColumn("a", F.lit(1)).withColumn("late", F.lit(2))
    got = {r["k"]: r["class_id"] for r in dedup.near_duplicates(df, "k", "fp").collect()}
    assert got == greedy(prints)


def test_fingerprint_by_definition(spark):
    import hashlib

    text = "涨停涨停 AB c1 收购"
    tokens = ["涨停", "停涨", "涨停", "停收", "收购", "ab", "c1"]
    v = [0] * 64
    for t in tokens:
        h = int(hashlib.md5(t.encode()).hexdigest()[:16], 16)
        for i in range(64):
            v[i] += 1 if h >> i & 1 else -1
    want = sum(1 << i for i in range(64) if v[i] > 0)
    assert dedup.fingerprint(text) & (2**64 - 1) == want
    assert dedup.fingerprint("") == dedup.fingerprint(None) == dedup.fingerprint("。") == 0
    assert spark.createDataFrame([(text,), (None,)], "t string").select(dedup.simhash(F.col("t")).alias("f")).where("f = 0").count() == 1


def plain_score(title, text):
    """Every occurrence of every word, one by one."""
    score = 0.0
    for field, weight in ((title or "", 2.0), (text or "", 1.0)):
        for words, sign in ((lw.POSITIVE, 1), (lw.NEGATIVE, -1)):
            for word, w in words.items():
                for i in range(len(field)):
                    if field[i : i + len(word)] != word:
                        continue
                    s = w * weight * sign
                    for d, c in lw.DEGREES.items():
                        if d in field[max(0, i - 3) : i]:
                            s *= c
                            break
                    if any(n in field[max(0, i - 4) : i] for n in lw.NEGATIONS):
                        s *= -0.9
                    if sign < 0 and any(c in field[max(0, i - 12) : i] for c in lw.CANCELS):
                        s *= -0.9
                    score += s
        import re

        for p, _, s in lw.PATTERNS:
            score += s * weight * len(re.findall(p, field))
    return score


PARTS = [*lw.POSITIVE, *lw.NEGATIVE, *lw.DEGREES, *lw.NEGATIONS, *lw.CANCELS, "同比", "净利润", "主力", "10派1.5元", "。", " ", "公司", "长"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12), st.lists(st.sampled_from(PARTS), max_size=12))
def test_lexicon_against_plain_scan(a, b):
    title, text = "".join(a), "".join(b)
    label, score, conf, pos, neg = lexicon.label_one(title, text)
    want = plain_score(title, text)
    assert score == pytest.approx(want, abs=6e-4) and conf == pytest.approx(min(1, abs(want) / 3), abs=6e-4)
    if abs(abs(want) - 1) > 1e-6:
        assert label == ("positive" if want > 1 else "negative" if want < -1 else "neutral")


def test_lexicon_terms_and_nulls(spark):
    assert lexicon.label_one("撤销退市风险警示", "")[4] == ["退市风险(撤销)", "警示(撤销)", "退市(撤销)"]
    assert lexicon.label_one("公司未增持", None)[3] == ["增持(否定)"]
    rows = spark.createDataFrame([(None, None), ("", ""), ("涨停", None)], "t string, x string").select(lexicon.sentiment(F.col("t"), F.col("x")).alias("s")).select("s.label").collect()
    assert [r[0] for r in rows] == ["neutral", "neutral", "positive"]


def test_top_k_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 16)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(120, 8)).astype(np.float32)
    m[7] = m[3]  # a tie
    data = [(i, [float(x) for x in m[i]]) for i in range(120)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    got = {}
    for r in vectors.top_k(df, df.where("id % 20 = 0"), "id", "v", 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q, ids in got.items():
        s = u @ u[q]
        s[q] = -9
        assert ids == sorted(range(120), key=lambda i: (-s[i], i))[:5]
    assert len(got) == 6 and vectors.top_k(df.limit(0), df, "id", "v", 5).count() == 0


def test_append_only_new(spark):
    docs = spark.createDataFrame([(i % 50,) for i in range(60)], "id int")
    index = spark.createDataFrame([(i,) for i in range(10)], "id int")
    assert vectors.new_rows(docs, index, "id").count() == 40
    assert vectors.new_rows(docs, docs, "id").count() == 0


def test_datasets(spark):
    df = spark.createDataFrame([(i, "a" if i < 800 else "b" if i < 990 else None) for i in range(1000)], "id int, l string")
    n = {r["l"]: r["count"] for r in datasets.stratified_sample(df, "l", "id", 200).groupBy("l").count().collect()}
    assert n == {"a": 160, "b": 38, None: 10}
    q = spark.createDataFrame([("a", 50), ("b", 10), ("c", 100)], "l string, n bigint")
    assert {r["l"]: r["quota"] for r in datasets.quotas(q, "l", "n", 101, {"a": 0.4, "b": 0.3, "c": 0.3}).collect()} == {"a": 40, "b": 10, "c": 31}
    s = datasets.train_val(df, "id")
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"val": 200, "train": 800}
    p = spark.createDataFrame([("p", "p"), ("p", "n"), ("n", "n"), ("n", None), (None, "p")], "t string, g string")
    m = {r["label"]: r for r in datasets.class_metrics(p, "t", "g", ["p", "n", "z"]).collect()}
    assert (m["p"]["precision"], m["p"]["recall"], m["z"]["f1"], m["all"]["recall"]) == (0.5, 0.5, 0.0, 0.5)
    c = {r["truth"]: (r["p"], r["n"]) for r in datasets.confusion(p, "t", "g", ["p", "n"]).collect()}
    assert c == {"p": (1, 1), "n": (0, 1)}
    h = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, False)], "q int, r int, rel boolean")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "q int")  # 4 found nothing and counts all the same
    got = datasets.ranking_metrics(h, asked, "q", "r", "rel").collect()[0]
    assert (got["n_queries"], got["recall_at_k"], got["mrr"], got["first_at_1"]) == (4, pytest.approx(2 / 4), pytest.approx(1.5 / 4), pytest.approx(1 / 4))
    assert datasets.ranking_metrics(h, asked.limit(0), "q", "r", "rel").collect()[0]["mrr"] == 0
