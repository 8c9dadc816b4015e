from pyspark.sql import functions as F

from brassvane import config
from brassvane.functions import text
from brassvane.operators import datasets, vectors


def test_config():
    s = config.deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2], "e": 3}})
    assert s == {"a": {"b": 1, "c": [2], "e": 3}, "d": 2}
    assert config.get(s, "a.e") == 3 and config.get(s, "a.x.y", 7) == 7 and config.get(s, "d.x") is None


def test_text_helpers(spark):
    df = spark.createDataFrame([('cb({"a": 1});', "It is NEGATIVE, not positive", 1.234, None)], "j string, l string, x double, y double")
    r = df.select(
        text.jsonp(F.col("j")).alias("j"), text.parse_label(F.col("l"), ["positive", "negative", "neutral"]).alias("l"), text.snapshot_lines(["x", "y"]).alias("s"), text.uncited(F.array(F.lit(1), F.lit(9)), F.array(F.lit(1))).alias("u"),
        text.references(F.array(F.lit("t1"), F.lit("t2")), F.array(F.lit("d1"), F.lit(None))).alias("r"), (text.request_key(F.lit(None), F.lit("")) != text.request_key(F.lit(""), F.lit(None))).alias("k"),
    ).collect()[0]
    assert (r["j"], r["l"], r["s"], r["u"], r["r"], r["k"]) == ('{"a": 1}', "positive", "x: 1.23", [9], "1. [d1] t1\n2. [] t2", True)
    assert df.select(text.jsonp(F.lit("none")).alias("j")).collect()[0]["j"] is None


def test_fallback(spark):
    h = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (2, 2, 21)], "query_id bigint, rank int, id bigint")
    r = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13), (2, 1, 99), (3, 1, 30)], "query_id bigint, rank int, id bigint")
    got = sorted((x["query_id"], x["rank"], x["id"], x["kind"]) for x in vectors.with_fallback(h, r, "id", 3).collect())
    assert got == [(1, 1, 10, "semantic"), (1, 2, 11, "recent"), (1, 3, 12, "recent"), (2, 1, 20, "semantic"), (2, 2, 21, "semantic"), (3, 1, 30, "recent")]


def test_groups_and_times_in_search(spark):
    rows = [(1, [1.0, 0.0], "a", "2024-01-01"), (2, [1.0, 0.1], "a", "2024-01-03"), (3, [1.0, 0.0], "b", "2024-01-01"), (4, [0.9, 0.1], "a", "2024-01-02"), (5, [1.0, 0.0], None, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, g string, t string")
    got = [(r["query_id"], r["id"]) for r in vectors.top_k(df, df, "id", "v", 5, group="g", until="t").orderBy("query_id", "rank").collect()]
    assert got == [(2, 4), (2, 1), (4, 1)]


def test_terms_ranks_net(spark):
    df = spark.createDataFrame([("a", ["x", "y"], 2), ("a", ["y"], 1), ("a", ["z", "x"], 3), ("b", [], 4), (None, ["x"], 5)], "g string, k array<string>, o int")
    got = [(r["g"], r["rank"], r["term"], r["n"]) for r in datasets.top_terms(df, "g", "k", "o", 2).orderBy("g", "rank").collect()]
    assert got == [(None, 1, "x", 1), ("a", 1, "y", 2), ("a", 2, "x", 2)]
    v = spark.createDataFrame([("a", float(i)) for i in range(20, 0, -1)] + [("b", 5.0), ("b", None)], "g string, v double")
    assert sorted(map(tuple, datasets.nearest_rank(v, ["g"], "v").collect())) == [("a", 20, 10.5, 19.0), ("b", 1, 5.0, 5.0)]
    s = spark.createDataFrame([("a", "positive", 0.5), ("a", "negative", 1.0), ("a", "neutral", 0.2)], "g string, l string, c double")
    r = datasets.net_sentiment(s, ["g"], "l", "c").collect()[0]
    assert r["n"] == 3 and abs(r["net"] + 0.5 / 3) < 1e-12


def test_related_counts_any_day_without_own_title(spark):
    q = spark.createDataFrame([(1, ["a", "b"], " x "), (2, ["b"], None), (3, ["z"], "x"), (4, [], "x")], "id int, codes array<string>, title string")
    n = spark.createDataFrame([(["a"], "x"), (["b", "a"], "y"), (["a", "b"], "y"), (["b"], "x　"), (["b", "c"], None), ([], "y"), (None, "y")], "codes array<string>, title string")
    assert {r["id"]: r["n_related"] for r in datasets.related_counts(q, n, "id").collect()} == {1: 3, 2: 4, 3: 0}


def test_related_news_counts_other_days(spark, tmp_path):
    from brassvane.plans import market

    cols = "stock_code string, publish_time string, title string"
    spark.createDataFrame([(1, "600519", "2024-05-01 09:00:00", "x")], f"golden_id bigint, {cols}").write.parquet(str(tmp_path / "golden_set_200.parquet"))
    rows = [(1, "600519", "2024-05-01 10:00:00", "x "), (2, "sh.600519,000001", "2023年01月02日", "y"), (3, "600519", "2024/05/01 09:00", "z"), (4, "000001", "2024-05-01 10:00:00", "z")]
    spark.createDataFrame(rows, f"news_id bigint, {cols}").write.parquet(str(tmp_path / "news.parquet"))
    assert [r["n_related"] for r in market.QUERIES["related_news_all_days"](spark, str(tmp_path)).collect()] == [2]


def test_recent_news_by_any_writing(spark, tmp_path):
    from brassvane.plans import market

    rows = [
        (1, "600519", "2024-05-01 09:00:00"), (2, "sh.600519", "2024/12/01 10:30"), (3, "000001,600519.SH", "2024年01月02日"), (4, " 600519 ", "1735574400000"),
        (5, "600519", "2024-12-30T20:00:00Z"), (6, "600519", "20241231080000"), (7, "600519", "2023-12-31T16:00:01Z"), (8, "600519", "2024-02-30 09:00:00"), (9, None, "2024-05-01 09:00:00"),
    ]
    spark.createDataFrame(rows, "news_id bigint, stock_code string, publish_time string").write.parquet(str(tmp_path / "news.parquet"))
    got = market.QUERIES["news_recent_by_code"](spark, str(tmp_path)).collect()
    got = sorted((r["code"], r["day"], r["second"], r["news_id"]) for r in got)
    assert got == [
        ("000001", "2024-01-02", 0, 3), ("600519", "2024-01-01", 1, 7), ("600519", "2024-01-02", 0, 3), ("600519", "2024-05-01", 32400, 1), ("600519", "2024-12-01", 37800, 2), ("600519", "2024-12-31", 0, 4),
        ("600519", "2024-12-31", 14400, 5), ("600519", "2024-12-31", 28800, 6),
    ]
