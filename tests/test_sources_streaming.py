import datetime as dt
import json
import sys

import pytest
from pyspark.sql import functions as F

from brassvane.operators import bars, vectors
from brassvane.sources import files, vendor
from brassvane.streaming import incremental


def test_shards_and_views(spark, tmp_path):
    d, schema = str(tmp_path / "s"), "k int, v string"
    assert files.load_shards(spark, d, schema).count() == 0
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema)
    files.save_shard(a, d, "001")
    files.save_shard(a, d, "001")  # again: replaced, not doubled
    files.save_shard(spark.createDataFrame([(2, "c")], schema), d, "002")
    assert files.load_shards(spark, d, schema).count() == 4
    assert files.merge_shards(spark, d, str(tmp_path / "all"), schema, distinct=False).count() == 4
    assert files.merge_shards(spark, d, str(tmp_path / "m.parquet"), schema).count() == 3
    assert files.merge_shards(spark, d, str(tmp_path / "k.parquet"), schema, ["k"], "v").orderBy("k").collect()[1]["v"] == "b"
    assert files.register_views(spark, str(tmp_path)) == ["k", "m"]
    assert files.query(spark, "SELECT count(*) AS n FROM m WHERE k = :k", {"k": 1}).collect()[0]["n"] == 1
    assert files.table_counts(spark, ["m", "missing"]) == {"m": 3, "missing": -1}
    wide = files.read_table(spark, str(tmp_path / "m.parquet"), "k string, more double")
    assert wide.columns == ["k", "more"] and wide.where("more is null").count() == 3


def test_progress_and_publish(spark, tmp_path):
    p = str(tmp_path / "progress")
    todo = spark.createDataFrame([(x,) for x in ("a", "b", "c")], "item string")
    assert files.remaining(todo, files.load_progress(spark, p), "item").count() == 3
    for part in ("a", "b", "a"):
        files.save_progress(todo.where(F.col("item") == part), p, "item")
    assert [r[0] for r in files.remaining(todo, files.load_progress(spark, p), "item").collect()] == ["c"]
    assert len(files.parts(spark, p)) == 2  # what was there isn't written again


def test_append_new_twice(spark, tmp_path):
    p = str(tmp_path / "idx")
    docs = spark.createDataFrame([(i % 50, "t") for i in range(60)] + [(None, "n")], "id int, t string")
    assert [files.append_new(docs, p, "id") for _ in range(2)] == [50, 0]


def test_json(spark, tmp_path):
    p = str(tmp_path / "j")
    files.write_json_lines(spark.createDataFrame([(1, None), (2, "é中")], "a int, b string").coalesce(1), p, {"label": "string"})
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines()]
    assert all(set(x) == {"a", "b", "label"} for x in lines) and any(x["b"] == "é中" for x in lines)
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").where("a is not null").count() == 2
    (tmp_path / "b1.json").write_text(json.dumps({"meta": {"n": 2}, "results": [{"x": 1}, {"x": 2}]}, indent=1))
    r = files.read_json_documents(spark, str(tmp_path / "b1.json"), "meta struct<n:int>, results array<struct<x:int>>").collect()[0]
    assert r["meta"]["n"] == 2 and len(r["results"]) == 2 and r["_file"] == "b1.json"


def test_bars_written_by_year(spark, tmp_path):
    df = spark.createDataFrame([("a", "2023-01-01", 1.0), ("b", "2024-01-01", 2.0)], "code string, date string, close double").withColumn("date", F.to_date("date"))
    files.write_bars(df, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars")).where("year = 2024")
    assert back.count() == 1 and "PartitionFilters" in back._jdf.queryExecution().toString()


def test_standardise(spark):
    df = spark.createDataFrame([("2024-01-02", "1"), ("bad", "2"), ("20240103", "3")], "trade_date string, `收盘` string")
    out = files.standardise(df, "600000", {"收盘": "close", "absent": "x"}, extra={"currency": F.lit("HKD")})
    assert out.count() == 2 and set(out.columns) == {"close", "date", "code", "currency"}


def test_vendor_source(spark, tmp_path):
    (tmp_path / "600000.jsonl").write_text('{"close": 1}\n{"close": 2}\n')
    rows = vendor.load(spark, "brassvane.sources.vendor.FileFetcher", ["600000", "missing"], [str(tmp_path)], tries=2, wait=0.01).collect()
    assert sum(r["record"] is not None for r in rows) == 2
    assert [r["item"] for r in rows if r["error"]] == ["missing"]


def test_streams(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "id int, ts timestamp, kind string, value double"
    one = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0), (2, "2024-01-01 00:20:00", "a", 2.0)], "id int, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    one.write.parquet(src)
    target = str(tmp_path / "out")
    for _ in range(2):
        incremental.append_new(spark.readStream.schema(schema).parquet(src), target, "id", str(tmp_path / "c1")).awaitTermination()
    assert files.read_parts(spark, target).count() == 2
    q = incremental.windowed_counts(spark.readStream.schema(schema).parquet(src), "ts", ["kind"], "value").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("w").collect()
    assert [(x["kind"], x["n"], x["total"]) for x in r] == [("a", 3, 5.0)]
    q = incremental.first_seen(spark.readStream.schema(schema).parquet(src), ["id"], "ts").writeStream.format("memory").queryName("f").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("f").count() == 2


def test_backward_pages():
    days = [f"2024-01-{d:02d}" for d in range(1, 11)]
    asked = []

    def page(start, end):
        asked.append(end)
        kept = [d for d in days if start <= d <= end][-4:]
        return [[d, "1.5", "2", "2.5", "x", "7", "more"] for d in kept]

    rows = vendor.backward_pages(page, "2024-01-01", "2024-01-10")
    assert [r["date"] for r in rows] == days and asked == ["2024-01-10", "2024-01-06", "2024-01-02"]
    assert rows[0] == {"date": "2024-01-01", "open": 1.5, "high": 2.5, "low": None, "close": 2.0, "volume": 700.0}
    assert len(vendor.backward_pages(page, "2024-01-01", "2024-01-10", most=1)) == 4 and vendor.backward_pages(lambda a, b: [], "2024-01-01", "2024-01-10") == []


def test_numbered_pages_and_articles():
    pages = {1: [{"n": i} for i in range(3)], 2: [{"n": 9}]}
    assert len(list(vendor.numbered_pages(pages.__getitem__, 5, size=3))) == 4
    assert len(list(vendor.numbered_pages(lambda n: pages[1] if n == 1 else 1 / 0, 5, size=3))) == 3
    assert vendor.unwrapped('cb_1({"a": [1]});', "cb_1") == vendor.unwrapped('{"a": [1]}', "cb_1") == {"a": [1]}
    a = vendor.article({"title": "<em>甲</em>公司　公告", "content": "正文" * 1200, "date": "2024-01-01 09:30:00.5", "url": None}, "000001", "s")
    assert a["title"] == "甲公司 公告" and len(a["text"]) == 2000 and a["publish_time"] == "2024-01-01 09:30:00" and a["url"] == ""
    assert vendor.article({"title": "短", "content": None}, "000001", "s") is None


def test_decoder(tmp_path):
    code = tmp_path / "d.py"
    code.write_text(
        "import sys, json, time\nfor x in sys.stdin:\n r = json.loads(x)\n print('noise', flush=True)\n"
        " time.sleep(9) if r['enc'] == 'slow' else sys.exit() if r['enc'] == 'end' else print(json.dumps({'id': r['id'], 'ok': r['enc'] != 'bad', 'data': r['enc'][::-1], 'err': 'no'}), flush=True)\n"
    )
    d = vendor.Decoder([sys.executable, str(code)], wait=5)
    assert d.decode("abc") == "cba"
    with pytest.raises(RuntimeError, match="no"):
        d.decode("bad")
    with pytest.raises(RuntimeError, match="ended"):
        d.decode("end")
    d.close()
    d = vendor.Decoder([sys.executable, str(code)], wait=0.2)
    with pytest.raises(TimeoutError):
        d.decode("slow")
    d.close()


def test_workers_pause_and_cache(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"ok{i}.jsonl").write_text('{"a": 1}\n')
    items = ["ok0", "no1", "ok1", "no2", "ok2", "no3", "ok3", "no4"]
    got = vendor.load(spark, "brassvane.sources.vendor.FileFetcher", items, [str(tmp_path)], tries=2, wait=0.0, workers=2, failures=2, pause=0.0)
    assert got.where("error is null").count() == 4 and got.where("error is not null").count() == 4
    vendor.failed(got, str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "failed")).count() == 4 and vendor.load(spark, "x.Y", []).count() == 0
    (tmp_path / "c").mkdir()
    cached = vendor.Cached(str(tmp_path / "c"), "brassvane.sources.vendor.FileFetcher", str(tmp_path))
    assert cached.fetch("ok0") == [{"a": 1}]
    (tmp_path / "ok0.jsonl").unlink()
    assert cached.fetch("ok0") == [{"a": 1}]


def test_growing_tables(spark, tmp_path):
    p, docs = str(tmp_path / "t"), spark.createDataFrame([(1, "甲 公司"), (2, None), (2, "乙"), (None, "x")], "id int, title string")
    assert vectors.build(docs, p, "id", "title", "title") == 2 and vectors.build(docs, p, "id", "title", "title") == 0
    assert vectors.build(spark.createDataFrame([("3", "乙")], "k string, title string").select(F.col("k").cast("int").alias("id"), "title"), p, "id", "title", "title") == 1
    found = vectors.search(spark, p, spark.createDataFrame([(9, "甲公司")], "q int, t string"), "q", "t", "id", 1).collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(9, 1)]
    c = vectors.consistent(files.read_parts(spark, p), "id", "vector").collect()[0]
    assert tuple(c) == (3, 3, 0, 1)


def test_text_keys_and_equal_titles(spark):
    e = spark.createDataFrame([("news_a", [1.0, 0.0], "T"), ("news_b", [1.0, 0.1], " T　"), ("news_c", [0.9, 0.2], "U"), ("news_z", [0.0, 0.0], "Z")], "id string, v array<double>, title string")
    h = vectors.top_k(e, e.where("id = 'news_a'"), "id", "v", 5)
    assert [r["id"] for r in h.orderBy("rank").collect()] == ["news_b", "news_c"]
    assert [(r["rank"], r["id"]) for r in vectors.without_equal_titles(h, e, "id", "title", 3).collect()] == [(1, "news_c")]


def test_reset_build_and_document(spark, tmp_path):
    shard = spark.createDataFrame([("a",), ("b",)], "code string")
    files.save_shard(shard, str(tmp_path / "s"), "07")
    files.save_progress(spark.createDataFrame([("a",), ("b",), ("c",)], "code string"), str(tmp_path / "p"), "code")
    assert files.reset(shard, str(tmp_path / "s"), "07", str(tmp_path / "p"), "code") == 2
    assert [r[0] for r in files.load_progress(spark, str(tmp_path / "p")).collect()] == ["c"] and not files.list_files(spark, str(tmp_path / "s"), "batch=.*")
    src = str(tmp_path / "src.parquet")
    shard.write.parquet(src)
    assert files.build_table(spark, src, str(tmp_path / "tab")) == {"rows": 2, "columns": 1} and files.build_table(spark, src, str(tmp_path / "tab"))["rows"] == 2
    files.write_document(spark, str(tmp_path / "doc"), {"as_of": "2024"}, shard.agg(F.count(F.lit(1)).alias("n")), shard)
    r = spark.read.json(str(tmp_path / "doc")).collect()[0]
    assert r["meta"]["as_of"] == "2024" and r["stats"]["n"] == 2 and len(r["results"]) == 2


def test_range_reaches_the_files(spark, tmp_path):
    rows = [(i, f"sh.60000{i % 3}", dt.date(2022 + i % 3, 5, 1 + i % 20), float(i)) for i in range(60)]
    files.write_bars(spark.createDataFrame(rows, "bar_id int, code string, date date, close double"), str(tmp_path / "b"))
    out = bars.bar_range(spark.read.parquet(str(tmp_path / "b")), "600001", "2023-01-01", "2023-12-31")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(code,600001)" in plan and "year" in plan.split("PartitionFilters")[1][:120]
    assert {r["bar_id"] for r in out.collect()} == {r[0] for r in rows if r[1].endswith("600001") and r[2].year == 2023}
