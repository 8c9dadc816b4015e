"""Tables as files: views, shards, progress, JSON lines, versioned publishing. Paths may be any file system Spark can write to."""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, folder: str, pattern: str = r".*") -> list[tuple[str, int]]:
    """(name, modification time in ms) of a folder's entries, newest first, ties by name; empty if there is no such folder."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)]
    return sorted(((n, t) for n, t in found if re.fullmatch(pattern, n)), key=lambda x: (-x[1], x[0]))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A parquet table; with `schema` its columns are enforced: extra ones dropped, absent ones null, types cast (unreadable values null)."""
    df = spark.read.parquet(path)
    if schema is None:
        return df
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def register_views(spark: SparkSession, folder: str) -> list[str]:
    """A temporary view for every parquet file or folder below `folder`, named by its stem."""
    names = []
    for name, _ in list_files(spark, folder, r".*\.parquet"):
        stem = name[: -len(".parquet")]
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(stem)
        names.append(stem)
    return sorted(names)


def query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """SQL over the registered views, with named parameters."""
    return spark.sql(sql, args=args or {})


def table_counts(spark: SparkSession, names: list[str]) -> dict[str, int]:
    """Rows per view; -1 where there is none."""
    return {n: spark.table(n).count() if spark.catalog.tableExists(n) else -1 for n in names}


def save_shard(df: DataFrame, folder: str, batch: str) -> str:
    """Writes a batch to its own subfolder; writing a batch again replaces it."""
    path = f"{folder}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_shards(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All batches together, without the batch column; an empty frame of `schema` if there is none."""
    if not exists(spark, folder) or not list_files(spark, folder, "batch=.*"):
        return spark.createDataFrame([], schema)
    return read_table(spark, folder, schema)


def merge_shards(spark: SparkSession, folder: str, out: str, schema: T.StructType | str, key: list[str] | None = None, order: str | None = None, distinct: bool = True) -> DataFrame:
    """The batches without repeated rows - or, with `key`, one row per key, the first by `order`; or, without `distinct`, as they are -
    written to `out`."""
    df = load_shards(spark, folder, schema)
    if key:
        rest = [c for c in df.columns if c not in key]
        pick = F.min_by(F.struct(*rest), order or rest[0])
        df = df.groupBy(*key).agg(pick.alias("_r")).select(*key, "_r.*").select(*df.columns)
    elif distinct:
        df = df.distinct()
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items of `todo` that aren't in `done`; null keys stay."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def parts(spark: SparkSession, path: str) -> list[str]:
    """The complete parts of a growing table, oldest first: a part counts once its success mark is there."""
    return [f"{path}/{n}" for n in sorted(n for n, _ in list_files(spark, path, r"part\d{8}")) if exists(spark, f"{path}/{n}/_SUCCESS")]


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*parts(spark, path))


def add_part(df: DataFrame, path: str) -> int:
    """Writes `df` as a further part, nothing else; returns its rows. No part is added for no rows. One writer at a time."""
    spark = df.sparkSession
    seen = F.count(F.lit(1)).alias("n")
    rows = Observation()
    out = f"{path}/part{int(p[-1][-8:]) + 1 if (p := parts(spark, path)) else 1:08d}"
    df.observe(rows, seen).write.mode("overwrite").parquet(out)
    n = rows.get["n"]
    if not n:
        fs, p = _fs(spark, out)
        fs.delete(p, True)
    return n


def save_progress(done: DataFrame, path: str, key: str) -> None:
    """Adds the keys that a progress table doesn't hold yet; only they are written."""
    append_new(done.select(F.col(key).cast("string").alias("item")), path, "item")


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    return read_parts(spark, path).select("item") if parts(spark, path) else spark.createDataFrame([], "item string")


def reset(df: DataFrame, folder: str, bad: str, progress: str, key: str) -> int:
    """Takes a bad shard out: moves its folder aside, and drops its keys (of `df`, the shard's rows) from the progress table, so
    they are done again. Returns how many keys that were."""
    spark = df.sparkSession
    keys = cut(df.select(F.col(key).cast("string").alias("item")).distinct())
    kept = cut(load_progress(spark, progress).join(keys, "item", "left_anti"))
    fs, at = _fs(spark, f"{folder}/batch={bad}")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_bad_{bad}")
    fs.delete(aside, True)
    fs.rename(at, aside)
    old = parts(spark, progress)
    add_part(kept, progress)
    for p in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)
    return keys.count()


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest complete version of a published table."""
    done = [n for n, _ in list_files(spark, path, r"v\d{6}") if exists(spark, f"{path}/{n}/_SUCCESS")]
    return f"{path}/{max(done)}" if done else None


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a new version beside the old ones; it counts once its success mark is there. Older versions than `keep` are removed."""
    spark = df.sparkSession
    at = current(spark, path)
    n = int(at[-6:]) + 1 if at else 1
    out = f"{path}/v{n:06d}"
    df.write.mode("overwrite").parquet(out)
    fs, _ = _fs(spark, path)
    for name, _ in list_files(spark, path, r"v\d{6}"):
        if int(name[1:]) <= n - keep:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return out


def append_new(docs: DataFrame, path: str, key: str) -> int:
    """Adds the rows whose key the growing table doesn't hold yet, one per key, as a further part; returns how many. Rows without a key
    are left out. What is there is read for its keys only and never written again."""
    fresh = docs.where(F.col(key).isNotNull()).dropDuplicates([key])
    if parts(docs.sparkSession, path):
        fresh = fresh.join(read_parts(docs.sparkSession, path).select(key), key, "left_anti").select(*docs.columns)
    return add_part(fresh, path)


def build_table(spark: SparkSession, source: str, path: str, schema: T.StructType | str | None = None) -> dict[str, int]:
    """Loads parquet under `source` into a new version of the table at `path` and returns its rows and columns; loading again replaces it."""
    df = read_table(spark, source, schema)
    rows = Observation()
    publish(df.observe(rows, F.count(F.lit(1)).alias("n")), path)
    return {"rows": rows.get["n"], "columns": len(df.columns)}


def catalogue(spark: SparkSession) -> list[tuple[str, int]]:
    """(name, columns) of all registered views and tables, by name."""
    return sorted((t.name, len(spark.catalog.listColumns(t.name))) for t in spark.catalog.listTables())


def write_document(spark: SparkSession, path: str, meta: dict, stats: DataFrame, results: DataFrame) -> None:
    """One JSON document {meta, stats, results}, as one file below `path`; meant for reports, whose frames fit one file."""
    s = stats.agg(F.first(F.struct(*stats.columns)).alias("stats"))
    r = results.agg(F.collect_list(F.struct(*results.columns)).alias("results"))
    one = s.crossJoin(r).withColumn("meta", F.create_map(*[F.lit(str(x)) for kv in meta.items() for x in kv]))
    one.select("meta", "stats", "results").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by year, sorted by code and date within files, so ranges prune folders and row groups."""
    b = bars.withColumn("year", F.year("date"))
    b.repartition("year", F.pmod(F.xxhash64("code"), F.lit(16))).sortWithinPartitions("code", "date").write.mode("overwrite").partitionBy("year").parquet(path)


def write_json_lines(df: DataFrame, path: str, null_columns: dict[str, str] | None = None) -> None:
    """One JSON object a line, null fields written out; `null_columns` adds columns of nulls by name and type."""
    for name, kind in (null_columns or {}).items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, broken ones give nulls."""
    return spark.read.schema(schema).json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON document each, with the file's name in `_file`."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def standardise(df: DataFrame, code: str, names: dict[str, str], time_columns: tuple[str, ...] = ("date", "trade_date", "日期", "time", "datetime"), extra: dict[str, Column] | None = None) -> DataFrame:
    """A vendor frame under common names: renames those of `names` that are present, `date` from the first time column that
    is (rows without a readable one are left out), `code` added, and `extra` columns."""
    df = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    times = [c for c in time_columns if c in df.columns]
    if not times:
        raise ValueError("no time column")
    text = F.col(times[0]).cast("string")
    date = F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy/MM/dd"))
    out = df.withColumns({"_date": date, "code": F.lit(code), **(extra or {})}).drop(*times).withColumnRenamed("_date", "date")
    return out.where(F.col("date").isNotNull())
