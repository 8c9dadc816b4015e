"""Column-level data-quality profile from unpivoted column-value counts.

One scan: all columns are unpivoted with Expand, which stays inside codegen, to numbers and hashed keys and counted
per (column, load, value) with map-side combine, so a hot value (a constant, null) costs one row per task. That shuffle is the
only one that grows with the table. Missing shares, distinct counts, ranges and population stability come from counts per
magnitude bin, which are few whatever the rows; for the medians a second scan keeps the values of the bins they lie in.
Texts are keyed by two hashes, 96 bits in all, and never leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

_DOUBLE = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)
_LONG = (T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)
MISSING, MALFORMED = -1, 1  # flags of a value; 0 is a plain one
TEXT_BINS = 16
FEW_GROUPS = 100_000  # (column, load) pairs whose median bins are sent to every task


def _kind(t: T.DataType) -> str:
    return "double" if isinstance(t, _DOUBLE) else "bigint" if isinstance(t, _LONG) else "string"


def text_bin(t: Column) -> Column:
    """One of TEXT_BINS bins by a text's first and last character and its length: what changes when a writing changes."""
    return (F.ascii(t) * 31 + F.ascii(F.right(t, F.lit(1))) + F.length(t)) % TEXT_BINS


def _cell(name: str, t: T.DataType, rule: object | None) -> Column:
    """(x, k, k2, bin, flag) of a column's value: x a number for numbers, days or microseconds; k and k2 a key; bin of a text; flag.
    NaN, null and blank texts are missing."""
    c, kind = F.col(f"`{name}`"), _kind(t)
    zero, none = F.lit(0), F.lit(None).cast("double")
    if kind == "double":
        x = c.cast("double")
        missing = x.isNull() | F.isnan(x)
        x, k, k2, b = F.when(x == 0, F.lit(0.0)).otherwise(x), zero.cast("bigint"), zero, zero  # -0.0 and 0.0 are one value
    elif kind == "bigint":
        k = F.unix_date(c).cast("bigint") if isinstance(t, T.DateType) else F.unix_micros(c.cast("timestamp")) if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else c
        missing, x, k2, b = k.isNull(), k.cast("double"), zero, zero
    else:
        text = F.to_json(c) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        missing = text.isNull() | ~text.rlike(r"[^\s\u3000]")
        x, k, k2, b = none, F.xxhash64(text), F.hash(text), text_bin(text)
    bad = ~rule(c.cast("string")) if rule is not None else F.lit(False)
    flag = F.when(missing, MISSING).when(F.coalesce(bad, F.lit(False)), MALFORMED).otherwise(0)
    there = lambda v: F.when(~missing, v)
    return F.struct(there(x).alias("x"), there(k).alias("k"), there(k2).alias("k2"), there(b).cast("int").alias("b"), flag.cast("tinyint").alias("flag"))


def unpivoted(df: DataFrame, load: str, columns: list[str], valid: dict[str, object] | None = None, first: int = 0) -> DataFrame:
    """(column_no, load, x, k, k2, b, flag): every cell of the columns, which are numbered from `first` on.

    `valid` maps a column to a function from its text column to a boolean column; a non-missing value that isn't valid is malformed.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [_cell(c, types[c], (valid or {}).get(c)).alias(f"c{i}") for i, c in enumerate(columns, first)]
    return _long(df, load, cells, "v").select("column_no", "load", "v.*")


def numbers(df: DataFrame, load: str, columns: list[str], first: int = 0) -> DataFrame | None:
    """(column_no, load, value): the numbers that are there, by the same column numbers; None without a column of numbers."""
    types = {f.name: f.dataType for f in df.schema.fields}
    own = [(i, c) for i, c in enumerate(columns, first) if _kind(types[c]) != "string"]
    if not own:
        return None
    return _long(df, load, [_cell(c, types[c], None)["x"].alias(f"c{i}") for i, c in own], "value").where("value is not null")


def _long(df: DataFrame, load: str, cells: list[Column], name: str) -> DataFrame:
    wide = df.select(F.col(f"`{load}`").cast("bigint").alias("load"), *cells)
    long = wide.unpivot(["load"], wide.columns[1:], "_c", name)
    return long.select(F.substring("_c", 2, 9).cast("int").alias("column_no"), "load", name)


def magnitude_bin(x: Column) -> Column:
    """Monotone bin of a number: sign and 1/16 octaves; the same for any data, so loads are comparable."""
    steps = F.floor(F.log2(F.abs(x)) * 16 + 1e-9).cast("int") + 20000  # powers of two lie on an edge: nudged, whatever the library
    return F.when(x == 0, F.lit(0)).when(x > 0, steps).otherwise(-steps)


def ranked_values(freq: DataFrame, by: list[str], ranks: dict[str, Column], bins: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(by, names of `ranks`): the values that stand at 1-based ranks of each group's ascending order, weighted by `n`.

    A rank is an expression in `_all`, the group's size without nulls. Counts per magnitude bin locate the bins that hold
    the ranks; only their values are then ordered, so no group is ever sorted or held as a whole. `bins` holds these counts
    (by, _b, _n) where they are known already. With `few`, the groups are so few that their bins are sent to all values.
    """
    f = freq.where(F.col("value").isNotNull()).select(*by, F.col("value").cast("double").alias("value"), "n").withColumn("_b", magnitude_bin(F.col("value")))
    bins = f.groupBy(*by, "_b").agg(F.sum("n").alias("_n")) if bins is None else bins
    w = Window.partitionBy(*by)
    up = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_to", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(w)).withColumns({f"_r{i}": r.cast("bigint") for i, r in enumerate(ranks.values())})
    before = F.col("_to") - F.col("_n")
    holds = F.lit(False)
    for i in range(len(ranks)):
        holds = holds | ((F.col("_to") >= F.col(f"_r{i}")) & (before < F.col(f"_r{i}")))
    mid = bins.where(holds).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_b").alias("_mb"), before.alias("_before"), *[f"_r{i}" for i in range(len(ranks))])
    on = F.col("_b") == F.col("_mb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    near = f.join(F.broadcast(mid) if few else mid, on)
    near = near.groupBy(*by, "_b", "value", "_before", *[f"_r{i}" for i in range(len(ranks))]).agg(F.sum("n").alias("n"))
    inside = near.withColumn("_at", F.col("_before") + F.sum("n").over(Window.partitionBy(*by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.groupBy(*by).agg(*[F.min(F.when(F.col("_at") >= F.col(f"_r{i}"), F.col("value"))).alias(name) for i, name in enumerate(ranks)])


def quantiles(freq: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, names of `shares`): exact quantiles with linear interpolation; groups without a value don't appear."""
    ranks, at = {}, {}
    for i, (name, p) in enumerate(shares.items()):
        ranks[f"_lo{i}"] = F.floor((F.col("_all") - 1) * p) + 1
        ranks[f"_hi{i}"] = F.ceil((F.col("_all") - 1) * p) + 1
        at[name] = p
    v = ranked_values(freq, by, ranks)
    total = freq.where(F.col("value").isNotNull()).groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.sum("n").alias("_all"))
    if all(p == 0.5 for p in shares.values()):  # both middle values weigh the same, or are one
        return v.select(*by, *[((F.col(f"_lo{i}") + F.col(f"_hi{i}")) / 2).alias(n) for i, n in enumerate(shares)])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    v = v.join(total, on)
    part = lambda p: (F.col("_all") - 1) * p - F.floor((F.col("_all") - 1) * p)
    return v.select(*by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(p)).alias(n) for i, (n, p) in enumerate(at.items())])


def profile(df: DataFrame, table_name: str, load: str, columns: list[str] | None = None, valid: dict[str, object] | None = None) -> DataFrame:
    """profile_tables of one table; without `columns`, of all but the load's."""
    return profile_tables([(df, table_name, columns or [c for c in df.columns if c != load], valid or {})], load)


def profile_tables(tables: list[tuple[DataFrame, str, list[str], dict]], load: str) -> DataFrame:
    """One row per (table, column, load): rows, missing, malformed, distinct, least and greatest value, median, PSI.

    `tables` holds (frame, name, columns, rules) each; they go through the same few jobs. least/greatest/median are numbers and
    null for text (dates count in days, times in microseconds since 1970). `psi` is the population stability index of the
    load's values against all loads together, over octaves of numbers or text_bin, missing and malformed values being bins
    of their own. A null load is a load of its own. An empty table gives no rows.
    """
    by, names, cells, values = ["column_no", "load"], [], None, None
    for df, table_name, columns, valid in tables:
        own, own_values = unpivoted(df, load, columns, valid, len(names)), numbers(df, load, columns, len(names))
        cells = own if cells is None else cells.unionByName(own)
        values = own_values if values is None else values if own_values is None else values.unionByName(own_values)
        names += [(table_name, c) for c in columns]
    counts = cells.groupBy(*by, "x", "k", "k2", "b", "flag").agg(F.count(F.lit(1)).alias("n"))
    plain = F.col("flag") != MISSING
    b = F.when(F.col("x").isNotNull(), magnitude_bin(F.col("x"))).otherwise(F.col("b"))
    bins = counts.groupBy(*by, "flag", b.alias("_b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_distinct"), F.min("x").alias("_least"), F.max("x").alias("_greatest"))
    bins = cut(bins)
    stats = bins.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~plain, F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.col("flag") == MALFORMED, F.col("n")).otherwise(0)).alias("n_malformed"),
        F.sum(F.when(plain, F.col("_distinct")).otherwise(0)).alias("n_distinct"),
        F.min("_least").alias("least"), F.max("_greatest").alias("greatest"),
    )
    moved = _psi(bins).select(F.col("column_no").alias("_pc"), F.col("load").alias("_pl"), "psi")
    out = stats.join(moved, (F.col("column_no") == F.col("_pc")) & F.col("load").eqNullSafe(F.col("_pl")), "left")
    if values is None:
        out = out.withColumn("median", F.lit(None).cast("double"))
    else:
        sizes = bins.where(F.col("_least").isNotNull()).groupBy(*by, "_b").agg(F.sum("n").alias("_n"))
        half = (F.col("_all") - 1) * 0.5
        mid = ranked_values(values.withColumn("n", F.lit(1)), by, {"_lo": F.floor(half) + 1, "_hi": F.ceil(half) + 1}, sizes, sizes_of(bins, by) <= FEW_GROUPS)
        mid = mid.select(F.col("column_no").alias("_mc"), F.col("load").alias("_ml"), ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))
        out = out.join(mid, (F.col("column_no") == F.col("_mc")) & F.col("load").eqNullSafe(F.col("_ml")), "left")
    known = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in names]), F.col("column_no") + 1)
    return out.select(known["t"].alias("table_name"), known["c"].alias("column_name"), F.col("load").alias("load_id"), "n_rows", "n_missing", "n_malformed", "n_distinct", "least", "greatest", "median", "psi")


def sizes_of(counts: DataFrame, by: list[str]) -> int:
    return counts.select(*by).distinct().count()


def _psi(counts: DataFrame) -> DataFrame:
    """Population stability index of each load against all loads; a bin empty on one side counts as 1e-4."""
    octave = F.when(F.col("flag") == 0, F.when(F.col("_least").isNotNull(), F.floor(F.col("_b") / 16)).otherwise(F.col("_b")))
    bins = counts.groupBy("column_no", "load", "flag", octave.alias("_o")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("column_no")
    bins = bins.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("column_no", "load")))
    bins = bins.withColumn("q", F.sum("n").over(Window.partitionBy("column_no", "flag", "_o")) / F.sum("n").over(w))
    # Bins absent from a load have p = 1e-4; their share of the sum is the total over all bins less that of the present ones.
    absent = lambda q: (q - 1e-4) * F.ln(q / 1e-4)
    every = bins.select("column_no", "flag", "_o", "q").distinct().groupBy("column_no").agg(F.sum(absent(F.col("q"))).alias("_all")).withColumnRenamed("column_no", "_c")
    own = bins.groupBy("column_no", "load").agg(
        F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("_in"), F.sum(absent(F.col("q"))).alias("_seen")
    )
    return own.join(every, own["column_no"] == every["_c"]).select("column_no", "load", (F.col("_in") + F.col("_all") - F.col("_seen")).alias("psi"))


def compared_loads(profiles: DataFrame, shares: tuple[str, ...] = ("n_missing", "n_malformed"), margin: float = 0.10, ratio: float = 3.0) -> DataFrame:
    """Profiles' rows, one a load, with `deviates`: whether the load's share of missing or malformed values, or its median, departs from the other loads.

    A share departs when it is more than `margin` above the median share over the table's loads; a median when it is over `ratio` times
    or under 1/`ratio` of the median of the loads' medians. A null median (no value) departs from nothing. The stability
    index stands beside, it can't decide: against a load that holds most rows, or its like, a departing load is stable.
    """
    w = Window.partitionBy("table_name", "column_name")
    out = F.lit(False)
    for s in shares:
        share = F.col(s) / F.col("n_rows")
        out = out | (share > F.percentile(share, F.lit(0.5)).over(w) + margin)
    mid = F.percentile("median", F.lit(0.5)).over(w)
    out = out | F.coalesce((F.col("median") > mid * ratio) | (F.col("median") < mid / ratio), F.lit(False))
    return profiles.withColumn("deviates", out)
