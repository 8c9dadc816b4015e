"""Bars, reports and news: cleaning, range and latest-n queries, indicators.

Windows run per symbol over clean bars, at most one row per symbol and calendar day, so a window
partition is bounded by the calendar whatever the number of raw rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import hk_code, six_digit
from ..functions.numbers import adjusted, finite, turnover
from .asof import forward_fill

PRICES = ["open", "high", "low", "close", "preclose"]
NUMBERS = [*PRICES, "volume", "amount", "turn", "pct_chg", "hfq_factor"]


def clean_bars(bars: DataFrame, key: str = "bar_id") -> DataFrame:
    """One bar per (symbol, date), the one with the smallest key; NaN and infinities become null.

    Rows with an unreadable code or no date are left out. Extra columns are kept.
    """
    b = bars.withColumns({c: finite(F.col(c)) for c in NUMBERS if c in bars.columns}).withColumn("symbol", six_digit(F.col("code")))
    b = b.where(F.col("symbol").isNotNull() & F.col("date").isNotNull())
    first = b.groupBy("symbol", "date").agg(F.min_by(F.struct(*[c for c in b.columns if c not in ("symbol", "date")]), key).alias("_r"))
    return first.select("symbol", "date", "_r.*")


TABLES = {"hfq": "daily_hfq", "raw": "daily_raw"}  # bars by adjustment


def table_of(adjust: str) -> str:
    """The table of an adjustment; any other than those known is refused, so no name reaches a query unchecked."""
    if adjust not in TABLES:
        raise ValueError(f"unknown adjustment: {adjust!r}")
    return TABLES[adjust]


def bar_range(bars: DataFrame, code: str, start: str | None = None, end: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Bars of one code, whichever way it is written, within inclusive bounds, by date.

    The digits and the bounds are filters on the stored columns, so they reach the Parquet scan; where the bars lie in
    folders by `year` (files.write_bars) only those of the bounds are read.
    """
    six = re.search(r"(?<!\d)\d{1,6}(?!\d)", code)
    if not six:
        raise ValueError(f"no code: {code!r}")
    unknown = set(fields or []) - set(bars.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    digits = six[0].zfill(6)
    out = bars.where(F.col("code").contains(digits.lstrip("0") or "0") & (six_digit(F.col("code")) == digits))
    for bound, op in ((start, "ge"), (end, "le")):
        if bound:
            out = out.where(F.col("date") >= F.lit(bound).cast("date") if op == "ge" else F.col("date") <= F.lit(bound).cast("date"))
            if "year" in bars.columns:
                out = out.where(F.col("year") >= int(bound[:4]) if op == "ge" else F.col("year") <= int(bound[:4]))
    return (out.select(*fields) if fields else out).orderBy(F.col("date").asc_nulls_last())


def merge_pages(bars: DataFrame, keys: list[str], page: str, order: str) -> DataFrame:
    """One row per key of a paged history: that of the earliest page, within a page the one with the least `order`; null keys are equal to each other."""
    rest = [c for c in bars.columns if c not in keys]
    return bars.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(page, order)).alias("_r")).select(*keys, "_r.*")


def filled_change(bars: DataFrame) -> DataFrame:
    """`bars` with `change`: pct_chg as recorded, or, for a symbol that has none at all, the percent change of its closes."""
    w = Window.partitionBy("symbol")
    own = (F.try_divide("close", F.lag("close").over(w.orderBy("date"))) - 1) * 100
    return bars.withColumn("change", F.when(F.count("pct_chg").over(w) > 0, F.col("pct_chg")).otherwise(own))


def latest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order; WindowGroupLimit keeps n rows a task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least `order` per key; null keys are equal to each other. Aggregates map-side, so a hot key is one row a task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def _last(n: int) -> Window:
    return Window.partitionBy("symbol").orderBy("date").rowsBetween(-(n - 1), 0)


def _full(value: Column, n: int, of: str = "close") -> Column:
    """`value` where the window of n rows is full."""
    return F.when(F.count(F.lit(1)).over(_last(n)) >= n, value)


def rolling_indicators(bars: DataFrame) -> DataFrame:
    """Per bar: moving averages, volume ratio, annualised volatility, support, resistance, n-row returns; null until a window is full.

    The volume ratio holds the last 5 bars against the 60 before, or against the whole history while that is shorter than 65 bars.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars.withColumn("_ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    base = Window.partitionBy("symbol").orderBy("date").rowsBetween(-64, -5)
    out = {f"sma{n}": _full(F.avg("close").over(_last(n)), n) for n in (5, 20, 60)}
    out["ma7_open"] = F.avg("close").over(_last(7))  # no minimum number of rows
    far = F.count(F.lit(1)).over(_last(65)) >= 65
    usual = F.when(far, F.avg("volume").over(base)).otherwise(F.avg("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out["volume_ratio"] = _full(F.try_divide(F.avg("volume").over(_last(5)), usual), 5)
    out["volatility"] = _full(F.stddev_samp("_ret").over(_last(20)) * F.sqrt(F.lit(244.0)), 21)
    out["support"], out["resistance"] = F.min("low").over(_last(60)), F.max("high").over(_last(60))
    for n in (5, 20, 60):
        out[f"ret_{n}d"] = (F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1) * 100
    return b.withColumns(out).drop("_ret")


def fold(values: Column, alpha: float) -> Column:
    """Exponential smoothing of an ordered array of doubles, seeded with its first value; null for an empty one."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.try_element_at(values, F.lit(1)), lambda acc, x: acc * (1 - alpha) + x * alpha))


def smoothed_indicators(bars: DataFrame, span: int = 12, n: int = 14) -> DataFrame:
    """Per symbol at its last bar: ema, rsi (100 without losses) and atr by Wilder's smoothing, n_bars.

    Bars without a close, high or low are skipped. Null with fewer than `span`, n + 1 bars.
    """
    b = bars.where("close is not null and high is not null and low is not null").withColumn("_pc", F.lag("close").over(Window.partitionBy("symbol").orderBy("date")))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))
    rows = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close", (F.col("close") - F.col("_pc")).alias("d"), tr.alias("tr")))).alias("_s"), F.count(F.lit(1)).alias("n_bars"))
    s = F.col("_s")
    moves = F.slice(F.transform(s, lambda x: x["d"]), F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
    up = fold(F.transform(moves, lambda d: F.greatest(d, F.lit(0.0))), 1.0 / n)
    down = fold(F.transform(moves, lambda d: F.greatest(-d, F.lit(0.0))), 1.0 / n)
    rows = rows.select("symbol", "n_bars", fold(F.transform(s, lambda x: x["close"]), 2.0 / (span + 1)).alias("ema"), up.alias("_u"), down.alias("_d"), fold(F.transform(s, lambda x: x["tr"]), 1.0 / n).alias("atr"))
    rsi = F.when(F.col("_d") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("_u"), F.col("_d"))))
    full = F.col("n_bars") >= n + 1
    return rows.select("symbol", "n_bars", F.when(F.col("n_bars") >= span, F.col("ema")).alias("ema"), F.when(full, rsi).alias("rsi"), F.when(full, F.col("atr")).alias("atr"))


def snapshot(bars: DataFrame) -> DataFrame:
    """One row per symbol: its last bar with all indicators, atr in percent of the close, and the number of bars. No rows without bars."""
    last = latest(rolling_indicators(bars), ["symbol"], [F.col("date").desc()], 1)
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    out = last.join(smoothed_indicators(bars).drop("n_bars"), "symbol", "left").join(n, "symbol")
    return out.withColumn("atr_pct", F.try_divide(F.col("atr"), F.col("close")) * 100)


def latest_ascending(bars: DataFrame, as_of: str, n: int) -> DataFrame:
    """Each symbol's last n bars not after `as_of`, oldest first: with `nth`, 1 for the oldest of them."""
    kept = latest(bars.where(F.col("date") <= F.lit(as_of).cast("date")), ["symbol"], [F.col("date").desc()], n)
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))


def look_back(as_of: Column, days: int) -> Column:
    """The day from which on `days` bars before `as_of` are read: 1.6 calendar days a bar."""
    return F.date_sub(as_of, int(days * 1.6))


def gaps(bars: DataFrame, max_days: int = 15) -> DataFrame:
    """(symbol, date, gap_days) where more than max_days lie between a bar and the one before."""
    w = Window.partitionBy("symbol").orderBy("date")
    return bars.withColumn("gap_days", F.date_diff("date", F.lag("date").over(w))).where(F.col("gap_days") > max_days).select("symbol", "date", "gap_days")


def return_outliers(bars: DataFrame, k: float = 5.0, n: int = 20) -> DataFrame:
    """Bars whose return lies more than k standard deviations from the mean of the last n returns, its own included."""
    w = Window.partitionBy("symbol").orderBy("date")
    r = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    m, s = F.avg("ret").over(_last(n)), F.stddev_samp("ret").over(_last(n))
    return r.withColumns({"_m": m, "_s": s}).where(F.abs(F.col("ret") - F.col("_m")) > k * F.col("_s")).select("symbol", "date", "ret")


RULES = {
    "price_missing": "open is null or high is null or low is null or close is null",
    "price_not_positive": "open <= 0 or high <= 0 or low <= 0 or close <= 0",
    "volume_negative": "volume < 0",
    "high_below_low": "high < low",
    "turn_negative": "turn < 0",
}


def violations(bars: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(rule, symbol, n, first_date, last_date): bars that break a rule, per symbol; one pass over the bars for all rules."""
    rules = rules or RULES
    hits = F.filter(F.array(*[F.when(F.expr(e), F.lit(r)) for r, e in rules.items()]), lambda x: x.isNotNull())
    rows = bars.select("symbol", "date", F.explode(hits).alias("rule"))
    return rows.groupBy("rule", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


CHECKS = {  # rule: (severity, condition on one bar)
    "row_empty": ("error", "open is null and high is null and low is null and close is null and volume is null"),
    "price_not_positive": ("error", "open <= 0 or high <= 0 or low <= 0 or close <= 0"),
    "price_missing": ("error", "open is null or high is null or low is null or close is null"),
    "volume_negative": ("error", "volume < 0"),
    "volume_missing": ("error", "volume is null"),
    "high_below_low": ("error", "high < low"),
    "turn_negative": ("error", "turn < 0"),
    "turn_above_100": ("warning", "turn > 100"),
    "date_repeated": ("error", "copies > 1"),
    "gap": ("error", "gap_days > 15"),
    "price_jump": ("warning", "jump"),
}


def validate(bars: DataFrame, deviations: float = 5.0) -> DataFrame:
    """(symbol, severity, rule, n, first_date): what the validator objects to, one pass over cleaned bars for all rules.

    Repeated dates are counted in `copies` where the bars carry it. A jump is a return more than `deviations` standard deviations
    from the mean of the last 20 returns, its own included. Errors come first, then by rule and symbol, in column `nth`. Symbols
    without an objection don't appear.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars if "copies" in bars.columns else bars.withColumn("copies", F.lit(1))
    b = b.withColumns({"gap_days": F.date_diff("date", F.lag("date").over(w)), "_ret": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1})
    b = b.withColumn("jump", F.abs(F.col("_ret") - F.avg("_ret").over(_last(20))) > deviations * F.stddev_samp("_ret").over(_last(20)))
    hits = F.filter(F.array(*[F.when(F.expr(e), F.struct(F.lit(sev).alias("severity"), F.lit(r).alias("rule"))) for r, (sev, e) in CHECKS.items()]), lambda x: x.isNotNull())
    rows = b.select("symbol", "date", F.explode(hits).alias("h"))
    out = rows.groupBy("symbol", "h.severity", "h.rule").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))
    order = Window.partitionBy("symbol").orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "rule")
    return out.withColumn("nth", F.row_number().over(order))


def liquid(bars: DataFrame, by: str, amount: str, least: float) -> DataFrame:
    """The bars of groups whose mean amount reaches `least`; null amounts are left out of the mean. Sums move, not bars."""
    kept = bars.groupBy(F.col(by).alias("_g")).agg(F.avg(amount).alias("_m")).where(F.col("_m") >= least).select("_g")
    return bars.join(kept, F.col(by) == F.col("_g"), "left_semi")


def without_special_treatment(bars: DataFrame) -> DataFrame:
    """Bars whose is_st isn't 1; an unknown flag counts as 0."""
    return bars.where(F.coalesce(F.col("is_st"), F.lit(0)) != 1)


def coverage(bars: DataFrame) -> DataFrame:
    """(symbol, n_days, n_business_days, coverage): distinct days against weekdays between the first and last."""
    d = bars.groupBy("symbol").agg(F.countDistinct("date").alias("n_days"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = F.date_diff("_b", "_a") + 1
    # Whole weeks hold five weekdays; the rest is counted one by one, at most six days.
    rest = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: (i < days % 7) & (F.weekday(F.date_add(F.col("_a"), i.cast("int"))) < 5))
    d = d.withColumn("n_business_days", F.floor(days / 7) * 5 + F.size(rest))
    return d.select("symbol", "n_days", "n_business_days", F.try_divide("n_days", "n_business_days").alias("coverage"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def assembled(raw: DataFrame, factors: DataFrame, shares: DataFrame) -> DataFrame:
    """Raw bars with `factor` (the last adjustment factor known on the day, 1 before the first), adjusted prices to cents, and
    `turn` by the outstanding ten thousands of shares valid on the day (null before the first).

    `raw` holds symbol, date, the prices and volume in shares; `factors` symbol, date, factor; `shares` symbol, date, outstanding_share.
    """
    b = forward_fill(raw, factors, ["symbol"], "date", "factor", 1.0)
    b = forward_fill(b, shares, ["symbol"], "date", "outstanding_share")
    prices = {f"{c}_adjusted": adjusted(F.col(c), F.col("factor")) for c in ("open", "high", "low", "close") if c in raw.columns}
    return b.withColumns({**prices, "turn": turnover(F.col("volume"), F.col("outstanding_share"))})


def with_lots(stocks: DataFrame, lots: dict[str, int], code: str = "code", default: int = 100) -> DataFrame:
    """`stocks` with `lot`, the shares of a board lot of their five-digit code; `default` where it isn't listed."""
    if not lots:
        return stocks.withColumn("lot", F.lit(default))
    known = F.create_map(*[F.lit(x) for kv in lots.items() for x in kv])
    return stocks.withColumn("lot", F.coalesce(F.try_element_at(known, hk_code(F.col(code))), F.lit(default)))
