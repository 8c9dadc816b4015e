"""Quantities recorded in different units, brought to shares, yuan and percent.

Two cases. Texts state their unit in the value or in a note: column expressions read it. Numbers
state none: the three fields of a bar measure one thing, the number of shares traded (volume;
amount / price; turnover x shares outstanding), so on a log10 scale they differ by sums of known
conversion factors. A mixture over the factor of each field is fitted by EM, its weights depending on
source and period, and units are assigned by posterior; the posterior is returned, and a value under
`sure` is flagged as uncertain. A field that disagrees with the others by no known factor is
a fault, not a unit: each pairwise term has an outlier component, so its unit is then the weights'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# log10 of (recorded / standard) for each unit the sources are known to use.
UNITS = {
    "volume": {"shares": 0.0, "lots": -2.0, "thousand shares": -3.0, "10k shares": -4.0, "million shares": -6.0},
    "amount": {"yuan": 0.0, "thousand yuan": -3.0, "10k yuan": -4.0, "million yuan": -6.0, "100m yuan": -8.0},
    "turn": {"percent": 0.0, "fraction": -2.0, "per mille": 1.0, "basis point": 2.0},
}
FIELDS = list(UNITS)
OFFSETS = [np.array(list(UNITS[f].values())) for f in FIELDS]
SIZES = [len(o) for o in OFFSETS]
SIGMA = {(0, 1): 0.02, (0, 2): 0.0005, (1, 2): 0.02}
OUTLIER, WIDTH, LEVEL, LEVEL_SIGMA, PRIOR_ROWS = 0.005, 14.0, -2.0, 0.8, 50.0


CELLS = int(np.prod(SIZES))
STEP, FLOOR = 0.25, -80  # log likelihoods are fitted in steps of STEP, from FLOOR steps below a row's best unit down as one
MAX_ROUNDS, SETTLED = 500, 1e-7  # of the fit; log likelihood a row that a round must still gain
FEW_WEIGHTS = 100_000  # rows of weights that are sent to every task


def likelihood(x: np.ndarray, level: np.ndarray) -> np.ndarray:
    """(n, CELLS) log likelihoods of the joint units of the three fields. x: (n, 3) log10 share counts as recorded, NaN if missing;
    level: (n,) log10 shares outstanding or NaN."""
    s = [x[:, [i]] - OFFSETS[i] for i in range(3)]
    unary = []
    for i in range(3):
        z = (s[i] - level[:, None] - LEVEL) / LEVEL_SIGMA
        unary.append(np.where(np.isfinite(z), -np.log1p(z * z), 0.0))  # heavy tails: a real surge isn't a unit
    total = unary[0][:, :, None, None] + unary[1][:, None, :, None] + unary[2][:, None, None, :]
    for (i, j), sd in SIGMA.items():
        d = (s[i][:, :, None] - s[j][:, None, :]) / sd
        p = np.log((1 - OUTLIER) * np.exp(-0.5 * np.minimum(d * d, 1400)) / (sd * 2.5066) + OUTLIER / WIDTH)
        p = np.where(np.isfinite(d), p, 0.0)
        total = total + (p[:, :, :, None] if (i, j) == (0, 1) else p[:, :, None, :] if (i, j) == (0, 2) else p[:, None, :, :])
    return total.reshape(len(x), -1)


def joint_weights(w: np.ndarray) -> np.ndarray:
    """(n, CELLS) log prior of the joint units from (n, sum of SIZES) weights of the fields."""
    a, b, c = (np.log(np.maximum(p, 1e-9)) for p in np.split(w, np.cumsum(SIZES)[:-1], axis=1))
    return (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(len(w), -1)


def margins(post: np.ndarray) -> list[np.ndarray]:
    post = post.reshape(len(post), *SIZES)
    return [post.sum(axis=tuple(a for a in (1, 2, 3) if a != i + 1)) for i in range(3)]


def _joint(x: np.ndarray, level: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Posterior of each field's unit, three arrays (n, size); a missing field keeps its weights."""
    flat = likelihood(x, level) + joint_weights(weights)
    flat = np.exp(flat - flat.max(axis=1, keepdims=True))
    return margins(flat / flat.sum(axis=1, keepdims=True))


def measured(bars: DataFrame) -> DataFrame:
    """Adds _x0.._x2 (log10 share counts by volume, amount, turn), _level, _src, _per.

    `bars` holds volume, amount, turn, open, high, low, close, hfq_factor, source, date and `shares`
    (outstanding, may be null). Null, NaN, 0 and negative amounts or turns count as missing; of a negative
    volume the absolute value is used.
    """
    good = lambda c: F.when(F.isnan(c) | (c == 0), None).otherwise(c)
    pos = lambda c: F.when(c > 0, c)
    prices = F.array_sort(F.filter(F.array(*[pos(good(F.col(c))) for c in ("open", "high", "low", "close")]), lambda v: v.isNotNull()))
    price = F.try_divide(F.try_element_at(prices, F.greatest(F.lit(1), F.floor((F.size(prices) + 1) / 2)).cast("int")), pos(good(F.col("hfq_factor"))))
    shares = pos(good(F.col("shares")))
    return bars.withColumns({
        "_x0": F.log10(F.abs(good(F.col("volume")))),
        "_x1": F.log10(pos(good(F.col("amount"))) / price),
        "_x2": F.log10(pos(good(F.col("turn"))) / 100 * shares),
        "_level": F.log10(shares),
        "_src": F.coalesce(F.lower(F.trim("source")), F.lit("")),
        "_per": F.coalesce(F.year("date") * 4 + F.quarter("date"), F.lit(0)),
    })


def settle(period: np.ndarray, like: np.ndarray, there: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(periods, their weights, rounds, log likelihood a row) of one source by EM, run until the likelihood settles.

    A row of `like` stands for n rows of one period; `there` tells which fields it has. A period's weights are drawn to its source's
    with the strength of PRIOR_ROWS rows.
    """
    periods, at = np.unique(period, return_inverse=True)
    w = np.tile(np.concatenate([[0.6] + [0.4 / (k - 1)] * (k - 1) for k in SIZES]), (len(periods), 1))
    cuts, before = np.cumsum([0, *SIZES]), -np.inf
    for rounds in range(1, MAX_ROUNDS + 1):
        flat = like + joint_weights(w)[at]
        top = flat.max(axis=1, keepdims=True)
        flat = np.exp(flat - top)
        total = flat.sum(axis=1, keepdims=True)
        now = float((n * (top + np.log(total))[:, 0]).sum() / n.sum())
        post = margins(flat / total)
        new = np.empty_like(w)
        for i, k in enumerate(SIZES):
            own = post[i] * (there[:, [i]] * n[:, None])
            s = np.column_stack([np.bincount(at, weights=own[:, j], minlength=len(periods)) for j in range(k)])
            share = (s.sum(axis=0) + 0.5 / k) / (s.sum() + 0.5)
            new[:, cuts[i] : cuts[i + 1]] = (s + PRIOR_ROWS * share) / (s.sum(axis=1, keepdims=True) + PRIOR_ROWS)
        w = new
        if now - before < SETTLED:
            break
        before = now
    return periods, w, rounds, now


def fit_weights(m: DataFrame) -> DataFrame:
    """EM over all rows of measured(): (_src, _per, _w, _rounds, _loglik), _w the unit weights of the three fields in turn.

    Rows whose likelihoods agree within STEP are alike for the fit; one pass counts them per source and period. What is left, a
    few thousand counts a source whatever the rows, is iterated until it settles.
    """
    slim = m.select("_src", "_per", "_x0", "_x1", "_x2", "_level")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = pdf[["_x0", "_x1", "_x2"]].to_numpy(float)
            like = likelihood(x, pdf["_level"].to_numpy(float))
            steps = np.maximum(np.round((like - like.max(axis=1, keepdims=True)) / STEP), FLOOR).astype(np.int8)
            there = np.isfinite(x)
            key = pd.DataFrame({"_src": pdf["_src"], "_per": pdf["_per"], "_like": [r.tobytes() for r in steps], "_there": there @ np.array([1, 2, 4])})
            yield key.groupby(list(key.columns)).size().reset_index(name="n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        like = np.frombuffer(b"".join(pdf["_like"]), np.int8).reshape(len(pdf), CELLS).astype(float) * STEP
        there = (pdf["_there"].to_numpy()[:, None] & np.array([1, 2, 4])) > 0
        periods, w, rounds, loglik = settle(pdf["_per"].to_numpy(), like, there, pdf["n"].to_numpy(float))
        return pd.DataFrame({"_src": pdf["_src"].iloc[0], "_per": periods.astype("int32"), "_w": w.tolist(), "_rounds": rounds, "_loglik": loglik})

    counts = slim.mapInPandas(count, "_src string, _per int, _like binary, _there int, n bigint")
    counts = counts.groupBy("_src", "_per", "_like", "_there").agg(F.sum("n").alias("n"))
    return cut(counts.groupBy("_src").applyInPandas(run, "_src string, _per int, _w array<double>, _rounds int, _loglik double"))


def infer_units(bars: DataFrame, sure: float = 0.9) -> DataFrame:
    """`bars` with `{field}_unit`, `{field}_p`, `{field}_std` for volume, amount and turn, and `unit_uncertain`.

    unit, p and std are null where the value is missing or 0 (std of 0 is 0). Faulty values keep their
    size: only the unit is removed. Needs the columns of measured(); the output columns replace any
    of the same name, as do its own that begin with an underscore.
    """
    m = measured(bars.drop("_w", "_a"))
    weights = fit_weights(m).select("_src", "_per", "_w")
    m = m.join(F.broadcast(weights) if weights.count() <= FEW_WEIGHTS else weights, ["_src", "_per"])
    names = [list(UNITS[f]) for f in FIELDS]

    @F.pandas_udf("struct<u0:int,p0:double,u1:int,p1:double,u2:int,p2:double>")
    def assign(x0: pd.Series, x1: pd.Series, x2: pd.Series, level: pd.Series, w: pd.Series) -> pd.DataFrame:
        x = np.column_stack([x0, x1, x2]).astype(float)
        weights = np.array(w.tolist(), dtype=float).reshape(len(x), sum(SIZES))
        out = {}
        for i, p in enumerate(_joint(x, level.to_numpy(float), weights)):
            out[f"u{i}"], out[f"p{i}"] = p.argmax(axis=1).astype("int32"), p.max(axis=1)
        return pd.DataFrame(out)

    m = m.withColumn("_a", assign("_x0", "_x1", "_x2", "_level", "_w"))
    cols: dict[str, Column] = {}
    unsure = F.lit(False)
    for i, f in enumerate(FIELDS):
        v = F.col(f).cast("double")
        there = v.isNotNull() & ~F.isnan(v) & (v != 0)
        unit = F.element_at(F.array(*[F.lit(u) for u in names[i]]), F.col(f"_a.u{i}") + 1)
        scale = F.element_at(F.array(*[F.lit(float(10 ** -o)) for o in OFFSETS[i]]), F.col(f"_a.u{i}") + 1)
        cols[f"{f}_unit"] = F.when(there, unit)
        cols[f"{f}_p"] = F.when(there, F.col(f"_a.p{i}"))
        cols[f"{f}_std"] = F.when(there, v * scale).when(v == 0, F.lit(0.0))
        unsure = unsure | (there & (F.col(f"_a.p{i}") < sure))
    cols["unit_uncertain"] = unsure
    return m.withColumns(cols).drop("_a", "_w")


# Unit words in texts and notes, longest first, and the factor to the standard unit.
WORDS = {
    "volume": [("million shares", 1e6), ("thousand lots", 1e5), ("m shares", 1e6), ("k shares", 1e3), ("k lots", 1e5), ("shares", 1.0), ("lots", 100.0), ("亿股", 1e8), ("万手", 1e6), ("万股", 1e4), ("千股", 1e3), ("百股", 100.0), ("手", 100.0), ("股", 1.0)],
    "amount": [("cny million", 1e6), ("rmb million", 1e6), ("cny mn", 1e6), ("cny bn", 1e9), ("百万元", 1e6), ("亿元", 1e8), ("万元", 1e4), ("千元", 1e3), ("rmb", 1.0), ("cny", 1.0), ("元", 1.0), ("亿", 1e8), ("万", 1e4)],
    "turn": [("percent", 1.0), ("per mille", 0.1), ("小数", 100.0), ("pct", 1.0), ("bps", 0.01), ("bp", 0.01), ("%", 1.0), ("‰", 0.1)],
}
NOTE_KEYS = {"volume": "量", "amount": "额", "turn": "换手"}


def plain(c: Column) -> Column:
    """Half-width lower-case text with simplified unit characters and single spaces."""
    wide = "０１２３４５６７８９．，％：＝；－＋￥　～萬億"
    t = F.lower(F.translate(c, wide, "0123456789.,%:=;-+¥ ~万亿"))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def read_quantity(text: Column, note: Column, field: str) -> tuple[Column, Column]:
    """(number, factor to the standard unit) of a text value; number null if it states none, factor null if no unit is named.

    Thousands separators, full-width digits and words round the number (约, ~, 合计) are allowed. A unit in the text
    beats one in the note; a bare currency sign means yuan where neither names a unit.
    """
    t = F.regexp_replace(plain(text), r"(?<=\d),(?=\d)", "")
    number = F.regexp_extract(t, r"([-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?)", 1).try_cast("double")
    after = F.trim(F.regexp_extract(t, r"\d(?:\.\d+)?(?:e[-+]?\d+)?\s*([^\d.]*)$", 1))

    table = F.create_map(*[F.lit(x) for pair in WORDS[field] for x in pair])
    any_word = "(" + "|".join(re.escape(w) for w, _ in WORDS[field]) + ")"  # longest first: the first alternative that fits wins

    def named(c: Column) -> Column:
        return F.try_element_at(table, F.regexp_extract(c, any_word, 1))

    key = NOTE_KEYS[field]
    own = F.trim(F.regexp_extract(plain(note), rf"{key}(?:单位)?[ :=]*([^;/|,，]+)", 1))
    factor = F.coalesce(named(after), named(own), F.when(F.instr(t, "¥") > 0, F.lit(1.0)) if field == "amount" else F.lit(None).cast("double"))
    return number, F.when(number.isNotNull(), factor)


FINE = 100  # bins a power of ten


def settle_factors(r: np.ndarray, n: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, width, share of outliers) of a mixture on the log10 ratios r, n rows each, with components at known offsets of one
    width: EM until the likelihood settles. The width starts at 0.05 and stays within 0.005 and 0.2."""
    w, sigma, out, before = np.full(len(offsets), 1 / len(offsets)), 0.05, 0.02, -np.inf
    d = r[:, None] - offsets
    for _ in range(MAX_ROUNDS):
        p = (1 - out) * w * np.exp(-0.5 * np.minimum((d / sigma) ** 2, 1400)) / (sigma * 2.5066)
        total = p.sum(axis=1) + out / WIDTH
        now = float((n * np.log(total)).sum() / n.sum())
        post = p / total[:, None] * n[:, None]
        inside = post.sum()
        w = (post.sum(axis=0) + 0.5 / len(w)) / (inside + 0.5)
        out = min(0.3, max(1e-3, 1 - inside / n.sum()))
        sigma = float(np.clip(np.sqrt(((post * d * d).sum() + 0.05**2) / (inside + 1)), 0.005, 0.2))
        if now - before < SETTLED:
            break
        before = now
    return w, sigma, out


def fit_factors(ratios: DataFrame) -> DataFrame:
    """(field_no, _fsrc, _fw, _fs, _fo): the mixtures of settle_factors per field and source over (field_no, _fsrc, r); rows become counts per bin first."""
    bins = ratios.groupBy("field_no", "_fsrc", F.round(F.col("r") * FINE).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["field_no"].iloc[0])
        offsets = -np.log10(np.array(sorted({v for _, v in WORDS[FIELDS[i]]})))
        w, sigma, out = settle_factors(pdf["bin"].to_numpy(float) / FINE, pdf["n"].to_numpy(float), offsets)
        return pd.DataFrame({"field_no": [i], "_fsrc": pdf["_fsrc"].iloc[:1].to_list(), "_fw": [w.tolist()], "_fs": [sigma], "_fo": [out]})

    return cut(bins.groupBy("field_no", "_fsrc").applyInPandas(run, "field_no int, _fsrc string, _fw array<double>, _fs double, _fo double"))


def quotes_to_standard(quotes: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Text quotes in common units: per field number, factor, std, and p, the probability of the unit.

    A unit that is named has p 1. Where none is, it is one of the words' factors: the ratio of the value to the reference (standard
    values of the same `keys`, columns volume_std, amount_std, turn_std) is a mixture over the known factors, fitted per
    field and source; p is the posterior. Without a reference the factor is 1 and p the weight that factor has in the source,
    0.5 where nothing could be fitted. Where `quotes` has a column `source`, a null one is a source of its own; where it has none, all are one.
    """
    out = quotes.withColumn("_fsrc", F.coalesce(F.lower(F.trim("source")), F.lit("")) if "source" in quotes.columns else F.lit(""))
    for f in FIELDS:
        number, factor = read_quantity(F.col(f"{f}_text"), F.col("unit_note"), f)
        out = out.withColumn(f"{f}_number", number).withColumn(f"{f}_factor", factor)
    ref = reference.groupBy(*keys).agg(*[F.expr(f"percentile_approx({f}_std, 0.5)").alias(f"_r{i}") for i, f in enumerate(FIELDS)])
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ref = ref.select(*renamed, *[f"_r{i}" for i in range(3)])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    out = out.join(ref, on, "left")
    ratio = lambda i, f: F.when((F.col(f"{f}_number") != 0) & (F.col(f"_r{i}") != 0), F.log10(F.abs(F.col(f"{f}_number") / F.col(f"_r{i}"))))
    out = out.withColumns({f"_q{i}": F.when(F.col(f"{f}_factor").isNull(), ratio(i, f)) for i, f in enumerate(FIELDS)}).drop(*[f"_k{i}" for i in range(len(keys))], *[f"_r{i}" for i in range(3)])
    out = cut(out)  # read twice: to fit and to assign
    open_ = F.filter(F.array(*[F.struct(F.lit(i).alias("field_no"), F.col(f"_q{i}").alias("r")) for i in range(3)]), lambda x: x["r"].isNotNull())
    fitted = fit_factors(out.select("_fsrc", F.explode(open_).alias("o")).select("_fsrc", "o.*"))
    few = fitted.count() <= FEW_WEIGHTS
    for i, f in enumerate(FIELDS):
        own = fitted.where(F.col("field_no") == i).select(F.col("_fsrc").alias("_s"), "_fw", "_fs", "_fo")
        out = out.join(F.broadcast(own) if few else own, F.col("_fsrc") == F.col("_s"), "left")
        factors = sorted({v for _, v in WORDS[f]})
        like = lambda v, w: F.struct((w * (1 - F.col("_fo")) * F.exp(-0.5 * F.pow((F.col(f"_q{i}") + F.log10(v)) / F.col("_fs"), F.lit(2.0))) / (F.col("_fs") * 2.5066)).alias("p"), v.alias("v"))  # noqa: E731, B023
        out = out.withColumn("_like", F.when(F.col(f"_q{i}").isNotNull(), F.zip_with(F.array(*[F.lit(v) for v in factors]), F.col("_fw"), like)))
        best = F.array_max("_like")
        total = F.aggregate("_like", F.col("_fo") / WIDTH, lambda acc, x: acc + x["p"])
        there = F.col(f"{f}_number").isNotNull()
        chosen = F.coalesce(F.col(f"{f}_factor"), best["v"], F.lit(1.0))
        usual = F.try_element_at("_fw", F.lit(factors.index(1.0) + 1))
        p = F.when(F.col(f"{f}_factor").isNotNull(), 1.0).otherwise(F.coalesce(best["p"] / total, usual, F.lit(0.5)))
        out = out.withColumns({f"{f}_p": F.when(there, p), f"{f}_factor": F.when(there, chosen), f"{f}_std": F.when(there, F.col(f"{f}_number") * chosen)}).drop("_like", "_s", "_fw", "_fs", "_fo")
    return out.drop("_fsrc", *[f"_q{i}" for i in range(3)])
