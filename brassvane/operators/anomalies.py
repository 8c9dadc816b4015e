"""Implausible spikes, stuck values and impossible readings in price bars.

A hidden Markov model with the states normal, spike, stuck and out of range runs over each stock's series of each field. How wide
a source's normal departures are, how far its spikes lie, and how often its series pass from state to state is estimated for
every source by Baum-Welch; forward-backward probabilities under these parameters, together with hard bounds, assign flags.

Every test is local in time: a spike lasts at most three bars, six equal bars make a stuck run and the
model forgets within a few dozen bars. So series are cut into chunks by rank of trading day, each with a
halo of its neighbours' bars, and chunks are worked off as a stream of bounded blocks: one stock with
most of the rows is many chunks. The ranks come from counts per (stock, month); no window spans a stock.
Departures don't depend on the parameters: they are computed and written once per chunk, 9 bytes a value, and a round of the
estimation reads them and sends back one row of sums a source and kind of field.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

FIELDS = ["close", "high", "low", "volume"]
VALUES = [*FIELDS, "open", "_vstd", "_vref"]
CHUNK, HALO, SIDE, BLOCK, COPIES = 512, 48, 7, 16, 64
RUN = 6  # successive equal bars that make a run stuck
NORMAL_WIDTH = 1.3  # of the source's scale: a bar against the median of its neighbours, not against one
AMOUNT_SIGMA, VOLUME_SIGMA = 0.06, 0.9  # ln volume against the same bar's amount or turnover; against its neighbours
P_SPIKE, P_STUCK, P_RANGE = 0.002, 0.0005, 0.0005
FAR = {"price": 4.0, "volume": 1.6}  # least departure of a spike: in first widths of a price, in ln of a volume
KINDS = ["price", "by_bar", "beside"]  # of a value: a price; a volume held against its own bar; one held against its neighbours
STATES = 4
FIRST_MOVE = np.array([
    [1 - P_SPIKE - P_STUCK - P_RANGE, P_SPIKE, P_STUCK, P_RANGE],
    [0.6 - P_RANGE, 0.4, 0.0, P_RANGE],
    [0.15 - P_RANGE, 0.0, 0.85, P_RANGE],
    [0.9, 0.05, 0.0, 0.05],
])
PRIOR_STEPS, PRIOR_VALUES = 2000.0, 200.0  # strength of the first transitions (steps out of a state) and widths (values) in the estimates
FIRST_SPAN = {"price": 0.5, "by_bar": 4.0, "beside": 4.0}  # mean departure of a spike beyond the least one
WIDE, FIRST_WIDE = 2.5, 0.05
MAX_ROUNDS, SETTLED = 12, 1e-3  # rounds of the estimation; greatest relative change of a parameter at which it ends
MAX_SOURCES = 100_000  # a source is a vendor; more are refused, as their parameters are sent to every task


@dataclass
class Model:
    """Per source and kind: transitions (sources, kinds, 4, 4), and (sources, kinds) each: width of normal departures in first widths, share of
    those that are WIDE times as wide (local peaks of a moving price), mean excess of spikes."""

    sources: dict[str, int]
    move: np.ndarray
    width: np.ndarray
    wide: np.ndarray
    span: np.ndarray


def first_model(sources: list[str]) -> Model:
    n = len(sources)
    return Model({s: i for i, s in enumerate(sources)}, np.tile(FIRST_MOVE, (n, len(KINDS), 1, 1)), np.ones((n, len(KINDS))), np.full((n, len(KINDS)), FIRST_WIDE), np.tile([FIRST_SPAN[k] for k in KINDS], (n, 1)))


def source_scales(bars: DataFrame) -> DataFrame:
    """(_src, _scale): the robust daily scale of ln(close / preclose) per source, over all its bars."""
    r = F.abs(F.ln(F.when((F.col("close") > 0) & (F.col("preclose") > 0), F.col("close") / F.col("preclose"))))
    r = bars.select("_src", r.alias("r")).where("r is not null and not isnan(r)")
    return r.groupBy("_src").agg((F.percentile_approx("r", 0.5, 10000) / 0.6745).alias("_scale"))


def trading_ranks(bars: DataFrame, code: str, date: str) -> DataFrame:
    """`bars` with _rank, the 0-based rank of the row's date among the distinct dates of its code."""
    month = F.trunc(date, "month")
    days = bars.select(F.col(code).alias("_c"), F.col(date).alias("_d")).distinct()
    w = Window.partitionBy("_c", "_m").orderBy("_d")
    days = days.withColumn("_m", F.trunc("_d", "month")).withColumn("_in", F.row_number().over(w) - 1)
    months = days.groupBy("_c", "_m").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy("_c").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0))).select(F.col("_c").alias("_mc"), F.col("_m").alias("_mm"), "_before")
    days = days.join(months, (F.col("_c") == F.col("_mc")) & (F.col("_m") == F.col("_mm"))).select("_c", "_d", (F.col("_before") + F.col("_in")).cast("int").alias("_rank"))
    return bars.join(days, (bars[code] == days["_c"]) & (bars[date] == days["_d"])).drop("_c", "_d")


def _beside(x: np.ndarray) -> np.ndarray:
    """Departure of each value of a series from the medians of the bars before and after, the nearer one; 0 where
    they lie on different sides (a move that stays) or a side has fewer than two values."""
    n = len(x)
    pad = np.full(SIDE, np.nan)
    win = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), SIDE)
    before, after = win[:n], win[SIDE + 1 : SIDE + 1 + n]
    out = []
    each = np.arange(n)
    for w in (before, after):
        count, ordered = np.isfinite(w).sum(axis=1), np.sort(w, axis=1)  # missing values come last
        middle = (ordered[each, np.maximum(count - 1, 0) // 2] + ordered[each, np.minimum(count // 2, SIDE - 1)]) / 2
        out.append(x - np.where(count >= 2, middle, np.nan))
    return _nearer(*out)


def _nearer(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The smaller of two departures of one sign, else 0; 0 where one is missing."""
    same = np.isfinite(b) & np.isfinite(a) & (np.sign(b) == np.sign(a))
    return np.where(same, np.where(np.abs(b) < np.abs(a), b, a), 0.0)


def _price_departures(s: dict) -> dict[str, np.ndarray]:
    """Per price field the larger of two departures: from the bars around, and from the opens that enclose the bar's own
    trading (its open and the next bar's). A real move carries the next open along; a faulty close doesn't."""
    log = {f: np.log(np.where(s[f] > 0, s[f], np.nan)) for f in ("open", "close", "high", "low")}
    after = np.append(log["open"][1:], np.nan)
    own = {"close": _nearer(log["close"] - log["open"], log["close"] - after)}
    sound = np.where(np.abs(own["close"]) > 4 * s["scale"], np.nan, log["close"])
    ends = np.vstack([log["open"], after, sound])
    both = np.isfinite(log["open"]) & np.isfinite(after)
    own["high"] = np.where(both, np.maximum(log["high"] - np.fmax.reduce(ends), 0), 0.0)
    own["low"] = np.where(both, np.minimum(log["low"] - np.fmin.reduce(ends), 0), 0.0)
    out = {}
    for f, o in own.items():
        near, o = _beside(log[f]), np.nan_to_num(o)
        out[f] = np.where(np.abs(o) > np.abs(near), o, near)
    return out


def _smooth(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over (series, time): probabilities of the states (series, time, 4) and, unscaled, of the steps between them
    (series, time - 1, 4, 4). `move` holds the transitions into each time (series, time, 4, 4)."""
    s, n, _ = emit.shape
    into = np.ascontiguousarray((move * emit[:, :, None, :]).transpose(1, 0, 2, 3))  # time first: a step reads one stretch of memory
    a, b = np.empty((n, s, STATES)), np.empty((n, s, STATES))
    cur = emit[:, 0] * move[:, 0, 0]
    a[0] = cur / cur.sum(axis=1, keepdims=True)
    for t in range(1, n):
        cur = np.einsum("si,sij->sj", a[t - 1], into[t])
        a[t] = cur / cur.sum(axis=1, keepdims=True)
    b[n - 1] = 1.0
    for t in range(n - 2, -1, -1):
        cur = np.einsum("sij,sj->si", into[t + 1], b[t + 1])
        b[t] = cur / cur.sum(axis=1, keepdims=True)
    p = (a * b).transpose(1, 0, 2)
    return p / p.sum(axis=2, keepdims=True), (a[:-1, :, :, None] * into[1:] * b[1:, :, None, :]).transpose(1, 0, 2, 3)


def _bells(z: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of a normal departure's density, in units of its width."""
    return (1 - wide) * np.exp(-0.5 * np.minimum(z * z, 1000)) / 2.5066, wide * np.exp(-0.5 * np.minimum((z / WIDE) ** 2, 1000)) / (2.5066 * WIDE)


def _emissions(d: dict, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(emissions (series, time, 4), transitions (series, time, 4, 4)) of departures under a model."""
    source, kind = d["source"], d["kind"]
    sigma, span = d["sigma"] * model.width[source, kind], model.span[source, kind]
    dev, equal, hard = d["dev"], d["equal"], d["hard"]
    z = dev / sigma
    over = np.abs(dev) - d["far"]
    soft = np.where(equal, 0.03, 0.97) * np.where(hard, 1e-6, 1.0)
    emit = np.empty((*dev.shape, STATES))
    narrow, broad = _bells(z, model.wide[source, kind])
    emit[:, :, 0] = (narrow + broad + 1e-7) / sigma * soft
    emit[:, :, 1] = np.where(over > 0, np.exp(-np.maximum(over, 0) / span) / (2 * span) + 1e-4, 1e-9) * soft
    emit[:, :, 2] = np.exp(-np.abs(dev)) / 2 * np.where(equal, 1.0, 1e-9) * np.where(hard, 1e-6, 1.0)
    emit[:, :, 3] = np.where(hard, 1.0, 1e-12)
    emit[~d["there"]] = 1.0
    return emit, model.move[source, kind]


def _sums(d: dict, model: Model) -> dict[tuple[int, int], np.ndarray]:
    """What one block adds to the estimates, per (source, kind): steps (16), weight and square of near departures, weight of wide ones, and spikes' weight and excess."""
    p, steps = _smooth(*_emissions(d, model))
    cell = d["source"] * len(KINDS) + d["kind"]
    own = d["own"]
    counts = own[:, 1:] & d["there"][:, 1:] & d["there"][:, :-1]
    total = steps.sum(axis=(2, 3), keepdims=True)
    steps = np.where(counts[:, :, None, None], steps / np.maximum(total, 1e-300), 0.0)
    seen = own & d["there"]
    normal, spike = p[:, :, 0] * seen, p[:, :, 1] * seen * (np.abs(d["dev"]) > d["far"])
    z = d["dev"] / d["sigma"]
    narrow, broad = _bells(z / model.width[d["source"], d["kind"]], model.wide[d["source"], d["kind"]])
    near = normal * narrow / (narrow + broad + 1e-7)
    far = normal * broad / (narrow + broad + 1e-7)
    n = int(cell.max()) + 1
    flat, at = cell[:, 1:].ravel(), cell.ravel()
    cols = [np.bincount(flat, weights=steps[:, :, i, j].ravel(), minlength=n) for i in range(STATES) for j in range(STATES)]
    cols += [np.bincount(at, weights=w.ravel(), minlength=n) for w in (near, near * z * z, far, spike, spike * np.maximum(np.abs(d["dev"]) - d["far"], 0))]
    table = np.column_stack(cols)
    return {divmod(int(c), len(KINDS)): table[c] for c in np.unique(at)}


def _estimate(model: Model, sums: dict[tuple[int, int], np.ndarray]) -> tuple[Model, float]:
    """(the model that the sums and the first one's prior weight give, its greatest relative change)."""
    new = Model(model.sources, *(x.copy() for x in (model.move, model.width, model.wide, model.span)))
    for (s, k), v in sums.items():
        steps = v[:16].reshape(STATES, STATES) + PRIOR_STEPS * FIRST_MOVE * np.array([1.0, 0.01, 0.01, 0.01])[:, None]
        new.move[s, k] = steps / steps.sum(axis=1, keepdims=True)
        new.width[s, k] = np.clip(np.sqrt((v[17] + PRIOR_VALUES) / (v[16] + PRIOR_VALUES)), 0.5, 1.5)
        new.wide[s, k] = np.clip((v[18] + PRIOR_VALUES * FIRST_WIDE) / (v[16] + v[18] + PRIOR_VALUES), 0.001, 0.2)
        new.span[s, k] = (v[20] + 10 * FIRST_SPAN[KINDS[k]]) / (v[19] + 10)
    old = np.concatenate([model.width.ravel(), model.span.ravel(), model.move[:, :, 0, 1].ravel()])
    now = np.concatenate([new.width.ravel(), new.span.ravel(), new.move[:, :, 0, 1].ravel()])
    return new, float(np.max(np.abs(now - old) / old, initial=0.0))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to the one before, length of the own run of equal values) of a series; a missing value equals nothing."""
    n = len(x)
    eq = np.zeros(n, bool)
    eq[1:] = x[1:] == x[:-1]
    starts = np.flatnonzero(~eq)
    return eq, np.repeat(np.diff(np.append(starts, n)), np.diff(np.append(starts, n)))


def _stuck_copies(at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether each copy belongs to, but doesn't begin, a run of RUN successive dates that have a copy of exactly its value."""
    out = np.zeros(len(v), bool)
    ok = np.flatnonzero(np.isfinite(v))
    if len(ok):
        order = ok[np.lexsort((at[ok], v[ok]))]
        step = np.diff(at[order])
        same = np.append(False, (v[order][1:] == v[order][:-1]) & (step <= 1))  # a step of 0: another copy of the date
        run = np.cumsum(~same) - 1
        first = at[order][~same]
        dates = np.bincount(run, weights=~same | np.append(True, step == 1))
        out[order] = (dates[run] >= RUN) & (at[order] > first[run])
    return out


def _chunk_series(pdf: pd.DataFrame) -> dict:
    """Series over the distinct dates of one chunk, from the first copy of a date with a value."""
    r = pdf["_rank"].to_numpy()
    new = np.append(True, r[1:] != r[:-1])
    at = np.cumsum(new) - 1
    n = at[-1] + 1
    out = {"at": at, "scale": pdf["_scale"].to_numpy(float)[new], "source": pdf["_src"].to_numpy()[new], "own": pdf["_own"].to_numpy(bool)[new]}
    for f in VALUES:
        v = pdf[f].to_numpy(float)
        first = np.full(n, np.nan)
        ok = np.flatnonzero(np.isfinite(v))[::-1]
        first[at[ok]] = v[ok]
        out[f] = first
    return out


def _departures(s: dict) -> dict:
    """What the model sees of one series: per field and time departure, first width, least departure of a spike, kind, and whether
    the value is there, equals the one before, and is impossible by itself."""
    n, prices = len(s["scale"]), _price_departures(s)
    out = {k: np.zeros((len(FIELDS), n), t) for k, t in (("dev", np.float32), ("sigma", np.float32), ("far", np.float32), ("kind", np.int8), ("equal", bool), ("hard", bool), ("there", bool))}
    for j, f in enumerate(FIELDS):
        x = s[f]
        out["equal"][j], out["there"][j] = _runs(x)[0], np.isfinite(x)
        if f == "volume":
            log = np.log(np.where(s["_vstd"] > 0, s["_vstd"], np.nan))
            by_bar = log - s["_vref"]  # against the same bar's amount or turnover
            known = np.isfinite(by_bar)
            out["dev"][j] = np.nan_to_num(np.where(known, by_bar, _beside(log)))
            out["sigma"][j] = np.where(known, AMOUNT_SIGMA, VOLUME_SIGMA)
            out["far"][j] = FAR["volume"]
            out["kind"][j], out["hard"][j] = np.where(known, 1, 2), x < 0
        else:
            out["dev"][j] = np.nan_to_num(prices[f])
            out["sigma"][j] = np.maximum(s["scale"], 1e-4) * NORMAL_WIDTH
            out["far"][j], out["hard"][j] = FAR["price"] * out["sigma"][j], x <= 0
    return {**out, "source": s["source"], "own": s["own"]}


def _stack(series: list[dict], sources: dict[str, int]) -> dict:
    """The departures of several series as one block (series x field, time), shorter ones filled with values that aren't there."""
    width, k = max(d["dev"].shape[1] for d in series), len(FIELDS)
    fill = {"dev": 0.0, "sigma": 1.0, "far": 1.0, "kind": 0, "equal": False, "hard": False, "there": False}
    out = {c: np.full((len(series) * k, width), v, dtype=series[0][c].dtype) for c, v in fill.items()}
    out["source"], out["own"] = np.zeros((len(series) * k, width), np.int64), np.zeros((len(series) * k, width), bool)
    for i, d in enumerate(series):
        n, rows = d["dev"].shape[1], slice(i * k, (i + 1) * k)
        for c in fill:
            out[c][rows, :n] = d[c]
        out["source"][rows, :n], out["own"][rows, :n] = [sources[x] for x in d["source"]], d["own"]
    return out


def _score(series: list[dict], model: Model) -> np.ndarray:
    """Probabilities of the states (series, field, time, 4)."""
    d = _stack(series, model.sources)
    p, _ = _smooth(*_emissions(d, model))
    return p.reshape(len(series), len(FIELDS), -1, STATES)


def _like(v: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return np.abs(v - kept) <= 1e-3 * np.abs(kept)  # a copy may differ in its last digit


def _as_series(pdf: pd.DataFrame, s: dict) -> np.ndarray:
    """(row, field): whether a copy's value is that of the series. Volumes are held against each other in shares, in which they
    are judged; as they stand, where one of the two has no shares."""
    at, out = s["at"], []
    for f in FIELDS:
        v, kept = pdf[f].to_numpy(float), s[f][at]
        same = _like(v, kept)
        if f == "volume":
            std, kept_std = pdf["_vstd"].to_numpy(float), s["_vstd"][at]
            same = np.where(np.isfinite(std) & np.isfinite(kept_std), _like(std, kept_std), same)
        out.append(same & np.isfinite(v))
    return np.column_stack(out)


def _with_copy(s: dict, values: dict[str, np.ndarray], r: int) -> tuple[dict, int]:
    """(the series around the date of copy `r` with its values in place, place of the date)."""
    t = s["at"][r]
    a, b = max(0, t - HALO), t + HALO + 1
    out = {"scale": s["scale"][a:b].copy(), "source": s["source"][a:b].copy(), "own": s["own"][a:b]}
    out["scale"][t - a], out["source"][t - a] = values["_scale"][r], values["_src"][r]
    for f in VALUES:
        out[f] = s[f][a:b].copy()
        if np.isfinite(values[f][r]) or f == "_vstd" and np.isfinite(values["volume"][r]):
            out[f][t - a] = values[f][r]
    return out, t - a


def _prepared(pdf: pd.DataFrame) -> dict:
    """Everything of one chunk that doesn't depend on the model: its departures, those of copies that differ from the series, and its own bars."""
    s = _chunk_series(pdf)
    at, own, k = s["at"], pdf["_own"].to_numpy(bool), len(FIELDS)
    values = {**{f: pdf[f].to_numpy(float) for f in [*VALUES, "_scale"]}, "_src": pdf["_src"].to_numpy()}
    same = _as_series(pdf, s)
    found = np.column_stack([np.isfinite(values[f]) for f in FIELDS])
    stuck = np.empty((len(at), k), bool)
    for j, f in enumerate(FIELDS):
        stuck[:, j] = _stuck_copies(at, values[f])
        eq, length = _runs(s[f])
        stuck[:, j] |= (eq & (length >= RUN))[at] & same[:, j]  # the hard bound; the probability is reported
    d = _departures(s)
    apart = []
    for r in np.flatnonzero(own & (found & ~same).any(axis=1)):  # tried in the series' place, each by itself
        local, t = _with_copy(s, values, r)
        apart.append((int(np.count_nonzero(own[:r])), t, found[r] & ~same[r], _departures(local)))
    return {"d": d, "apart": apart, "at": at[own], "bar_id": pdf["bar_id"].to_numpy()[own], "range": pdf["_range"].to_numpy()[own], "stuck": stuck[own], "found": found[own], "same": same[own]}


def _flag_block(chunks: list[dict], model: Model) -> pd.DataFrame:
    p = _score([c["d"] for c in chunks], model)
    tried = [(i, x) for i, c in enumerate(chunks) for x in c["apart"]]
    frames, probs, theres = [], [], []
    for i, c in enumerate(chunks):
        probs.append(p[i][:, c["at"]].transpose(1, 0, 2).copy())
        theres.append(c["d"]["there"][:, c["at"]].T & c["same"])
    for x in range(0, len(tried), COPIES):
        part = tried[x : x + COPIES]
        q = _score([d for _, (_, _, _, d) in part], model)
        for (i, (row, t, differs, _)), own in zip(part, q):
            probs[i][row, differs] = own[differs, t]
            theres[i][row] |= differs
    for c, prob, there in zip(chunks, probs, theres):
        spike = (prob[:, :, 1] > 0.5) & there & ~c["stuck"]
        cols = {"bar_id": c["bar_id"]}
        for j, f in enumerate(FIELDS):
            cols[f"{f}_spike"], cols[f"{f}_stuck"], cols[f"{f}_range"] = spike[:, j], c["stuck"][:, j], (c["range"] >> j & 1) > 0
            cols[f"{f}_p"] = np.where(c["found"][:, j], 1 - prob[:, j, 0], np.nan)
        frames.append(pd.DataFrame(cols))
    return pd.concat(frames, ignore_index=True)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for pdf in batches:
        for blob in pdf["chunk"]:
            held.append(pickle.loads(blob))
            if len(held) == BLOCK:
                yield held
                held = []
    if held:
        yield held


def chunks_of(bars: DataFrame) -> DataFrame:
    """(chunk BINARY): the chunks of all series with what the model needs of them, written to shared storage."""
    b = bars.where((F.col("tradestatus") == 1) & F.col("symbol").isNotNull() & F.col("date").isNotNull())
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    b = b.withColumns({f: value(f) for f in VALUES})
    c, h, lo, v = (F.col(x) for x in FIELDS)
    impossible = [(c <= 0) | (c > h) | (c < lo), (h <= 0) | (h < lo), (lo <= 0) | (h < lo), (v < 0) | (F.col("_vstd") > F.col("shares"))]
    bits = F.lit(0)
    for j, x in enumerate(impossible):
        bits = bits + F.when(F.coalesce(x, F.lit(False)), 1 << j).otherwise(0)
    scales = source_scales(b)
    slim = b.select("bar_id", "symbol", "date", *VALUES, F.coalesce("_src", F.lit("")).alias("_src"), bits.alias("_range"))
    slim = slim.join(scales.select(F.coalesce("_src", F.lit("")).alias("_ss"), "_scale"), F.col("_src") == F.col("_ss"), "left").drop("_ss").withColumn("_scale", F.coalesce("_scale", F.lit(0.02)))
    ranked = trading_ranks(slim, "symbol", "date")
    chunk = F.floor(F.col("_rank") / CHUNK).cast("int")
    rest = F.col("_rank") % CHUNK
    homes = F.array_compact(F.array(
        F.struct(chunk.alias("c"), F.lit(True).alias("own")),
        F.when((rest < HALO) & (chunk > 0), F.struct((chunk - 1).alias("c"), F.lit(False).alias("own"))),
        F.when(rest >= CHUNK - HALO, F.struct((chunk + 1).alias("c"), F.lit(False).alias("own"))),
    ))
    spread = ranked.select("bar_id", "symbol", "_rank", *VALUES, "_scale", "_src", "_range", F.explode(homes).alias("_h"))
    spread = spread.select("*", F.col("_h.c").alias("_chunk"), F.col("_h.own").alias("_own")).drop("_h")
    ordered = spread.repartition("symbol", "_chunk").sortWithinPartitions("symbol", "_chunk", "_rank", "bar_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for pdf in batches:
            if tail is not None:
                pdf = pd.concat([tail, pdf], ignore_index=True)
            sym, ch = pdf["symbol"].to_numpy(), pdf["_chunk"].to_numpy()
            cuts = np.flatnonzero((sym[1:] != sym[:-1]) | (ch[1:] != ch[:-1])) + 1
            edges = [0, *cuts.tolist(), len(pdf)]
            yield pd.DataFrame({"chunk": [pickle.dumps(_prepared(pdf.iloc[x:y])) for x, y in zip(edges[:-2], edges[1:-1])]})
            tail = pdf.iloc[edges[-2] :]
        if tail is not None and len(tail):
            yield pd.DataFrame({"chunk": [pickle.dumps(_prepared(tail))]})

    return cut(ordered.mapInPandas(run, "chunk binary"))


def estimate(chunks: DataFrame, sources: list[str]) -> tuple[Model, int]:
    """(the model, rounds) by Baum-Welch over all chunks: each round sends back one row of sums a source and kind and partition."""
    model = first_model(sources)
    for rounds in range(1, MAX_ROUNDS + 1):

        def run(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for held in _blocks(batches):
                for cell, v in _sums(_stack([c["d"] for c in held], model.sources), model).items():
                    total[cell] = total.get(cell, 0) + v
            yield pd.DataFrame({"s": [c[0] for c in total], "k": [c[1] for c in total], "v": [v.tolist() for v in total.values()]}).astype({"s": "int32", "k": "int32"})

        part = chunks.mapInPandas(run, "s int, k int, v array<double>")
        rows = part.groupBy("s", "k").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(21)]).alias("v")).collect()  # sources x kinds
        model, change = _estimate(model, {(r["s"], r["k"]): np.array(r["v"]) for r in rows})
        if change < SETTLED:
            break
    return model, rounds


def flag_bars(bars: DataFrame) -> DataFrame:
    """One row per bar with tradestatus 1: bar_id, per field {field}_spike, _stuck, _range and _p, and `faulty`.

    `bars` holds bar_id, symbol, date, tradestatus, open, close, high, low, preclose, volume, _src, shares (outstanding,
    may be null), _vstd (volume in shares) and _vref (ln of the shares traded that amount or turnover imply, may be
    null). `_p` is the probability that the value isn't normal. Out-of-range bounds: a price of 0 or
    less, high below low, close outside low..high, volume below 0 or above the outstanding shares. Missing values are
    never flagged and belong to no run; suspended bars, null codes and null dates don't appear. Copies of a (symbol, date) are
    one point of the series, of the first one's values; a copy with other values is judged in its place. An empty table gives no rows.
    """
    names = [r[0] for r in bars.select(F.coalesce("_src", F.lit("")).alias("s")).distinct().orderBy("s").limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    chunks = chunks_of(bars)
    model, _ = estimate(chunks, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _blocks(batches):
            yield _flag_block(held, model)

    schema = "bar_id bigint, " + ", ".join(f"{f}_spike boolean, {f}_stuck boolean, {f}_range boolean, {f}_p double" for f in FIELDS)
    faulty = F.lit(False)
    for f in FIELDS:
        for kind in ("spike", "stuck", "range"):
            faulty = faulty | F.col(f"{f}_{kind}")
    return chunks.mapInPandas(run, schema).withColumn("faulty", faulty)
