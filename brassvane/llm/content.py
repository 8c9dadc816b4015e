"""Scores of abusive, hateful or sexual content by a factorization machine over hashed terms.

A text is folded (width, case, look-alikes, invisible and separating characters, traditional forms) to a
stream of letters and digits. Its terms are hashed: single characters of scripts without spaces, runs of 3 letters of
alphabets, across words too; longer expressions are told by their pairs. The machine scores a window as wide as a sentence, WINDOW characters or
four times as many letters of an alphabet: a bias, one weight a term, and factors whose inner products are the
weights of pairs, so that an insult and a group mention say more together than apart, wherever in the sentence
they stand. Sums over a window are differences of prefix sums, so all windows of a batch of texts are scored
without a loop over windows. A text's score is that of its highest window; whole texts are read.

Raters label texts, not places, so fitting picks in each epoch the highest window of every labelled text and
moves it towards the label (multiple-instance learning), starting from the terms' log odds. The fit uses
at most `max_fit` labelled texts of at most `max_chars` characters in all, chosen by hash; every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .script import unmask

BITS, FACTORS, ORDERS = 18, 8, 1
WINDOW, STRIDE, LETTERS = 24, 4, 4  # width and step in characters; so many letters of an alphabet count as one
SIZE = 1 << BITS
_MULT = np.uint64(0x9E3779B97F4A7C15)
SCALE, PAIR_SCALE = 1.0 / np.sqrt(WINDOW * ORDERS), 2.0 / (WINDOW * ORDERS)
LETTER_VALUE = 0.5  # of a term of letters: a window holds four times as many
MAX_FIT, MAX_CHARS = 20_000, 20_000_000
MIN_TEXTS, FOLDS = 2, 5  # at every number of texts; max_fit bounds the cost
BLOCK_CHARS = 200_000
SLIP = 1.0  # log odds beyond the threshold from which a contrary label counts as a slip
_DROPPED, _DIGITS, _LONG_RUN = re.compile(r"[\W_]+"), re.compile(r"\d"), re.compile(r"(.)\1{3,}")


def stream(text: str | None) -> str:
    """Letters and digits of the folded text; digits become 0, runs of four and more equal characters three."""
    return _LONG_RUN.sub(r"\1\1\1", _DIGITS.sub("0", _DROPPED.sub("", unmask(text)))) if text else ""


class Terms:
    """Hashed terms (ORDERS, n) of texts' joined streams, SIZE where a run would cross texts; the terms' values; widths of the
    positions in quarters of a character, summed up; and the texts' starts."""

    def __init__(self, texts: list[str | None]):
        s = [stream(t) for t in texts]
        self.starts = np.cumsum([0, *map(len, s)])
        n = int(self.starts[-1])
        chars = np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        left = np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(n)  # characters up to the text's end
        letter = (chars < 0x2E80) & (chars != ord("0"))
        self.codes = np.full((ORDERS, n), SIZE, dtype=np.int32)
        h = np.zeros(n + 1, dtype=np.uint64)
        padded = np.concatenate([chars, np.zeros(ORDERS + 2, np.uint64)])
        with np.errstate(over="ignore"):
            h = chars + np.uint64(1)
            for k in range(1, ORDERS + 3):  # h covers k characters from each position
                code = ((h * _MULT) >> np.uint64(64 - BITS)).astype(np.int32)
                for own, order in ((~letter, k - 1), (letter, k - 3)):
                    if 0 <= order < ORDERS:
                        at = own & (left >= k)
                        self.codes[order, at] = code[at]
                h = h * np.uint64(1000003) + padded[k : n + k] + np.uint64(7 * k + 1)
        self.value = np.where(letter, LETTER_VALUE, 1.0).astype(np.float32)
        self.width = np.concatenate([[0], np.cumsum(np.where(letter, 4 // LETTERS, 4))])

    def part(self, a: int, b: int) -> Terms:
        """The terms of the texts a to b."""
        out = object.__new__(Terms)
        x, y = self.starts[a], self.starts[b]
        out.codes, out.value, out.width, out.starts = self.codes[:, x:y], self.value[x:y], self.width[x : y + 1] - self.width[x], self.starts[a : b + 1] - x
        return out

    def spots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of all windows: every STRIDE characters one that holds WINDOW of them or ends with the text."""
        whole = np.diff(self.width[self.starts])
        count = np.maximum(1, -(-(whole - 4 * WINDOW) // (4 * STRIDE)) + 1)
        owner = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = np.minimum(nth * 4 * STRIDE, np.maximum(0, whole - 4 * WINDOW)[owner]) + self.width[self.starts[:-1]][owner]
        a = np.maximum(np.searchsorted(self.width, at), self.starts[:-1][owner])
        b = np.minimum(np.searchsorted(self.width, at + 4 * WINDOW, side="right") - 1, self.starts[1:][owner])
        return owner, np.minimum(a, self.starts[1:][owner]), np.maximum(a, b)


class Machine:
    """Bias, weights (SIZE + 1) and factors (SIZE + 1, FACTORS); the last entry stands for no term and stays 0."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.w, self.v = bias, weights.astype(np.float32), factors.astype(np.float32)

    def windows(self, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, start, end) of the highest window of each text; -inf for a text without terms.

        Texts are taken in blocks of about BLOCK_CHARS characters, so memory doesn't grow with their number.
        """
        out, a = [], 0
        while a < len(terms.starts) - 1:
            b = max(a + 1, int(np.searchsorted(terms.starts, terms.starts[a] + BLOCK_CHARS, side="right")) - 1)
            s, p, q = self._windows(terms.part(a, b))
            out.append((s, p + terms.starts[a], q + terms.starts[a]))
            a = b
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _windows(self, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = terms.value
        sums = np.zeros((terms.codes.shape[1], FACTORS + 2), np.float32)
        for k in range(ORDERS):
            f = self.v[terms.codes[k]]
            sums[:, 0] += self.w[terms.codes[k]]
            sums[:, 1] += np.einsum("nf,nf->n", f, f)
            sums[:, 2:] += f
        sums[:, 1] *= x  # squared in the next step
        sums *= x[:, None]
        cum = np.zeros((len(sums) + 1, FACTORS + 2))
        np.cumsum(sums, axis=0, out=cum[1:])
        owner, a, b = terms.spots()
        d = cum[b] - cum[a]
        score = self.bias + SCALE * d[:, 0] + 0.5 * PAIR_SCALE * ((d[:, 2:] ** 2).sum(axis=1) - d[:, 1])
        score[b <= a] = -np.inf
        order = np.lexsort((a, -score, owner))
        first = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        return score[first], a[first], b[first]


def _log_odds(terms: Terms, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of each term's presence in positive against negative texts, number of texts with it)."""
    doc = np.repeat(np.arange(len(y)), np.diff(terms.starts))
    pos, neg, df = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for k in range(ORDERS):
        pair = np.unique(doc.astype(np.int64) * (SIZE + 1) + terms.codes[k])
        d, c = pair // (SIZE + 1), pair % (SIZE + 1)
        pos += np.bincount(c, weights=weight[d] * y[d], minlength=SIZE + 1)
        neg += np.bincount(c, weights=weight[d] * (1 - y[d]), minlength=SIZE + 1)
        df += np.bincount(c, minlength=SIZE + 1)
    odds = np.log((pos + 0.5) / (weight * y).sum()) - np.log((neg + 0.5) / (weight * (1 - y)).sum())
    odds[SIZE] = 0.0
    return odds, df


def fit(terms: Terms, y: np.ndarray, weight: np.ndarray, epochs: int = 12, seed: int = 7, rate: float = 0.15, decay: float = 1e-3, pairs: bool = True) -> Machine:
    """The machine that tells the texts with y = 1 from those with y = 0; `weight` is how sure the labels are, texts of weight 0
    aren't used. Without `pairs` it is an additive model, to compare with."""
    rng = np.random.default_rng(seed)
    odds, df = _log_odds(terms, y, weight)
    rare = df < MIN_TEXTS  # a term of one text would only learn that text's label
    kept = object.__new__(Terms)
    kept.__dict__.update(terms.__dict__, codes=np.where(rare[terms.codes], SIZE, terms.codes))
    w = np.where(rare, 0.0, odds * 0.5)
    v = rng.normal(0, 0.05, (SIZE + 1, FACTORS)) * pairs
    v[rare], v[SIZE] = 0, 0
    m = Machine(-3.0, w, v)
    gw, gv, gb = np.full(SIZE + 1, 1e-2), np.full((SIZE + 1, FACTORS), 1e-2), 1e-2
    use = np.flatnonzero((np.diff(terms.starts) > 0) & (weight > 0))
    for _ in range(epochs):
        _, start, end = m.windows(kept)
        for batch in np.array_split(rng.permutation(use), max(1, len(use) // 256)):
            a, b = start[batch], end[batch]
            size = b - a
            place = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            row = np.repeat(np.arange(len(batch)), size)
            c, x, row = kept.codes[:, place].ravel(), np.tile(kept.value[place], ORDERS), np.tile(row, ORDERS)
            there = c != SIZE
            c, x, row = c[there], x[there], row[there]
            flat, at = np.unique(c, return_inverse=True)
            f = m.v[c] * x[:, None]
            total = np.column_stack([np.bincount(row, weights=f[:, j], minlength=len(batch)) for j in range(FACTORS)])
            own = np.bincount(row, weights=np.einsum("nf,nf->n", f, f), minlength=len(batch))
            score = m.bias + SCALE * np.bincount(row, weights=m.w[c] * x, minlength=len(batch)) + 0.5 * PAIR_SCALE * ((total**2).sum(axis=1) - own)
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[batch]) * weight[batch]
            dw = np.bincount(at, weights=g[row] * SCALE * x, minlength=len(flat)) + decay * m.w[flat]
            gw[flat] += dw**2
            gb += g.sum() ** 2
            m.w[flat] -= rate * dw / np.sqrt(gw[flat])
            m.bias -= rate * g.sum() / np.sqrt(gb)
            if pairs:
                grad = (g[row] * x)[:, None] * PAIR_SCALE * (total[row] - f)
                dv = np.column_stack([np.bincount(at, weights=grad[:, j], minlength=len(flat)) for j in range(FACTORS)]) + decay * m.v[flat]
                gv[flat] += dv**2
                m.v[flat] -= 0.3 * rate * dv / np.sqrt(gv[flat])
    return m


def labelled(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_chars: int = MAX_CHARS) -> pd.DataFrame:
    """At most `max_fit` labelled texts of at most `max_chars` characters in all: text, y (the raters' majority), weight (how far
    they agree, more for more raters).

    Chosen by hash of doc_id, so the sample doesn't depend on order or partitioning; ties are not used.
    """
    bad = F.sum(F.when(F.col("category") != "none", 1).otherwise(0))
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("category").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"), F.count(F.lit(1)).alias("n"))
    votes = votes.where(F.col("bad") * 2 != F.col("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    sample = votes.join(docs.select("doc_id", "text"), "doc_id").where("text is not null")
    kept = sample.select("doc_id", F.length("text").alias("_n")).withColumn("_all", F.sum("_n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))  # at most max_fit rows
    sample = sample.join(kept.where(F.col("_all") <= max_chars).select("doc_id"), "doc_id")
    y = (F.col("bad") * 2 > F.col("n")).cast("double")
    return sample.select("doc_id", "text", y.alias("y"), F.least(F.lit(1.0), F.lit(0.4) + 0.3 * F.abs(2 * F.col("bad") - F.col("n"))).alias("weight")).orderBy("doc_id").toPandas()


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The least score from which on calling a text positive has the highest F1."""
    order = np.argsort(-score, kind="stable")
    s, hit, all_ = score[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / np.maximum(1e-9, all_ + (weight * y).sum())
    best = int(np.flatnonzero(f1 >= f1.max())[-1])
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best])


def _fold_scores(terms: Terms, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts of fold k, their scores by a machine fitted on the other folds)."""
    own, rest = np.flatnonzero(fold == k), np.where(fold == k, 0.0, weight)
    if len(set(y[rest > 0])) < 2:
        return own, np.full(len(own), -5.0)
    return own, np.maximum(fit(terms, y, rest).windows(terms)[0][own], -50.0)


def judge(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights without slips, threshold) from out-of-fold scores. A label that machines fitted on the other texts contradict clearly is
    taken for a rater's slip and left out of the fit."""
    cut = best_threshold(score, y, weight)
    kept = np.where(((y > 0) & (score < cut - SLIP)) | ((y == 0) & (score > cut + SLIP)), 0.0, weight)
    kept = kept if len(set(y[kept > 0])) == 2 else weight
    use = kept > 0
    return kept, best_threshold(score[use], y[use], kept[use])


def folds_of(texts: list[str]) -> np.ndarray:
    return np.array([hash_text(t) % FOLDS for t in texts], np.int64)  # copies of a text stay in one fold


def learn(texts: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[Machine, float]:
    """A machine and its threshold, all in this process; train() does the same in tasks."""
    terms, fold, score = Terms(texts), folds_of(texts), np.zeros(len(y))
    for k in range(FOLDS):
        own, s = _fold_scores(terms, y, weight, fold, k)
        score[own] = s
    kept, cut = judge(score, y, weight)
    return fit(terms, y, kept), cut


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> tuple[Machine, float] | None:
    """learn() on the sample of labelled texts, one task a fold and one for the machine itself; None if one class is missing."""
    data = labelled(docs, labels, max_fit)
    y, weight, texts = data["y"].to_numpy(), data["weight"].to_numpy(), data["text"].tolist()
    if len(set(y)) < 2:
        return None
    spark = docs.sparkSession
    shared, fold = spark.sparkContext.broadcast((texts, y, weight)), folds_of(texts)

    def score_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["k"]:
                texts, y, weight = shared.value
                own, s = _fold_scores(Terms(texts), y, weight, folds_of(texts), int(k))
                yield pd.DataFrame({"i": own, "s": s})

    ks = spark.createDataFrame([(k,) for k in range(FOLDS)], "k int").repartitionById(FOLDS, F.col("k"))
    score = np.zeros(len(y))
    for r in ks.mapInPandas(score_fold, "i bigint, s double").collect():  # at most max_fit rows
        score[r["i"]] = r["s"]
    kept, cut = judge(score, y, weight)

    def fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                texts, y, _ = shared.value
                m = fit(Terms(texts), y, kept)
                yield pd.DataFrame({"bias": [float(m.bias)], "w": [m.w.tobytes()], "v": [m.v.astype(np.float16).tobytes()]})

    r = ks.where("k = 0").mapInPandas(fit_all, "bias double, w binary, v binary").first()
    shared.unpersist()
    return Machine(r["bias"], np.frombuffer(r["w"], np.float32), np.frombuffer(r["v"], np.float16).reshape(SIZE + 1, FACTORS)), cut


def hash_text(t: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, model: tuple[Machine, float] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(docs' columns but the text, score DOUBLE in 0..1, flagged BOOLEAN) of every row.

    The score is 0.5 at the threshold. Columns of the result's names are replaced. Null, empty and blank texts score 0 and are not flagged, as are all if there was
    nothing to fit on. The model, of fixed size, is broadcast.
    """
    keep = [c for c in docs.columns if c not in (text, "score", "flagged")]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    machine, cut = model
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v.astype(np.float16), cut))

    @F.pandas_udf("double")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, w, v, at = shared.value
        m = Machine(bias, w, v.astype(np.float32))
        for t in parts:
            s = m.windows(Terms(t.tolist()))[0] if len(t) else np.zeros(0)
            yield pd.Series(np.where(np.isfinite(s), 1 / (1 + np.exp(-np.clip(s - at, -30, 30))), 0.0))

    out = docs.select(*keep, apply(F.col(text)).alias("score"))
    return out.withColumn("flagged", F.col("score") > 0.5)
