"""Lexicon sentiment: one automaton over all words finds every hit in a single pass, modifiers are read from the text before it.

Every occurrence counts, nested words too. Scores add title hits doubled and text hits once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon_words as lw

SCHEMA = "struct<label:string,score:double,confidence:double,pos_terms:array<string>,neg_terms:array<string>>"


@lru_cache(maxsize=1)
def _tables():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for sign, words in ((1, lw.POSITIVE), (-1, lw.NEGATIVE)):
        for order, (word, weight) in enumerate(words.items()):
            auto.add_word(word, (sign, -len(word), order, word, weight))
    auto.make_automaton()
    return auto, [(re.compile(p), name, s) for p, name, s in lw.PATTERNS]


def scan(text: str, weight: float) -> tuple[float, list[str], list[str]]:
    """(score, positive terms, negative terms) of one field; terms go by longer word, lexicon order, place, then patterns."""
    auto, patterns = _tables()
    score, hits = 0.0, []
    for end, (sign, length, order, word, w) in auto.iter(text):
        at = end + length + 1
        s = w * weight * sign
        near = text[max(0, at - lw.DEGREE_WINDOW) : at]
        s *= next((c for d, c in lw.DEGREES.items() if d in near), 1.0)
        tag = ""
        if sign < 0 and any(c in text[max(0, at - lw.CANCEL_WINDOW) : at] for c in lw.CANCELS):
            s, tag = s * lw.FLIP, "(撤销)"
        if any(x in text[max(0, at - lw.NEGATION_WINDOW) : at] for x in lw.NEGATIONS):
            s, tag = s * lw.FLIP, "(否定)"
        score += s
        hits.append((sign, length, order, at, word + tag))
    hits.sort(key=lambda h: h[1:4])
    pos, neg = [h[4] for h in hits if h[0] > 0], [h[4] for h in hits if h[0] < 0]
    for pattern, name, s in patterns:
        n = sum(1 for _ in pattern.finditer(text))
        if n:
            score += s * weight * n
            (pos if s > 0 else neg).append(f"{name}×{n}")
    return score, pos, neg


def label_one(title: str | None, text: str | None) -> tuple[str, float, float, list[str], list[str]]:
    a, b = scan(title or "", lw.TITLE_WEIGHT), scan(text or "", 1.0)
    s = a[0] + b[0]
    s = round(s, 9)  # sums of weights in tenths: removes the order of addition from the threshold test
    label = "positive" if s >= lw.THRESHOLD else "negative" if s <= -lw.THRESHOLD else "neutral"
    return label, round(s, 3), round(min(1.0, abs(s) / lw.CONFIDENCE_NORM), 3), a[1] + b[1], a[2] + b[2]


def sentiment(title: Column, text: Column) -> Column:
    """Struct of label, score, confidence and the terms hit; null fields count as empty, both empty is neutral with score 0."""

    @F.pandas_udf(SCHEMA)
    def apply(t: pd.Series, x: pd.Series) -> pd.DataFrame:
        rows = [label_one(a, b) for a, b in zip(t, x)]
        return pd.DataFrame(rows, columns=["label", "score", "confidence", "pos_terms", "neg_terms"])

    return apply(title, text)
