"""Near-duplicate texts by 64-bit SimHash within a Hamming distance, kept greedily in key order.

Equal fingerprints are folded to one first. Two fingerprints within three bits agree on at least two of five
blocks, so the ten pairs of blocks (25 bits and more each) are exact candidate keys: groups stay small where single 16-bit bands
would grow with the square of the corpus. The greedy scan - keep a row unless an earlier kept one is near - is
the lexicographically first maximal independent set, found by rounds that each decide all rows whose earlier
neighbours are decided.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bars import keep_first

BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_WORD = re.compile(r"[a-zA-Z0-9]{2,}")
HAN_FIRST, HAN_LAST = 0x4E00, 0x9FFF


def _token_signs(tokens: list[str]) -> np.ndarray:
    """(tokens, 64) of +1 and -1: the bits of the first half of each token's md5, highest first."""
    digest = b"".join(hashlib.md5(t.encode()).digest()[:8] for t in tokens)
    return np.unpackbits(np.frombuffer(digest, np.uint8)).reshape(-1, 64).astype(np.int8) * 2 - 1


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Signed 64-bit fingerprints: majority bits over the md5s of a text's tokens - bigrams of its CJK characters and lower-case
    alphanumeric runs, each as often as it stands; 0 for a text without tokens. A token is hashed once per batch."""
    texts = [t or "" for t in texts]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    han = np.flatnonzero((chars >= HAN_FIRST) & (chars <= HAN_LAST))
    left, right = han[:-1], han[1:]
    inside = owner[left] == owner[right]
    left, right = left[inside], right[inside]
    pairs, which = np.unique(chars[left].astype(np.uint64) << np.uint64(32) | chars[right], return_inverse=True)
    names = [chr(int(p) >> 32) + chr(int(p) & 0xFFFFFFFF) for p in pairs]
    words: dict[str, int] = {}
    word_at, word_of = [], []
    for i, t in enumerate(texts):
        for w in _WORD.findall(t):
            word_of.append(i)
            word_at.append(words.setdefault(w.lower(), len(words)))
    signs = _token_signs([*names, *words]) if names or words else np.zeros((0, 64), np.int8)
    token = np.concatenate([which.ravel(), np.array(word_at, np.int64) + len(names)]).astype(np.int64)
    text = np.concatenate([owner[left], np.array(word_of, np.int64)]).astype(np.int64)
    order = np.argsort(text, kind="stable")
    token, text = token[order], text[order]
    out = np.zeros(len(texts), np.int64)
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(text))
    for a in range(0, len(starts), 512):  # blocks of texts bound the token matrix
        s = starts[a : a + 512]
        total = np.add.reduceat(signs[token[s[0] : ends[min(a + 512, len(ends)) - 1]]], s - s[0], axis=0, dtype=np.int32)
        out[text[s]] = np.packbits(total > 0, axis=1).view(">i8").ravel()
    return out


def fingerprint(text: str | None) -> int:
    return int(fingerprints([text])[0])


def simhash(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def apply(t: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(t.tolist()), dtype="int64")

    return apply(text)


def near_pairs(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b, dist), a < b: pairs of distinct fingerprints of column fp within `threshold` (at most 3) bits."""
    if threshold > 3:
        raise ValueError("five blocks are exact up to three bits")
    block = lambda c, i: F.shiftrightunsigned(c, BLOCKS[i][0]).bitwiseAND(F.lit((1 << BLOCKS[i][1]) - 1))
    keys = F.array(*[F.struct(F.lit(n).alias("n"), block(F.col("fp"), i).alias("x"), block(F.col("fp"), j).alias("y")) for n, (i, j) in enumerate(combinations(range(5), 2))])
    k = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    other = k.select(F.col("fp").alias("b"), F.col("n").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dist = F.bit_count(F.col("fp").bitwiseXOR(F.col("b")))
    hit = k.join(other, (F.col("n") == F.col("n2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("fp") < F.col("b")) & (dist <= threshold))
    return hit.select(F.col("fp").alias("a"), "b", dist.alias("dist")).distinct()


def near_duplicates(df: DataFrame, key: str, fp: str, threshold: int = 3) -> DataFrame:
    """(key, fp, class_id, keep): each row's class, the key of the kept row it is near to; keep for class_id = key.

    Rows of fingerprint 0 or null are each a class. A row near several kept ones belongs to the earliest.
    """
    rows = cut(df.select(F.col(key).alias("_k"), F.col(fp).alias("fp")))  # 16 bytes a row; fingerprints are made once
    real = rows.where((F.col("fp") != 0) & F.col("fp").isNotNull())
    first = cut(real.groupBy("fp").agg(F.min("_k").alias("_k")))
    pairs = near_pairs(first, threshold)
    a, b = first.select(F.col("fp").alias("a"), F.col("_k").alias("ka")), first.select(F.col("fp").alias("b"), F.col("_k").alias("kb"))
    both = pairs.join(a, "a").join(b, "b")
    edges = cut(both.select(F.least("ka", "kb").alias("early"), F.greatest("ka", "kb").alias("late")))
    # Fingerprints without neighbours are kept; the rounds decide the others.
    nodes = edges.select(F.col("early").alias("_k")).unionByName(edges.select(F.col("late").alias("_k"))).distinct()
    open_ = cut(nodes.withColumn("state", F.lit(0)))  # 0 open, 1 kept, 2 dropped
    while not open_.where("state = 0").isEmpty():
        e = edges.join(open_.select(F.col("_k").alias("early"), F.col("state").alias("s")), "early")
        blocked = e.groupBy(F.col("late").alias("_l")).agg(F.max(F.when(F.col("s") == 1, 1).otherwise(0)).alias("near_kept"), F.max(F.when(F.col("s") == 0, 1).otherwise(0)).alias("waits"))
        n = open_.join(blocked, F.col("_k") == F.col("_l"), "left")
        state = F.when(F.col("state") != 0, F.col("state")).when(F.col("near_kept") == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        open_ = cut(n.select("_k", state.alias("state")))
    kept = open_.where("state = 1").select(F.col("_k").alias("early"))
    owner = edges.join(kept, "early").groupBy(F.col("late").alias("_l")).agg(F.min("early").alias("_o"))
    dropped = open_.where("state = 2").select(F.col("_k").alias("_l")).join(owner, "_l")
    classes = first.join(dropped, F.col("_k") == F.col("_l"), "left").select(F.col("fp").alias("_f"), F.coalesce("_o", "_k").alias("_c"))
    out = real.join(classes, F.col("fp") == F.col("_f")).select("_k", "fp", "_c")
    alone = rows.where(F.col("fp").isNull() | (F.col("fp") == 0)).withColumn("_c", F.col("_k"))
    out = out.unionByName(alone)
    return out.select(F.col("_k").alias(key), "fp", F.col("_c").alias("class_id"), (F.col("_c") == F.col("_k")).alias("keep"))


def corpus(news: DataFrame, key: str, title: str, text: str, url: str) -> DataFrame:
    """`news` without repeats: the earliest row of each near-duplicate class, of those the earliest of each url, of those the earliest of each text.

    Null urls are one url and null texts one text, as in keep_first. The texts move once, with the rows that are kept.
    """
    line = F.concat(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    kept = near_duplicates(news.select(F.col(key), simhash(line).alias("_fp")), key, "_fp").where("keep").select(key)
    slim = news.select(key, F.md5(url).alias("_u"), F.md5(text).alias("_t")).join(kept, key)
    slim = keep_first(keep_first(slim, ["_u"], key), ["_t"], key)
    return news.join(slim.select(key), key, "left_semi")
