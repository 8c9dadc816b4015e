"""Encoding a corpus with a public byte-level BPE tokenizer, as a monoid tree reduction.

A text is halved recursively down to leaves, leaves are encoded, and neighbours are joined. A join
re-encodes a window around the seam that grows until everything outside provably stays:

* Pre-tokens. The pattern matches from left to right, and a match depends on its own text and at most LOOKAHEAD
  characters after it. So the left part's pre-tokens that end at least that far from the seam stay. The right part's stay
  from the first boundary on that the window's scan shares with the right part's own scan.
* Tokens inside a pre-token that crosses the seam. A BPE token sequence whose tokens are each their own encoding
  is the encoding of its bytes if and only if every adjacent pair is the encoding of the pair's bytes. So tokens
  outside the window stay once the pairs at both of its edges hold.

Decoding is concatenation of the tokens' bytes up the tree.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
MAX_VOCABULARY = 64 << 20  # bytes that are sent to every executor
# Fixed value: the pre-token pattern of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOKAHEAD = 3  # an apostrophe looks two characters ahead, white space one; one more to be plain
LEAF = 256  # a text of more characters is halved; most characters of the tables stand in such texts


@dataclass
class Piece:
    """An encoded span: its text, its pre-tokens' ends (characters), and each pre-token's ids."""

    text: str
    ends: list[int]
    ids: list[list[int]]

    def flat(self) -> list[int]:
        return [i for p in self.ids for i in p]


class ByteBpe:
    """A vocabulary of ranks with the operations the reduction needs; `data` is the content of a file of base64 tokens and ranks."""

    def __init__(self, data: bytes):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def bpe(self, data: bytes) -> list[int]:
        one = self.ranks.get(data)
        return [one] if one is not None else self.enc._encode_single_piece(data)

    def leaf(self, text: str) -> Piece:
        spans = [m.span() for m in self.pattern.finditer(text)]
        return Piece(text, [e for _, e in spans], [self.bpe(text[s:e].encode()) for s, e in spans])

    def pair_holds(self, a: int, b: int) -> bool:
        return self.bpe(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of `left` + `right`, two encodings that lie inside one pre-token."""
        if not left or not right:
            return left + right
        if self.pair_holds(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self.bpe(b"".join(self.bytes_of[i] for i in left[-a:] + right[:b]))
            ok_left = a >= len(left) or self.pair_holds(left[-a - 1], window[0])
            ok_right = b >= len(right) or self.pair_holds(window[-1], right[b])
            if ok_left and ok_right:
                return left[: max(0, len(left) - a)] + window + right[b:]
            a, b = (a if ok_left else a * 2), (b if ok_right else b * 2)

    def join(self, a: Piece, b: Piece) -> Piece:
        if not a.text or not b.text:
            return b if not a.text else a
        n = len(a.text)
        keep = len(a.ends)
        while keep and a.ends[keep - 1] > n - LOOKAHEAD:
            keep -= 1
        start = a.ends[keep - 1] if keep else 0
        marks = {e: k for k, e in enumerate(b.ends)}
        take = min(len(b.text), max(64, 2 * (b.ends[0] + LOOKAHEAD)))
        while True:
            window = a.text[start:] + b.text[:take]
            whole = take == len(b.text)
            sure = len(window) - (0 if whole else LOOKAHEAD)
            spans, sync = [], None
            for m in self.pattern.finditer(window):
                if m.end() > sure:
                    break
                spans.append(m.span())
                at = start + m.end() - n  # in b
                if at > 0 and at in marks:
                    sync = marks[at]
                    break
            if sync is not None:
                break
            take = min(len(b.text), take * 2)
        ids = [self._window_ids(window[s:e], start + s - n, a, b) for s, e in spans]
        ends = a.ends[:keep] + [start + e for _, e in spans] + [n + e for e in b.ends[sync + 1 :]]
        return Piece(a.text + b.text, ends, a.ids[:keep] + ids + b.ids[sync + 1 :])

    def _window_ids(self, text: str, at: int, a: Piece, b: Piece) -> list[int]:
        """Ids of a window pre-token that starts `at` (0 is the seam). One made of the left part's last and the right part's
        first pre-token reuses their tokens."""
        if at < 0 < at + len(text) and at + len(text) == b.ends[0]:
            last = a.ends[-2] if len(a.ends) > 1 else 0
            if last - len(a.text) == at:
                return self.join_tokens(a.ids[-1], b.ids[0])
        return self.bpe(text.encode())

    def tree(self, text: str, leaf: int = LEAF) -> Piece:
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half], leaf), self.tree(text[half:], leaf))

    def encode(self, text: str | None, leaf: int = LEAF) -> list[int]:
        """Ids of a text; empty for an empty or null one. A text of one leaf takes the compiled encoder, which is the leaf operation in one call."""
        if not text:
            return []
        return self.enc.encode_ordinary(text) if len(text) <= leaf else self.tree(text, leaf).flat()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode()


@lru_cache(maxsize=4)
def _parsed(data: bytes) -> ByteBpe:
    return ByteBpe(data)


def read_vocabulary(path: str | None = None) -> bytes:
    """The vocabulary's file, read where the job is planned and shipped with it: executors need no copy."""
    path = path or vocabulary_path()
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return f.read()


def vocabulary(path: str | None = None) -> ByteBpe:
    return _parsed(read_vocabulary(path))


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode(docs: DataFrame, key: str, text: str, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(key, ids ARRAY<INT>): the token ids of every row's text, without special tokens.

    Null and empty texts give an empty array; strings that look like special tokens are plain text. One row per input
    row, repeated keys included. One scan and no shuffle: a text is reduced where it is read, in time near linear in
    its length. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    out_type = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _parsed(shared.value)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": [bpe.encode(t, leaf) for t in pdf["_t"]]})

    return docs.select(F.col(key), F.col(text).alias("_t")).mapInPandas(run, out_type)


def decode(coded: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the text of every row's ids; an empty one for an empty array or null."""
    shared = coded.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    out_type = T.StructType([T.StructField(key, coded.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _parsed(shared.value)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": pd.Series([bpe.decode(i) if i is not None else "" for i in pdf["_i"]], dtype=object)})

    return coded.select(F.col(key), F.col(ids).alias("_i")).mapInPandas(run, out_type)


def counter(spark: SparkSession, path: str | None = None) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens; 0 for null and empty texts."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("int")
    def count(t: pd.Series) -> pd.Series:
        bpe = _parsed(shared.value)
        return pd.Series([len(bpe.encode(x)) for x in t], dtype="int32")

    return count
