"""Same and nearly the same headlines across splits, by a compressed full-text index of the evaluation side.

Titles are brought to a canonical string: folded, without tags' marks, punctuation and spaces, each figure written one way and
led by a marker of the company the title names. Distinct evaluation titles are cut into shards of bounded size
by a hash of their company; each shard is indexed once (Burrows-Wheeler transform, stored packed, with its suffix order) and the
training titles of its companies are streamed through backward search:

* From each figure's end the search runs back to the company's marker: the interval holds every title that has this figure of
  this company; of a title's figures the rarest counts. A title without a figure is searched among those without one, from each of its places, until the interval
  is rare or can't be extended, i.e. the match is maximal. Intervals give the pairs to look at; company and figures decide on them at once.
* For each remaining pair the search runs from every place of the training title as long as the interval still holds
  a suffix of the evaluation title. That gives the pair's maximal matches; they are merged to spans, and the share of letters
  in them decides, after periods and directions have been compared.

Nothing is keyed by figure: no two titles meet but through an interval. A training title visits only its company's
shards; a company with most of the titles has several shards, and the training titles of a shard are spread
over tasks by a salt. Copies are folded to distinct titles first and joined back at the end.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut as written
from .script import fold

MARK, END = 0xF0000, "\ue000"
MARKS = 65_000
RARE = 32  # suffixes in an interval from which on a search without a figure goes no further
COVER, COVER_NO_FIGURE = 0.4, 0.8  # share of the shorter title's letters that maximal matches must cover
LEAST = 2  # symbols of a match that counts
SHARD = 2_000_000  # symbols of one index
CELL = 50_000  # distinct training titles that one task searches in one shard

_TAG = re.compile(r"<[^<>]{0,40}>|&[a-z]{2,6};")
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
_FIGURE = re.compile(r"\d+(?:\.\d+)?")
_CODE = re.compile(r"(?<![\d.])\d{6}(?![\d.])")
_CUT = re.compile(r"(?:\.{3}|…)\W*(?:\w{0,8}\W*)$")
# Words for periods, longest first, and pairs of opposite directions; a word of the second list hides the first's inside it.
_MARKED = re.compile(f"[{chr(MARK)}-{chr(0x10FFFD)}]([^{END}]*){END}")
_PERIOD = re.compile("前三季度|第?一季度|第?二季度|第?三季度|第?四季度|上半年|下半年|全年|中期|first half|second half|full year|q[1-4]")
DIRECTIONS = [
    (["增长", "上升", "增加", "多出", "同比增", "上涨", "上调", "up", "rise", "rises", "gain", "gains"], ["下降", "减少", "少了", "同比降", "下滑", "下跌", "下调", "down", "fall", "falls", "drop", "drops"]),
    (["增持"], ["减持"]),
    (["买入"], ["卖出", "偿还"]),
    (["流入"], ["流出"]),
    (["收购"], ["出售", "转让"]),
    (["质押"], ["解除质押", "解质押", "解押", "解质"]),
    (["投产"], ["停产"]),
    (["溢价"], ["折价"]),
    (["盈利", "扭亏"], ["亏损"]),
    (["win", "wins", "secure", "secures"], ["lose", "loses"]),
]


def _slipped(words: list[str]) -> re.Pattern:
    """The Chinese words with any one letter wrong."""
    forms = {w[:i] + "." + w[i + 1 :] for w in words if not w.isascii() for i in range(len(w))}
    return re.compile("|".join(sorted(forms, key=lambda w: (-len(w), w))) or "(?!)")


_SLIPPED = [(_slipped(a), _slipped(b)) for a, b in DIRECTIONS]
_SIDES = {w: (i, side) for i, pair in enumerate(DIRECTIONS) for side, words in enumerate(pair) for w in words}
_ENGLISH = re.compile(r"\b(?:" + "|".join(w for w in _SIDES if w.isascii()) + r")\b")
_DROPPED = re.compile(f"[^\\w.{END}{chr(MARK)}-{chr(0x10FFFD)}]+|_|(?<!\\d)\\.|\\.(?!\\d)")


@lru_cache(maxsize=1)
def _direction_words():
    import ahocorasick

    words = ahocorasick.Automaton()
    for w in _SIDES:
        if not w.isascii():
            words.add_word(w, w)
    words.make_automaton()
    return words


def directions(text: str) -> tuple[int, int]:
    """(bits of the pairs whose first direction the text names, bits of the second); of words inside each other the longest counts."""
    out = [0, 0]
    for w in [*(w for _, w in _direction_words().iter_long(text)), *_ENGLISH.findall(text)]:
        i, side = _SIDES[w]
        out[side] |= 1 << i
    return out[0], out[1]


def figures_of(body: str) -> list[str]:
    """The figures of a canonical string, sorted."""
    return sorted(_MARKED.findall(body))


class Names:
    """Company names and six-digit codes to be recognised in titles; both are optional. Of equal names the smallest code counts."""

    def __init__(self, names: dict[str, str]):
        self.by_name: dict[str, str] = {}
        for name, code in sorted(names.items(), key=lambda x: (x[1] or "", x[0] or "")):
            if name and code and fold(name):
                self.by_name.setdefault(fold(name), code)
        self.codes = set(self.by_name.values())
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"by_name": self.by_name, "codes": self.codes, "_automaton": None}  # built once in each worker

    def of(self, text: str) -> tuple[str, str]:
        """(company code or '', the text without its mentions). One pass whatever the number of names; the longest name at a place wins."""
        if not self.by_name:
            return "", text
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for name, code in self.by_name.items():
                self._automaton.add_word(name, (len(name), code))
            self._automaton.make_automaton()
        found, kept, at = [], [], 0
        for end, (length, code) in self._automaton.iter_long(text):
            found.append(code)
            kept += [text[at : end + 1 - length], " "]
            at = end + 1
        text = "".join([*kept, text[at:]])
        listed = [m for m in _CODE.findall(text) if m in self.codes]
        if listed:
            text = _CODE.sub(lambda m: " " if m[0] in self.codes else m[0], text)
        found += listed
        return (found[0] if found else ""), text


def canonical(title: str, names: Names) -> dict:
    """The canonical string of a title and what the check needs: company, figures, directions, period, cut."""
    text = _THOUSANDS.sub("", fold(_TAG.sub("", title)))
    cut = bool(_CUT.search(text))
    company, text = names.of(text)
    mark = chr(MARK + zlib.crc32(company.encode()) % MARKS)
    figures: list[str] = []

    def figure(m: re.Match) -> str:
        f = m[0].lstrip("0") or "0"
        f = (f.rstrip("0").rstrip(".") or "0") if "." in f else f
        figures.append(f)
        return f"{mark}{f}{END}"

    body = _DROPPED.sub("", _FIGURE.sub(figure, text))  # letters, digits, marks and points inside figures stay
    plus, minus = directions(text)
    period = "|".join(sorted({p.lstrip("第") for p in _PERIOD.findall(text)}))
    return {"body": body, "company": company, "figures": sorted(figures), "plus": plus, "minus": minus, "period": period, "cut": cut}


def symbols(body: str) -> np.ndarray:
    return np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def is_letter(raw: np.ndarray) -> np.ndarray:
    """Which symbols of joined canonical strings are letters, i.e. stand outside figures."""
    opens, closes = raw >= MARK, raw == ord(END)
    return (np.cumsum(opens) - np.cumsum(closes) <= 0) & ~closes


class Index:
    """Full-text index of strings: backward search over the Burrows-Wheeler transform; symbols are ranked densely.

    `pack` keeps the transform deflated and the suffix order in 32 bits; the search lists are rebuilt on reading.
    """

    def __init__(self, strings: list[str]):
        lengths = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        n = int(starts[-1])
        raw = symbols("\x00".join([*strings, ""]))
        alphabet, dense = np.unique(raw, return_inverse=True)
        text = dense.ravel().astype(np.int64)
        # Separators sort by position before all letters, so suffix order is total and needs no text beyond a title.
        rank = text + len(strings)
        rank[starts[1:] - 1] = np.arange(len(strings))
        k, top = 1, int(lengths.max()) if n else 0
        rank = np.unique(rank, return_inverse=True)[1].ravel().astype(np.int64)
        while k < top and n and rank.max() < n - 1:
            key = rank * (n + 1) + np.concatenate([rank[k:] + 1, np.zeros(min(k, n), np.int64)])
            rank = np.unique(key, return_inverse=True)[1].ravel().astype(np.int64)
            k *= 2
        suffixes = np.argsort(rank, kind="stable").astype(np.uint32)
        bwt = text[suffixes.astype(np.int64) - 1] if n else text
        self._open(starts, alphabet, bwt.astype(np.uint32), suffixes)

    def _open(self, starts: np.ndarray, alphabet: np.ndarray, bwt: np.ndarray, suffixes: np.ndarray) -> None:
        self.starts, self.alphabet, self.bwt, self.suffixes, self.n = starts, alphabet, bwt, suffixes, int(starts[-1])
        order = np.argsort(bwt, kind="stable")
        self.keys = bwt[order].astype(np.int64) * (self.n + 1) + order  # per symbol the rows whose transform it is
        self.owner = (np.searchsorted(starts, suffixes.astype(np.int64), side="right") - 1).astype(np.int32)  # of each row
        by_owner = np.argsort(self.owner, kind="stable")
        self.owner_rows = self.owner[by_owner].astype(np.int64) * (self.n + 1) + by_owner

    def pack(self) -> bytes:
        parts = [zlib.compress(a.tobytes(), 6) for a in (np.diff(self.starts).astype(np.uint32), self.alphabet, self.bwt)]
        parts.append(self.suffixes.tobytes())
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        sizes = np.frombuffer(data[:32], np.int64)
        at = 32 + np.concatenate([[0], np.cumsum(sizes)])
        lengths, alphabet, bwt = (np.frombuffer(zlib.decompress(data[at[i] : at[i + 1]]), np.uint32) for i in range(3))
        self = cls.__new__(cls)
        self._open(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), alphabet, bwt, np.frombuffer(data[at[3] : at[4]], np.uint32))
        return self

    def codes(self, raw: np.ndarray) -> np.ndarray:
        """Dense symbols, -1 for one that the index doesn't hold."""
        at = np.minimum(np.searchsorted(self.alphabet, raw), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == raw, at, -1).astype(np.int64)

    def back(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches extended by the symbols c to the left: one step of backward search for all queries."""
        base = c * (self.n + 1)
        a, b = np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)
        return np.where(c < 0, 0, a), np.where(c < 0, 0, b)  # keys are ordered by symbol, so a place among all keys is a row already

    def search(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of the patterns; empty ones have lo = hi."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        width = np.array([len(p) for p in patterns], np.int64)
        flat, at = self.codes(symbols("".join(patterns))), np.concatenate([[0], np.cumsum(width)])
        for step in range(int(width.max()) if m else 0):
            live = np.flatnonzero((step < width) & (lo < hi))
            lo[live], hi[live] = self.back(flat[at[live] + width[live] - 1 - step], lo[live], hi[live])
        return lo, np.maximum(lo, hi)

    def owners(self, lo: int, hi: int) -> np.ndarray:
        """Numbers of the strings in which the suffixes of an interval start."""
        return np.unique(self.owner[lo:hi])

    def holds(self, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether a suffix of the string `owner` lies in [lo, hi)."""
        base = owner * (self.n + 1)
        return np.searchsorted(self.owner_rows, base + lo) < np.searchsorted(self.owner_rows, base + hi)


class Batch:
    """Joined canonical strings of training titles, ready to be searched."""

    def __init__(self, ix: Index, bodies: list[str]):
        self.raw = symbols("".join(bodies))
        self.codes = ix.codes(self.raw)
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies], dtype=np.int64)])
        self.letter = is_letter(self.raw)


def candidates(ix: Index, batch: Batch, figures: np.ndarray, cut: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(title, evaluation string) of all pairs that share a figure of one company, or, where neither has a figure, a rare or maximal match.

    `figures` is the number of each title's figures; `cut` and `bare` tell the evaluation strings that are cut off and those without
    a figure. A pair has equal figures, or those of the cut-off side are among the other's. So every figure of a title is sought
    among cut-off strings; among all strings its rarest one is enough, and none if one of its figures stands nowhere. A figure that most titles
    have, such as a year, gives no pairs by itself.
    """
    doc = np.repeat(np.arange(len(figures)), np.diff(batch.starts))
    pairs = []

    def search(end: np.ndarray, rows: np.ndarray | None, to_mark: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(title, interval) of each search back from the ends that has a result; with `rows`, only suffixes in these rows count, and intervals are of them."""
        lo, hi, at = np.zeros(len(end), np.int64), np.full(len(end), ix.n, np.int64), end.copy()
        begin, owner = batch.starts[doc[end - 1]], doc[end - 1]
        live = np.arange(len(end))
        done = []
        while len(live):
            a, b = ix.back(batch.codes[at[live] - 1], lo[live], hi[live])
            left = (np.searchsorted(rows, b) - np.searchsorted(rows, a)) if rows is not None else b - a
            fits = left > 0
            if not to_mark:
                done.append(live[~fits])  # can't be extended: the match is maximal
            live, a, b, left = live[fits], a[fits], b[fits], left[fits]
            lo[live], hi[live], at[live] = a, b, at[live] - 1
            over = batch.raw[at[live]] >= MARK if to_mark else ((left <= RARE) & (end[live] - at[live] >= LEAST)) | (at[live] == begin[live])
            done.append(live[over])
            live = live[~over]
        found = np.concatenate(done) if done else np.zeros(0, np.int64)
        found = found[(end[found] - at[found]) >= LEAST]
        a, b = lo[found], hi[found]
        return owner[found], *((np.searchsorted(rows, a), np.searchsorted(rows, b)) if rows is not None else (a, b))

    def pair(owner: np.ndarray, a: np.ndarray, b: np.ndarray, rows: np.ndarray | None) -> None:
        n = b - a
        row = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        row = rows[row] if rows is not None else row
        pairs.append(np.unique(np.repeat(owner, n).astype(np.int64) * len(bare) + ix.owner[row]))

    places = np.arange(1, len(doc) + 1)
    ends = places[batch.raw == ord(END)]
    owner, a, b = search(ends, None, True)
    order = np.lexsort((b - a, owner))
    owner, a, b = owner[order], a[order], b[order]
    rarest = np.append(True, owner[1:] != owner[:-1])[: len(owner)] & (np.bincount(owner, minlength=len(figures)) == figures)[owner]
    pair(owner[rarest], a[rarest], b[rarest], None)
    for rows, sought in ((np.flatnonzero(cut[ix.owner]), ends), (np.flatnonzero(bare[ix.owner]), places[figures[doc] == 0])):
        if len(rows) and len(sought):
            pair(*search(sought, rows, sought is ends), rows)
    key = np.unique(np.concatenate(pairs))
    return key // len(bare), key % len(bare)


def matches(ix: Index, batch: Batch, title: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in `title` that ends a match, its length, number of the pair) for each pair and place: the longest match with the evaluation string `owner`."""
    width = np.diff(batch.starts)[title]
    pair = np.repeat(np.arange(len(title)), width)
    end = np.repeat(batch.starts[title] - np.cumsum(width) + width, width) + np.arange(int(width.sum())) + 1
    begin, own = batch.starts[title][pair], owner[pair].astype(np.int64)
    lo, hi, length = np.zeros(len(end), np.int64), np.full(len(end), ix.n, np.int64), np.zeros(len(end), np.int64)
    live = np.arange(len(end))
    while len(live):
        a, b = ix.back(batch.codes[end[live] - length[live] - 1], lo[live], hi[live])
        fits = a < b
        fits[fits] = ix.holds(own[live[fits]], a[fits], b[fits])
        live, a, b = live[fits], a[fits], b[fits]
        lo[live], hi[live], length[live] = a, b, length[live] + 1
        live = live[end[live] - length[live] > begin[live]]
    return end, length, pair


def merged(ix: Index, batch: Batch, title: np.ndarray, owner: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair: share of the shorter title's letters that lie in matches of LEAST or more symbols, these letters, merged spans.

    `letters` is the number of letters of each evaluation string. Two titles without letters share all, one without shares none.
    """
    end, length, pair = matches(ix, batch, title, owner)
    width = np.diff(batch.starts)[title]
    at = np.concatenate([[0], np.cumsum(width + 1)])
    depth = np.zeros(int(at[-1]) + 1, np.int64)
    long = length >= LEAST
    shift = (at[:-1] - batch.starts[title])[pair]
    np.add.at(depth, (end - length + shift)[long], 1)
    np.add.at(depth, (end + shift)[long], -1)
    inside = np.cumsum(depth)[:-1] > 0
    place = np.repeat(batch.starts[title], width) + np.arange(len(pair)) - np.repeat(np.cumsum(width) - width, width)
    slot = place + shift
    hit = inside[slot] & batch.letter[place]
    covered = np.bincount(pair, weights=hit, minlength=len(title)).astype(np.int64)
    first = place == batch.starts[title][pair]
    opens = inside[slot] & (first | ~inside[np.maximum(slot - 1, 0)])
    spans = np.bincount(pair, weights=opens, minlength=len(title)).astype(np.int64)
    own = np.bincount(pair, weights=batch.letter[place], minlength=len(title)).astype(np.int64)
    shorter = np.minimum(own, letters[owner])
    cover = np.where(shorter > 0, np.minimum(1.0, covered / np.maximum(shorter, 1)), (own == letters[owner]).astype(float))
    return cover, covered, spans


def _slipped_away(g: dict, n: dict) -> bool:
    """Whether `n` lacks a direction word of `g` but has, where the titles differ, a word one letter off the opposite and none one letter off the own ones."""
    for i, words in enumerate(_SLIPPED):
        if (n["plus"] | n["minus"]) >> i & 1 or not (g["plus"] ^ g["minus"]) >> i & 1:
            continue
        own, opposite = words if g["plus"] >> i & 1 else words[::-1]
        differs = [any(m not in g["body"] for m in p.findall(n["body"])) for p in (own, opposite)]
        if differs[1] and not differs[0]:
            return True
    return False


def same_fact(g: dict, n: dict) -> bool:
    """Figures equal - or, of a cut-off title, contained, if it has any -, periods and directions not opposed.

    A title in which a direction's word is slipped has the direction whose words it comes nearer to.
    """
    if g["company"] != n["company"]:
        return False
    a, b = list(g["figures"]), list(n["figures"])
    if a != b:
        few, many, cut = (b, a, n["cut"]) if len(b) < len(a) else (a, b, g["cut"])
        if not cut or not few or len(few) == len(many) or any(few.count(x) > many.count(x) for x in few):
            return False
    if (g["plus"] & n["minus"] & ~g["minus"]) or (g["minus"] & n["plus"] & ~n["minus"]) or (g["plus"] & n["minus"] & ~n["plus"]):
        return False
    if _slipped_away(g, n) or _slipped_away(n, g):
        return False
    p, q = set(filter(None, g["period"].split("|"))), set(filter(None, n["period"].split("|")))
    return not (p and q and p.isdisjoint(q))


FACTS = ["body", "company", "plus", "minus", "period", "cut"]
_FACTS = "body string, company string, plus int, minus int, period string, cut boolean"


def _figure_key(figures: list) -> int:
    return zlib.crc32("|".join(figures).encode()) | len(figures) << 32


class Shard:
    """An index with the facts of its strings."""

    def __init__(self, ix: Index, hashes: list[str], facts: list[dict], letters: np.ndarray):
        self.ix, self.hashes, self.facts, self.letters = ix, np.array(hashes, object), facts, letters
        self.company = np.array([zlib.crc32(f["company"].encode()) for f in facts], np.int64)
        for f in facts:
            f["figures"] = figures_of(f["body"])
        self.figures = np.array([_figure_key(f["figures"]) for f in facts], np.int64)
        self.cut = np.array([f["cut"] for f in facts], bool)
        self.bare = (self.figures >> 32) == 0

    def find(self, rows: pd.DataFrame) -> pd.DataFrame:
        bodies = rows["body"].tolist()
        rows = rows.astype({"plus": int, "minus": int, "cut": bool})  # beside an index's row they are floats
        facts = rows[FACTS].to_dict("records")
        company = np.array([zlib.crc32(f["company"].encode()) for f in facts], np.int64)
        for f in facts:
            f["figures"] = figures_of(f["body"])
        figures = np.array([_figure_key(f["figures"]) for f in facts], np.int64)
        cut = rows["cut"].to_numpy(bool)
        batch = Batch(self.ix, bodies)
        t, e = candidates(self.ix, batch, figures >> 32, self.cut, self.bare)
        same = figures[t] == self.figures[e]
        fewer = (figures[t] >> 32) < (self.figures[e] >> 32)
        more = (figures[t] >> 32) > (self.figures[e] >> 32)
        ok = (company[t] == self.company[e]) & (same | (fewer & cut[t]) | (more & self.cut[e]))
        t, e = t[ok], e[ok]
        ok = np.fromiter((same_fact(self.facts[j], facts[i]) for i, j in zip(t, e)), bool, len(t))
        t, e = t[ok], e[ok]
        cover, matched, spans = merged(self.ix, batch, t, e, self.letters)
        ok = cover >= np.where(self.bare[e], COVER_NO_FIGURE, COVER)
        t, e = t[ok], e[ok]
        hashes = rows["hash"].to_numpy()
        return pd.DataFrame({"e_hash": self.hashes[e], "t_hash": hashes[t], "cover": cover[ok], "matched": matched[ok], "spans": spans[ok]})


def _canonical_titles(df: DataFrame, title: str, names: Names) -> DataFrame:
    """(hash, n, facts): one row per distinct title with a letter or digit, written to shared storage."""
    distinct = df.where(F.col(title).isNotNull()).select(F.col(title).alias("_t")).distinct().select("_t", F.unhex(F.md5("_t")).alias("_h"))
    shared = df.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, t in zip(pdf["_h"], pdf["_t"]):
                c = canonical(t, shared.value)
                if c["body"]:
                    rows.append((h, len(c["body"]), *(c[f] for f in FACTS)))
            yield pd.DataFrame(rows, columns=["hash", "n", *FACTS])

    return written(distinct.mapInPandas(run, f"hash binary, n int, {_FACTS}"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's index and the facts of its strings, as one row."""
    bodies = pdf["body"].tolist()
    letters = [int(is_letter(symbols(b)).sum()) for b in bodies]
    facts = pdf[FACTS].to_dict("records")
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "packed": Index(bodies).pack(), "hashes": pdf["hash"].tolist(), "letters": letters, "facts": json.dumps(facts)}])


_SHARD = "shard int, packed binary, hashes array<binary>, letters array<int>, facts string"


def overlapping_titles(evaluation: DataFrame, training: DataFrame, title_e: str, title_t: str, names: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """(e_hash, t_hash, cover, matched, spans): md5s of each pair of distinct titles that are the same headline.

    Null titles and titles without a letter or digit match nothing. `matched` is the number of letters in merged maximal
    matches, `spans` their number. `names` maps company names to codes; without it figures alone anchor.
    """
    spark = evaluation.sparkSession
    known = Names(names or {})
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    e, t = _canonical_titles(evaluation, title_e, known), _canonical_titles(training, title_t, known)
    total = e.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * parts, 2 * -(-total // SHARD))
    bucket = F.pmod(F.xxhash64("company"), F.lit(buckets)).cast("int")
    # One row a bucket: its evaluation symbols make shards, its training titles make tasks.
    count = e.groupBy(bucket.alias("b")).agg(F.ceil(F.sum("n") / SHARD).cast("int").alias("k"))
    seen = t.groupBy(bucket.alias("b2")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("m"))
    sizes = count.join(seen, F.col("b") == F.col("b2")).select("b", "k", "m").orderBy("b").collect()
    shards, cells, shard_at, cell_at = 0, 0, {}, {}
    for b, k, m in sizes:
        shard_at[b] = (shards, k)
        for s in range(k):
            cell_at[shards + s] = (cells, m)
            cells += m
        shards += k
    plan_b = spark.createDataFrame([(b, *v, cell_at[v[0]][1]) for b, v in shard_at.items()], "_b int, _first int, _k int, _m int")
    plan_s = spark.createDataFrame([(s, *v) for s, v in cell_at.items()], "_s int, _cell int, _salts int")
    e = e.withColumn("_b", bucket).join(plan_b, "_b").withColumn("shard", (F.col("_first") + F.pmod(F.xxhash64("hash"), F.col("_k"))).cast("int"))
    built = e.select("shard", "hash", *FACTS).groupBy("shard").applyInPandas(_build, _SHARD)
    built = built.join(plan_s, F.col("shard") == F.col("_s")).withColumn("_c", F.explode(F.sequence(F.col("_cell"), F.col("_cell") + F.col("_salts") - 1))).drop("_s", "_cell", "_salts")
    t = t.withColumn("_b", bucket).join(plan_b, "_b").withColumn("shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_k") - 1)))
    t = t.join(plan_s, F.col("shard") == F.col("_s")).withColumn("_c", (F.col("_cell") + F.pmod(F.xxhash64("hash"), F.col("_salts"))).cast("int"))
    t = t.select("_c", F.lit(1).alias("side"), "hash", *FACTS)
    both = built.select("_c", F.lit(0).alias("side"), "packed", "hashes", "letters", "facts").unionByName(t, allowMissingColumns=True)
    both = both.repartitionById(parts, F.col("_c") % parts).sortWithinPartitions("_c", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for pdf in batches:
            side = pdf["side"].to_numpy()
            cuts = [0, *(np.flatnonzero(side == 0)).tolist(), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = pdf.iloc[a:b]
                if side[a] == 0:
                    r = part.iloc[0]
                    shard = Shard(Index.unpack(r["packed"]), list(r["hashes"]), json.loads(r["facts"]), np.asarray(r["letters"], np.int64))
                    part = part.iloc[1:]
                if len(part):
                    yield shard.find(part)

    return both.mapInPandas(run, "e_hash binary, t_hash binary, cover double, matched int, spans int")


def overlapping_rows(evaluation: DataFrame, training: DataFrame, key_e: str, key_t: str, title_e: str, title_t: str, names: dict[str, str] | None = None, keep_e: list[str] | None = None, keep_t: list[str] | None = None) -> DataFrame:
    """(key_e, key_t, kept columns, cover): every pair of rows whose titles are the same headline; each copy counts by itself."""
    pairs = overlapping_titles(evaluation, training, title_e, title_t, names)
    e = evaluation.where(F.col(title_e).isNotNull()).select(F.col(key_e), *(keep_e or []), F.unhex(F.md5(title_e)).alias("e_hash"))
    t = training.where(F.col(title_t).isNotNull()).select(F.col(key_t), *(keep_t or []), F.unhex(F.md5(title_t)).alias("t_hash"))
    return t.join(pairs, "t_hash").join(e, "e_hash").select(key_e, key_t, *(keep_e or []), *(keep_t or []), "cover")
