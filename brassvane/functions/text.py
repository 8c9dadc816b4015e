"""Text cleaning, ids and token functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Without HTML tags; ideographic space, carriage returns and line feeds become spaces, runs of white space one."""
    t = F.regexp_replace(c, "<[^>]+>", "")
    return F.trim(F.regexp_replace(F.translate(t, "　\r\n", "   "), r"\s+", " "))


def clean_entities(c: Column, limit: int = 2000) -> Column:
    """clean() with the five common entities resolved, cut to `limit` characters with three dots."""
    t = clean(c)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def snippet(c: Column, n: int) -> Column:
    t = F.trim(F.translate(c, "\n", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("…")))


def stable_id(url: Column, title: Column, code: Column, time: Column) -> Column:
    """`news_` and 16 hex digits of the md5 of the url, or of title|code|time where there is none."""
    blank = F.coalesce(url, F.lit("")) == ""
    parts = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (title, code, time)])
    return F.concat(F.lit("news_"), F.substring(F.md5(F.when(blank, parts).otherwise(url)), 1, 16))


def bigram_tokens(c: Column) -> Column:
    """Bigrams of the text's CJK characters, other characters skipped, then its lower-case alphanumeric runs of two and more."""
    t = F.coalesce(c, F.lit(""))
    han = F.regexp_extract_all(t, F.lit("([\\u4e00-\\u9fff])"), F.lit(1))
    pairs = F.when(F.size(han) > 1, F.zip_with(F.slice(han, F.lit(1), F.greatest(F.size(han) - 1, F.lit(0))), F.slice(han, F.lit(2), F.greatest(F.size(han) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    words = F.transform(F.regexp_extract_all(t, F.lit("([a-zA-Z0-9]{2,})"), F.lit(1)), F.lower)
    return F.concat(F.coalesce(pairs, F.array().cast("array<string>")), words)


def citations(c: Column) -> Column:
    """Distinct numbers cited as [证据 n]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[证据\s*(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def keywords(c: Column, stop: list[str] | None = None) -> Column:
    """Runs of two to six CJK characters, without those that are `stop` words."""
    runs = F.regexp_extract_all(c, F.lit("([\\u4e00-\\u9fff]{2,6})"), F.lit(1))
    return F.filter(runs, lambda x: ~x.isin(*stop)) if stop else runs


def loose_json(c: Column, schema: str) -> Column:
    """A JSON object out of text that may fence it, wrap it in prose, use Chinese quotes or leave trailing commas; null if there is none."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    plain = F.translate(body, "“”：，", '"":,')
    fixed = F.regexp_replace(plain, r",\s*([}\]])", "$1")
    has = F.length(body) > 0
    strict = F.from_json(F.when(has, body), schema, {"mode": "PERMISSIVE"})
    loose = F.from_json(F.when(has, fixed), schema, {"mode": "PERMISSIVE"})
    ok = lambda s, t: F.when(F.try_parse_json(F.when(has, t)).isNotNull(), s)
    # Truncated output: from the first brace on, up to eight closing braces, with and without the last, incomplete key.
    rest = F.translate(F.regexp_extract(c, r"(?s)(\{.*)", 1), "“”：，", '"":,')
    whole = F.regexp_replace(rest, r",?\s*\"[^\"]*\"?\s*:?\s*(?:\"[^\"]*)?$", "")
    repaired = [F.concat(t, F.lit("}" * n)) for t in (rest, whole) for n in range(1, 9)]
    cut = F.filter(F.array(*repaired), lambda t: F.try_parse_json(t).isNotNull())
    return F.coalesce(ok(strict, body), ok(loose, fixed), F.from_json(F.try_element_at(cut, F.lit(1)), schema, {"mode": "PERMISSIVE"}))


def messages(title: Column, body: Column, label: Column, system: str) -> Column:
    """A chat sample: system, user (title and body), assistant (label)."""
    user = F.concat(F.lit("标题："), F.coalesce(title, F.lit("")), F.lit("\n正文："), F.coalesce(body, F.lit("")))
    rows = [(F.lit("system"), F.lit(system)), (F.lit("user"), user), (F.lit("assistant"), label)]
    return F.array(*[F.struct(r.alias("role"), t.alias("content")) for r, t in rows])


def jsonp(c: Column) -> Column:
    """The JSON inside `callback(...)`; null if there is none."""
    body = F.regexp_extract(c, r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1)
    return F.when(F.length(body) > 0, body)


def parse_label(c: Column, labels: list[str], default: str = "neutral") -> Column:
    """The first of `labels`, in their order, that the text contains."""
    t = F.lower(c)
    out = F.lit(default)
    for x in reversed(labels):
        out = F.when(F.contains(t, F.lit(x)), F.lit(x)).otherwise(out)
    return out


def references(titles: Column, dates: Column) -> Column:
    """Numbered, dated lines of two arrays of texts."""
    return F.array_join(F.transform(F.arrays_zip(titles.alias("t"), dates.alias("d")), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.coalesce(r["d"], F.lit("")), F.lit("] "), F.coalesce(r["t"], F.lit("")))), "\n")


def request_key(*parts: Column) -> Column:
    """Cache key of a request: sha-256 of its parts, nulls kept apart from empty texts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def uncited(cited: Column, valid: Column) -> Column:
    """Cited numbers that aren't valid."""
    return F.array_except(cited, valid)


def snapshot_lines(names: list[str]) -> Column:
    """`name: value` lines with two decimals; nulls are skipped."""
    return F.concat_ws("\n", *[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.format_string("%.2f", F.col(n).cast("double")))) for n in names])
