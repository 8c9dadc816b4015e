"""Stock-code normalisers. All are column expressions and run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six_digit(c: Column) -> Column:
    """Six digits of a code written in any of the vendors' ways; lost leading zeros are put back.

    `sh.600519`, `600519.SH`, ` SH600519`, `4108` -> `600519`, `004108`. Null when the
    text holds no run of one to six digits.
    """
    digits = F.regexp_extract(c, r"(?<![0-9])([0-9]{1,6})(?![0-9])", 1)
    return F.when(F.length(digits) > 0, F.lpad(digits, 6, "0"))


def market_code(c: Column, sh_first: tuple[str, ...] = ("5", "6", "9")) -> Column:
    """`sh.`/`sz.` form of a code. A code with a dot keeps its prefix (lower-cased, trimmed)."""
    t = F.lower(F.trim(c))
    head = F.when(F.substring(t, 1, 1).isin(*sh_first), F.lit("sh.")).otherwise(F.lit("sz."))
    return F.when(F.instr(t, ".") > 0, t).otherwise(F.concat(head, t))


def exchange(c: Column, sh_prefixes: tuple[str, ...] = ("60", "68")) -> Column:
    """`sh` or `sz` by the leading digits of the six-digit code."""
    s = six_digit(c)
    hit = F.lit(False)
    for p in sh_prefixes:
        hit = hit | s.startswith(p)
    return F.when(s.isNull(), None).when(hit, F.lit("sh")).otherwise(F.lit("sz"))


def hk_code(c: Column) -> Column:
    """Five-digit Hong Kong code: digits only, left-padded."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) > 0, F.lpad(digits, 5, "0"))


def all_codes(c: Column) -> Column:
    """Distinct six-digit codes of a field that may hold several, in order of appearance."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{6})(?![0-9])"), F.lit(1)), F.array().cast("array<string>")))


# Boards by the first two digits; others have the default.
BOARDS = {"60": "沪主板", "68": "科创板", "00": "深主板", "30": "创业板"}


def board(c: Column, default: str = "其他") -> Column:
    """The board of a code by its first two digits; null for no code."""
    s = six_digit(c)
    out = F.lit(default)
    for head, name in BOARDS.items():
        out = F.when(s.startswith(head), F.lit(name)).otherwise(out)
    return F.when(s.isNotNull(), out)
