"""Readers of dates and times as vendors write them. Session time zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"^(\d{4})[-/年]?(\d{1,2})[-/月]?(\d{1,2})日?"
_TIMED = r"^\d{4}(?:-\d{1,2}-\d{1,2}|/\d{1,2}/\d{1,2}|年\d{1,2}月\d{1,2}日)(?:[T ]*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(Z|\+00:?00|\+08:?00)?)?$"
_PACKED = r"^(\d{8})(\d{2})(\d{2})(\d{2})$"


def day_of(text: Column, offset_hours: int = 8) -> Column:
    """Local calendar day of a time written in any of the known ways, null if it isn't one.

    Understood: `yyyy-MM-dd[ T]HH:mm[:ss]`, a bare day, `/` or Chinese separators, the same
    packed into 8 or 14 digits, and instants (a trailing Z, or 13 digits of epoch milliseconds),
    which are moved by `offset_hours`. Impossible days and times of day give null.
    """
    usual = text.rlike(r"^\d{4}-\d{2}-\d{2}( ([01]\d|2[0-3]):[0-5]\d:[0-5]\d)?$")
    # The usual writing takes one pattern; the others are tried for the rest only.
    return F.when(usual, F.try_to_date(F.when(usual, F.substring(text, 1, 10)), "yyyy-MM-dd")).otherwise(_unusual_day(text, offset_hours))


def _unusual_day(text: Column, offset_hours: int) -> Column:
    t = F.trim(F.regexp_replace(text, r"[\s　]+", " "))
    packed = t.rlike(_PACKED) | t.rlike(r"^\d{8}$")
    timed = t.rlike(_TIMED)
    y, m, d = (F.regexp_extract(t, _DAY, i) for i in (1, 2, 3))
    day = F.when(packed, F.substring(t, 1, 8)).when(timed, F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    day = F.when(F.length(day) == 8, F.try_to_date(day, "yyyyMMdd"))
    num = lambda c: F.coalesce(F.when(c != "", c).cast("int"), F.lit(0))
    hour = F.when(packed, num(F.regexp_extract(t, _PACKED, 2))).otherwise(num(F.regexp_extract(t, _TIMED, 1)))
    minute = F.when(packed, num(F.regexp_extract(t, _PACKED, 3))).otherwise(num(F.regexp_extract(t, _TIMED, 2)))
    second = F.when(packed, num(F.regexp_extract(t, _PACKED, 4))).otherwise(num(F.regexp_extract(t, _TIMED, 3)))
    zone = F.regexp_extract(t, _TIMED, 4)
    instant = (zone == "Z") | zone.startswith("+00")
    day = F.when((hour < 24) & (minute < 60) & (second < 60), day)
    day = F.when(instant & (hour + offset_hours >= 24), F.date_add(day, 1)).otherwise(day)
    epoch = t.rlike(r"^\d{13}$")
    ms = F.when(epoch, t).cast("bigint")
    return F.when(epoch, F.date_from_unix_date(F.floor((ms / 1000 + offset_hours * 3600) / 86400).cast("int"))).otherwise(day)


def second_of(text: Column, offset_hours: int = 8) -> Column:
    """Second of the local day of a time that day_of reads; 0 for a bare day, null if it isn't a time."""
    t = F.trim(F.regexp_replace(text, r"[\s　]+", " "))
    packed = t.rlike(_PACKED)
    num = lambda i: F.coalesce(F.when(packed, F.regexp_extract(t, _PACKED, i + 1)).otherwise(F.regexp_extract(t, _TIMED, i)).try_cast("int"), F.lit(0))
    zone = F.regexp_extract(t, _TIMED, 4)
    moved = F.when((zone == "Z") | zone.startswith("+00"), offset_hours * 3600).otherwise(0)
    ms = F.when(t.rlike(r"^\d{13}$"), t).cast("bigint")
    second = F.coalesce(F.floor(ms / 1000) + offset_hours * 3600, num(1) * 3600 + num(2) * 60 + num(3) + moved) % 86400
    return F.when(day_of(text, offset_hours).isNotNull(), second.cast("int"))


def is_standard_time(text: Column) -> Column:
    """True for a valid `yyyy-MM-dd HH:mm:ss` time of exactly 19 characters; null for null."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d$") & (F.length(text) == 19)
    return F.when(text.isNull(), None).otherwise(shape & F.try_to_date(F.when(shape, F.substring(text, 1, 10)), "yyyy-MM-dd").isNotNull())


def quarter_end(text: Column) -> Column:
    """Quarter's end of a report_date in any writing: `yyyyMMdd`, with separators, or `yyyyQn`."""
    t = F.trim(text)
    q = F.regexp_extract(t, r"^(\d{4})[Qq]([1-4])$", 2)
    year = F.substring(t, 1, 4)
    by_quarter = F.concat(year, F.element_at(F.create_map(*[F.lit(x) for x in ("1", "0331", "2", "0630", "3", "0930", "4", "1231")]), F.when(q != "", q)))
    parts = r"^(\d{4})[-/.年]?(\d{1,2})[-/.月]?(\d{1,2})日?$"
    spelled = F.concat(F.regexp_extract(t, parts, 1), F.lpad(F.regexp_extract(t, parts, 2), 2, "0"), F.lpad(F.regexp_extract(t, parts, 3), 2, "0"))
    packed = F.when(t.rlike(r"^\d{8}$"), t).when(q != "", by_quarter).when(t.rlike(parts), spelled)
    return F.when(F.length(packed) == 8, F.try_to_date(packed, "yyyyMMdd"))
