"""Time texts to seconds and back, as native expressions.

Four parsers exist on purpose: the sites and sheets the data comes from disagree on what ``a:b:c`` means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted layouts, tried in this order, and the texts that mean "no time".
STAGE_TIME_LAYOUTS = {
    "m:s.f": r"^(\d{1,2}):(\d{2})\.(\d{1,3})$",
    "h:m:s.f": r"^(\d{1,2}):(\d{2}):(\d{1,2})\.(\d{1,3})$",
    "h:m:s:f": r"^(\d{1,2}):(\d{2}):(\d{2}):(\d{1,3})$",
    "a:b:c": r"^(\d{1,2}):(\d{2}):(\d{1,3})$",
    "m:s": r"^(\d{1,2}):(\d{2})$",
}
NO_TIME_MARKERS = r"DNF|DNS|DSQ|—|N/A|RET"

DASH = "—"


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _millis(text: Column, pattern: str, group: int) -> Column:
    """A fraction of one to three digits, read as thousandths after padding on the right."""
    return F.rpad(F.regexp_extract(text, pattern, group), 3, "0").try_cast("int") / F.lit(1000.0)


def parse_stage_time(text: Column) -> Column:
    """Seconds of a published stage time, NULL when the text is no time."""
    t = F.upper(F.trim(text))
    msf, hmsf, hmsx, abc, ms = STAGE_TIME_LAYOUTS.values()
    third = F.regexp_extract(t, abc, 3)
    as_tenths = (F.length(third) == 1) | (_int(t, abc, 1) > 59)
    return (
        F.when(t.isNull() | (t == "") | t.rlike(NO_TIME_MARKERS), None)
        .when(t.rlike(msf), _int(t, msf, 1) * 60 + _int(t, msf, 2) + _millis(t, msf, 3))
        .when(
            t.rlike(hmsf),
            _int(t, hmsf, 1) * 3600 + _int(t, hmsf, 2) * 60 + _int(t, hmsf, 3) + _millis(t, hmsf, 4),
        )
        .when(
            t.rlike(hmsx),
            _int(t, hmsx, 1) * 3600 + _int(t, hmsx, 2) * 60 + _int(t, hmsx, 3) + _millis(t, hmsx, 4),
        )
        .when(t.rlike(abc) & as_tenths, _int(t, abc, 1) * 60 + _int(t, abc, 2) + _millis(t, abc, 3))
        .when(
            t.rlike(abc),
            (_int(t, abc, 1) * 3600 + _int(t, abc, 2) * 60 + _int(t, abc, 3)).cast("double"),
        )
        .when(t.rlike(ms), (_int(t, ms, 1) * 60 + _int(t, ms, 2)).cast("double"))
    )


def parse_live_time(text: Column) -> Column:
    """Seconds of a live-feed time; 0 when unreadable. ``m:s:t`` when t < 10 and s < 60, else ``h:m:s``."""
    parts = F.split(F.regexp_replace(text, ",", "."), ":")
    n = F.size(parts)
    a, b, c = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3))
    return F.coalesce(
        F.when(n == 2, a * 60 + b)
        .when((n == 3) & (c < 10) & (b < 60), a * 60 + b + c / 10.0)
        .when(n == 3, a * 3600 + b * 60 + c),
        F.lit(0.0),
    )


def _manual_parts(text: Column):
    t = F.regexp_replace(F.trim(text), ",", ".")
    parts = F.split(t, ":")
    texts = [F.trim(F.try_element_at(parts, F.lit(i))) for i in (1, 2, 3)]
    return t, F.size(parts), texts


def parse_manual_time(text: Column) -> Column:
    """Seconds of a hand-entered time, NULL when it breaks a range rule (see ``manual_time_error``)."""
    t, n, (p1, p2, p3) = _manual_parts(text)
    whole = r"^[+-]?\d+$"
    first = F.when(p1.rlike(whole), p1.try_cast("int"))
    second = F.when(p2.rlike(whole), p2.try_cast("int"))
    sec2 = p2.try_cast("double")
    digits = p3.rlike(r"^\d+$")
    third = F.when(digits, p3.try_cast("int"))
    value = (
        F.when(n == 1, t.try_cast("double"))
        .when((n == 2) & (first >= 0) & (sec2 > 0) & (sec2 < 60), first * 60 + sec2)
        .when((n == 3) & (first >= 0) & second.between(0, 59) & (F.length(p3) == 1), first * 60 + second + third / F.lit(10.0))
        .when((n == 3) & (first >= 0) & second.between(0, 59) & (F.length(p3) == 3), first * 60 + second + third / F.lit(1000.0))
        .when(
            (n == 3) & (first >= 0) & second.between(0, 59) & (F.length(p3) == 2) & (third < 60),
            (first * 3600 + second * 60 + third).cast("double"),
        )
    )
    return F.when(value > 0, value)


def manual_time_error(text: Column) -> Column:
    """Why ``parse_manual_time`` gave NULL; NULL for a readable time."""
    t, n, (p1, p2, p3) = _manual_parts(text)
    sec2 = p2.try_cast("double")
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(parse_manual_time(text).isNotNull(), None)
        .when((n == 2) & (sec2 >= 60), "seconds_not_below_60")
        .when((n == 3) & (p2.try_cast("int") >= 60), "middle_not_below_60")
        .when((n == 3) & (F.length(p3) == 2) & (p3.try_cast("int") >= 60), "last_not_below_60")
        .when((n == 1) & (t.try_cast("double") <= 0), "not_positive")
        .otherwise("bad_format")
    )


def parse_collector_time(text: Column) -> Column:
    """Seconds of a collector time split on ``:`` or ``.``; the last of 3 or 4 parts are tenths."""
    t = F.regexp_replace(F.trim(text), ",", ".")
    parts = F.split(t, "[:.]")
    n = F.size(parts)
    a, b, c, d = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3, 4))
    value = (
        F.when(n == 4, a * 3600 + b * 60 + c + d / 10.0)
        .when(n == 3, a * 60 + b + c / 10.0)
        .when(n == 2, a * 60 + b)
    )
    return F.when(value > 0, value)


def _minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60).cast("bigint")


def _rest(seconds: Column) -> Column:
    return seconds - F.floor(seconds / 60) * 60


def format_time(seconds: Column) -> Column:
    """``M:SS.ff`` or ``H:MM:SS.ff``; a dash for NULL and negative input."""
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes = F.floor((seconds - hours * 3600) / 60).cast("bigint")
    return (
        F.when(seconds.isNull() | (seconds < 0), DASH)
        .when(hours > 0, F.format_string("%d:%02d:%05.2f", hours, minutes, _rest(seconds)))
        .otherwise(F.format_string("%d:%05.2f", minutes, _rest(seconds)))
    )


def format_minutes(seconds: Column, decimals: int = 2) -> Column:
    """``M:SS.ff`` (or ``.fff``) without an hour part; zero or less gives ``0:00.00``."""
    width = decimals + 3
    zero = "0:00." + "0" * decimals
    return F.when(seconds <= 0, zero).otherwise(
        F.format_string(f"%d:%0{width}.{decimals}f", _minutes(seconds), _rest(seconds))
    )


def format_manual(seconds: Column) -> Column:
    """``MM:SS:mmm`` with a sign, rounded to the millisecond before it is cut into parts."""
    millis = F.bround(F.abs(seconds) * 1000).cast("bigint")
    total = F.floor(millis / 1000).cast("bigint")
    return F.concat(
        F.when(seconds < 0, "-").otherwise(""),
        F.format_string("%02d:%02d:%03d", F.floor(total / 60).cast("bigint"), total % 60, millis % 1000),
    )


def format_collector(seconds: Column) -> Column:
    """``MM:SS,t``; tenths are rounded half to even but never carried."""
    tenths = F.least(F.bround((seconds - F.floor(seconds)) * 10).cast("bigint"), F.lit(9).cast("bigint"))
    return F.when(seconds.isNull() | (seconds <= 0), "00:00,0").otherwise(
        F.format_string("%02d:%02d,%d", _minutes(seconds), F.floor(_rest(seconds)).cast("bigint"), tenths)
    )
