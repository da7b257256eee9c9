"""``yyyymmdd`` integers and real dates.

Integers are only a storage format: ``20170301 - 7`` is not a date. All
arithmetic goes through DATE. The helpers return SQL text, so a whole projection
is one call into the JVM however many dates it handles.
"""

from __future__ import annotations

from datetime import date, timedelta


def date_sql(ymd: str) -> str:
    """SQL text: lenient ``yyyymmdd`` -> DATE, null for anything but a calendar day."""
    return f"try_to_date(cast({ymd} as string), 'yyyyMMdd')"


def known_date_sql(ymd: str) -> str:
    """``yyyymmdd`` known to be a calendar day -> DATE, without text; anything else fails."""
    return (
        f"make_date(cast({ymd} div 10000 as int), cast({ymd} div 100 % 100 as int),"
        f" cast({ymd} % 100 as int))"
    )


def days_between_sql(later: str, earlier: str) -> str:
    """Whole days between two calendar days; negative if reversed."""
    return f"datediff({known_date_sql(later)}, {known_date_sql(earlier)})"


def lenient_days_between_sql(later: str, earlier: str) -> str:
    """The same for columns that may hold no calendar day: null instead of an error."""
    return f"datediff({date_sql(later)}, {date_sql(earlier)})"


def ymd_sql(day: str) -> str:
    """DATE -> ``yyyymmdd`` integer."""
    return f"year({day}) * 10000 + month({day}) * 100 + day({day})"


def shift_ymd_sql(ymd: str, days: int) -> str:
    """Move a ``yyyymmdd`` integer by whole days: never by integer arithmetic on the digits."""
    return ymd_sql(f"date_add({known_date_sql(ymd)}, {days})")


def days_before_sql(cutoff: str, event: str) -> str:
    """Days an event lies before the cutoff; null when it lies after (future information)."""
    days = lenient_days_between_sql(cutoff, event)
    return f"case when {days} >= 0 then {days} end"


def parse_ymd(ymd: int) -> date:
    return date(ymd // 10000, ymd // 100 % 100, ymd % 100)


def format_ymd(d: date) -> int:
    return d.year * 10000 + d.month * 100 + d.day


def add_days(ymd: int, days: int) -> int:
    """Driver-side shift for parameters such as filter bounds."""
    return format_ymd(parse_ymd(ymd) + timedelta(days=days))
