"""Durations, alarms, cache lifetimes and back-off in epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes before the end at which a watched lot is announced; lifetimes of cached results by status, in milliseconds.
ALARMS = (15, 2)
LIFETIMES = {"ok": 12 * 3_600_000, "no_results": 15 * 60_000, "blocked": 5 * 60_000}
OTHER_LIFETIME = 2 * 60_000


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def alarm_at(now: Column, ends: Column, minutes: Column) -> Column:
    """When to announce, a second from now at the earliest; null for a lot that has ended."""
    return F.when(ends > now, F.greatest(now + 1000, ends - minutes * 60_000))


def countdown(ms: Column) -> Column:
    """1d 2h, 2h 3m, 3m or Ended; null for an unknown time."""
    minutes = F.floor(ms / 60_000)
    days, hours, rest = F.floor(minutes / 1440), F.floor(F.pmod(minutes, F.lit(1440)) / 60), F.pmod(minutes, F.lit(60))
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(ms <= 0, "Ended").when(days > 0, F.concat_ws(" ", text(days, "d"), text(hours, "h"))).when(hours > 0, F.concat_ws(" ", text(hours, "h"), text(rest, "m"))).otherwise(text(rest, "m"))


def duration_ms(x: Column) -> Column:
    """Milliseconds of a text like ``1d 2h 3m 4s``; null without any part."""
    part = lambda unit: F.nullif(F.regexp_extract(x, rf"(?i)(\d+)\s*{unit}", 1), F.lit("")).try_cast("long")
    sizes = {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000}
    total = sum((F.coalesce(part(u), F.lit(0)) * n for u, n in sizes.items()), F.lit(0).cast("long"))
    return F.when(F.coalesce(*(part(u) for u in sizes)).isNotNull(), total)


def end_time(absolute: Column, relative: Column) -> Column:
    """struct(at, approximate): the stated end, unless it is over five minutes from the relative one."""
    far = F.abs(absolute - relative) > 300_000
    return F.struct(F.when(far, relative).otherwise(F.coalesce(absolute, relative)).alias("at"), (absolute.isNull() | F.coalesce(far, F.lit(False))).alias("approximate"))


def lifetime(status: Column) -> Column:
    out = F.lit(OTHER_LIFETIME)
    for name, ms in LIFETIMES.items():
        out = F.when(status == name, ms).otherwise(out)
    return out


def backoff(failures: Column, floor: Column) -> Column:
    """Milliseconds to wait after so many failures in a row: doubled from 5 s, at least ``floor``, at most two minutes."""
    return F.least(F.lit(120_000), F.greatest(floor, (5000 * F.pow(F.lit(2), F.least(F.lit(5), failures - 1))).cast("long"))).cast("long")
