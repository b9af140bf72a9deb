"""Nights, intervals and windows. Timestamps are UTC; local wall clocks come from an IANA zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def night_of(ts: Column, zone: str = "UTC", starts_at_hour: int = 4) -> Column:
    """The date of the night a moment belongs to: nights run from 04:00 to 04:00 of the wall clock."""
    return F.to_date(local(ts, zone) - F.make_dt_interval(hours=F.lit(starts_at_hour)))


def night_start(night: Column, zone: str = "UTC", starts_at_hour: int = 4) -> Column:
    return F.to_utc_timestamp(night.cast("timestamp") + F.make_dt_interval(hours=F.lit(starts_at_hour)), zone)


def overlaps_night(start: Column, end: Column, night: Column, zone: str = "UTC", starts_at_hour: int = 4) -> Column:
    """Starts before the night ends and ends no sooner than it begins; without an end the start counts."""
    return (start < night_start(F.date_add(night, 1), zone, starts_at_hour)) & (F.coalesce(end, start) >= night_start(night, zone, starts_at_hour))


def in_ingest_window(start: Column, end: Column, floor: Column, ceiling: Column) -> Column:
    """Overlap with [floor, ceiling); without a start it is kept."""
    return start.isNull() | ((F.coalesce(end, start) >= floor) & (start < ceiling))


def passes_lookback(start: Column, published: Column, now: Column, cutoff: Column) -> Column:
    return F.coalesce(start > now, F.lit(False)) | published.isNull() | (published >= cutoff)


def overlaps_clock(start: Column, end: Column, begin: Column, until: Column, long_span_hours: int = 24) -> Column:
    """Overlap with a window of one night: without an end the start lies in it, both ends included; otherwise start <= until and end > begin.

    Spans beyond ``long_span_hours`` recur daily: equal clock times mean all day, others are projected on the window's date.
    """
    day = F.to_date(begin)
    clock = lambda c: day.cast("timestamp") + (c - F.date_trunc("day", c))
    long_span = (end.cast("long") - start.cast("long")) > long_span_hours * 3600
    same_clock = (start - F.date_trunc("day", start)) == (end - F.date_trunc("day", end))
    daily = same_clock | ((clock(start) <= until) & (clock(end) > begin))
    return F.when(end.isNull(), start.between(begin, until)).when(long_span, daily).otherwise((start <= until) & (end > begin))


def sunset_minutes(day: Column, latitude: Column) -> Column:
    """Minutes after local solar noon at which the sun sets: the declination formula of the year's day; null where it does not set."""
    declination = F.radians(F.lit(-23.44) * F.cos(F.radians(F.lit(360.0 / 365.0) * (F.dayofyear(day) + 10))))
    cosine = (F.sin(F.radians(F.lit(-0.833))) - F.sin(F.radians(latitude)) * F.sin(declination)) / (F.cos(F.radians(latitude)) * F.cos(declination))
    return F.when(F.abs(cosine) <= 1, F.degrees(F.acos(cosine)) * 4)


def window_of(spec: str, anchors: dict[str, Column]) -> tuple[Column | None, Column | None]:
    """``after X``, ``before X`` or ``A to B``; an anchor may end in ``_plus_2h`` or ``_minus_30m``. Anything else raises ValueError."""

    def at(text: str) -> Column:
        m = re.fullmatch(r"([a-z]+)(?:_(plus|minus)_(\d+)([hm]))?", text.strip())
        if not m or m[1] not in anchors:
            raise ValueError(f"no anchor: {text}")
        if not m[2]:
            return anchors[m[1]]
        shift = F.make_dt_interval(hours=F.lit(int(m[3]))) if m[4] == "h" else F.make_dt_interval(mins=F.lit(int(m[3])))
        return anchors[m[1]] + shift if m[2] == "plus" else anchors[m[1]] - shift

    if spec.startswith("after "):
        return at(spec[6:]), None
    if spec.startswith("before "):
        return None, at(spec[7:])
    if " to " in spec:
        a, b = spec.split(" to ", 1)
        return at(a), at(b)
    raise ValueError(f"no window: {spec}")


def clock_window(spec: str) -> tuple[int, int]:
    """``HH:MM-HH:MM`` as minutes; the start comes first and midnight isn't crossed."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})", spec.strip())
    if not m:
        raise ValueError(f"no window: {spec}")
    a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
    if not (a < b <= 24 * 60) or int(m[2]) > 59 or int(m[4]) > 59:
        raise ValueError(f"no window: {spec}")
    return a, b


def selected(key: Column, title: Column, selector: str) -> Column:
    """``#`` and the beginning of a handle, or else a part of the title, in any case."""
    if selector.startswith("#"):
        return F.substring(F.sha1(key), 1, 7).startswith(selector[1:].lower())
    return F.contains(F.lower(title), F.lit(selector.lower()))
