"""iCalendar documents: parsing, time zones, recurrence and overrides. Bodies arrive as rows (source, body)."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPES = {"n": "\n", "N": "\n", ",": ",", ";": ";", "\\": "\\"}


def unfold(body: str) -> list[str]:
    """Content lines; a line that begins with a blank or tab continues the one before."""
    return re.sub(r"\r?\n[ \t]", "", body.replace("\r\n", "\n")).replace("\r", "\n").split("\n")


def content_line(line: str) -> tuple[str, dict[str, str], str] | None:
    """(NAME, parameters, value); a colon within a quoted parameter is none."""
    m = re.match(r'^([A-Za-z0-9-]+)((?:;[^=;:]+=(?:"[^"]*"|[^;:]*))*):(.*)$', line)
    if not m:
        return None
    params = {k.upper(): v.strip('"') for k, v in re.findall(r';([^=;:]+)=("[^"]*"|[^;:]*)', m[2])}
    return m[1].upper(), params, m[3]


def events_in(body: str) -> list[dict]:
    """The VEVENTs of a document; nested blocks such as alarms are ignored, repeated properties are kept."""
    found, event, depth = [], None, 0
    for line in unfold(body):
        parsed = content_line(line)
        if not parsed:
            continue
        name, params, value = parsed
        if name == "BEGIN":
            if value.upper() == "VEVENT" and event is None:
                event = {}
            elif event is not None:
                depth += 1
        elif name == "END":
            if event is not None and depth == 0 and value.upper() == "VEVENT":
                found.append(event)
                event = None
            elif event is not None and depth:
                depth -= 1
        elif event is not None and depth == 0:
            text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value) if name in ("SUMMARY", "DESCRIPTION", "LOCATION", "UID") else value
            event.setdefault(name, []).append((params, text))
    return found


def instant(value: str, params: dict[str, str], zone: str) -> dt.datetime | None:
    """The instant of a date or time in UTC: with Z in UTC, with TZID in that zone, else in ``zone``; unreadable text gives null."""
    m = re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z?))?", value.strip())
    if not m:
        return None
    try:
        at = dt.datetime(*(int(x) for x in m.groups()[:3]), *(int(x or 0) for x in m.groups()[3:6]))
        tz = dt.timezone.utc if m[7] else ZoneInfo(params.get("TZID", zone))
    except (ValueError, KeyError, OSError):
        return None
    return at.replace(tzinfo=tz).astimezone(dt.timezone.utc)


def occurrences(event: dict, begin: dt.datetime, end: dt.datetime, zone: str) -> list[dt.datetime]:
    """Starts within [begin, end): the rule's, on the wall clock of the event's zone, without the excluded ones; a rule that can't be read leaves the base start."""
    from dateutil.rrule import rrulestr

    params, value = event["DTSTART"][0]
    first = instant(value, params, zone)
    if first is None:
        return []
    excluded = {instant(x, p, zone) for p, v in event.get("EXDATE", []) for x in v.split(",")}
    rule = event.get("RRULE", [(None, "")])[0][1]
    starts = [first]
    if rule:
        try:
            wall = ZoneInfo(params.get("TZID", zone))
            rule = re.sub(r"UNTIL=(\d{8})(T\d{6})?Z?", lambda m: "UNTIL=" + m[1] + (m[2] or "T235959"), rule)
            local = first.astimezone(wall).replace(tzinfo=None)
            series = rrulestr(rule, dtstart=local).between(begin.astimezone(wall).replace(tzinfo=None), end.astimezone(wall).replace(tzinfo=None), inc=True)
            starts = [x.replace(tzinfo=wall).astimezone(dt.timezone.utc) for x in series]
        except (ValueError, TypeError, KeyError, OSError):
            starts = [first]
    return [s for s in starts if begin <= s < end and s not in excluded]


def expand(events: list[dict], begin: dt.datetime, end: dt.datetime, zone: str) -> list[dict]:
    """Occurrences of a calendar: an override takes the slot (uid, recurrence-id) it names, cancelled ones vanish, overrides without a slot are added."""
    out, overrides = {}, {}
    for e in events:
        uid = e.get("UID", [(None, None)])[0][1]
        if not uid or "DTSTART" not in e:
            continue
        if "RECURRENCE-ID" in e:
            p, v = e["RECURRENCE-ID"][0]
            overrides.setdefault((uid, instant(v, p, zone)), e)
            continue
        for s in occurrences(e, begin, end, zone):
            out.setdefault((uid, s), (s, e))
    for slot, e in overrides.items():
        out.pop(slot, None)
        p, v = e["DTSTART"][0]
        s = instant(v, p, zone)
        if s is not None and begin <= s < end:
            out[slot] = (s, e)
    rows = []
    for (uid, _), (s, e) in out.items():
        if e.get("STATUS", [(None, "")])[0][1].upper() == "CANCELLED":
            continue
        p, v = e["DTSTART"][0]
        first = instant(v, p, zone)
        stop = instant(e["DTEND"][0][1], e["DTEND"][0][0], zone) if "DTEND" in e else None
        rows.append({"uid": uid, "start": s, "end": s + (stop - first) if stop and first and stop >= first else None, "all_day": len(v.strip()) == 8, **{k.lower(): e[k][0][1] if k in e else None for k in ("SUMMARY", "DESCRIPTION", "LOCATION", "URL")}})
    return sorted(rows, key=lambda r: (r["start"], r["uid"]))


SCHEMA = "source string, uid string, start timestamp, end timestamp, all_day boolean, summary string, description string, location string, url string"


def read_calendars(bodies: DataFrame, begin: dt.datetime, end: dt.datetime, zone: str = "UTC") -> DataFrame:
    """Occurrences in [begin, end) of the calendars in ``bodies(source, body)``; a null or unreadable body gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"source": s, **r} for s, body in zip(b.source, b.body) if isinstance(body, str) for r in expand(events_in(body), begin, end, zone)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for c in ("start", "end"):
                out[c] = pd.to_datetime(out[c], utc=True)
            yield out

    return bodies.select("source", "body").mapInPandas(run, SCHEMA)


def split_summary(df: DataFrame, column: str = "summary") -> DataFrame:
    """``[Venue, City, Category] Title`` in columns venue, city, category and title; without brackets the whole is the title."""
    inside = F.split(F.regexp_extract(column, r"^\s*\[([^\]]*)\]", 1), r"\s*,\s*")
    part = lambda i: F.nullif(F.trim(F.try_element_at(inside, F.lit(i))), F.lit(""))
    return df.withColumns({"venue": part(1), "city": part(2), "category": part(3), "title": F.trim(F.regexp_replace(column, r"^\s*\[[^\]]*\]", ""))})
