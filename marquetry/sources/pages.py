"""Feeds and web pages: RSS items, JSON-LD and microdata events, date-grouped listings, preference files. Bodies arrive as rows (source, body)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise


def parse_bodies(bodies: DataFrame, parse: Callable[[str], list[dict]], fields: list[str]) -> DataFrame:
    """One row (source, position, ``fields``...) of strings per record ``parse`` finds; a body that can't be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, body in zip(b.source, b.body):
                for i, r in enumerate(parse(body) if isinstance(body, str) else []):
                    rows.append((s, i, *[r.get(f) for f in fields]))
            yield pd.DataFrame(rows, columns=["source", "position", *fields])

    return bodies.select("source", "body").mapInPandas(run, "source string, position int, " + ", ".join(f"`{f}` string" for f in fields))


RSS_FIELDS = ["title", "link", "guid", "body", "published", "categories"]


def rss_items(body: str) -> list[dict]:
    """The items with a title; the full content before the description, the guid or else the link, the date in ISO form."""
    try:
        root = ElementTree.fromstring(body.strip())
    except ElementTree.ParseError:
        return []
    out = []
    for item in root.iter("item"):
        text = lambda tag: (item.findtext(tag) or "").strip() or None  # noqa: B023, E731
        if not text("title"):
            continue
        try:
            published = parsedate_to_datetime(text("pubDate")).isoformat() if text("pubDate") else None
        except (ValueError, TypeError):
            published = None
        content = text("{http://purl.org/rss/1.0/modules/content/}encoded") or text("description")
        out.append({"title": text("title"), "link": text("link"), "guid": text("guid") or text("link"), "body": content, "published": published, "categories": json.dumps([c.text for c in item.findall("category") if c.text])})
    return out


EVENT_FIELDS = ["name", "start", "end", "url", "venue", "address", "description"]


def jsonld_events(body: str) -> list[dict]:
    """Events of the page's JSON-LD, at any depth, with name and start; cancelled and postponed ones are left out."""
    out = []

    def walk(node) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            kinds = node.get("@type") or ""
            if any(str(k).endswith("Event") for k in (kinds if isinstance(kinds, list) else [kinds])):
                dead = re.search(r"(?i)cancell?ed|postponed", str(node.get("eventStatus", "")))
                place = node.get("location") or {}
                place = place[0] if isinstance(place, list) and place else place
                place = place if isinstance(place, dict) else {"name": place}
                address = place.get("address")
                address = ", ".join(str(v) for k, v in address.items() if not k.startswith("@")) if isinstance(address, dict) else address
                if node.get("name") and node.get("startDate") and not dead:
                    out.append({"name": str(node["name"]), "start": str(node["startDate"]), "end": node.get("endDate"), "url": node.get("url"), "venue": place.get("name"), "address": address, "description": node.get("description")})
            for v in node.values():
                if isinstance(v, (dict, list)):
                    walk(v)

    for block in re.findall(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", body):
        try:
            walk(json.loads(block))
        except ValueError:
            continue
    return out


class _Microdata(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__()
        self.found, self.depth, self.event, self.prop, self.scopes = [], 0, None, None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        name = a.get("itemprop")
        if "schema.org/Event" in (a.get("itemtype") or "") and self.event is None:
            self.event = (self.depth, {})
        elif self.event:
            # a property belongs to the innermost item around it; that of a nested item stands under the item's own name
            path = ".".join([s[1] for s in self.scopes if s[1]] + [name]) if name else None
            if name and "itemscope" not in a:
                value = a.get("content") or a.get("datetime") or (a.get("href") if name == "url" else None)
                if value:
                    self.event[1].setdefault(path, value)
                elif tag not in self.VOID:
                    self.prop = (self.depth, path, [])
            if "itemscope" in a and tag not in self.VOID:
                self.scopes.append((self.depth, name))
        if tag not in self.VOID:
            self.depth += 1

    def handle_data(self, data):
        if self.prop:
            self.prop[2].append(data)

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        self.depth -= 1
        if self.prop and self.depth <= self.prop[0]:
            text = " ".join("".join(self.prop[2]).split())
            if text and self.event:
                self.event[1].setdefault(self.prop[1], text)
            self.prop = None
        while self.scopes and self.depth <= self.scopes[-1][0]:
            self.scopes.pop()
        if self.event and self.depth <= self.event[0]:
            e = self.event[1]
            if e.get("url") and e.get("startDate"):
                address = e.get("location.address") or ", ".join(v for k, v in e.items() if k.startswith("location.address.")) or e.get("address")
                self.found.append({"name": e.get("name"), "start": e["startDate"], "end": e.get("endDate"), "url": e["url"], "venue": e.get("location.name") or e.get("location"), "address": address or None, "description": e.get("description")})
            self.event, self.scopes = None, []


def microdata_events(body: str) -> list[dict]:
    """Events marked with schema.org microdata; cards without a link or a start are left out."""
    p = _Microdata()
    p.feed(body)
    p.close()
    return p.found


LISTING_FIELDS = ["date_heading", "category", "clock", "title", "venue", "city"]


def listing_lines(body: str) -> list[dict]:
    """Lines ``7:00 PM - TITLE - VENUE - CITY`` below bold headings; a heading with a date resets the category, any other is one."""
    date = category = None
    out = []
    for inner in re.findall(r"(?is)<p[^>]*>(.*?)</p>", body):
        text = " ".join(re.sub(r"<[^>]+>", " ", inner).replace("&amp;", "&").replace("&nbsp;", " ").split())
        if re.fullmatch(r"(?is)\s*<strong[^>]*>.*?</strong>\s*", inner):
            if re.search(r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}\b", text):
                date, category = text, None
            else:
                category = text
            continue
        m = re.match(r"(?i)^(\d{1,2}(?::\d{2})? ?[ap]\.?m\.?)\s*[-–—]\s*(.+)$", text)
        if m and date:
            parts = [p.strip() for p in re.split(r"\s[-–—]\s", m[2])]
            venue, city = (parts[-2], parts[-1]) if len(parts) >= 3 else (parts[-1], None) if len(parts) == 2 else (None, None)
            title = " - ".join(parts[:-2] if len(parts) >= 3 else parts[:1])
            out.append({"date_heading": date, "category": category, "clock": m[1], "title": title, "venue": venue, "city": city})
    return out


def union_sources(frames: list[DataFrame], key: str | None = None) -> DataFrame:
    """All rows of all sources, missing columns as null; with ``key`` the first source that has it wins."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("__place", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if key:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__place"))).where("__r = 1").drop("__r")
    return out.drop("__place")


def failover(readers: list[Callable[[], DataFrame]], failed: list[Exception] | None = None) -> DataFrame | None:
    """The first reader whose whole result can be read and written, even if it has no rows; null if all fail.

    The result is a written table, so a source that fails later than its first row fails here and the next one is asked. What a reader raised is added to ``failed``.
    """
    for read in readers:
        try:
            return materialise(read(), "source")
        except Exception as problem:  # noqa: BLE001  (any failure of a source means the next one)
            if failed is not None:
                failed.append(problem)
    return None


def union_read(readers: dict[str, Callable[[], DataFrame]], failed: dict[str, Exception], key: str | None = None) -> DataFrame | None:
    """``union_sources`` over the readers that do not fail; those that do are named in ``failed`` with what they raised and passed over. Null if none is left."""
    frames = []
    for name, read in readers.items():
        problems: list[Exception] = []
        if (df := failover([read], problems)) is None:
            failed[name] = problems[0]
        else:
            frames.append(df)
    return union_sources(frames, key) if frames else None


def in_window(items: DataFrame, start: str, floor, ceiling) -> DataFrame:
    """Items that start within [floor, ceiling); what could not be interpreted, without a start, is left out."""
    return items.where((F.col(start) >= F.lit(floor)) & (F.col(start) < F.lit(ceiling)))


def titled_dates(items: DataFrame, title: str = "title", body: str = "body", zone: str = "UTC", usual_hour: int = 4) -> DataFrame:
    """Add start, timing and venue to items that carry their date in the title (``6/14/25 - Name``) and time and place in the text (``at 7pm at the Old Mill``).

    Without a time it is ``usual_hour`` with the timing unknown. Items without a date in the title get a null start.
    """
    part = lambda i: F.regexp_extract(title, r"\b(\d{1,2})/(\d{1,2})/(\d{2}(?:\d{2})?)\b", i).try_cast("int")
    text = F.regexp_replace(F.col(body), r"<[^>]+>", " ")
    clock = lambda i: F.regexp_extract(text, r"(?i)\bat (\d{1,2})(?::(\d{2}))? ?([ap])\.?m", i)
    hour = F.when(clock(3) != "", clock(1).try_cast("int") % 12 + F.when(F.lower(clock(3)) == "p", 12).otherwise(0))
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    named = {"__y": year, "__mo": part(1), "__d": part(2), "__h": F.coalesce(hour, F.lit(usual_hour)), "__mi": F.when(hour.isNotNull(), F.coalesce(clock(2).try_cast("int"), F.lit(0))).otherwise(0)}
    out = items.withColumns(named).withColumn("start", F.to_utc_timestamp(F.expr("try_make_timestamp(__y, __mo, __d, __h, __mi, CAST(0 AS DECIMAL(16, 6)))"), zone))
    venue = F.nullif(F.trim(F.regexp_extract(text, r"(?i)\bat \d{1,2}(?::\d{2})? ?[ap]\.?m\.?,? (?:at|@|in) (?:the )?([^.,;<\n]{3,60})", 1)), F.lit(""))
    return out.withColumns({"timing": F.when(hour.isNotNull(), "exact").otherwise("unknown"), "venue": venue}).drop(*named)


def preambles(items: DataFrame, body: str = "body") -> DataFrame:
    """Add venue, organisation, address and prose to items whose text begins with four lines: a heading, venue, organisation and address; blank lines do not count."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.col(body), r"(?i)<br ?/?>|</p>", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))), lambda x: x != "")
    at = lambda i: F.when(F.size(lines) >= 4, F.get(lines, F.lit(i)))
    return items.withColumns({"venue": at(1), "organisation": at(2), "address": at(3), "prose": F.array_join(F.when(F.size(lines) >= 4, F.slice(lines, 5, 1 << 20)).otherwise(lines), "\n")})


def preferences(lines: DataFrame, file: str, position: str, text: str) -> DataFrame:
    """(file, position, domain, preference, hash) of preference files: ``#`` comments, ``[domain]`` headings carried forward, one preference a line, the first of repeats."""
    clean = lines.select(F.col(file).alias("file"), F.col(position).alias("position"), F.trim(text).alias("t")).where((F.length("t") > 0) & ~F.col("t").startswith("#"))
    heading = F.nullif(F.lower(F.trim(F.regexp_extract("t", r"^\[([^\]]+)\]$", 1))), F.lit(""))
    above = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    headed = clean.withColumn("domain", F.coalesce(F.last(heading, ignorenulls=True).over(above), F.lit("general")))
    rows = headed.where(~F.col("t").rlike(r"^\[[^\]]+\]$") & (F.length("t") <= 500)).select("file", "position", "domain", F.col("t").alias("preference"), F.sha2("t", 256).alias("hash"))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("file", "domain", "hash").orderBy("position"))).where("__r = 1").drop("__r")


def hourly_readings(bodies: DataFrame) -> DataFrame:
    """(source, time, name, value) of columnar JSON readings ``{"hourly": {"time": [...], name: [...], ...}}``; arrays of other lengths are padded with null."""
    hourly = F.from_json("body", "struct<hourly: map<string, array<string>>>")["hourly"]
    series = bodies.select("source", hourly["time"].alias("times"), F.explode(F.map_filter(hourly, lambda k, v: k != "time")).alias("name", "values"))
    return series.select("source", "name", F.explode(F.arrays_zip("times", "values")).alias("x")).where("x.times IS NOT NULL").select("source", F.try_to_timestamp("x.times").alias("time"), "name", F.col("x.values").try_cast("double").alias("value"))
