"""Parsers of calendars, feeds and pages on short documents of our own, and the streaming forms."""

import datetime as dt

from pyspark.sql import functions as F

from marquetry.sources import pages
from marquetry.sources.calendars import content_line, events_in, read_calendars, split_summary, unfold
from marquetry.sources.pages import EVENT_FIELDS, LISTING_FIELDS, RSS_FIELDS, failover, hourly_readings, jsonld_events, listing_lines, microdata_events, parse_bodies, preferences, rss_items, union_sources
from marquetry.streaming.windows import latch_stream, night_counts

UTC = dt.timezone.utc
ICS = """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:weekly
DTSTART;TZID=America/New_York:20250301T190000
DTEND;TZID=America/New_York:20250301T210000
RRULE:FREQ=WEEKLY;COUNT=5
EXDATE;TZID=America/New_York:20250315T190000
SUMMARY:[Old Mill\\, Ullton] Fiddle\\, flute and
  friends
BEGIN:VALARM
SUMMARY:ignored
END:VALARM
END:VEVENT
BEGIN:VEVENT
UID:weekly
RECURRENCE-ID;TZID=America/New_York:20250308T190000
DTSTART;TZID=America/New_York:20250308T200000
SUMMARY:moved
END:VEVENT
BEGIN:VEVENT
UID:gone
STATUS:CANCELLED
DTSTART:20250302T120000Z
END:VEVENT
BEGIN:VEVENT
UID:day
DTSTART;VALUE=DATE:20250320
SUMMARY:all day
END:VEVENT
END:VCALENDAR"""


def test_calendar(spark):
    assert unfold("A:1\r\n 2\nB:3") == ["A:12", "B:3"]
    assert content_line('X;P="a:b";Q=c:v:w') == ("X", {"P": "a:b", "Q": "c"}, "v:w")
    assert len(events_in(ICS)) == 4
    bodies = spark.createDataFrame([("s", ICS), ("t", None), ("u", "no calendar")], "source string, body string")
    rows = read_calendars(bodies, dt.datetime(2025, 3, 1, tzinfo=UTC), dt.datetime(2025, 4, 1, tzinfo=UTC)).orderBy("start").collect()
    assert [(r.uid, str(r.start), r.summary) for r in rows] == [
        ("weekly", "2025-03-02 00:00:00", "[Old Mill, Ullton] Fiddle, flute and friends"), ("weekly", "2025-03-09 01:00:00", "moved"), ("day", "2025-03-20 00:00:00", "all day"),
        ("weekly", "2025-03-22 23:00:00", "[Old Mill, Ullton] Fiddle, flute and friends"), ("weekly", "2025-03-29 23:00:00", "[Old Mill, Ullton] Fiddle, flute and friends"),
    ]
    assert (rows[0].end - rows[0].start).seconds == 7200 and rows[2].all_day
    s = split_summary(spark.createDataFrame([(rows[0].summary,)], "summary string")).collect()[0]
    assert (s.venue, s.city, s.category, s.title) == ("Old Mill", "Ullton", None, "Fiddle, flute and friends")


def test_feeds_and_pages(spark):
    rss = "<rss><channel><item><title>T</title><link>http://x</link><pubDate>Tue, 08 Apr 2025 17:32:58 -0500</pubDate><category>a</category></item><item><link>y</link></item></channel></rss>"
    page = '<script type="application/ld+json">{"@graph":[{"@type":"MusicEvent","name":"N","startDate":"2025-01-01","location":{"name":"V","address":{"streetAddress":"1 A St","addressLocality":"B"}}},{"@type":"Event","name":"X","startDate":"2025-01-02","eventStatus":"https://schema.org/EventCancelled"}]}</script><script type="application/ld+json">{broken</script>'
    micro = '<div itemscope itemtype="http://schema.org/Event"><a itemprop="url" href="/e/1"><span itemprop="name"> A  B </span></a><meta itemprop="startDate" content="2025-02-02T20:00"></div><div itemtype="http://schema.org/Event"><span itemprop="name">no link</span></div>'
    lines = "<p><strong>Friday, March 7</strong></p><p><strong>Music</strong></p><p>7:00 PM - Fiddles - live - Old Mill - Ullton</p><p>8 pm – Alone</p><p><strong>Saturday, March 8</strong></p><p>9:00 PM - Trivia - Barn</p>"
    bodies = spark.createDataFrame([("r", rss), ("p", page), ("m", micro), ("l", lines), ("n", None)], "source string, body string")
    assert [(r.title, r.guid, r.published) for r in parse_bodies(bodies, rss_items, RSS_FIELDS).collect()] == [("T", "http://x", "2025-04-08T17:32:58-05:00")]
    assert [(r.name, r.venue, r.address) for r in parse_bodies(bodies, jsonld_events, EVENT_FIELDS).collect()] == [("N", "V", "1 A St, B")]
    assert [(r.name, r.url, r.start) for r in parse_bodies(bodies, microdata_events, EVENT_FIELDS).collect()] == [("A B", "/e/1", "2025-02-02T20:00")]
    got = [(r.date_heading, r.category, r.title, r.venue, r.city) for r in parse_bodies(bodies, listing_lines, LISTING_FIELDS).orderBy("position").collect()]
    assert got == [("Friday, March 7", "Music", "Fiddles - live", "Old Mill", "Ullton"), ("Friday, March 7", "Music", "Alone", None, None), ("Saturday, March 8", None, "Trivia", "Barn", None)]


def test_small_readers(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["# c", "jazz", "[Film]", "noir", "noir", "", "x" * 501])], "file string, pos int, line string")
    assert [(r.domain, r.preference) for r in preferences(lines, "file", "pos", "line").orderBy("position").collect()] == [("general", "jazz"), ("film", "noir")]
    a, b = spark.createDataFrame([(1, "a")], "k int, x string"), spark.createDataFrame([(1, "b", 2), (2, "b", 3)], "k int, x string, y int")
    assert {(r.k, r.x) for r in union_sources([a, b], "k").collect()} == {(1, "a"), (2, "b")}

    def broken():
        raise OSError

    assert failover([broken, lambda: a.where("false"), lambda: b]).count() == 0 and failover([broken]) is None
    r = hourly_readings(spark.createDataFrame([("s", '{"hourly":{"time":["2025-01-01T00:00","2025-01-01T01:00"],"t":[1.5,null]}}'), ("u", "bad")], "source string, body string")).orderBy("time").collect()
    assert [(str(x.time), x.name, x.value) for x in r] == [("2025-01-01 00:00:00", "t", 1.5), ("2025-01-01 01:00:00", "t", None)]


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 2, 3, 59), "a"), (dt.datetime(2025, 1, 2, 4, 0), "a"), (dt.datetime(2025, 1, 2, 5, 0), "a")]
    spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = night_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("nights").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r.night), r.n) for r in spark.table("nights").collect()} == {("2025-01-01", 1), ("2025-01-02", 2)}
    spark.createDataFrame([("s", 10, 9), ("s", 20, 12), ("t", 10, 1)], "p string, seen long, churned long").coalesce(1).write.parquet(str(tmp_path / "runs"))
    runs = spark.readStream.schema("p string, seen long, churned long").parquet(str(tmp_path / "runs"))
    q = latch_stream(runs, "p").writeStream.outputMode("update").format("memory").queryName("latched").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.p, r.evidence, r.runs, r.armed) for r in spark.table("latched").where(F.col("p") == "s").collect()} == {("s", 21, 2, True)}


def test_nested_places_and_failing_sources(spark):
    page = """<div itemscope itemtype="http://schema.org/Event"><div itemprop="location" itemscope itemtype="http://schema.org/Place"><span itemprop="name">Old Mill</span>
      <div itemprop="address" itemscope><span itemprop="streetAddress">1 Elm St</span><span itemprop="addressLocality">Holt</span></div></div>
      <h2 itemprop="name">Jazz Night</h2><a itemprop="url" href="/j">x</a><meta itemprop="startDate" content="2025-06-01T20:00"></div>
      <div itemscope itemtype="http://schema.org/Event"><h2 itemprop="name">Folk</h2><span itemprop="location">Barn</span><a itemprop="url" href="/f">x</a><time itemprop="startDate" datetime="2025-06-02">x</time></div>"""
    got = [(e["name"], e["venue"], e["address"]) for e in pages.microdata_events(page)]
    assert got == [("Jazz Night", "Old Mill", "1 Elm St, Holt"), ("Folk", "Barn", None)]

    def broken():
        return spark.range(5).selectExpr("CAST(id AS STRING) AS id", "IF(id = 4, raise_error('late'), 1) AS n")

    def good():
        return spark.sql("SELECT 'a' AS id, 1 AS n")

    failed: dict = {}
    assert [r.id for r in pages.union_read({"bad": broken, "good": good}, failed).collect()] == ["a"] and list(failed) == ["bad"]
    assert pages.failover([broken, good]).count() == 1 and pages.failover([broken]) is None and pages.union_read({}, {}) is None


def test_items_with_dates_in_titles_and_preambles(spark):
    items = spark.createDataFrame([("6/14/25 - Owls", "<p>Music at 7:30pm at the Old Mill. Bring friends</p>"), ("7/4/2025 Parade", "All day"), ("No date", "at 8pm"), ("13/40/25 x", None)], "title string, body string")
    rows = [(str(r.start), r.timing, r.venue) for r in pages.titled_dates(items, zone="America/New_York").collect()]
    assert rows == [("2025-06-14 23:30:00", "exact", "Old Mill"), ("2025-07-04 08:00:00", "unknown", None), ("None", "exact", None), ("None", "unknown", None)]
    kept = pages.in_window(pages.titled_dates(items), "start", dt.datetime(2025, 7, 1), dt.datetime(2025, 8, 1))
    assert [r.title for r in kept.collect()] == ["7/4/2025 Parade"]
    pre = pages.preambles(spark.createDataFrame([("Event<br>Main Hall<br/>Library<br>1 Elm St<br><b>Come</b> in<br>Free",), ("Short",)], "body string")).collect()
    assert [(r.venue, r.organisation, r.address, r.prose) for r in pre] == [("Main Hall", "Library", "1 Elm St", "Come in\nFree"), (None, None, None, "Short")]
