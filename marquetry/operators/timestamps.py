"""Timestamps published in mixed formats and zones, normalised to one instant in UTC."""

from __future__ import annotations

import datetime as dt
import math
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.session import require_utc

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"

_BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_CLOCK = r"(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)? ?(?:([ap])\.? ?m\.?)?"
_ZONE = r" ?(z|(?:utc|gmt)?[+\-\x{2212}]\d{1,2}(?::?\d{2})?|[a-z]{2,5}|[a-z]+(?:/[a-z0-9_+\-]+)+)?(?: ?\[([a-z0-9_/+\-]+)\])?(?: ?\([^)]*\))?"
_DAYNAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? )?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_LINK = r"(?:,? ?(?:at|@|-|\x{2013}|\x{00B7}|\|)? ?"

#: Each family rewrites its text as year|month|day|hour|minute|second|fraction|half|zone|named zone, or a|b for a day and month whose order the source decides.
_FAMILIES = (
    (rf"(?i)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[t ] ?{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"(?i)^(?:;?tzid=([a-z0-9_/+\-]+):)?(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?(z|[+-]\d{2}:?\d{2})?)?$", "$2|$3|$4|$5|$6|$7|||$8|$1"),
    (rf"(?i)^{_DAYNAME}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH},?[ -](\d{{4}}|\d{{2}}){_LINK}{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^{_DAYNAME}{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}|\d{{2}}){_LINK}{_CLOCK}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^{_DAYNAME}(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_LINK}{_CLOCK}{_ZONE})?$", "$3|?$1|?$2|$4|$5|$6|$7|$8|$9|$10"),
)


def abbreviation_offsets(zones: list[str], first_year: int = 1970, last_year: int = 2040) -> list[tuple[str, str, int]]:
    """(zone, abbreviation, minutes east of UTC) for every abbreviation the given IANA zones use between two years.

    Where a zone used one abbreviation with two offsets, the latest stands. The result is bounded by the number of IANA zones.
    """
    out: dict[tuple[str, str], int] = {}
    for name in sorted({z for z in zones if z}):
        try:
            zone = ZoneInfo(name)
        except (KeyError, ValueError, OSError):
            continue
        for year in range(first_year, last_year + 1):
            for month in range(1, 13):
                at = dt.datetime(year, month, 15, tzinfo=zone)
                abbreviation = at.tzname() or ""
                if abbreviation.isalpha():
                    out[name, abbreviation.upper()] = round(at.utcoffset().total_seconds() / 60)
    return [(z, a, m) for (z, a), m in sorted(out.items())]


def read_parts(text: Column) -> Column:
    """The parts that a published timestamp text states, as an array of ten texts; null when no format fits.

    ``text`` is a cleaned text. The parts are year, month, day, hour, minute, second, fraction, half of the day, zone, and a named zone.
    """
    # the beginning tells the family, so each text meets one long pattern
    read = lambda k: F.regexp_replace(text, *_FAMILIES[k])
    rewritten = F.when(text.rlike(r"^\d{4}[-/.]"), read(0)).when(text.rlike(r"(?i)^(?:;?tzid=|\d{8})"), read(1)).when(text.rlike(rf"(?i)^{_DAYNAME}\d{{1,2}}[-/.]\d"), read(4)).when(text.rlike(rf"(?i)^{_DAYNAME}\d"), read(2)).otherwise(read(3))
    parts = F.split(rewritten, r"\|", -1)
    return F.when(F.size(parts) == 10, parts)


_EPOCH = r"^-?(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(\.\d+)?$"


def _kept(c: Column) -> Column:
    """``c``, which the optimiser then computes once: it would push a filter on it down as a copy of the whole expression, too long to compile."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _month(c: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS, 1) for x in (name, i)])
    return F.coalesce(_number(c), F.try_element_at(numbers, F.lower(F.substring(c, 1, 3))))


def to_instants(df: DataFrame, value: str, order: str, zone: str, abbreviations: DataFrame | None = None, out: str = "utc_us") -> DataFrame:
    """Add ``out``, microseconds since 1970-01-01 UTC that ``value`` denotes, or null where it denotes no instant.

    ``zone`` is the column with the IANA name for texts without one, ``order`` the column with the order of numeric dates.
    A wall-clock reading that occurs twice is the earlier instant, one that is skipped takes the offset in force before
    the change, digits below the microsecond are dropped, a date alone is its midnight. Abbreviations other than UTC and GMT are looked
    up for the row's zone in ``abbreviations(zone, abbreviation, minutes)``; unknown ones, unknown zones and
    impossible dates and times give null. Null and empty texts give null.
    """
    spark = df.sparkSession
    require_utc(spark)
    if abbreviations is None:
        names = _names(df, zone)
        abbreviations = abbreviation_table(spark, names)
    offsets = {(r[0], r[1]): r[2] for r in abbreviations.collect()}  # bounded by the IANA zones
    keys = [x for (z, a), m in offsets.items() for x in (F.lit(f"{z}|{a}"), F.lit(m))]
    lookup = F.create_map(*keys) if keys else F.create_map().cast("map<string,int>")

    p = lambda i: F.col("__p")[i]
    # a column for each step, read more than once: the optimiser then keeps the projections apart instead of repeating the patterns
    step = df.withColumn("__t", F.trim(F.regexp_replace(F.col(value), _BLANK, " ")))
    step = step.withColumn("__epoch", F.when(F.col("__t").rlike(_EPOCH), F.col("__t")))
    step = step.withColumn("__p", _kept(read_parts(F.when(F.col("__epoch").isNull(), F.col("__t")))))
    first, second = F.regexp_replace(p(1), r"^\?", ""), F.regexp_replace(p(2), r"^\?", "")
    swap = p(1).startswith("?") & (F.col(order) == "dmy")
    year, hour, half = _number(p(0)), _number(p(3)), F.lower(p(7))
    full_hour = (
        F.when((half != "") & ~hour.between(1, 12), None)
        .when(half == "p", hour % 12 + 12)
        .when(half == "a", hour % 12)
        .when((p(3) != "") & (p(4) == ""), None)
        .when(p(3) == "", 0)
        .otherwise(hour)
    )
    step = step.withColumns(
        {
            "__y": F.when(F.length(p(0)) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year),
            "__mo": F.when(swap, _number(second)).otherwise(_month(first)),
            "__d": F.when(swap, _number(first)).otherwise(_number(second)),
            "__h": full_hour,
            "__mi": F.when(p(4) == "", 0).otherwise(_number(p(4))),
            "__s": F.when(p(5) == "", 0).otherwise(_number(p(5))),
            "__us": F.coalesce(F.rpad(F.substring(p(6), 1, 6), 6, "0").try_cast("int"), F.lit(0)),
            "__zone": F.regexp_replace(F.upper(p(8)), "−", "-"),
            "__named": F.coalesce(F.when(p(9) != "", p(9)), F.when(p(8).contains("/"), p(8)), F.when(p(8) == "", F.col(zone))),
        }
    )
    # the 24th hour exists as the end of a day only
    last = (F.col("__h") == 24) & (F.col("__mi") == 0) & (F.col("__s") == 0) & (F.col("__us") == 0)
    whole = F.expr("try_make_timestamp(__y, __mo, __d, CASE WHEN __h = 24 THEN 0 ELSE __h END, __mi, CAST(__s AS DECIMAL(16,6)))")
    signed = F.split(F.regexp_replace("__zone", r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$", "$1|$2|$3"), r"\|")
    step = step.withColumns({"__local": F.when((F.col("__s") < 60) & ((F.col("__h") < 24) | last), whole), "__signed": F.when(F.col("__zone").rlike(r"[+-]\d"), signed)})
    hours, minutes = _number(F.col("__signed")[1]), F.coalesce(_number(F.col("__signed")[2]), F.lit(0))
    offset = (
        F.when(F.col("__zone").isin("Z", "UTC", "GMT"), 0)
        .when((hours <= 18) & (minutes < 60), F.when(F.col("__signed")[0] == "-", -1).otherwise(1) * (hours * 60 + minutes))
        .otherwise(F.try_element_at(lookup, F.concat(F.col(zone), F.lit("|"), F.col("__zone"))))
    )
    step = step.withColumn("__offset", offset)
    wall = F.to_utc_timestamp(F.col("__local"), F.when(F.col("__offset").isNull() & F.col("__named").isin(*sorted(_all_zones())), F.col("__named")))
    extra = F.col("__us") + F.when(F.col("__h") == 24, F.lit(86_400_000_000)).otherwise(F.lit(0))
    dated = F.unix_micros(F.coalesce(F.col("__local") - F.make_dt_interval(mins="__offset"), wall)) + extra
    digits = F.length(F.regexp_extract("__epoch", r"^-?(\d+)", 1))
    number = F.col("__epoch").try_cast("decimal(30,9)")
    scale = F.when(digits <= 10, F.lit("1000000")).when(digits <= 13, F.lit("1000")).when(digits <= 16, F.lit("1")).otherwise(F.lit("0.001"))
    counted = F.floor(number * scale.cast("decimal(10,3)")).cast("bigint")
    step = step.withColumn(out, _kept(F.when(F.col("__epoch").isNotNull(), counted).otherwise(dated)))
    return step.drop("__t", "__epoch", "__p", "__y", "__mo", "__d", "__h", "__mi", "__s", "__us", "__zone", "__named", "__local", "__signed", "__offset")


def _names(df: DataFrame, zone: str) -> list[str]:
    """The IANA names that occur in a column: known ones only, so their number is bounded by the zone database whatever the column holds."""
    return [r[0] for r in df.where(F.col(zone).isin(*sorted(_all_zones()))).select(zone).distinct().collect()]


def _all_zones() -> set[str]:
    from zoneinfo import available_timezones

    return {z for z in available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/"))} | {"UTC", "GMT"}


def abbreviation_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    return spark.createDataFrame(abbreviation_offsets(zones), "zone string, abbreviation string, minutes int")


#: A wall-clock text: one that states no zone, is no count of seconds and no date alone.
_STATES_ZONE = r"(?i)(z|utc|gmt|[+-]\d{2}:?\d{2}|\d ?[a-z]{3}|m\.? [a-z]{3})\s*$|^\s*-?\d{8,}\s*$|/[a-z_]+|^\s*\d{4}-\d\d-\d\d\s*$"


def zone_histories(first_year: int, last_year: int) -> dict[str, list[str]]:
    """The IANA zones by their offset history in those years, told week by week: a zone for each history, the first by name, with all that share it."""
    weeks = [dt.datetime(first_year, 1, 1, 12) + dt.timedelta(days=7 * k) for k in range(53 * (last_year - first_year + 1))]
    found: dict[tuple, list[str]] = {}
    for name in sorted(_all_zones()):
        zone = ZoneInfo(name)
        found.setdefault(tuple(zone.utcoffset(w) for w in weeks), []).append(name)
    return {names[0]: names for names in found.values()}


#: A span that never occurs costs as much as one in so many, and by so many nats must the best history be better than the next.
RARE, LEAST_MARGIN = 1_000, 1.0
#: What a start costs, in nats, that differs from what another feed states for that title and place: such a pair may be two shows.
SAME_COST = 2.0


def estimate_zones(df: DataFrame, source: str, local: str, other_us: str, candidates: list[str], after: str | None = None, usual: dict[int, float] | None = None, prefer: list[str] | None = None, same: str | None = None) -> DataFrame:
    """For each source, the zone whose offset history fits its wall-clock readings to known instants.

    ``local`` is a timestamp holding the wall clock, ``other_us`` an instant the reading lies before, such as that of ingestion or of the
    event's end; where the boolean column ``after`` holds it lies after it. A reading on the wrong side, or at the instant itself, violates; the zone with
    the fewest violations is chosen, among equals the one with the least distance in total, then the smaller name. Null readings and instants are left
    out; a source without any gets no row. Every reading is tried with every candidate and reduced to sums per source and zone before the shuffle.

    With ``usual``, the shares of spans in minutes, such as those between starts and ends, a violation counts by its rarity: the zone that makes the spans
    least surprising is chosen, and none (a null zone) where it is not ``LEAST_MARGIN`` nats better than the next that reads them otherwise. ``alike`` has all zones
    that read the source's readings as the chosen one does; among them those in ``prefer`` come first. Where the boolean column ``same`` holds, the instant is that of the
    same happening elsewhere: any distance violates, at a cost of ``SAME_COST``.
    """
    zones = F.explode(F.array(*[F.lit(z) for z in sorted(set(candidates))]))
    sign = F.when(F.col(after), -1).otherwise(1) if after else F.lit(1)
    lag = sign * (F.col(other_us) - F.unix_micros(F.to_utc_timestamp(F.col(local), F.col("zone")))) / F.lit(1_000_000.0)
    kept = [source, local, other_us, *(c for c in (after, same) if c)]
    lags = df.where(F.col(local).isNotNull() & F.col(other_us).isNotNull()).select(*kept, zones.alias("zone")).withColumn("lag", lag)
    worst = math.log(RARE)
    costs = F.create_map(*[F.lit(x) for m, share in sorted((usual or {}).items()) for x in (m, min(worst, -math.log(share)))]) if usual else None
    cost = F.coalesce(F.try_element_at(costs, (F.col("lag") / 60).cast("int")), F.lit(worst)) if usual else F.lit(0.0)
    if usual and same:
        cost = F.when(F.col(same), F.when(F.col("lag") == 0, 0.0).otherwise(SAME_COST)).otherwise(cost)
        lags = lags.withColumn("wrong", F.when(F.col(same), F.col("lag") != 0).otherwise(F.col("lag") <= 0))
    else:
        lags = lags.withColumn("wrong", F.col("lag") <= 0)
    fits = lags.groupBy(source, "zone").agg(F.sum(F.col("wrong").cast("int")).alias("violations"), F.round(F.sum(F.abs("lag")), 3).alias("total_lag"), F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("readings"))
    # a row per candidate: which zones read everything alike, and what the next other reading costs
    rank = F.coalesce(F.array_position(F.array(*[F.lit(z) for z in prefer]), F.col("zone")), F.lit(0)) if prefer else F.lit(0)
    fits = fits.withColumn("rank", F.when(rank > 0, rank).otherwise(1 << 20))
    order = ("cost", "violations", "total_lag", "rank", "zone")
    sorted_ = fits.groupBy(source, "readings").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("all"))
    best = F.get(F.col("all"), F.lit(0))
    other = F.get(F.filter("all", lambda x: x["total_lag"] != best["total_lag"]), F.lit(0))
    sure = other.isNull() | (other["cost"] - best["cost"] >= LEAST_MARGIN) if usual else F.lit(True)
    alike = F.transform(F.filter("all", lambda x: (x["total_lag"] == best["total_lag"]) & (x["cost"] == best["cost"])), lambda x: x["zone"])
    return sorted_.select(source, F.when(sure, best["zone"]).alias("zone"), best["violations"].alias("violations"), "readings", F.when(sure, alike).alias("alike"))


def usual_spans(rows: DataFrame, longest_minutes: int = 2_880) -> dict[int, float]:
    """The shares of the spans in minutes between starts and ends that are stated alike, both with a zone or both without, so that they need none.

    ``rows(source, start_us, end_us)`` holds such pairs. Spans of up to ``longest_minutes`` whole minutes count, so the result is bounded.
    """
    minutes = F.col("end_us") - F.col("start_us")
    found = rows.where((minutes > 0) & (minutes <= longest_minutes * 60_000_000) & (minutes % 60_000_000 == 0)).groupBy((minutes / 60_000_000).cast("int").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in found)
    return {r.m: r.n / total for r in found}


def sequences(rows: DataFrame, zones: DataFrame, candidates: list[str], alike: bool = False) -> DataFrame:
    """(source, local, other_us, after): wall-clock starts beside ends with a stated zone, and the other way round.

    With ``alike``: (source, start_us, end_us) of the starts and ends that are both without a zone or both with one. ``zones(source, tz_name, date_order)``; only
    the order is used. Rows repeat as in the input.
    """
    table = abbreviation_table(rows.sparkSession, candidates)
    ordered = rows.select("source", "start_time", "end_time").join(F.broadcast(zones.select("source", F.coalesce("date_order", F.lit("mdy")).alias("assumed_order"), F.lit("UTC").alias("assumed_zone"))), "source")
    naive = lambda c: F.col(c).rlike(r"\d.*\d") & ~F.col(c).rlike(_STATES_ZONE)
    stated = lambda c: F.col(c).rlike(_STATES_ZONE) & ~F.col(c).rlike(r"^\s*\d{8}\s*$|^\s*\d{4}-\d\d-\d\d\s*$|(?i)[a-z]{3}\s*$")
    read = lambda pairs, a, b: to_instants(to_instants(pairs, a, "assumed_order", "assumed_zone", table, "a_us"), b, "assumed_order", "assumed_zone", table, "b_us")
    if alike:
        pairs = ordered.where((naive("start_time") & naive("end_time")) | (stated("start_time") & stated("end_time")))
        return read(pairs, "start_time", "end_time").select("source", F.col("a_us").alias("start_us"), F.col("b_us").alias("end_us"))
    out = None
    for wall, sure, after in (("start_time", "end_time", False), ("end_time", "start_time", True)):
        part = read(ordered.where(naive(wall) & stated(sure)), wall, sure).select("source", F.timestamp_micros("a_us").alias("local"), F.col("b_us").alias("other_us"), F.lit(after).alias("after"))
        out = part if out is None else out.unionByName(part)
    return out


def shared_starts(rows: DataFrame, zones: DataFrame, title: str, venue: str, within_hours: int = 15) -> DataFrame:
    """(source, local, other_us, after, same): wall-clock starts beside the starts that other listings state with a zone for the same title and venue.

    Titles and venues agree in lower case without outer blanks, starts are less than ``within_hours`` apart as they stand. Equal readings of one source count once,
    and listings meet by title, venue and day, so a title of any number of dates is spread over them.
    """
    table = abbreviation_table(rows.sparkSession, ["UTC"])
    key = F.xxhash64(F.lower(F.trim(title)), F.lower(F.trim(venue)))
    own = rows.where(F.col(title).isNotNull() & F.col(venue).isNotNull()).select("source", "start_time", key.alias("key"))
    own = own.join(F.broadcast(zones.select("source", F.coalesce("date_order", F.lit("mdy")).alias("assumed_order"), F.lit("UTC").alias("assumed_zone"))), "source")
    naive = F.col("start_time").rlike(r"\d.*\d") & ~F.col("start_time").rlike(_STATES_ZONE)
    stated = F.col("start_time").rlike(_STATES_ZONE) & ~F.col("start_time").rlike(r"^\s*\d{8}\s*$|^\s*\d{4}-\d\d-\d\d\s*$|(?i)[a-z]{3}\s*$")
    read = lambda d: to_instants(d, "start_time", "assumed_order", "assumed_zone", table, "us").where("us IS NOT NULL")
    day = F.floor(F.col("us") / 86_400_000_000)
    wall = read(own.where(naive)).select("source", "key", "us", F.explode(F.sequence(day - 1, day + 1)).alias("day")).distinct()
    sure = read(own.where(stated)).select("key", F.col("us").alias("other_us"), day.alias("day")).distinct()
    met = wall.join(sure, ["key", "day"]).where(F.abs(F.col("us") - F.col("other_us")) < within_hours * 3_600_000_000)
    return met.select("source", F.timestamp_micros("us").alias("local"), "other_us", F.lit(False).alias("after"), F.lit(True).alias("same"))


def complete_zones(rows: DataFrame, zones: DataFrame, local_field: str, seen: str, candidates: list[str] | None = None) -> DataFrame:
    """``zones(source, tz_name, date_order)`` with a row for every source of ``rows``: an undeclared zone is estimated from
    the wall-clock readings of ``local_field`` against ``seen`` and of starts against ends, among ``candidates`` or the declared zones; where that is impossible it is
    UTC. A declared zone always stands."""
    declared = zones.where(F.col("tz_name").isNotNull()).select("source", "tz_name", F.coalesce("date_order", F.lit("mdy")).alias("date_order")).dropDuplicates(["source"])
    missing = rows.select("source").where(F.col("source").isNotNull()).distinct().join(F.broadcast(declared), "source", "left_anti")
    if missing.isEmpty():
        return declared
    candidates = candidates or _names(declared, "tz_name") or ["UTC"]
    open_rows = rows.join(missing, "source", "left_semi").withColumn("assumed_order", F.lit("mdy")).withColumn("assumed_zone", F.lit("UTC"))
    naive = to_instants(open_rows.where(F.col(local_field).rlike(r"\d.*\d") & ~F.col(local_field).rlike(_STATES_ZONE)), local_field, "assumed_order", "assumed_zone", out="local_us")
    readings = naive.select("source", F.timestamp_micros("local_us").alias("local"), F.unix_micros(F.col(seen).cast("timestamp")).alias("other_us"), F.lit(False).alias("after"))
    if {"start_time", "end_time"} <= set(rows.columns):
        readings = readings.unionByName(sequences(open_rows, missing.select("source", F.lit("mdy").alias("date_order")), candidates))
    guessed = missing.join(estimate_zones(readings, "source", "local", "other_us", candidates, "after"), "source", "left")
    return declared.unionByName(guessed.select("source", F.coalesce("zone", F.lit("UTC")).alias("tz_name"), F.lit("mdy").alias("date_order")))


def normalise_fields(rows: DataFrame, key: str, fields: list[str], zones: DataFrame, seen: str = "discovered_at") -> DataFrame:
    """One row (``key``, field_name, text, utc_us) for each of ``fields`` that is not null; utc_us is null for unreadable text.

    ``zones(source, tz_name, date_order)`` is broadcast: it holds one short row per feed. Repeated rows come out repeated;
    a null source is read as UTC with month first.
    """
    known = complete_zones(rows, zones, "raw_published_at" if "raw_published_at" in rows.columns else fields[0], seen).select("source", "tz_name", "date_order")
    names = _names(known, "tz_name")
    table = abbreviation_table(rows.sparkSession, names)
    stacked = rows.select(key, "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x")).select(key, "source", "x.*").where(F.col("text").isNotNull())
    zoned = stacked.join(F.broadcast(known), "source", "left").withColumns({"tz_name": F.coalesce("tz_name", F.lit("UTC")), "date_order": F.coalesce("date_order", F.lit("mdy"))})
    return to_instants(zoned, "text", "date_order", "tz_name", table).select(key, "field_name", "text", "utc_us")
