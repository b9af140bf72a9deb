"""Text keys, hashes and small parsers as Column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = r"[\s\x{00A0}]+"


def collapse(c: Column) -> Column:
    """Runs of blanks and no-break spaces become one blank; ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition, which has no built-in; already composed text passes unchanged."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_text(c: Column) -> Column:
    return collapse(nfc(c))


def canonical_title(c: Column) -> Column:
    """Lower case; w/o, w/ and & written out; blanks collapsed."""
    out = F.lower(c)
    for pattern, to in ((r"\bw/o\b", "without"), (r"\bw/", "with "), ("&", " and ")):
        out = F.regexp_replace(out, pattern, to)
    return collapse(out)


def canonical_venue(c: Column) -> Column:
    """Lower case without one leading article; blanks collapsed."""
    return F.regexp_replace(F.lower(collapse(c)), "^(the|a|an) ", "")


def swap_article(c: Column) -> Column:
    """``Foo, The`` becomes ``The Foo``."""
    return F.regexp_replace(collapse(c), r"(?i)^(.*), (the|a|an)$", "$2 $1")


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Python's title case, which differs from ``initcap`` after apostrophes, digits and hyphens."""
    return s.map(lambda t: None if t is None else t.title())


def html_to_text(c: Column) -> Column:
    """Anchors as ``text (url)``, block tags as line breaks, other tags dropped, the five basic entities resolved, one blank line at most."""
    out = F.regexp_replace(c, r"(?is)<a\b[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "$2 ($1)")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\s*/?>", "\n")
    out = F.regexp_replace(out, "(?s)<[^>]*>", "")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(to))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\x{00A0}]+", " "), r" ?\n ?", "\n")
    return F.when(c.rlike("[<&]"), F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))).otherwise(c)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def derived_id(kind: Column, *parts: Column) -> Column:
    """``kind:`` and 16 hex digits of the hash of the parts, null parts as empty ones; null if every part is blank."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    some = F.lit(False)
    for p in parts:
        some = some | (F.trim(F.coalesce(p.cast("string"), F.lit(""))) != "")
    return F.when(some, F.concat(kind, F.lit(":"), F.substring(F.sha2(joined, 256), 1, 16)))


def short_handle(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 7)


def hash_bucket(c: Column, n: int) -> Column:
    """The first 64 bits of the SHA-256 of ``c``, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


def handles_in(c: Column) -> Column:
    """Distinct lower-case handles ``@name`` of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(@[A-Za-z0-9_.]+)"), 1), F.lower))


def json_object_in(c: Column) -> Column:
    """The JSON object a reply consists of, or else its outermost braces; null if neither parses to an object."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.try_parse_json(x)) for x in (c, inner)])


def looks_cancelled(c: Column) -> Column:
    """A cancellation marker; the bare word within a title is none."""
    return c.rlike(r"(?i)\*{2,}\s*cancell?ed\s*\*{2,}|^\s*cancell?ed\s*[-–—:]")


def clamp_weight(c: Column) -> Column:
    """Weights in [0, 1]; what is no number weighs one."""
    number = c.try_cast("double")
    return F.least(F.greatest(F.coalesce(F.when(~F.isnan(number), number), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def title_key(c: Column) -> Column:
    return F.lower(collapse(c))


def duration(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, hours and minutes above."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(seconds.cast("bigint").cast("string"), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(seconds.isNotNull(), F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("m")))


@F.pandas_udf(StringType())
def symbol_names(s: pd.Series) -> pd.Series:
    """The Unicode names of a text's symbols in lower case."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.name(ch).lower() for ch in t if unicodedata.category(ch) == "So" and unicodedata.name(ch, "")))


def embedding_text(c: Column) -> Column:
    """Without format characters, symbols, variation selectors and skin tones, blanks collapsed; a text of nothing else is told by its symbols' names."""
    left = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Cf}\p{So}\x{FE00}-\x{FE0F}\x{1F3FB}-\x{1F3FF}]", ""), r"[\s\x{00A0}]+", " "))
    return F.when(left != "", left).when(c.isNotNull(), symbol_names(F.when(left == "", c)))


def image_type(c: Column) -> Column:
    """The media type by the first bytes of a binary; JPEG where they say nothing."""
    head = F.hex(F.substring(c, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif").when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe(F.lit("57454250")), "image/webp").otherwise("image/jpeg")
