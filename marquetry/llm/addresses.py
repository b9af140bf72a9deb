"""Postal addresses written differently: a set-containment join over canonical address parts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise

# Street types, directions, units, states, numbers and ordinals with their usual spellings.
TYPES = {
    "street": "street st str", "avenue": "avenue ave av aven", "road": "road rd", "boulevard": "boulevard blvd boul", "lane": "lane ln", "court": "court ct crt", "square": "square sq",
    "terrace": "terrace terr ter", "highway": "highway hwy hiway", "wharf": "wharf whf", "place": "place pl", "drive": "drive dr", "parkway": "parkway pkwy", "way": "way", "circle": "circle cir",
    "alley": "alley aly", "row": "row", "crescent": "crescent cres", "plaza": "plaza plz", "pike": "pike", "trail": "trail trl",
}
DIRECTIONS = {"north": "north n no", "south": "south s so", "east": "east e", "west": "west w", "northeast": "northeast ne", "northwest": "northwest nw", "southeast": "southeast se", "southwest": "southwest sw"}
UNITS = "suite ste unit floor fl flr level apt apartment room rm bldg building rear lower upper upstairs downstairs basement bsmt front mezzanine".split()
STATES = """al alabama ala|ak alaska|az arizona ariz|ar arkansas ark|ca california calif|co colorado colo|ct connecticut conn|de delaware|dc district of columbia|fl florida fla|ga georgia|hi hawaii|id idaho|il illinois ill|in indiana ind|ia iowa
ks kansas|ky kentucky|la louisiana|me maine|md maryland|ma massachusetts mass|mi michigan mich|mn minnesota minn|ms mississippi miss|mo missouri|mt montana mont|ne nebraska neb|nv nevada nev|nh new hampshire|nj new jersey|nm new mexico|ny new york
nc north carolina|nd north dakota|oh ohio|ok oklahoma okla|or oregon ore|pa pennsylvania penn|ri rhode island|sc south carolina|sd south dakota|tn tennessee tenn|tx texas tex|ut utah|vt vermont|va virginia|wa washington wash|wv west virginia|wi wisconsin wis|wy wyoming wyo"""
COUNTRY = ("usa", "us", "u s a", "u s", "united states", "united states of america")
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
PREFIXES = {"st": "saint", "mt": "mount", "ft": "fort"}

_TYPE = {short: full for full, all_ in TYPES.items() for short in all_.split()}
_DIRECTION = {short: full for full, all_ in DIRECTIONS.items() for short in all_.split()}
_TWO_WORDS = ("new", "north", "south", "west", "rhode", "district")
_STATE, _PHRASES = {}, {tuple(c.split()): "usa" for c in COUNTRY}
for _line in STATES.replace("\n", "|").split("|"):
    _short, *_names = _line.split()
    _STATE[_short] = _short
    _PHRASES[tuple(_short)] = _short
    if _names[0] in _TWO_WORDS:
        _PHRASES[tuple(_names)] = _short
    else:
        _STATE |= dict.fromkeys(_names, _short)
_BY_FIRST: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _phrase, _short in sorted(_PHRASES.items(), key=lambda x: -len(x[0])):
    _BY_FIRST.setdefault(_phrase[0], []).append((_phrase, _short))
_NUMBER = {w: str(i) for i, w in enumerate(NUMBERS, 1)}
_ORDINAL = {w: i for i, w in enumerate(ORDINALS, 1)}
FIXED_WORDS = sorted({*_TYPE, *_DIRECTION, *_STATE, *_NUMBER, *_ORDINAL, *UNITS, *(w for p in _PHRASES for w in p), "usa", "saint", "mount", "fort", "upstairs", "the"})

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W\d_]+)?|[,/\n|;()-]")


def folded(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold().replace("’", "'"))
    return text if text.isascii() else "".join(c for c in text if not unicodedata.combining(c))


def tokens_of(address: str, names: tuple[str, ...] = ()) -> list[str]:
    """Lower-case words without accents, and separators; a leading name of the venue is taken off."""
    text = re.sub(r"[^\S\n]+", " ", folded(address)).strip()
    for name in names:
        low = re.sub(r"\s+", " ", folded(name or "")).strip()
        if low and text.startswith(low) and not text[len(low) : len(low) + 1].isalnum():
            text = text[len(low) :].lstrip(" ,/-\n|;")
            break
    return _TOKEN.findall(re.sub(r"(?<=[a-z])\.(?=[a-z])", ". ", text).replace(".", " "))


def is_word(token: str) -> bool:
    return token.replace("'", "").isalnum()


def parse(tokens: list[str], towns: dict[str, frozenset[str]]) -> dict[str, str] | None:
    """The parts number, direction, name, type, town, code and state, empty where they are missing; null without a number or a name.

    ``towns`` has the postal codes of each town's name; a town has one or several.
    """
    words: list[str] = []
    i = 0
    while i < len(tokens):
        for phrase, short in _BY_FIRST.get(tokens[i], ()):
            after = tokens[i + len(phrase)] if i + len(phrase) < len(tokens) else ","
            if tuple(tokens[i : i + len(phrase)]) == phrase and (len(phrase[-1]) > 1 or not is_word(after) or after.isdigit() or after in ("u", "usa")):
                words.append(short)
                i += len(phrase)
                break
        else:
            words.append(tokens[i])
            i += 1
    is_unit = lambda j: 0 <= j < len(words) and words[j] in UNITS

    def is_state(j: int) -> bool:
        """A state stands at the end, before a separator, a number or the country; elsewhere such a word is an ordinary one, and behind a number it is a floor."""
        if words[j] in UNITS and j and (words[j - 1] in _ORDINAL or words[j - 1] in _NUMBER or words[j - 1][0].isdigit()):
            return False
        return words[j] in _STATE and (j + 1 == len(words) or not is_word(words[j + 1]) or words[j + 1] == "usa" or words[j + 1] in _NUMBER or words[j + 1].isdigit())

    def leads_to_type(j: int) -> bool:
        for k in range(j + 1, min(j + 6, len(words))):
            if words[k] in _TYPE:
                return True
            if not words[k].isalnum() or is_state(k):
                return False
        return False

    digits = [j for j, w in enumerate(words) if re.fullmatch(r"\d{1,5}[a-z]?", w)]
    short = [j for j in digits if not re.fullmatch(r"\d{5}", words[j])]
    at = next((j for j in short if not is_unit(j - 1)), None)
    if at is None:  # a number right after a unit, or one as long as a postal code
        at = next((j for j in short + [j for j in digits if j not in short] if leads_to_type(j)), None)
    code = next((words[j] for j in reversed(digits) if j != at and re.fullmatch(r"\d{5}", words[j])), None)
    if at is None:
        at = next((j for j, w in enumerate(words) if w in _NUMBER and j + 1 < len(words) and words[j + 1].isalnum()), None)
    if at is None:
        return None
    number = _NUMBER.get(words[at], words[at].lstrip("0") or "0")
    j = at + 1
    direction = kind = None
    if j + 1 < len(words) and words[j] in _DIRECTION and words[j + 1].isalnum() and (words[j + 1] not in _TYPE or words[j + 1] == "st"):
        direction = _DIRECTION[words[j]]
        j += 1
    name: list[str] = []
    while j < len(words) and is_word(words[j]):
        w = words[j]
        if not name and w in PREFIXES and j + 1 < len(words) and words[j + 1].isalpha() and not is_state(j + 1):
            name.append(PREFIXES[w])
        elif name and w in _TYPE and not (w == "ct" and name == ["saint"]):
            kind = _TYPE[w]
            j += 1
            break
        elif name and (is_state(j) or w in (code, "usa") or is_unit(j) or (w in towns and (code is None or code in towns[w]))):
            break
        elif re.fullmatch(r"\d{5}", w):
            break
        else:
            m = re.fullmatch(r"(\d+)(?:st|nd|rd|th)", w)
            name.append(f"{int(m[1])}th" if m else f"{_ORDINAL[w]}th" if w in _ORDINAL else w)
        j += 1
    if not name:
        return None
    if direction is None and kind and j < len(words) and words[j] in _DIRECTION:
        direction = _DIRECTION[words[j]]
    rest = [*range(at), *range(j, len(words))]
    town = next((words[k] for k in rest if words[k] in towns), None)
    state = next((_STATE[words[k]] for k in reversed(rest) if is_state(k)), None)
    return {"number": number, "direction": direction or "", "name": " ".join(name), "type": kind or "", "town": town or "", "code": code or "", "state": state or ""}


def token_corrections(words: DataFrame, ratio: int = 8, least: int = 8) -> DataFrame:
    """(word, right) for rare words one edit away from a word at least ``ratio`` times as frequent.

    ``words(word, n)``. Words share a key if they are equal after one deletion in either, so only neighbours meet; an adjacent swap counts as one edit.
    """
    usable = words.where((F.length("word") >= 4) & F.col("word").rlike("^[\\p{L}']+$"))
    keys = F.explode(F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))))))
    rare = usable.where(~F.col("word").isin(FIXED_WORDS)).select("word", "n", keys.alias("k"))
    often = usable.where(F.col("n") >= least).select(F.col("word").alias("right"), F.col("n").alias("m"), keys.alias("k"))
    near = rare.join(often, "k").where((F.col("word") != F.col("right")) & (F.col("m") >= ratio * F.col("n")))
    return near.groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def deletions(text: str) -> set[str]:
    """The text and what is left of it after one deletion; texts within one edit share one of them."""
    return {text} | {text[:i] + text[i + 1 :] for i in range(len(text))}


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours makes ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[2:] == y[2:] and x[:2] == y[:2][::-1])


def same_spelling(a: str, b: str) -> bool:
    """Whether two names of a street differ by one edit: within a word of four letters or more that is no fixed word, or by a space."""
    if not one_edit(a, b):
        return False
    u, v = a.split(), b.split()
    if len(u) != len(v):
        return a.replace(" ", "") == b.replace(" ", "")
    return all(x == y or (min(len(x), len(y)) >= 4 and not re.search("[0-9]", x + y) and x not in FIXED_WORDS and y not in FIXED_WORDS) for x, y in zip(u, v))


def mended_names(sets: list[tuple[str, str, str, int]]) -> list[str]:
    """For each (name, direction, type, frequency) at one number and area the most frequent spelling of its name.

    Names that share a deletion key meet, and those within one edit whose directions and types don't contradict are linked, through others too.
    """
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    met: dict[str, list[int]] = {}
    for i, (name, direction, kind, _) in enumerate(sets):
        for key in deletions(name):
            for j in met.setdefault(key, []):
                other = sets[j]
                if all(x == y or not x or not y for x, y in ((direction, other[1]), (kind, other[2]))) and same_spelling(name, other[0]):
                    root[top(i)] = top(j)
            met[key].append(i)
    best: dict[int, int] = {}
    for i, x in enumerate(sets):
        j = best.setdefault(top(i), i)
        if (x[3], x[0]) > (sets[j][3], sets[j][0]):
            best[top(i)] = i
    return [sets[best[top(i)]][0] for i in range(len(sets))]


def near_towns(towns: dict[str, frozenset[str]]) -> dict[str, list[str]]:
    """The towns of four letters or more under their deletion keys."""
    found: dict[str, list[str]] = {}
    for town in sorted(towns):
        for key in deletions(town) if len(town) >= 4 else ():
            found.setdefault(key, []).append(town)
    return found


def readings(tokens: list[str], towns: dict[str, frozenset[str]], near: dict[str, list[str]]) -> list[tuple[bool, dict[str, str]]]:
    """(guessed, parts): what an address may say. Where it names neither a known town nor a code, there is one for each town within one edit of one of
    its words, and if there is none, the reading without an area."""
    plain = parse(tokens, towns)
    if plain and (plain["town"] or plain["code"]):
        return [(False, plain)]
    found = []
    for i, w in enumerate(tokens):
        if len(w) >= 4 and w.replace("'", "").isalpha() and w not in FIXED_WORDS:
            for town in sorted({t for key in deletions(w) for t in near.get(key, ()) if one_edit(w, t)}):
                p = parse([*tokens[:i], town, *tokens[i + 1 :]], towns)
                if p and p["town"] and (True, p) not in found:
                    found.append((True, p))
    return found or ([(False, plain)] if plain else [])


PARTS = ["number", "direction", "name", "type", "town", "code", "state"]
#: The share of a town's records with a code that one of its codes must have to stand for records without one.
MAIN_CODE = 0.9
#: Records of one location that meet in one task; a location with more is joined in blocks.
MEETING = 1_000


def same_addresses(records: DataFrame, key: str, address: str, names: list[str], least_containment: float = 0.999) -> DataFrame:
    """(a, b) pairs of different keys, smaller first, whose addresses denote one location, as ``locations`` has it. A location of many records is joined block by block."""
    placed = materialise(locations(records, key, address, names, least_containment).select("key", "location").distinct(), "address-locations")
    blocks = placed.groupBy("location").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("blocks"))
    each = placed.join(blocks, "location").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # every two blocks meet once, the smaller first
    left = each.select("location", F.col("key").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = each.select("location", F.col("key").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    met = left.join(right, ["location", "i", "j"]).where((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & (F.col("i") < F.col("j"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def locations(records: DataFrame, key: str, address: str, names: list[str], least_containment: float = 0.999) -> DataFrame:
    """(key, location) for every record with a readable address; ``location`` is the struct of the fullest address of that place.

    A location is a building: number, street and town agree, units and floors do not count, parts that one of the addresses
    lacks (street type, direction, postal code, town or state) contradict nothing. Null and unreadable addresses, without a number or a street, give no
    row; repeated rows give one. Postal codes are those of five digits; a town is one word, that of most records with a code.

    Rare misspellings are replaced by the frequent word one edit away (a corpus statistic). Whatever the frequencies, names one edit apart at one
    number and area are one street, and a town that is not known is read as one within an edit, as the one with records of that number
    and name where there are several; frequency only chooses the spelling. What a code or a town implies is added: its town, its state, its main code.

    Each distinct set of tokens (number, words of the name, type, direction, town, code, state) is indexed under its rarest token beside the number;
    fuller sets probe with all of theirs; weighted containment and the absence of contradictory parts are verified. A set that fits several
    goes to the fullest street, then to the one with more records; an address without any area only if the fuller ones are all of one area.
    """
    spark = records.sparkSession
    kind = records.schema[key].dataType.simpleString()
    rows = records.where(F.col(key).isNotNull() & F.col(address).isNotNull()).select(F.col(key).alias("key"), F.col(address).alias("address"), F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names]).alias("names")).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b.key, "tokens": [tokens_of(a, tuple(n)) for a, n in zip(b.address, b.names)]})

    tokens = materialise(rows.mapInPandas(split, f"key {kind}, tokens array<string>").distinct(), "address-tokens")
    words = tokens.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    fixes = materialise(token_corrections(words), "address-fixes")
    spread = tokens.select("key", "tokens", F.posexplode("tokens").alias("pos", "word"))
    mended = spread.join(fixes, "word").groupBy("key", "tokens").agg(F.map_from_entries(F.collect_list(F.struct("pos", "right"))).alias("fix"))
    right = tokens.join(mended, ["key", "tokens"], "left").select("key", F.when(F.col("fix").isNull(), F.col("tokens")).otherwise(F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("fix", i), t))).alias("tokens"))
    right = materialise(right, "address-right")

    # the towns: of each code the word most often with it, so a row per five-digit code at most
    is_code = lambda t: t.rlike(r"^\d{5}$")
    code = F.element_at(F.filter("tokens", is_code), -1)
    with_code = right.where(F.exists("tokens", is_code)).select(code.alias("code"), F.explode(F.array_distinct(F.filter("tokens", lambda t: t.rlike("^[\\p{L}']{3,}$")))).alias("word")).where(~F.col("word").isin(FIXED_WORDS))
    top = with_code.groupBy("code", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.max_by("word", F.struct("n", "word")).alias("word"), F.max("n").alias("n"))
    found = top.collect()  # 100,000 rows at most
    codes: dict[str, dict[str, int]] = {}
    for r in found:
        codes.setdefault(r.word, {})[r.code] = r.n
    towns = {w: frozenset(c) for w, c in codes.items()}
    shared = spark.sparkContext.broadcast(towns)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = near_towns(shared.value)
        for b in batches:
            read = [{"key": k, "guessed": " ".join(t) if guess else None, **p} for k, t in zip(b.key, b.tokens) for guess, p in readings(list(t), shared.value, near)]
            yield pd.DataFrame(read, columns=["key", "guessed", *PARTS])

    read = materialise(right.mapInPandas(parts, f"key {kind}, guessed string, " + ", ".join(f"{p} string" for p in PARTS)), "address-parts")
    # what a code or a town implies
    main = [(w, c, n) for w, own in codes.items() for c, n in own.items() if n >= MAIN_CODE * sum(own.values())]
    by_code = spark.createDataFrame([(r.code, r.word) for r in found], "code string, its_town string")
    by_town = spark.createDataFrame([x[:2] for x in main], "town string, its_code string")
    full = read.join(by_code, "code", "left").withColumn("town", F.when(F.col("town") == "", F.coalesce("its_town", F.lit(""))).otherwise(F.col("town")))
    full = full.join(by_town, "town", "left").withColumn("code", F.when(F.col("code") == "", F.coalesce("its_code", F.lit(""))).otherwise(F.col("code")))
    states = full.where("code <> '' AND state <> ''").groupBy("code", "state").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.max_by("state", F.struct("n", "state")).alias("its_state"))
    full = full.join(states, "code", "left").withColumn("state", F.when(F.col("state") == "", F.coalesce("its_state", F.lit(""))).otherwise(F.col("state")))
    read = materialise(full.select("key", "guessed", *PARTS, F.coalesce(F.nullif("code", F.lit("")), "town").alias("area")), "address-full")

    known = read.where("guessed IS NULL").groupBy("number", "name", "area").agg(F.count(F.lit(1)).alias("n"))
    likely = Window.partitionBy("key", "guessed").orderBy(F.desc_nulls_last("n"), *PARTS)
    guesses = read.where("guessed IS NOT NULL").join(known, ["number", "name", "area"], "left").withColumn("r", F.row_number().over(likely)).where("r = 1")
    read = materialise(read.where("guessed IS NULL").select("key", *PARTS, "area").unionByName(guesses.select("key", *PARTS, "area")), "address-read")

    # misspelt names: where several stand at one number and area
    street = ["number", "area", "name", "direction", "type"]
    spellings = read.where("area <> ''").groupBy(*street).agg(F.count(F.lit(1)).alias("n"))
    names_n = spellings.groupBy("name").agg(F.sum("n").alias("m"))
    there = spellings.join(names_n, "name").groupBy("number", "area").agg(F.collect_list(F.struct("name", "direction", "type", "m")).alias("sets"), F.count_distinct("name").alias("names")).where("names > 1")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for number, area, sets in zip(b.number, b.area, b.sets):
                own = sorted((x["name"], x["direction"], x["type"], x["m"]) for x in sets)
                out += [(number, area, *x[:3], to) for x, to in zip(own, mended_names(own)) if x[0] != to]
            yield pd.DataFrame(out, columns=["number", "area", "name", "direction", "type", "to"])

    mends = materialise(there.select("number", "area", "sets").mapInPandas(mend, "number string, area string, name string, direction string, type string, to string"), "address-names")
    rest = [p for p in PARTS if p not in street]
    parsed = materialise(read.join(mends, street, "left").select("key", "number", "direction", F.coalesce("to", "name").alias("name"), "type", *rest), "address-mended")

    # the containment join
    sets = parsed.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("records"))
    token = lambda mark, p: F.when(F.col(p) != "", F.concat(F.lit(mark), F.col(p)))
    whole = F.array_compact(F.concat(F.array(token("n:", "number"), token("t:", "type"), token("d:", "direction"), token("c:", "town"), token("z:", "code"), token("s:", "state")), F.transform(F.array_distinct(F.split("name", " ")), lambda w: F.concat(F.lit("w:"), w))))
    sets = materialise(sets.select(F.struct(*PARTS).alias("set"), "records", whole.alias("tokens")), "address-sets")
    weights = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weighed = sets.select("set", "records", F.size("tokens").alias("size"), F.explode("tokens").alias("t")).join(weights, "t").withColumn("w", 1 / F.log1p(F.col("df") + 1))
    by_set = Window.partitionBy("set")
    weighed = materialise(weighed.withColumn("total", F.sum("w").over(by_set)), "address-weights")
    rarest = Window.partitionBy("set").orderBy("df", "t")
    index = weighed.where(~F.col("t").startswith("n:")).withColumn("r", F.row_number().over(rarest)).where("r = 1").select(F.col("set.number").alias("number"), "t", F.col("set").alias("less"), F.col("size").alias("less_size"), F.col("total").alias("less_total"))
    probes = weighed.select(F.col("set.number").alias("number"), "t", F.col("set").alias("full"), F.col("size").alias("full_size"), F.col("records").alias("full_records"))
    met = index.join(probes, ["number", "t"]).where(F.col("full_size") > F.col("less_size"))
    agree = F.col("less.name") == F.col("full.name")
    for p in ("type", "direction", "town", "code", "state"):
        agree = agree & ((F.col(f"less.{p}") == F.col(f"full.{p}")) | (F.col(f"less.{p}") == "") | (F.col(f"full.{p}") == ""))
    met = met.where(agree).select("less", "less_total", "full", "full_records").distinct()
    held = met.join(weighed.select(F.col("set").alias("less"), "t", "w"), "less").join(weighed.select(F.col("set").alias("full"), "t"), ["full", "t"])
    held = held.groupBy("less", "full").agg(F.sum("w").alias("held"), F.first("less_total").alias("total"), F.first("full_records").alias("records"))
    fits = held.where(F.col("held") >= least_containment * F.col("total")).select("less", "full", "records")
    has = lambda *ps: sum((F.when(F.col(f"full.{p}") != "", 1).otherwise(0) for p in ps), F.lit(0))
    choice = Window.partitionBy("less").orderBy(F.desc(has("type", "direction")), F.desc(has("town", "code", "state")), F.desc("records"), "full")
    of_less = Window.partitionBy("less")
    areas = F.when((F.col("less.town") == "") & (F.col("less.code") == ""), F.size(F.collect_set(F.when((F.col("full.town") != "") | (F.col("full.code") != ""), F.struct("full.town", "full.code"))).over(of_less))).otherwise(1)
    chosen = fits.withColumn("areas", areas).withColumn("r", F.row_number().over(choice)).where("r = 1 AND areas <= 1").select(F.col("less").alias("set"), F.col("full").alias("home"))
    chosen = materialise(chosen, "address-homes")
    further = chosen.join(chosen.select(F.col("set").alias("home"), F.col("home").alias("next")), "home", "left").select("set", F.coalesce("next", "home").alias("home"))
    return parsed.select("key", F.struct(*PARTS).alias("set")).join(further, "set", "left").select("key", F.coalesce("home", "set").alias("location")).distinct()
