"""New batches deduplicated against all history: a stored index of small-world graph shards, exact reranking, the first accepted listing of each happening."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.llm.components import components
from marquetry.llm.smallworld import SmallWorld
from marquetry.operators.lineage import delete_folder, discard, materialise
from marquetry.session import shared_folder

#: Starts at most so far apart can be one happening.
WINDOW_US = 2 * 3_600_000_000
#: Vectors of one shard at most, and rows of one probing task; segments of the history are as wide as to hold about half as many.
SHARD = 20_000
#: Least similarity of billing and place, half each; the reranking decides.
LEAST = 0.62
#: Weight of the start in a vector, beside billing and place.
START_WEIGHT = 1 / 3
#: A segment with so many small shards is compacted.
COMPACT_AT = 6

# Announcements around a title that are no part of the billing.
PREFIXES = ("rescheduled", "sold out", "tonight", "live", "new", "free", "just announced", "postponed", "cancelled", "canceled", "added", "last chance", "reminder", "update", "updated")
SUFFIXES = ("free", "tickets at the door", "free admission", "free entry", "sold out", "all ages", "21", "18", "new", "live", "rescheduled", "tickets available")
JOINERS = {"w": "with", "feat": "with", "ft": "with", "featuring": "with", "plus": "with", "n": "and"}
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


# Short forms of what a venue is.
KINDS = {"theater": "theatre", "thtr": "theatre", "centre": "center", "ctr": "center", "cntr": "center", "rm": "room", "pub": "pub"}
_ASIDES = re.compile(r"[\[(][^\])]*[\])]|[*~#]+|[^\w\s.,:;!?&@+/|'–—\-…]")
_BEFORE = re.compile(r"^([^:!\-–—|]{2,24})\s*(?:[:!|]|\s[-–—])\s*(.+)$")
_BEHIND = re.compile(r"^(.*)[-–—|:]\s*([^-–—|:]+)$")
_ANNOUNCED = re.compile(r"\b(?:" + "|".join(PREFIXES) + r")\s*[:!]")


def plain(text: str) -> str:
    text = html.unescape(text).casefold().replace("’", "'").translate(_LETTERS)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text).strip()


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.replace("'", ""))


def billing(title: str, venue: str) -> tuple[list[str], bool]:
    """The sorted words of a title's billing, and whether it was cut short. Announcements, brackets, and the venue after an at sign are left out."""
    t = plain(re.sub(r"\bw/o\b", "without", re.sub(r"\bw/", "with ", title, flags=re.I), flags=re.I))
    t = _ASIDES.sub(" ", t)
    while (at := t.rfind("@")) > 0:
        after = words(t[at + 1 :])
        if after and len(after) > 6 and not set(after) & set(words(plain(venue))):
            break
        t = t[:at]
    cut = False
    changed = True
    while changed:
        changed = False
        t = t.strip(" !-–—|:;,*")
        if re.search(r"(\.\.\.|…)$", t):
            cut, t, changed = True, re.sub(r"[\s.…]+$", "", t), True
        m = _BEFORE.match(t)
        if m and m[1].strip() in PREFIXES:
            t, changed = m[2], True
        m = _BEHIND.match(t)
        if m and " ".join(words(m[2])) in SUFFIXES:
            t, changed = m[1], True
    t = _ANNOUNCED.sub(" ", t)
    found = words(t.replace("&", " and ").replace("+", " with "))
    return [w if cut and i == len(found) - 1 else JOINERS.get(w, w) for i, w in enumerate(found)], cut


@lru_cache(maxsize=100_000)
def place(venue: str) -> list[str]:
    """The words of a venue's name, without the article and without a town after a dash. The list is shared: it is not to be changed."""
    v = re.sub(r"\s[-–—|]\s[^-–—|]*$", "", plain(venue))
    v = re.sub(r"^(.*), (the|a|an)$", r"\2 \1", v)
    found = [KINDS.get(w, w) for w in words(v.replace("&", " and "))]
    return found[1:] if len(found) > 1 and found[0] in ("the", "a", "an") else found


@lru_cache(maxsize=1_000_000)
def close(a: str, b: str) -> bool:
    """Equal, or words of four letters and more within one edit or one swap, of nine and more within two."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2 or (a.isdigit() or b.isdigit()):
        return False
    return _edits(a, b) <= (2 if min(len(a), len(b)) >= 7 else 1)


def _edits(a: str, b: str) -> int:
    before, last = list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, last[j - 2] + 1)
            row.append(best)
        before, last = row, before
    return before[-1]


def same_words(a: list[str], b: list[str], typos: int = 2) -> bool:
    """Whether two lists hold the same words in any order, up to ``typos`` misspelt ones."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    rest = list(b)
    odd = []
    for w in a:
        if w in rest:
            rest.remove(w)
        else:
            odd.append(w)
    if len(odd) != len(rest) or len(odd) > typos:
        return _joined(a, b)
    for w in odd:
        match = next((v for v in rest if close(w, v)), None)
        if match is None:
            return _joined(a, b)
        rest.remove(match)
    return True


def same_place(a: list[str], b: list[str]) -> bool:
    """The same venue's name; what it is, the last word, may be shortened or end otherwise (gall., brewing and brewery)."""
    if same_words(a, b):
        return True
    if len(a) != len(b) or len(a) < 2:
        return False
    u, v = sorted((a[-1], b[-1]), key=len)
    return (len(u) >= 3 and v.startswith(u) or len(u) >= 5 and u[:4] == v[:4]) and same_words(a[:-1], b[:-1], 1)


def _joined(a: list[str], b: list[str]) -> bool:
    return abs(len(a) - len(b)) == 1 and "".join(a) == "".join(b)


def same_billing(a: list[str], cut_a: bool, b: list[str], cut_b: bool) -> bool:
    """The same billing in any order; a title cut short must be the beginning of the other."""
    if cut_a or cut_b:
        (x, y) = (a, b) if (cut_a and (not cut_b or len(" ".join(a)) <= len(" ".join(b)))) else (b, a)
        if not x:
            return False
        turned = y[y.index("with") + 1 :] + ["with"] + y[: y.index("with")] if "with" in y else y
        if turned[0] == x[0] != y[0]:
            y = turned
        head, n = y[: len(x)], len(x)
        if len(head) < n:
            return False
        odd = 0
        for i in range(n):
            u, v = x[i], head[i]
            if u == v or (i == n - 1 and v.startswith(u)):
                continue
            if i == n - 1 and len(u) >= 4 and close(u, v[: len(u)]) or close(u, v):
                odd += 1
                continue
            return False
        return odd <= 2
    return same_words(a, b)


@lru_cache(maxsize=100_000)
def _word_vector(word: str, dims: int) -> np.ndarray:
    v = np.zeros(dims, np.float32)
    p = f" {word} "
    for i in range(len(p) - 2):
        h = zlib.crc32(p[i : i + 3].encode())
        v[h % dims] += 1 if h >> 16 & 1 else -1
    return v


TITLE_DIMS, VENUE_DIMS, START_DIMS = 64, 32, 25
#: Starts within the window have at least this similarity: a start lies between two of ``START_DIMS`` marks, three windows apart.
START_LEAST = 0.8
GRAPH_LEAST = (1 - START_WEIGHT) * LEAST + START_WEIGHT * START_LEAST


def _units(lists: list[list[str]], dims: int) -> np.ndarray:
    """A unit vector for each list of words: the sum of their hashed letter trigrams."""
    code = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists for w in ws))}
    table = np.stack([_word_vector(w, dims) for w in code]) if code else np.zeros((1, dims), np.float32)
    sizes = np.array([len(ws) for ws in lists])
    out = np.zeros((len(lists), dims), np.float32)
    if sizes.any():
        flat = table[np.array([code[w] for ws in lists for w in ws])]
        some = np.flatnonzero(sizes)
        out[some] = np.add.reduceat(flat, np.r_[0, np.cumsum(sizes[some])[:-1]], axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def vectors(titles: list[list[str]], venues: list[list[str]], starts: np.ndarray, window_us: int = WINDOW_US) -> np.ndarray:
    """Unit vectors: letter trigrams of the billing's words in any order, those of the venue's, and the start between its two nearest marks."""
    marks = starts / (3 * window_us)
    low = np.floor(marks)
    part = (marks - low).astype(np.float32)
    when = np.zeros((len(starts), START_DIMS), np.float32)
    rows = np.arange(len(starts))
    when[rows, (low % START_DIMS).astype(int)] = 1 - part
    when[rows, ((low + 1) % START_DIMS).astype(int)] += part
    when /= np.linalg.norm(when, axis=1, keepdims=True)
    text = np.float32(((1 - START_WEIGHT) / 2) ** 0.5)
    return np.concatenate([text * _units(titles, TITLE_DIMS), text * _units(venues, VENUE_DIMS), np.float32(START_WEIGHT**0.5) * when], axis=1)


class Listings:
    """Canonical listings of one shard or batch as parallel arrays; words are split when first read."""

    def __init__(self, ids: list[str], keys: list[str], starts: np.ndarray):
        self.ids, self.keys, self.starts = ids, keys, starts
        self.read: dict[int, tuple] = {}

    def parts(self, i: int) -> tuple[list[str], bool, list[str], frozenset[str]]:
        if i not in self.read:
            title, cut, venue, town = self.keys[i].split("\x1f")
            self.read[i] = title.split(" "), cut == "1", venue.split(" "), frozenset(w for w in town.split(" ") if w)
        return self.read[i]

    def vectors(self, window_us: int) -> np.ndarray:
        split = [k.split("\x1f") for k in self.keys]
        return vectors([x[0].split(" ") for x in split], [x[2].split(" ") for x in split], self.starts, window_us)


def _same(a: Listings, i: int, b: Listings, j: int) -> bool:
    """Exact reranking: the same place and billing; towns may be missing but must not differ."""
    (title, cut, venue, town), (title2, cut2, venue2, town2) = a.parts(i), b.parts(j)
    if town and town2 and town != town2 and not any(len(w) > 2 for w in town & town2):
        return False
    return same_place(venue, venue2) and same_billing(title, cut, title2, cut2)


def _verified(new: Listings, x: np.ndarray, q: np.ndarray, old: Listings, y: np.ndarray, i: np.ndarray, window_us: int, root: list[int] | None) -> Iterator[tuple[int, int]]:
    """The retrieved pairs that are one happening, the most similar first. With ``root``, a union-find of one shard, pairs already linked through others are passed over."""
    text = slice(0, TITLE_DIMS + VENUE_DIMS)
    near = np.abs(new.starts[q] - old.starts[i]) <= window_us
    q, i = q[near], i[near]
    score = np.einsum("ij,ij->i", x[q, text], y[i, text]) / (1 - START_WEIGHT)
    good = np.flatnonzero(score >= LEAST - 0.01)
    good = good[np.argsort(-score[good], kind="stable")]

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(q[good].tolist(), i[good].tolist()):
        if new.ids[a] == old.ids[b] or (root is not None and top(a) == top(b)):
            continue
        if _same(new, a, old, b):
            if root is not None:
                root[top(a)] = top(b)
            yield a, b


_GRAPH = "segment bigint, shard int, n int, beam int, ids array<string>, ats array<bigint>, keys array<string>, starts array<bigint>, x binary, adj binary"
_MEMBERS = "id string, group_id string, at timestamp, start_us bigint, low bigint, high bigint, first string, batch int, segment bigint"


def _graph_row(segment: int, shard: int, ids: list, ats: list, keys: list, starts: np.ndarray, graph: SmallWorld) -> dict:
    return {
        "segment": [segment], "shard": pa.array([shard], pa.int32()), "n": pa.array([graph.n], pa.int32()), "beam": pa.array([graph.beam], pa.int32()),
        "ids": pa.array([ids], pa.list_(pa.string())), "ats": pa.array([ats], pa.list_(pa.int64())), "keys": pa.array([keys], pa.list_(pa.string())), "starts": pa.array([starts], pa.list_(pa.int64())),
        "x": [graph.x[: graph.n].astype(np.float16).tobytes()], "adj": [graph.adj[: graph.n].tobytes()],
    }


def _stored_graph(row: dict) -> tuple[Listings, SmallWorld]:
    n = row["n"]
    x = np.frombuffer(row["x"], np.float16).reshape(n, -1).astype(np.float32)
    adj = np.frombuffer(row["adj"], np.int32).reshape(n, -1)
    return Listings(row["ids"], row["keys"], np.array(row["starts"], np.int64)), SmallWorld.stored(x, adj, row["beam"])


def _build(window_us: int, link: bool):
    """A shard's graph from rows (segment, shard, id, at, key, start_us), inserted in the order of acceptance, and the links found on the way."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        ids, keys, ats = table["id"].to_pylist(), table["key"].to_pylist(), table["at"].to_pylist()
        new = Listings(ids, keys, table["start_us"].to_numpy())
        x = new.vectors(window_us)
        graph, root, found = SmallWorld(x.shape[1], len(x)), list(range(len(x))), []
        for q, i in graph.insert(x, GRAPH_LEAST):
            found += _verified(new, x, q, new, x, i, window_us, root) if link else ()
        row = _graph_row(table["segment"][0].as_py(), table["shard"][0].as_py(), ids, ats, keys, new.starts, graph)
        return pa.table(row | ({"a": pa.array([[ids[a] for a, _ in found]], pa.list_(pa.string())), "b": pa.array([[ids[b] for _, b in found]], pa.list_(pa.string()))} if link else {}))

    return run


def _probe(window_us: int):
    """The verified links of probing rows with one stored shard."""

    def run(probes: pa.Table, shards: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if len(probes) and len(shards):
            new = Listings(probes["id"].to_pylist(), probes["key"].to_pylist(), probes["start_us"].to_numpy())
            x = new.vectors(window_us)
            for row in shards.to_pylist():
                old, graph = _stored_graph(row)
                q, i = graph.within(x, GRAPH_LEAST)
                for a, b in _verified(new, x, q, old, graph.x, i, window_us, None):
                    out_a.append(new.ids[a])
                    out_b.append(old.ids[b])
        return pa.table({"a": pa.array(out_a, pa.string()), "b": pa.array(out_b, pa.string())})

    return run


def _tasks(groups: int) -> int:
    """Partitions for groups that each take a task's time, so that few share one; adaptive coalescing sees their bytes only."""
    return max(1, min(2 * groups, groups + 4_000))


class ListingIndex:
    """Everything accepted so far, stored below ``path``, against which a new batch is checked without reading it all again.

    The history is cut into segments by start, as wide as to hold about half of ``shard`` vectors when the index is made. ``graphs`` holds, for each batch and
    segment it touches, a shard: listings, vectors and the small-world graph over them; a segment beyond ``shard`` rows of one batch gets several.
    ``members`` holds each listing's group and first, in versions of which the latest counts. Both are partitioned by segment, so that ``add`` reads the
    segments in reach of its batch only. ``log`` has a row per finished step and is written last: what a lost driver left unfinished does not count.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window_us: int = WINDOW_US, shard: int = SHARD, compact_at: int = COMPACT_AT):
        self.spark, self.window_us, self.shard, self.compact_at = spark, window_us, shard, compact_at
        self.path = path or f"{shared_folder(spark)}/marquetry/listings-{uuid.uuid4().hex}"
        self.batch, self.width, self.dead = 0, None, []
        try:
            log = spark.read.parquet(f"{self.path}/log").collect()  # a row per step
        except AnalysisException:
            log = []
        for row in log:
            self.batch, self.width = max(self.batch, row.batch + 1), row.width_us
            self.dead += [(x.segment, x.batch) for x in row.compacted]

    def _commit(self, compacted: list[tuple[int, int]] | None = None) -> None:
        row = [(self.batch, self.width, compacted or [])]
        self.spark.createDataFrame(row, "batch int, width_us bigint, compacted array<struct<segment: bigint, batch: int>>").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.dead += compacted or []
        self.batch += 1

    def graphs(self, segments: list[int] | None = None) -> DataFrame:
        """The shards that count, of some segments or all."""
        if not self.batch:
            return self.spark.createDataFrame([], _GRAPH + ", batch int")
        found = self.spark.read.schema(_GRAPH + ", batch int").parquet(f"{self.path}/graphs").where(F.col("batch") < self.batch)
        if segments is not None:
            found = found.where(F.col("segment").isin(segments))  # prunes partitions
        if self.dead:
            found = found.join(self.spark.createDataFrame(self.dead, "segment bigint, batch int"), ["segment", "batch"], "left_anti")
        return found

    def members(self, segments: list[int] | None = None) -> DataFrame:
        """The latest version of each listing: id, group_id, at, start_us, low, high (the group's segments), first."""
        if not self.batch:
            return self.spark.createDataFrame([], _MEMBERS).drop("batch", "segment")
        found = self.spark.read.schema(_MEMBERS).parquet(f"{self.path}/members").where(F.col("batch") < self.batch)
        if segments is not None:
            found = found.where(F.col("segment").isin(segments))
        latest = found.groupBy("id").agg(F.max_by(F.struct("group_id", "at", "start_us", "low", "high", "first"), "batch").alias("m"))
        return latest.select("id", "m.*")

    def accepted(self) -> DataFrame:
        """(later, first) for every listing whose happening was accepted earlier."""
        return self.members().where("first IS NOT NULL").select(F.col("id").alias("later"), "first")

    def _width(self, rows: DataFrame) -> int:
        """Segments about half as full as a shard; a whole number of windows, four of them at least."""
        low, high = rows.agg(F.percentile_approx("start_us", [0.1, 0.9], 200).alias("q")).first().q or (0, 0)
        fitting = (high - low) * self.shard / max(1.0, 1.6 * rows.count())
        return self.window_us * int(min(max(fitting // self.window_us, 4), 24 * 366))

    def add(self, listings: DataFrame) -> DataFrame:
        """Accept a batch; returns (later, first) of the listings whose first was found or changed by it. See ``first_listings``."""
        rows = listings.where(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("venue").isNotNull() & F.col("start_us").isNotNull() & F.col("at").isNotNull())
        canonical = rows.mapInPandas(_canonical, "id string, at timestamp, start_us long, key string").groupBy("id", "key", "start_us").agg(F.min("at").alias("at"))
        canonical = materialise(canonical, "listings")
        if self.width is None:
            self.width = self._width(canonical)
        width, window = self.width, self.window_us
        segment = F.floor(F.col("start_us") / F.lit(width)).cast("bigint")

        # exact copies are one vector, that of the earliest
        first = materialise(canonical.groupBy("key", "start_us").agg(F.min(F.struct("at", "id")).alias("f")).select("key", "start_us", "f.id", "f.at").withColumn("segment", segment), "copies")
        copied = canonical.join(first.select("key", "start_us", F.col("id").alias("rep")), ["key", "start_us"]).where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        counts = {r.segment: r.n for r in first.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per SHARD listings
        reach = sorted({s + d for s in counts for d in (-1, 0, 1)})

        # new shards; the links within them are found as their graphs are built
        sizes = self.spark.createDataFrame([(s, -(-n // self.shard)) for s, n in counts.items()], "segment bigint, shards int")
        news = first.join(sizes, "segment").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
        fields = "a array<string>, b array<string>"
        spread = _tasks(sum(-(-n // self.shard) for n in counts.values()))
        built = materialise(news.select("segment", "shard", "id", F.unix_micros("at").alias("at"), "key", "start_us").repartition(spread, "segment", "shard").groupBy("segment", "shard").applyInArrow(_build(window, True), f"{_GRAPH}, {fields}"), "graphs")
        links = built.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")

        # other shards in reach: stored ones, those of the batch beside a row's own, and those across the segment's edge
        stored = self.graphs(reach)
        known = stored.select("segment", "batch", "shard").unionByName(built.select("segment", F.lit(self.batch).alias("batch"), "shard"))
        known = known.select(F.col("segment").alias("to"), "batch", F.col("shard").alias("to_shard"))
        beyond = F.array_compact(F.array(F.col("segment"), F.when(F.col("start_us") - F.col("segment") * width <= window, F.col("segment") - 1), F.when((F.col("segment") + 1) * width - F.col("start_us") <= window, F.col("segment") + 1)))
        probes = news.select("segment", "shard", "shards", "id", "key", "start_us", F.explode(beyond).alias("to")).join(known, "to")
        # of two rows of the batch the one in the later shard asks
        probes = probes.where((F.col("batch") < self.batch) | (F.struct("to", "to_shard") < F.struct("segment", "shard")))
        probes = probes.select("to", "batch", "to_shard", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shards")).cast("int").alias("chunk"), "id", "key", "start_us")
        probes = materialise(probes, "probes")
        at = ["to", "batch", "to_shard"]
        asked = materialise(probes.select(*at, F.col("chunk").alias("part")).distinct(), "asked")
        spread = _tasks(asked.count())
        named = lambda d, b: d.select(F.col("segment").alias("to"), b, F.col("shard").alias("to_shard"), "n", "beam", "ids", "keys", "starts", "x", "adj")
        shards = named(stored, F.col("batch")).unionByName(named(built, F.lit(self.batch).alias("batch"))).join(asked, at)
        met = probes.repartition(spread, *at, "chunk").groupBy(*at, "chunk").cogroup(shards.repartition(spread, *at, "part").groupBy(*at, "part")).applyInArrow(_probe(window), "a string, b string")
        links = materialise(links.unionByName(met).unionByName(copied), "same-happening")

        placed = materialise(self._placed(canonical, links, reach), "placed")
        graph = built.drop("a", "b").withColumn("batch", F.lit(self.batch))
        graph.write.mode("append").partitionBy("segment", "batch").parquet(f"{self.path}/graphs")
        discard(canonical, first, built, probes, asked, links)
        placed.withColumn("segment", segment).write.mode("append").partitionBy("segment", "batch").parquet(f"{self.path}/members")
        self._commit()
        if self.compact_at and (small := self._small(sorted(counts))):
            self.compact(small)
        return placed.where("first IS NOT NULL").select(F.col("id").alias("later"), "first")

    def _placed(self, canonical: DataFrame, links: DataFrame, reach: list[int]) -> DataFrame:
        """New versions of the members: all of the batch, and those of the groups that its links touch."""
        fresh = canonical.groupBy("id").agg(F.min(F.struct("at", "start_us")).alias("t")).select("id", "t.at", "t.start_us")
        if self.batch:
            own = materialise(self.members(reach), "members")
            group = own.select("id", "group_id")
            ends = links
            for end in ("a", "b"):
                ends = ends.join(group.select(F.col("id").alias(end), F.col("group_id").alias(f"g_{end}")), end, "left")
            ends = ends.select(F.coalesce("g_a", "a").alias("a"), F.coalesce("g_b", "b").alias("b"))
            joined = materialise(components(ends, "a", "b"), "joined")
            # an id that comes again stays with what it was
            fresh = fresh.join(own.select("id", F.col("group_id").alias("was"), F.col("at").alias("was_at"), F.col("start_us").alias("was_start")), "id", "left")
            earlier = F.col("was_at").isNotNull() & (F.col("was_at") <= F.col("at"))
            fresh = fresh.select("id", F.when(earlier, F.col("was_at")).otherwise(F.col("at")).alias("at"), F.when(earlier, F.col("was_start")).otherwise(F.col("start_us")).alias("start_us"), F.coalesce("was", "id").alias("node"))
            touched = joined.select(F.col("record_id").alias("node"))
            again = fresh.select("id")
            moved = own.withColumnRenamed("group_id", "node").join(touched.unionByName(fresh.select("node")).distinct(), "node", "left_semi")
            bounds = moved.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
            if bounds.low is not None and (bounds.low < reach[0] or bounds.high > reach[-1]):  # a group beyond the segments read
                beyond = [s for s in range(bounds.low, bounds.high + 1) if s not in set(reach)]
                moved = moved.unionByName(self.members(beyond).withColumnRenamed("group_id", "node").join(touched, "node", "left_semi"))
            nodes = fresh.unionByName(moved.join(again, "id", "left_anti").select("id", "at", "start_us", "node"))
        else:
            joined = components(links, "a", "b")
            nodes = fresh.withColumn("node", F.col("id"))
        nodes = nodes.join(joined.select(F.col("record_id").alias("node"), F.col("group_id").alias("to")), "node", "left").select("id", "at", "start_us", F.coalesce("to", "node").alias("group_id"))
        nodes = materialise(nodes, "nodes")

        # the firsts of a group by its distinct starts: few, however many listings share them
        starts = nodes.groupBy("group_id", "start_us").agg(F.min(F.struct("at", "id")).alias("e"))
        starts = starts.groupBy("group_id").agg(F.collect_list(F.struct(F.unix_micros("e.at").alias("at"), F.col("e.id").alias("id"), F.col("start_us"))).alias("starts"))
        # a group of one start needs no splitting
        window, width = self.window_us, self.width

        def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(g, *x) for g, own in zip(b.group_id, b.starts) for x in split_firsts([(s["at"], s["id"], s["start_us"]) for s in own], window)]
                yield pd.DataFrame(out, columns=["group_id", "start_us", "first", "before"])

        several = starts.where(F.size("starts") > 1).mapInPandas(accept, "group_id string, start_us long, first string, before string")
        single = starts.where(F.size("starts") == 1).select("group_id", F.col("starts")[0]["start_us"].alias("start_us"), F.col("starts")[0]["id"].alias("first"), F.lit(None).cast("string").alias("before"))
        segments = F.transform("starts", lambda s: F.floor(s["start_us"] / F.lit(width)).cast("bigint"))
        spans = starts.select("group_id", F.array_min(segments).alias("low"), F.array_max(segments).alias("high"))
        found = nodes.join(several.unionByName(single), ["group_id", "start_us"]).join(spans, "group_id")
        first = F.when(F.col("id") == F.col("first"), F.col("before")).otherwise(F.col("first"))
        return found.select("id", "group_id", "at", "start_us", "low", "high", first.alias("first"), F.lit(self.batch).alias("batch"))

    def _small(self, segments: list[int]) -> list[tuple[int, int]]:
        """(segment, batch) of the shards half full or less, in those of the segments that have ``compact_at`` of them or more."""
        small = self.graphs(segments).groupBy("segment", "batch").agg(F.sum("n").alias("n")).where(F.col("n") <= self.shard / 2)
        often = small.groupBy("segment").agg(F.count(F.lit(1)).alias("shards")).where(F.col("shards") >= self.compact_at)
        return [(r.segment, r.batch) for r in small.join(often, "segment").select("segment", "batch").collect()]

    def compact(self, small: list[tuple[int, int]]) -> None:
        """Merge shards (segment, batch) into as few as hold them; of copies in several batches the earliest stays. Files no longer used are deleted."""
        old = self.graphs(sorted({s for s, _ in small})).join(self.spark.createDataFrame(small, "segment bigint, batch int"), ["segment", "batch"], "left_semi")
        upto = F.sum("n").over(Window.partitionBy("segment").orderBy("batch", "shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        bins = old.select("segment", "batch", "shard", "n").withColumn("bin", F.floor(upto / self.shard).cast("int")).drop("n")
        rows = old.join(bins, ["segment", "batch", "shard"]).select("segment", F.col("bin").alias("shard"), F.explode(F.arrays_zip("ids", "ats", "keys", "starts")).alias("x"))
        rows = rows.groupBy("segment", "shard", F.col("x.keys").alias("key"), F.col("x.starts").alias("start_us")).agg(F.min(F.struct("x.ats", "x.ids")).alias("f"))
        rows = rows.select("segment", "shard", F.col("f.ids").alias("id"), F.col("f.ats").alias("at"), "key", "start_us")
        spread = _tasks(bins.select("segment", "bin").distinct().count())
        merged = materialise(rows.repartition(spread, "segment", "shard").groupBy("segment", "shard").applyInArrow(_build(self.window_us, False), _GRAPH), "compacted")
        merged.withColumn("batch", F.lit(self.batch)).write.mode("append").partitionBy("segment", "batch").parquet(f"{self.path}/graphs")
        discard(merged)
        self._commit(small)
        for s, b in small:
            delete_folder(self.spark, f"{self.path}/graphs/segment={s}/batch={b}")

    def recall(self, every: int = 50) -> DataFrame:
        """(segment, batch, shard, vectors, asked, similar, found): what walks find of what an exhaustive search finds, for every ``every``-th vector of each shard."""

        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in tables:
                out = []
                for row in t.to_pylist():
                    _, graph = _stored_graph(row)
                    ask = graph.x[::every]
                    q, i = graph.within(ask, GRAPH_LEAST)
                    similar = found = 0
                    for at in range(0, len(ask), 512):
                        a, b = np.nonzero(ask[at : at + 512] @ graph.x.T >= GRAPH_LEAST)
                        exact = set(zip((a + at).tolist(), b.tolist()))
                        similar += len(exact)
                        found += len(exact & set(zip(q.tolist(), i.tolist())))
                    out.append((row["segment"], row["batch"], row["shard"], graph.n, len(ask), similar, found))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["segment", "batch", "shard", "vectors", "asked", "similar", "found"]).astype({"batch": "int32", "shard": "int32"}), preserve_index=False)

        return self.graphs().mapInArrow(run, "segment bigint, batch int, shard int, vectors bigint, asked bigint, similar bigint, found bigint")


def first_listings(listings: DataFrame, cuts: list[str] | None = None, index: ListingIndex | None = None, **settings) -> DataFrame:
    """(later, first) for every listing whose happening was accepted earlier, directly or through other listings.

    ``listings(id, title, venue, town, start_us, at)``: ``at`` is the time of discovery. Of rows repeated under one id the earliest
    counts. Rows without id, title, venue, start or time are left out, as are titles and venues without a word. Equal times go to the smaller id.

    Linked listings are split by time: the first accepted takes those that start within the window of it, then the first of the others, and so
    on. A listing that begins such a part comes out with the earliest listing it is linked to within the window, if one was accepted before.

    The listings go into ``index``, or a new one, in batches: ``cuts`` are the times of discovery at which one ends and the next begins. The result does not depend
    on them. Rows that agree in canonical billing, place and start are one vector. A row walks the graphs of the segments in reach, those of the batches before
    and the one it is inserted into, with a beam tuned against exhaustive search until it finds 99 of 100 and widened while all it
    holds is similar; what it meets is decided by the words themselves. A hot segment is spread over shards of bounded size, and its probes over tasks.
    """
    index = index or ListingIndex(listings.sparkSession, **settings)
    edges = [None, *(cuts or []), None]
    for since, until in zip(edges, edges[1:]):
        part = listings
        if since is not None:
            part = part.where(F.col("at") >= F.lit(since).cast("timestamp"))
        if until is not None:
            part = part.where(F.col("at") < F.lit(until).cast("timestamp"))
        index.add(part)
    return index.accepted()


def split_firsts(starts: list[tuple[int, str, int]], window_us: int) -> list[tuple[int, str, str | None]]:
    """(start, first, before) for the earliest (at, id, start) of each start of a group of linked listings.

    The earliest takes all within the window of its start, the earliest of what remains those within its own, until none is left.
    ``before``: the earliest listing of another part that a first still meets within the window, if it came before it.
    """
    order, out = sorted(starts), []
    rest = order
    while rest:
        at, name, start = rest[0]
        before = next((x[1] for x in order if x < rest[0] and abs(x[2] - start) <= window_us), None)
        out += [(x[2], name, before) for x in rest if abs(x[2] - start) <= window_us]
        rest = [x for x in rest if abs(x[2] - start) > window_us]
    return out


def _canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    read = lru_cache(maxsize=100_000)(billing)
    for b in batches:
        out = []
        for i, at, start, title, venue, town in zip(b.id, b["at"], b.start_us, b.title, b.venue, b.town):
            (w, cut), p = read(title, venue), place(venue)
            if w and p:
                key = "\x1f".join((" ".join(w), str(int(cut)), " ".join(p), " ".join(words(plain(town))) if isinstance(town, str) else ""))
                out.append((i, at, start, key))
        yield pd.DataFrame(out, columns=["id", "at", "start_us", "key"])
