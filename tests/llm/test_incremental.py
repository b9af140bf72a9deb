"""Dedup of new batches: canonical forms, the graph's recall against exhaustive search, first listings against brute force."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest

from marquetry.llm.incremental import ListingIndex, billing, first_listings, place, same_billing, same_place, split_firsts
from marquetry.llm.smallworld import SmallWorld

H = 3_600_000_000


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Owls with Foxes", "Foxes with Owls (21+)", True),
        ("Film: The Teal Barrel of Stourbrook", "Film - The Teal Barrel of Stou...", True),
        ("Paint & Sip", "PAINT &amp; SIP @ Old Mill", True),
        ("Rescheduled: Open Mic Night", "Open Mic Nigth - Free!", True),
        ("Linocut for Beginners", "Watercolor for Beginners", False),
        ("Open Mic Night", "Open Mic Night 2", False),
        ("Ska Night", "Soul Night", False),
    ],
)
def test_billing(a, b, same):
    assert same_billing(*billing(a, "Old Mill"), *billing(b, "Old Mill")) is same


def test_places():
    assert same_place(place("Mellow Granary, The"), place("the mellow  granary - Ullton"))
    assert same_place(place("Hollow Mill Books"), place("Hollow Mill Bookshop"))
    assert not same_place(place("The Seventh Accordion"), place("The Ochre Accordion"))


@pytest.mark.parametrize("n", [1, 2, 40, 900, 12_000])
def test_graph_recall(n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(max(1, n // 6), 48))
    x = base[rng.integers(0, len(base), n)] + 0.3 * rng.normal(size=(n, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = SmallWorld(x.shape[1], n)
    inserted = {p for q, i in graph.insert(x, 0.7) for p in zip(q.tolist(), i.tolist())}
    exact = {tuple(p) for p in np.argwhere(x @ x.T >= 0.7).tolist()}
    q, i = graph.within(x, 0.7)
    got = set(zip(q.tolist(), i.tolist()))
    assert len(got & exact) >= 0.97 * len(exact) and len(got - exact) <= 2  # rounding at the threshold
    earlier = {p for p in exact if p[0] > p[1]}
    assert len(inserted & earlier) >= 0.97 * len(earlier) and len(inserted - earlier) <= 2
    again = SmallWorld.stored(graph.x[: graph.n].astype(np.float16), graph.adj[: graph.n], graph.beam)
    q, i = again.within(x, 0.69)
    assert len(set(zip(q.tolist(), i.tolist())) & exact) >= 0.97 * len(exact)


def rows():
    t0, day = 1_750_000_000_000_000, dt.datetime(2025, 5, 1)
    out = []
    for k in range(9):
        t = t0 + k * 26 * H
        out += [(f"k{k}a", f"Act {'abcdefghij'[k % 10] * 5} with Owls", "The Old Mill", None, t, day + dt.timedelta(days=2)), (f"k{k}b", f"ACT {'abcdefghij'[k % 10] * 5} w/ Owls!", "Old Mill, The", None, t + H, day)]
    out += [("late", "Act aaaaa with Owls", "The Old Mill", None, t0 + 3 * H, day + dt.timedelta(days=9)), ("other", "Act aaaaa with Owls", "New Barn", None, t0, day), ("n1", None, "The Old Mill", None, t0, day), ("n2", "Act", None, None, t0, day), ("n3", "Act", "The Old Mill", None, None, day), ("empty", "", "The Old Mill", None, t0, day), ("long", "x " * 5000, "The Old Mill", None, t0, day)]
    return out + out[:4]


SCHEMA = "id string, title string, venue string, town string, start_us long, at timestamp"


def test_first_listings(spark):
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS slot", "'x' AS words")
    got = {(r.later, r.first) for r in first_listings(df).collect()}
    assert got == {(f"k{k}a", f"k{k}b") for k in range(9)} | {("late", "k0b")}
    spread = {(r.later, r.first) for r in first_listings(df, shard=3).collect()}  # a hot segment in many shards
    assert spread == got
    index = ListingIndex(spark, compact_at=2, shard=40)
    batches = {(r.later, r.first) for r in first_listings(df, ["2025-05-02", "2025-05-05"], index).collect()}
    assert batches == got
    assert index.dead  # some segments were compacted
    live = index.graphs().select("segment", "batch", "ids").collect()
    stored = [i for r in live for i in r.ids]
    assert len(stored) == len(set(stored)) == 9 * 2 + 3
    folders = {(int(p.parent.name.split("=")[1]), int(p.name.split("=")[1])) for p in Path(index.path.removeprefix("file://").removeprefix("file:")).glob("graphs/segment=*/batch=*")}
    assert folders == {(r.segment, r.batch) for r in live}


def test_a_batch_reads_only_the_segments_in_reach(spark):
    """Stored files out of a batch's reach are made unreadable; adding to others still works, and what it returns are the changes."""
    old = spark.createDataFrame([r for r in rows() if r[0].startswith("k")], SCHEMA)
    index = ListingIndex(spark, shard=4)
    index.add(old)
    t0, day = 1_750_000_000_000_000, dt.datetime(2025, 7, 1)
    t = t0 + 8 * 26 * H
    near = {t // index.width + d for d in (-1, 0, 1)}
    home = Path(index.path.removeprefix("file://").removeprefix("file:"))
    far = [p for kind in ("graphs", "members") for p in home.glob(f"{kind}/segment=*/batch=*/*.parquet") if int(p.parent.parent.name.split("=")[1]) not in near]
    assert len(far) > 10
    for p in far:
        p.write_bytes(b"unreadable")
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    again = ListingIndex(spark, index.path, shard=4)  # as another session would open it
    new = spark.createDataFrame([("n1", "Act iiiii with Owls", "The Old Mill", None, t + H // 2, day), ("n2", "Quite Another Act", "The Old Mill", None, t, day), ("k8a", "Act iiiii with Owls", "The Old Mill", None, t, day)], SCHEMA)
    got = {(r.later, r.first) for r in again.add(new).collect()}
    assert got == {("k8a", "k8b"), ("n1", "k8b")}
    assert {(r.later, r.first) for r in again.add(new.where("id = 'n2'")).collect()} == set()


def test_a_later_batch_joins_groups(spark):
    """Two listings too different to be linked are joined by a third; the result is that of one batch."""
    t0, day = 1_750_000_000_000_000, dt.datetime(2025, 5, 1)
    chain = [("a", "Act with Owls", 0, 1), ("b", "Act with Owls", 3 * H, 2), ("c", "Act with Owls", 3 * H // 2, 3)]
    df = spark.createDataFrame([(i, n, "The Old Mill", None, t0 + s, day + dt.timedelta(days=d)) for i, n, s, d in chain], SCHEMA)
    one = {(r.later, r.first) for r in first_listings(df).collect()}
    assert one == {("c", "a")}
    assert {(r.later, r.first) for r in first_listings(df, ["2025-05-03", "2025-05-04"]).collect()} == one


def test_recall_of_an_index(spark):
    t0, day = 1_750_000_000_000_000, dt.datetime(2025, 5, 1)
    rng = np.random.default_rng(3)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    many = [(f"i{k}", f"{names[k % 300]} {names[(k * 7) % 300]} night", f"{names[(k * 3) % 300]} hall", None, t0 + int(rng.integers(0, 40)) * H, day) for k in range(6000)]
    index = ListingIndex(spark)
    index.add(spark.createDataFrame(many, SCHEMA))
    r = index.recall().selectExpr("sum(similar) AS s", "sum(found) AS f", "sum(asked) AS a").first()
    assert r.a >= 50 and r.f >= 0.95 * r.s


def test_many_copies_of_one_listing(spark):
    """A third of all rows is one listing, exact and misspelt."""
    t0, day = 1_750_000_000_000_000, dt.datetime(2025, 5, 1)
    hot = [(f"h{k:04}", "Act with Owls" if k % 2 else f"Act with Owl{'abcdefgh'[k % 8]}", "The Old Mill", None, t0, day + dt.timedelta(seconds=k)) for k in range(1500)]
    cold = [(f"c{k:04}", f"Number {k * 37}", "The Old Mill", None, t0 + k * H, day) for k in range(300)]
    df = spark.createDataFrame(hot + cold, SCHEMA)
    got = {(r.later, r.first) for r in first_listings(df, shard=200).collect()}
    assert got == {(h[0], "h0000") for h in hot[1:]}


def test_split_firsts():
    assert split_firsts([(1, "a", 0), (3, "b", 2), (2, "c", 4)], 2) == [(0, "a", None), (2, "a", None), (4, "c", None)]
    assert split_firsts([(1, "a", 0), (2, "b", 2), (3, "c", 4), (4, "d", 5)], 2) == [(0, "a", None), (2, "a", None), (4, "c", "b"), (5, "c", "b")]


def test_chains_of_starts(spark):
    t0, day = 1_750_000_000_000_000, dt.datetime(2025, 5, 1)
    at = lambda d: day + dt.timedelta(days=d)
    chain = [("a", 0, 1), ("b", 2 * H, 2), ("c", 5 * H // 2, 3), ("d", 4 * H, 4), ("e", 9 * H // 2, 5), ("e2", 9 * H // 2, 6)]
    df = spark.createDataFrame([(i, "Act with Owls", "The Old Mill", None, t0 + s, at(d)) for i, s, d in chain], SCHEMA)
    got = {(r.later, r.first) for r in first_listings(df).collect()}
    assert got == {("b", "a"), ("c", "b"), ("d", "c"), ("e", "c"), ("e2", "c")}


def test_no_listings(spark):
    assert first_listings(spark.createDataFrame([], SCHEMA)).count() == 0
