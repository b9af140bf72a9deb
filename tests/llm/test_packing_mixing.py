"""Containers and mixes: nothing lost, nothing overfull, little room, shares met, caps kept."""

import random
from collections import defaultdict

from marquetry.llm import mixing
from marquetry.llm.mixing import mix, reachable_total
from marquetry.llm.packing import first_fit, improve, pack


def fewest(sizes, capacity):
    """The lower bound of Martello and Toth: items beyond half a container share none with each other."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = [n for n in sizes if n > capacity - a]
        half = [n for n in sizes if capacity / 2 < n <= capacity - a]
        small = [n for n in sizes if a <= n <= capacity / 2]
        best = max(best, len(alone) + len(half) + max(0, -(-(sum(small) - (len(half) * capacity - sum(half))) // capacity)))
    return best


def test_pack_keeps_every_token(spark):
    random.seed(5)
    sizes = [(i, random.choice([0, 1, 17, 90, 255, 256, 257, 900, random.randrange(1, 300)])) for i in range(600)] + [(600, None), (601, 5000), (3, 10), (None, 9)]
    kinds = spark.createDataFrame([("small", 256), ("large", 2048), ("none", 0), (None, 5), ("small", 256)], "container_kind string, capacity int")
    df = spark.createDataFrame(sizes, "doc long, n int").selectExpr("*", "1 AS k", "'x' AS part", "2 AS capacity")
    rows = pack(df, kinds, "doc", "n", block=200).collect()
    for kind, capacity in (("small", 256), ("large", 2048)):
        fill, tokens = defaultdict(int), defaultdict(int)
        for r in rows:
            if r.container_kind == kind:
                fill[r.container_id] += r.tokens
                tokens[r.doc] += r.tokens
                assert r.tokens <= capacity
        want = defaultdict(int)
        for d, n in sizes:
            if d is not None:
                want[d] += n or 0
        assert set(tokens) == set(want) and {d: (tokens[d], want[d]) for d in want if tokens[d] != want[d]} == {}
        assert max(fill.values()) <= capacity
        whole = sum((n or 0) // capacity for d, n in sizes if d is not None and (n or 0) > capacity)
        rest = [(n or 0) % capacity if (n or 0) > capacity else (n or 0) for d, n in sizes if d is not None]
        assert whole + fewest(rest, capacity) <= len(fill) <= whole + 1.03 * fewest(rest, capacity) + 4  # four blocks
        split = {r.doc for r in rows if r.container_kind == kind and r.part > 0}
        assert all(want[d] > capacity for d in split)
    assert {r.container_kind for r in rows} == {"small", "large"}


def test_pack_of_nothing(spark):
    kinds = spark.createDataFrame([("small", 256)], "container_kind string, capacity int")
    empty = spark.createDataFrame([], "doc long, n int")
    assert pack(empty, kinds, "doc", "n").count() == 0
    assert pack(spark.createDataFrame([(1, 2)], "doc long, n int"), kinds.where("false"), "doc", "n").count() == 0


def test_local_search_never_loses_or_overfills():
    random.seed(6)
    for _ in range(20):
        sizes = [random.randrange(20, 70) for _ in range(120)]
        first = first_fit(sizes, 100)
        better = improve(first, sizes, 100)
        assert sorted(i for b in better for i in b) == list(range(120))
        assert max(sum(sizes[i] for i in b) for b in better) <= 100
        assert len(better) <= len(first)
        assert sum(sum(sizes[i] for i in b) ** 2 for b in better) >= sum(sum(sizes[i] for i in b) ** 2 for b in first)


def test_first_fit_takes_the_first_container_with_room():
    assert first_fit([5, 6, 4, 5, 0, 10, 1], 10) == [[0, 2, 4, 6], [1], [3], [5]]
    assert first_fit([], 10) == [] and first_fit([3], 3) == [[0]]


def test_local_search_empties_containers_that_the_first_fit_leaves():
    """Hard sizes, around a third of the capacity: containers that can be full to the brim, shuffled."""
    random.seed(8)
    sizes = []
    for _ in range(300):
        a, b = random.randrange(250, 420), random.randrange(250, 330)
        sizes += [a, b, 1000 - a - b]
    random.shuffle(sizes)
    first = first_fit(sizes, 1000)
    better = improve(first, sizes, 1000)
    assert sorted(i for b in better for i in b) == list(range(900)) and max(sum(sizes[i] for i in b) for b in better) <= 1000
    assert len(first) >= 320 and len(better) <= 306


def test_local_search_of_many_items_in_one_container():
    """Large containers of small items: pairs are those of distinct sizes, and nothing is left out for their number."""
    random.seed(9)
    sizes = [random.choice([1, 2, 3, 5, 8]) for _ in range(6000)] + [997] * 9
    random.shuffle(sizes)
    better = improve(first_fit(sizes, 1000), sizes, 1000)
    assert sorted(i for b in better for i in b) == list(range(len(sizes))) and len(better) == -(-sum(sizes) // 1000)


def test_mix_meets_targets_and_caps(spark):
    random.seed(7)
    docs = [(i, random.choice("aaaab"), random.randrange(1, 400)) for i in range(3000)] + [(5000 + i, "tiny", 50) for i in range(20)] + [(9000, None, 5), (9001, "a", None), (9002, "a", 0), (9003, "zzz", 5)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("tiny", 0.05, 4), ("absent", 0.05, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc long, source string, tokens long").selectExpr("*", "'clash' AS k", "1 AS rate")
    copies, report = mix(df, targets, "doc")
    caps = {"a": 1, "b": 3, "tiny": 4}
    rows = copies.collect()
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    by = {r.source: r for r in report.collect()}
    assert by["absent"].mixed_tokens == 0 and set(by) == {"a", "b", "tiny", "absent"}
    for s in ("a", "b"):
        assert abs(by[s].mixed_tokens - by[s].wanted_tokens) <= 0.0001 * by[s].wanted_tokens
    assert by["tiny"].mixed_tokens == 20 * 50 * 4
    assert by["a"].mixed_tokens == sum(r.tokens * r.copies for r in rows if r.source == "a")


def test_mix_of_few_uneven_documents_and_of_one_size(spark):
    """A small source of very uneven sizes meets its tokens; documents of one size share their copies evenly, in many strata too."""
    random.seed(11)
    docs = [(i, "few", n) for i, n in enumerate([9000, 7000, 3100, 900, 450, 300, 120, 77, 35, 20, 11, 5, 3, 2, 1])] + [(1000 + i, "same", 40) for i in range(2500)] + [(1000, "same", 40)] * 3
    targets = spark.createDataFrame([("few", 0.11, 4), ("same", 0.89, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc long, source string, tokens long")
    old = mixing.STRATUM
    try:
        for mixing.STRATUM in (old, 100):
            copies, report = mix(df, targets, "doc", total=150_000.0)
            by = {r.source: r for r in report.collect()}
            assert abs(by["few"].mixed_tokens - 16_500) <= 1 and abs(by["same"].mixed_tokens - 133_500) <= 20
            rows = copies.collect()
            assert {r.copies for r in rows if r.source == "same"} == {1, 2} and max(r.copies for r in rows if r.source == "few") <= 4
    finally:
        mixing.STRATUM = old


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, report = mix(spark.createDataFrame([], "doc long, source string, tokens long"), targets, "doc")
    assert copies.count() == 0 and report.collect()[0].actual_share == 0.0


def test_reachable_total_ignores_sources_that_would_hold_all_down():
    assert reachable_total({"a": 1000.0, "b": 1.0}, {"a": (0.5, 1), "b": (0.5, 1)}) == 2000
    assert reachable_total({}, {"a": (1.0, 1)}) == 0.0
