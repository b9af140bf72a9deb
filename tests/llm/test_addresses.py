"""Addresses: parts, corrections, containment, and the cases that are left out."""

import pytest

from marquetry.llm import addresses
from marquetry.llm.addresses import mended_names, one_edit, parse, same_addresses, same_spelling, token_corrections, tokens_of

TOWNS = {"holtford": frozenset(["01000"]), "hexpool": frozenset(["01013"]), "boston": frozenset(["02108", "02110"])}


@pytest.mark.parametrize(
    ("address", "want"),
    [
        ("836 Sycamore Street, Holtford, MA 01000", ("836", "", "sycamore", "street", "01000")),
        ("836 SYCAMORE - HOLTFORD - MA - USA", ("836", "", "sycamore", "", "01000")),
        ("01000 Holtford, MA, 12 N. 5th Ave", ("12", "north", "5th", "avenue", "01000")),
        ("Hexpool / Twelve Fifth Ave. West / Suite 3", ("12", "west", "5th", "avenue", "01013")),
        ("2nd Fl 99 Ft Wexcombe Rd Hexpool NH", ("99", "", "fort wexcombe", "road", "01013")),
        ("10451 Foxglove Ct\nHexpool", ("10451", "", "foxglove", "court", "01013")),
    ],
)
def test_parts(address, want):
    p = parse(tokens_of(address), TOWNS)
    assert (p["number"], p["direction"], p["name"], p["type"], p["code"] or min(TOWNS[p["town"]])) == want


@pytest.mark.parametrize("address", ["", "Holtford, MA", "somewhere", "   ", "Suite 12"])
def test_unreadable(address):
    assert parse(tokens_of(address), TOWNS) is None


@pytest.mark.parametrize(
    ("address", "name", "town", "code", "state"),
    [
        ("12 Sycamore St", "sycamore", "", "", ""),
        ("10 Main St, Boston", "main", "boston", "", ""),
        ("10 Main St, Boston, MA 02110", "main", "boston", "02110", "ma"),
        ("01013 hexpool nh seven ninth avenue", "9th", "hexpool", "01013", "nh"),
        ("10 Main St, N.H.", "main", "", "", "nh"),
        ("12 N C St, Boston", "c", "boston", "", ""),
        ("12 La Salle Ave, Boston, Mass.", "la salle", "boston", "", "ma"),
        ("12 Lake Washington Blvd, Seattle, Washington 98101", "lake washington", "", "98101", "wa"),
        ("12 Rue Café, Hexpool", "rue cafe", "hexpool", "", ""),
        ("12 Łąkowa Rd, Hexpool, South Carolina", "łakowa", "hexpool", "", "sc"),
    ],
)
def test_areas_and_letters(address, name, town, code, state):
    p = parse(tokens_of(address), TOWNS)
    assert (p["name"], p["town"], p["code"], p["state"]) == (name, town, code, state)


def test_a_leading_name_is_no_part_of_the_address():
    assert tokens_of("Nine Pins Bowl, 848 Cranberry Ter", ("Nine Pins Bowl",))[0] == "848"


def test_corrections_join_only_neighbours(spark):
    words = spark.createDataFrame([("sycamore", 40), ("sycmaore", 1), ("sycamor", 2), ("harbor", 30), ("street", 1)], "word string, n int")
    assert {(r.word, r.right) for r in token_corrections(words).collect()} == {("sycmaore", "sycamore"), ("sycamor", "sycamore")}


def test_pairs(spark):
    rows = [("v%02d" % i, f"{900 + i} Filler Street, Holtford, MA 01000", None) for i in range(12)]
    rows += [
        ("a", "836 Sycamore Street, Holtford, MA 01000", "X"), ("b", "836 Sycamore St., 2nd Fl, Holtford", "Y"), ("c", "836 sycamore, 01000", "Z"),
        ("d", "836 Sycamore Avenue, Hexpool, NH 01013", "X"), ("e", "838 Sycamore Street, Holtford, MA 01000", "X"), ("f", None, "X"), ("g", "", "X"),
        ("a", "836 Sycamore Street, Holtford, MA 01000", "X"), ("h", "836 East Sycamore Street, Hexpool, NH 01013", "W"), ("i", "836 Sycamore Lane, Hexpool 01013", None), (None, "836 Sycamore Street, Holtford, MA 01000", "X"),
    ]
    df = spark.createDataFrame(rows, "id string, address string, name string").selectExpr("*", "'clash' AS key", "1 AS tokens")
    got = {(r.a, r.b) for r in same_addresses(df, "id", "address", ["name"]).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}


def test_missing_and_contradicting_areas(spark):
    """A town with several codes; a town without a code; no town at all; accents; the same street in two towns."""
    rows = [("f%02d" % i, f"{900 + i} Filler Street, Boston, MA {('02108', '02110')[i % 2]}", None) for i in range(12)]
    rows += [
        ("a", "10 Main St, Boston", None), ("b", "10 Main Street, Boston, MA 02110", None), ("c", "20 Elm St, Boston 02108", None), ("d", "20 Elm St, Boston 02110", None),
        ("e", "12 Rue Café, Boston 02108", None), ("f", "12 RUE CAFE, Boston, MA", None), ("g", "31 Lone Rd", None), ("h", "31 Lone Road, Boston, MA 02108", None),
        ("i", "40 Twin St, Boston 02108", None), ("j", "40 Twin St, Boston 02110", None), ("k", "40 Twin St", None), ("l", "10 Main St, MA", None), ("m", "10 Main St, NH", None),
    ]
    df = spark.createDataFrame(rows, "id string, address string, name string")
    got = {(r.a, r.b) for r in same_addresses(df, "id", "address", ["name"]).collect()}
    assert got == {("a", "b"), ("e", "f"), ("g", "h"), ("a", "l"), ("b", "l")}


def test_a_place_with_very_many_records(spark, monkeypatch):
    monkeypatch.setattr(addresses, "MEETING", 7)
    rows = [(i, ["12 Elm Street, Holtford, MA 01000", "12 Elm St, Holtford", "12 elm, 01000"][i % 3]) for i in range(60)] + [(99, "14 Elm Street, Holtford, MA 01000")]
    got = {(r.a, r.b) for r in same_addresses(spark.createDataFrame(rows, "id long, address string"), "id", "address", []).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60)}


def test_one_edit():
    assert [one_edit("orchard", w) for w in ("orchard", "ochard", "orrchard", "orhcard", "orcherd", "orchards", "ohrcadr", "rchards")] == [False, True, True, True, True, True, False, False]
    assert same_spelling("orchard view", "orchardview") and same_spelling("mount tamsin", "mount tasin")
    assert not same_spelling("5th", "6th") and not same_spelling("elm", "elk")
    assert mended_names([("hill", "", "street", 9), ("mill", "", "road", 9), ("orchardview", "", "", 5), ("orcharddview", "", "lane", 1)]) == ["hill", "mill", "orchardview", "orchardview"]


def test_rare_and_repeated_misspellings(spark):
    rows = [
        ("a", "1189 Orcharddview St, Holtford, MA 01000"), ("b", "1189 Orchardview Street, Holtford, MA 01000"), ("c", "1189 Orchardview Lane, Holtford, MA 01000"), ("d", "1187 Orchardview Street, Holtford, MA 01000"),
        ("e", "7 Harbarview Rd, Hexpool, NH 01013"), ("f", "7 Harbarview Road, Hexpool, NH 01013"), ("g", "7 Harborview Rd, Hexpool, NH 01013"),
        ("h", "1189 Orchardview Street, Holtfrod, MA"), ("i", "12 5th Ave, Hexpool 01013"), ("j", "12 6th Ave, Hexpool 01013"),
    ]
    df = spark.createDataFrame(rows, "id string, address string")
    got = {(r.a, r.b) for r in same_addresses(df, "id", "address", []).collect()}
    assert got == {("a", "b"), ("a", "h"), ("b", "h"), ("e", "f"), ("e", "g"), ("f", "g")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, address string, name string")
    assert same_addresses(df, "id", "address", ["name"]).count() == 0
