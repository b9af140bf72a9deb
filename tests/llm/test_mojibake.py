"""Garbled text: exact round trips, held-out accuracy, and sound text that must stay."""

import random

import numpy as np

from marquetry.llm.mojibake import CHAINS, Classifier, cuts, find_garbled, garble, read_long, restore, words_of

SOUND = "déjà-vu soirée théâtre l’été crème brûlée naïve Zoë Renée São João coração não maçã Müller Straße schön größte Übung łąka źródło śpiew część żółty niño mañana corazón ¡Última Þórunn Ðalberg № 20°C £8 €5 “quoted” don’t мастерская открыта вход свободный разговор музыка концерт".split()


def model():
    return Classifier.fit({w: 50 for w in SOUND})


def test_round_trips():
    for chain in CHAINS:
        for w in SOUND:
            g = garble(w, chain)
            if g:
                assert restore(g, chain) == w


def test_sound_words_stay_and_utf8_garbling_is_restored():
    m = model()
    assert [w for w in SOUND if m.verdict(w)[0] != "sound"] == []
    for w in SOUND:
        for chain in CHAINS[:3]:
            g = garble(w, chain)
            if g and len(g) > 3:
                assert m.verdict(g) == ("restored", w), (w, chain, g)


def test_held_out_accuracy():
    random.seed(4)
    held = set(random.sample(SOUND, 10))
    m = Classifier.fit({w: 50 for w in SOUND if w not in held})
    tries = [(w, g) for w in held for c in CHAINS[:2] if (g := garble(w, c))]
    assert sum(m.verdict(g)[1] == w for w, g in tries) >= 0.8 * len(tries)


def test_words_keep_the_whole_text():
    text = "плюс" * 4000 + " ascii " + "é"
    assert "".join(words_of(text)) == "плюс" * 4000 + "é"


def test_documents(spark):
    rows = [(i, f"{a} {b} plain") for i, (a, b) in enumerate(zip(SOUND * 3, SOUND[::-1] * 3))]
    bad = [(1000, "La soirÃ©e au thÃ©Ã¢tre"), (1001, "lost � here"), (1002, None), (1003, ""), (1004, "IRMÃ, MÃE"), (1005, "x" * 200_000 + " dÃ©jÃ\xa0-vu")]
    df = spark.createDataFrame(rows + bad + bad[:1], "doc_id long, text string").selectExpr("*", "'clash' AS k", "0 AS restored")
    found = find_garbled(df).collect()
    assert sorted(r.doc_id for r in found) == [1000, 1000, 1001, 1005]
    assert {r.restored for r in found if r.doc_id == 1000} == {"La soirée au théâtre"}
    assert find_garbled(df.where("false")).count() == 0


def test_rare_words_of_a_large_table(spark):
    filler = [(i, f"{SOUND[i % len(SOUND)]} plain {i}") for i in range(2_000)]
    names = [(10_000 + i, "met Łucja there") for i in range(12)] + [(20_000, "met £ucja there"), (20_001, "met £ucja there")]
    df = spark.createDataFrame(filler + names, "doc_id long, text string")
    model = Classifier.fit({w: 50 for w in SOUND})  # as of a sample without the name
    found = {r.doc_id: r.restored for r in find_garbled(df, model=model).collect()}
    assert found == {20_000: "met Łucja there", 20_001: "met Łucja there"}


def test_long_words_are_inverted_as_a_whole():
    m = model()
    plain = "музыка,концерт,свободный,разговор,мастерская," * 5 + "вход"
    once = garble(plain, CHAINS[0])
    assert len(once) > 400 and read_long(once, m) == ("restored", plain)
    assert read_long(garble(once, CHAINS[0]), m) == ("restored", plain)
    assert read_long(plain, m) == ("sound", plain)
    # what can't be inverted as a whole is cut between characters
    assert read_long("日" + once, m) == ("restored", "日" + plain)
    assert "".join(cuts(once, CHAINS[0])) == once
    assert all(restore(x, CHAINS[0]) for x in cuts(once, CHAINS[0]) if not x.isascii())


def test_every_chain_above_sound_text_is_tried():
    fitted = model()
    seventh = fitted.classes.index(("utf-8", "koi8-r"))
    others = [k for k, c in enumerate(fitted.classes) if c and c != ("utf-8", "koi8-r") and restore(garble("śpiew", ("utf-8", "koi8-r")), c) is None]
    assert len(others) >= 8

    def scores(word):
        s = np.full(len(fitted.classes), -9.0)
        s[0], s[seventh] = (0, 1) if word == garble("śpiew", ("utf-8", "koi8-r")) else (9, 1)
        s[others[:8]] = np.arange(8) + 2
        return s

    fitted.scores = scores
    assert fitted.verdict(garble("śpiew", ("utf-8", "koi8-r"))) == ("restored", "śpiew")


def test_text_garbled_often_by_any_utf8_chain():
    fitted = model()
    inner = garble("мастерская", CHAINS[0])
    outer = garble(inner, ("utf-8", "koi8-r")) or garble(inner, ("utf-8", "cp437"))
    lossy = next(k for k, c in enumerate(fitted.classes) if c == CHAINS[0])
    plain_scores = fitted.scores

    def scores(word):
        s = plain_scores(word)
        if word == outer:
            s[:] = -50
            s[lossy] = 0
        return s

    fitted.scores = scores
    assert fitted.verdict(outer) == ("restored", "мастерская")
