"""Text garbled by a wrong character encoding: found by a classifier of byte bigrams, restored by inverting the predicted chain."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise

#: (encoding the bytes were in, encoding they were read with). The public names of codecs.
CHAINS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "koi8-r"),
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("euc_jp", "cp1252"), ("shift_jis", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp437", "cp1252"),
)
#: Buckets of the hashed bigrams.
BUCKETS = 1 << 16
#: Documents from which the classifier is fitted, at most: those with the smallest hash of their id.
FIT_DOCUMENTS = 8_000
#: By so many nats must a chain fit better than sound text where the original can't be restored.
LOSSY_MARGIN = 9.0

#: A chain's probability before a word is seen, in nats.
PRIOR = -5.0
#: By so much must a restored word be more typical, in nats per bigram, where any byte would decode.
LEGACY_MARGIN = 1.0

#: A well-known word stands in one of so many documents, a known one in one of ``FIT_DOCUMENTS`` and in two at least; so both are bounded in number.
KNOWN_ONE_IN = 400
#: Documents with a well-known word where their number isn't given.
KNOWN = 20
#: By so many times must an original be more frequent than a word with few bytes of a legacy encoding.
RATIO = 3

# anchored at the start of a word and possessive, so that a long word without such characters is read once
_WORD = re.compile(r"(?<![^ \t\r\n])[\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \t\r\n]*")
_PIECE = 48


def words_of(text: str) -> list[str]:
    """The words of a text that hold characters beyond ASCII; very long ones, as in scripts without spaces, in pieces."""
    return [w[i : i + _PIECE] for w in _WORD.findall(text) for i in range(0, len(w), _PIECE)]


def encode(text: str, codec: str) -> bytes:
    """As the codec does, and bytes it leaves undefined stand for themselves, as browsers and most libraries have it."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(codec)
            except UnicodeEncodeError:
                if 0x80 <= ord(ch) < 0xA0 and codec.startswith("cp125"):
                    out.append(ord(ch))
                else:
                    raise
        return bytes(out)


def decode(data: bytes, codec: str, undefined: str = "keep") -> str:
    """``undefined``: bytes the codec leaves undefined are kept as control characters or dropped."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        if not codec.startswith("cp125"):
            raise
        return "".join(bytes([b]).decode(codec, "ignore") or (chr(b) if undefined == "keep" else "") for b in data)


def garble(text: str, chain: tuple[str, str], undefined: str = "keep") -> str | None:
    """``text`` as the chain leaves it; null where it can't be written in the first encoding, can't be read, or stays as it is."""
    try:
        out = decode(encode(text, chain[0]), chain[1], undefined)
    except UnicodeError:
        return None
    return None if out == text else out


def restore(text: str, chain: tuple[str, str]) -> str | None:
    """The text before the chain; null unless every byte decodes strictly."""
    try:
        out = encode(text, chain[1]).decode(chain[0])
    except UnicodeError:
        return None
    return None if out == text else out


def _garbled(words: dict[str, int], chain: tuple[str, str], undefined: str = "keep") -> dict[str, int]:
    return {g: n for w, n in words.items() if (g := garble(w, chain, undefined))}


def buckets_of(word: str) -> np.ndarray:
    data = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.int64)
    pairs = (data[:-1] << 8 | data[1:])[(data[:-1] > 127) | (data[1:] > 127)]
    return (pairs * 40_503) % BUCKETS  # odd, so bijective at 2^16


class Classifier:
    """Multinomial naive Bayes over hashed byte bigrams; class 0 is sound text, class k the chain k-1, then the lossy ones."""

    def __init__(self, table: np.ndarray, classes: list[tuple[str, str] | None], known: dict[str, int], often: float = KNOWN):
        self.table, self.classes, self.known = table, classes, known
        self.often = sorted(w for w, n in known.items() if n >= often)

    def begins_often(self, word: str) -> bool:
        """Whether a word of many documents begins so, as where a text was cut within it."""
        i = bisect.bisect_left(self.often, word)
        return i < len(self.often) and self.often[i].startswith(word)

    def scores(self, word: str) -> np.ndarray:
        found = self.table[:, buckets_of(word)].sum(axis=1)
        found[1:] += PRIOR
        return found

    def typical(self, word: str) -> float:
        """How usual the word is as sound text, in nats per bigram."""
        found = self.table[0, buckets_of(word)]
        return float(found.mean()) if len(found) else 0.0

    @classmethod
    def fit(cls, sound: dict[str, int], rounds: int = 3, alpha: float = 0.02) -> Classifier:
        """Fit on words with the number of documents that hold them; those a first fit finds garbled leave the sound ones for the next."""
        words = {w: n for w, n in sorted(sound.items()) if "\ufffd" not in w}
        model = None
        for _ in range(rounds):
            if model is not None:
                words = {w: n for w, n in words.items() if model.verdict(w, legacy=3 * LEGACY_MARGIN)[0] == "sound"}
            classes: list[tuple[str, str] | None] = [None]
            samples = [words]

            def add(chain: tuple[str, str], made: dict[str, int]) -> None:
                if made:
                    classes.append(chain)  # noqa: B023
                    samples.append(made)  # noqa: B023

            for chain in CHAINS:
                made = _garbled(words, chain)
                add(chain, made)
                if chain[0] == "utf-8" and chain[1].startswith("cp125"):
                    add(chain, {g: n for g, n in _garbled(words, chain, "drop").items() if g not in made})
                    add(chain, _garbled(made, chain))
            table = np.empty((len(classes), BUCKETS), np.float32)
            for k, made in enumerate(samples):
                counts = np.zeros(BUCKETS)
                for w, n in made.items():
                    np.add.at(counts, buckets_of(w), n**0.75)
                table[k] = np.log((counts + alpha) / (counts.sum() + alpha * BUCKETS))
            model = cls(table, classes, {w: n for w, n in sound.items() if n > 1})
        return model

    def verdict(self, word: str, depth: int = 4, legacy: float = LEGACY_MARGIN, counts: dict[str, int] | None = None) -> tuple[str, str]:
        """(sound, restored or lossy; the best text). ``counts``: documents that hold the word and its ``originals``, beside the known words."""
        if "�" in word:
            return "lossy", word
        number = lambda w: (counts or {}).get(w) or self.known.get(w, 0)
        s = self.scores(word)
        tried, best = set(), {}
        for k in np.argsort(-s):  # every chain that fits better than sound text, once
            chain = self.classes[k]
            if chain is None or s[k] <= s[0]:
                break
            if chain in tried:
                continue
            if chain[0] != "utf-8" and any(c[0] == "utf-8" and s[0] + LOSSY_MARGIN < best[c] for c in tried):
                continue  # rather a UTF-8 chain that lost bytes, as any byte decodes in a legacy encoding
            tried.add(chain)
            best[chain] = s[k]
            back = restore(word, chain)
            if back and not _readable(back) and chain[0] == "utf-8" and depth > 1:  # garbled twice, with bytes that the second encoding leaves undefined
                further, deeper = self.verdict(back, depth - 1, legacy, counts)
                if further == "restored":
                    return "restored", deeper
            if back is None or not _readable(back) or (chain[0] != "utf-8" and sum(not ch.isascii() for ch in word) < 2):
                continue
            if chain[0] != "utf-8" and (self.known.get(word, 0) > self.known.get(back, 0) or self.begins_often(word) > self.begins_often(back)):
                continue  # more documents have it so than otherwise
            # the inversion must leave text that is more like sound text, by its own characters
            if back.isascii() or self.typical(back) > self.typical(word) + (0 if chain[0] == "utf-8" else legacy):
                if depth > 1 and not back.isascii():
                    further, deeper = self.verdict(back, depth - 1, legacy, counts)
                    if further == "restored":
                        return "restored", deeper
                return "restored", back
        for chain in CHAINS if sum(not ch.isascii() for ch in word) else ():  # few bytes of a legacy encoding: the original must be a more frequent word
            back = restore(word, chain) if chain[0] != "utf-8" else None
            if back and len(back) > 3 and _readable(back) and number(back) > RATIO * max(1, number(word)):
                return "restored", back
        utf8 = [k for k, chain in enumerate(self.classes) if chain and chain[0] == "utf-8"]
        if utf8 and s[utf8].max() > s[0] + LOSSY_MARGIN:
            for chain in CHAINS if depth > 1 else ():  # more than twice garbled
                back = restore(word, chain) if chain[0] == "utf-8" else None
                if back and (further := self.verdict(back, depth - 1, legacy, counts))[0] == "restored":
                    return further
            return "lossy", word
        return "sound", word


def cuts(word: str, chain: tuple[str, str]) -> list[str]:
    """The word in pieces of ``_PIECE`` characters at most, none of which parts what the chain made of one character.

    What the chain can't have made stands apart from what it can.
    """
    data = []
    for ch in word:
        try:
            data.append(encode(ch, chain[1]))
        except UnicodeError:
            data.append(b"")
    pieces, start, i, before = [], 0, 0, None
    while i < len(word):
        n, made = 1, False
        for m in range(1, 5) if data[i] else ():
            part = data[i : i + m]
            if len(part) < m or not all(part):
                break
            try:
                b"".join(part).decode(chain[0])
            except UnicodeError:
                continue
            n, made = m, True
            break
        if i > start and (i + n - start > _PIECE or made != before):
            pieces.append(word[start:i])
            start = i
        before = made
        i += n
    return [*pieces, word[start:]]


def read_long(word: str, model: Classifier, depth: int = 4) -> tuple[str, str]:
    """The verdict of a word of any length: as a whole, or else in pieces, cut between the characters of each chain that may have made it.

    What the pieces leave is read again, as text garbled twice is cut between its outer characters first.
    """
    what, text = model.verdict(word)
    if what == "restored" or len(word) <= _PIECE:
        return what, text
    s = model.scores(word)
    ranked = [model.classes[k] for k in np.argsort(-s) if k and s[k] > s[0]]
    best, left = word, None
    for chain in dict.fromkeys(ranked or [CHAINS[0]]):
        read = [model.verdict(x) for x in cuts(word, chain)]
        lossy = sum(x[0] == "lossy" for x in read)
        if any(x[0] == "restored" for x in read) and (left is None or lossy < left):
            best, left = "".join(x[1] for x in read), lossy
        if left == 0:
            break
        if left is None and lossy:
            what = "lossy"
    if left is None:
        return what, word
    if depth > 1:
        further, deeper = read_long(best, model, depth - 1)
        if further == "restored":
            return "restored", deeper
    return ("part" if left else "restored"), best


def originals(word: str, depth: int = 4) -> set[str]:
    """The texts whose frequencies decide on a word: those before a legacy chain, of the word itself and of what UTF-8 chains leave of it."""
    found = {word}
    for chain in CHAINS:
        back = restore(word, chain)
        if back and not word.isascii():
            if chain[0] != "utf-8" and len(back) > 3 and _readable(back):
                found.add(back)
            elif chain[0] == "utf-8" and depth > 1 and not back.isascii():
                found |= originals(back, depth - 1)
    return found


def _readable(text: str) -> bool:
    return all(ch.isprintable() or ch in " ­​‍　️\n\t" for ch in text)


def fit(documents: DataFrame, key: str, text: str, fit_documents: int = FIT_DOCUMENTS) -> Classifier:
    """Fit from the documents with the smallest hash of their key, ``fit_documents`` at most."""
    sample = documents.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.xxhash64(key).alias("h"), F.col(text).alias("t")).orderBy("h").limit(fit_documents)
    words = sample.select(F.explode(F.array_distinct(F.filter(F.split("t", r"[ \t\r\n]+"), lambda w: w.rlike(r"[^\x00-\x7F]")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, int] = {}
    for row in words.collect():  # the words of a bounded sample
        for w in words_of(row.w):
            counts[w] = counts.get(w, 0) + row.n
    return Classifier.fit(counts)


def count_words(documents: DataFrame, text: str) -> DataFrame:
    """(w, n): the words beyond ASCII with the number of documents that hold them, over all documents."""
    return documents.select(F.explode(_distinct_words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w.rlike(r"[^\x00-\x7F]")))


def find_garbled(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Classifier | None = None) -> DataFrame:
    """(``key``, restored string, words_restored int, words_lossy int) for the documents that hold garbled text.

    ``restored`` is the text with every invertible word restored; what is lost stays as it is and is counted. A long word that can't be
    inverted as a whole is read in pieces and counts as restored, as lossy or as both. Every document is read as a whole,
    word by word. Null and empty texts hold nothing garbled; repeated rows come out repeated; a table without any character beyond ASCII gives no rows.
    The model is bounded: a table of float32 per class and bucket, fitted on a sample. Frequencies are those in all documents: the rates of known
    words are broadcast, a rarer word is joined with the counts of its possible originals.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]")).withColumn("u", F.monotonically_increasing_id())
    rows = materialise(rows, "garbled-rows")
    model = model or fit(rows, "k", "t")
    words = materialise(count_words(rows, "t"), "garbled-words")
    total = rows.count()
    # words of one document in FIT_DOCUMENTS and more: no more than that many documents' worth
    common = {r.w: r.n for r in words.where(F.col("n") > max(1.0, total / FIT_DOCUMENTS)).collect()}
    shared = spark.sparkContext.broadcast((model.table, model.classes, common, max(2.0, total / KNOWN_ONE_IN)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, x) for w in b.w for x in originals(w)], columns=["w", "original"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Classifier(*shared.value)
        for b in batches:
            out = [(w, *own.verdict(w, counts=dict(c))) for w, c in zip(b.w, b.counts)]
            yield pd.DataFrame([x for x in out if x[1] != "sound"], columns=["w", "what", "better"])

    # words whose verdict the frequency of an original in all documents can change
    asked = words.select("w").mapInPandas(ask, "w string, original string").join(words.select(F.col("w").alias("original"), "n"), "original")
    asked = asked.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("original", "n"))).alias("counts")).where(F.size("counts") > 1)
    judged = materialise(asked.mapInPandas(judge, "w string, what string, better string"), "garbled-judged")
    held = rows.select("u", F.explode(_distinct_words(F.col("t"))).alias("w")).join(judged, "w").groupBy("u").agg(F.collect_list(F.struct("w", "what", "better")).alias("judged"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Classifier(*shared.value)
        verdict = lru_cache(maxsize=200_000)(lambda w: read_long(w, own))
        for batch in batches:
            out = []
            for k, t, judged in zip(batch["k"], batch["t"], batch["judged"]):
                counts = {"restored": 0, "lossy": 0}
                by_count = {x["w"]: (x["what"], x["better"]) for x in judged} if judged is not None else {}

                def better(m: re.Match) -> str:
                    what, word = by_count.get(m[0]) or verdict(m[0])  # noqa: B023
                    for x in ("restored", "lossy") if what == "part" else (what,) if what != "sound" else ():
                        counts[x] += 1  # noqa: B023
                    return word

                restored = _WORD.sub(better, t)
                if any(counts.values()):
                    out.append((k, restored, counts["restored"], counts["lossy"]))
            yield pd.DataFrame(out, columns=[key, "restored", "words_restored", "words_lossy"])

    return rows.join(held, "u", "left").select("k", "t", "judged").mapInPandas(run, f"`{key}` {kind}, restored string, words_restored int, words_lossy int")
