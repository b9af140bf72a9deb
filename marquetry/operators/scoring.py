"""Similarity of records to preferences: best matches per side and domain, gated contributions, scores, labels and reasons; final scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.numeric import gate
from marquetry.operators.lineage import materialise

#: Preferences whose vectors are broadcast at once.
PREFERENCE_BLOCK = 4_096


@dataclass(frozen=True)
class Scoring:
    """The gate, the weight of the summary, and the margins of the label."""

    midpoint: float = 0.5
    temperature: float = 0.1
    summary_weight: float = 0.3
    yes_from: float = 0.30
    no_margin: float = 0.15
    balanced: bool = True


def nearest(vectors: DataFrame, preferences: DataFrame, block: int = PREFERENCE_BLOCK) -> DataFrame:
    """(vid, side, c, pid): for each row of ``vectors(vid, v)`` and each side the most similar of ``preferences(pid, p, side)``.

    Similarities are compared to nine digits, equal ones go to the smaller pid; a zero vector has similarity zero. Null ids, vectors and sides are left out.
    Preferences are broadcast in blocks of ``block``, one after another, and the best of each block are merged, so every vector meets all of them.
    """
    spark = vectors.sparkSession
    prefs = materialise(preferences.where("pid IS NOT NULL AND p IS NOT NULL AND side IS NOT NULL").select("pid", F.transform("p", lambda x: x.cast("double")).alias("p"), F.col("side").cast("string").alias("side")), "preferences")
    blocks = max(1, -(-prefs.count() // block))
    rows = vectors.where("vid IS NOT NULL AND v IS NOT NULL").select("vid", "v")
    kind = rows.schema["vid"].dataType.simpleString()
    part = F.pmod(F.xxhash64("pid"), F.lit(blocks))
    best = None
    for b in range(blocks):
        own = prefs.where(part == b).orderBy("pid").collect()  # about ``block`` rows
        met = rows.mapInPandas(_nearest([(r.pid, r.p, r.side) for r in own], spark), f"vid {kind}, side string, c double, pid bigint")
        found = met if best is None else best.unionByName(met)
        order = F.struct(F.round("c", 9).alias("c"), (-F.col("pid")).alias("n"))
        found = found.groupBy("vid", "side").agg(F.max("c").alias("c"), F.max_by("pid", order).alias("pid"))
        best = materialise(found, "best-preferences") if blocks > 1 else found
    return best


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nearest(preferences: list[tuple[int, list[float], str]], spark: SparkSession):
    shared = spark.sparkContext.broadcast(preferences)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: dict = {}
        for pid, p, side in shared.value:
            sides.setdefault(side, ([], []))[0].append(pid)
            sides[side][1].append(p)
        sides = {s: (np.array(ids), _unit(np.array(v, float))) for s, (ids, v) in sides.items()}
        for batch in batches:
            for at in range(0, len(batch), 1_024):
                some = batch.iloc[at : at + 1_024]
                x = _unit(np.stack(some.v.to_numpy()).astype(float))
                for side, (ids, p) in sides.items():
                    c = x @ p.T
                    first = np.round(c, 9).argmax(axis=1)  # ids ascend, so the first of equal ones has the smallest
                    yield pd.DataFrame({"vid": some.vid.to_numpy(), "side": side, "c": c.max(axis=1), "pid": ids[first]})

    return run


def similar_pairs(vectors: DataFrame, queries: DataFrame, least: float, block: int = PREFERENCE_BLOCK) -> DataFrame:
    """(qid, vid, c) for each query and each other vector with a cosine of ``least`` or more: ``queries(qid, q)`` against all of ``vectors(vid, v)``.

    Queries are broadcast in blocks. Null ids and vectors are left out; a zero vector is similar to none.
    """
    spark = vectors.sparkSession
    asked = materialise(queries.where("qid IS NOT NULL AND q IS NOT NULL").select("qid", F.transform("q", lambda x: x.cast("double")).alias("q")), "queries")
    blocks = max(1, -(-asked.count() // block))
    rows = vectors.where("vid IS NOT NULL AND v IS NOT NULL").select("vid", "v")
    kind, other = rows.schema["vid"].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()  # about ``block`` rows
        shared = spark.sparkContext.broadcast((np.array([r.qid for r in own]), _unit(np.array([r.q for r in own], float)) if own else None))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for batch in batches if q is not None else ():
                for at in range(0, len(batch), 1_024):
                    some = batch.iloc[at : at + 1_024]
                    c = _unit(np.stack(some.v.to_numpy()).astype(float)) @ q.T
                    i, j = np.nonzero(c >= least)
                    yield pd.DataFrame({"qid": ids[j], "vid": some.vid.to_numpy()[i], "c": c[i, j]})

        met = rows.mapInPandas(run, f"qid {other}, vid {kind}, c double")
        out = met if out is None else out.unionByName(met)
    return out.where("qid <> vid")


def contributions(items: DataFrame, vectors: DataFrame, preferences: DataFrame, scopes: list[str], config: Scoring, general: str = "general") -> DataFrame:
    """A row for each of ``items(id, position, scope, weight, vid, ...)`` whose vector is known: like, like_pid, dislike, dislike_pid, factor, pid, similarity, contribution.

    ``preferences(pid, p, side, domain)``: an item meets those of the general domain and of its scope. The like wins only if it is strictly more similar than
    the dislike, which is zero where there is none; without a winner factor and contribution are null. Each distinct vector is compared once, however many
    items have it; ``vectors(vid, v)`` is the dictionary, and items without an entry give no row.
    """
    used = vectors.join(items.select("vid").distinct(), "vid", "left_semi")
    best = nearest(used, preferences.select("pid", "p", F.concat_ws("|", "side", "domain").alias("side")))
    best = best.withColumns({"domain": F.substring_index("side", "|", -1), "side": F.substring_index("side", "|", 1)})
    every = F.array(*[F.lit(s) for s in sorted({*scopes, general})])
    scoped = best.withColumn("scope", F.explode(F.when(F.col("domain") == general, every).otherwise(F.array("domain"))))
    order = F.struct(F.round("c", 9).alias("c"), (-F.col("pid")).alias("n"))
    one = lambda side, what: F.max(F.when(F.col("side") == side, F.col("c"))) if what == "c" else F.max_by("pid", F.when(F.col("side") == side, order))
    scoped = scoped.groupBy("vid", "scope").agg(one("like", "c").alias("like"), one("like", "pid").alias("like_pid"), one("dislike", "c").alias("dislike"), one("dislike", "pid").alias("dislike_pid"))
    met = items.join(scoped, ["vid", "scope"])
    likes = F.col("like") > F.coalesce("dislike", F.lit(0.0))
    factor = F.when(likes, "like").when(F.col("dislike").isNotNull(), "dislike")
    similarity = F.when(factor == "like", F.col("like")).when(factor == "dislike", F.col("dislike"))
    worth = similarity * gate(similarity, config.midpoint, config.temperature) * F.col("weight")
    return met.withColumns({"factor": factor, "pid": F.when(factor == "like", F.col("like_pid")).when(factor == "dislike", F.col("dislike_pid")), "similarity": similarity, "contribution": F.when(factor == "like", worth).when(factor == "dislike", -worth)})


def similarity_scores(contributed: DataFrame, config: Scoring) -> DataFrame:
    """(id, tag_score, summary_score, base_score, match) from the contributions of each record; a null ``position`` marks the summary.

    The tag score is the mean of the positive less the mean of the negative contributions, or the plain mean. The label is no where the best dislike beats
    the best like by the margin, yes from ``yes_from`` on, maybe otherwise; similarities below zero count as zero.
    """
    c, tag = F.col("contribution"), F.col("position").isNotNull()
    mean = lambda when, x=c: F.coalesce(F.avg(F.when(tag & when, x)), F.lit(0.0))
    score = mean(c > 0) - mean(c < 0, -c) if config.balanced else mean(c.isNotNull())
    g = contributed.groupBy("id").agg(score.alias("tag_score"), F.coalesce(F.max(F.when(~tag, c)), F.lit(0.0)).alias("summary_score"), F.greatest(F.max("like"), F.lit(0.0)).alias("__like"), F.greatest(F.max("dislike"), F.lit(0.0)).alias("__dislike"))
    g = g.withColumn("base_score", F.col("tag_score") + config.summary_weight * F.col("summary_score"))
    return g.select("id", "tag_score", "summary_score", "base_score", match_label(F.col("base_score"), F.col("__like"), F.col("__dislike"), config).alias("match"))


def match_label(base: Column, like: Column, dislike: Column, config: Scoring) -> Column:
    return F.when(dislike - like >= config.no_margin, "no").when(base >= config.yes_from, "yes").otherwise("maybe")


def final_score(base: Column, sure: Column, direction: Column, times: dict[str, float], weather: Column | None = None) -> Column:
    """The base score times its confidence, multiplied toward its match, and the weather's adjustment; a missing factor changes nothing."""
    score = base * F.coalesce(F.when(~F.isnan(sure), sure), F.lit(1.0))
    m = F.lit(1.0)
    for name, x in times.items():
        m = F.when(direction == name, x).otherwise(m)
    toward = F.when(score >= 0, score * m).otherwise(score / m)
    return toward + F.coalesce(weather, F.lit(0.0)) if weather is not None else toward
