"""Structured Streaming forms: nights as windows, deduplication within a watermark, the keyed latch with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def night_counts(stream: DataFrame, ts: str, by: str, late: str = "1 hour", starts_at_hour: int = 4) -> DataFrame:
    """Rows per night (04:00 to 04:00 UTC) and ``by``; later than the watermark they are dropped."""
    night = F.window(F.col(ts), "24 hours", "24 hours", f"{starts_at_hour} hours")
    g = stream.withWatermark(ts, late).groupBy(night.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.to_date("w.start").alias("night"), by, "n")


def unchanged_skipped(stream: DataFrame, ts: str, key: str, content: str, late: str = "1 day") -> DataFrame:
    """The rows whose key and content were not seen within the watermark: unchanged input is not processed again."""
    hashed = stream.withColumn("content_hash", F.sha2(content, 256)).withWatermark(ts, late)
    return hashed.dropDuplicatesWithinWatermark([key, "content_hash"])


def latch_stream(runs: DataFrame, part: str, least_rate: float = 0.5, least_evidence: int = 20, least_runs: int = 2) -> DataFrame:
    """(part, evidence, runs, armed) as runs (part, seen, churned) arrive; once armed it stays so. The state is three numbers per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        evidence, count, armed = state.get if state.exists else (0, 0, False)
        for b in batches:
            good = b[(b.seen > 0) & (b.churned >= least_rate * b.seen)]
            evidence += int(good.churned.sum())
            count += len(good)
        armed = armed or (evidence >= least_evidence and count >= least_runs)
        state.update((evidence, count, armed))
        yield pd.DataFrame({part: [key[0]], "evidence": [evidence], "runs": [count], "armed": [armed]})

    kind = runs.schema[part].dataType.simpleString()
    return runs.groupBy(part).applyInPandasWithState(step, f"{part} {kind}, evidence long, runs long, armed boolean", "evidence long, runs long, armed boolean", "update", GroupStateTimeout.NoTimeout)
