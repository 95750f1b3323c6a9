"""Live sessions as Structured Streaming: windows, latest views and a cursor per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CURSOR = "session_id string, sequence long, line_no int, new_poem boolean, misses int"
STATE = "line_no int, misses int"


def windowed(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide or size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows by user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def follow(lines: list[str], threshold: float = 0.7, limit: int = 3) -> object:
    """A stateful function that follows a session through canonical lines (a bounded list).

    A text is held against the current line, the next and the one before (word overlap of
    at least threshold), else against all lines; more than limit misses in a row forget the
    place. Within a batch a session's rows are taken in order of their sequence.
    """
    sets = [set(x.split()) for x in lines]

    def near(a: set[str], i: int) -> bool:
        return 0 <= i < len(sets) and bool(a and sets[i]) and len(a & sets[i]) / len(a | sets[i]) >= threshold

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, misses = state.get if state.exists else (-1, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("sequence").itertuples():
            a = set((r.text or "").split())
            hit = next((i for i in (at, at + 1, at - 1) if at >= 0 and near(a, i)), None)
            fresh = hit is None
            if fresh:
                hit = next((i for i in range(len(sets)) if near(a, i)), None)
            if hit is None:
                misses += 1
                if misses > limit:
                    at, misses = -1, 0
            else:
                at, misses = hit, 0
            out.append((key[0], r.sequence, at, fresh and hit is not None, misses))
        state.update((at, misses))
        yield pd.DataFrame(out, columns=["session_id", "sequence", "line_no", "new_poem", "misses"])

    return run


def cursor(chunks: DataFrame, lines: list[str]) -> DataFrame:
    """Each chunk (session_id, sequence, text) of a stream with its session's place in the lines."""
    return chunks.groupBy("session_id").applyInPandasWithState(follow(lines), CURSOR, STATE, "append", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, key: str = "segment_id") -> DataFrame:
    """The last phase of each segment: verified over draft."""
    rank = F.when(F.col("phase") == "verified", 2).otherwise(1)
    return updates.groupBy(key).agg(F.max_by(F.struct("phase", "text"), rank).alias("u")).select(key, "u.*")
