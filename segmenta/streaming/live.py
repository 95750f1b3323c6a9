"""Live sessions: chunks, drafts and verified texts, a cursor with control events, counters and progress.

State is keyed by session, so sessions never share a place; it ends after a time without
events. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: fixed values: seconds of a chunk without an end, by mode
CHUNK_SECONDS = {"live": 1.0, "verse": 2.0}
EVENTS = "session_id string, sequence long, kind string, text string, value string"


def chunks(raw: DataFrame, mode: str = "live") -> DataFrame:
    """Chunk events (session_id, sequence, session_start, start_time, end_time, text) with an end, an event time and a segment id."""
    end = F.coalesce("end_time", F.col("start_time") + CHUNK_SECONDS[mode])
    d = raw.withColumn("end_time", end).withColumn("ts", F.timestamp_micros((F.unix_micros("session_start") + F.col("start_time") * 1_000_000).cast("long")))
    return d.withColumn("segment_id", F.format_string("seg_%.2f_%.2f", "start_time", "end_time"))


def two_phases(segments: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An append stream of each segment's draft and its verified text."""
    return segments.withColumn("phase", F.lit("draft")).unionByName(verify(segments).withColumn("phase", F.lit("verified")), allowMissingColumns=True)


def latest_view(updates: DataFrame) -> DataFrame:
    """Of each session's segments the verified row if there is one, else the draft."""
    rank = F.struct(F.when(F.col("phase") == "verified", 2).otherwise(1), F.col("sequence"))
    return updates.groupBy("session_id", "segment_id").agg(F.max_by(F.struct("phase", "text", "start_time"), rank).alias("u")).select("session_id", "segment_id", "u.*")


def counters(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Chunks, drafts, verified and detected by session; a session ends after gap without events."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id").agg(n("chunk").alias("chunks"), n("draft").alias("drafts"), n("verified").alias("verified"), n("detected").alias("detected"))


class Lines:
    """Canonical lines with an index from words to lines, so that a text meets only lines it shares a word with."""

    def __init__(self, lines: Sequence[tuple[str, str]]):
        """lines: (poem, text), in order."""
        self.poems, self.sets = [p for p, _ in lines], [frozenset(t.split()) for _, t in lines]
        self.index: dict[str, list[int]] = {}
        for i, words in enumerate(self.sets):
            for w in words:
                self.index.setdefault(w, []).append(i)

    def score(self, words: frozenset[str], i: int) -> float:
        if not (0 <= i < len(self.sets)) or not words or not self.sets[i]:
            return 0.0
        return len(words & self.sets[i]) / len(words | self.sets[i])

    def find(self, words: frozenset[str], least: float) -> int | None:
        """The first line in order that is near enough."""
        seen = {i for w in words for i in self.index.get(w, ())}
        return next((i for i in sorted(seen) if self.score(words, i) >= least), None)


FOLLOWED = "session_id string, sequence long, line_no int, new_poem boolean, misses int, next_line int, language string"


def follow(lines: Lines, least: float = 0.7, limit: int = 3, idle: str = "30 minutes") -> object:
    """The state function of followed: the current line, the next, the one before, else any line; too many misses forget the place.

    Events of kind reset forget the place at once, those of kind preference set the
    session's language, all others are texts. Within a batch a session's events are taken
    in order of sequence. Without events for idle the state ends.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, misses, language = state.get if state.exists else (-1, 0, "")
        out = []
        for r in pd.concat(list(batches)).sort_values("sequence").itertuples():
            if r.kind == "reset":
                at, misses = -1, 0
                continue
            if r.kind == "preference":
                language = r.value or ""
                continue
            words = frozenset((r.text or "").split())
            hit = next((i for i in (at, at + 1, at - 1) if at >= 0 and lines.score(words, i) >= least), None)
            elsewhere = hit is None
            if elsewhere:
                hit = lines.find(words, least)
            new = False
            if hit is None:
                misses += 1
                if misses > limit:
                    at, misses = -1, 0
            else:
                new = elsewhere and (at < 0 or lines.poems[hit] != lines.poems[at])
                at, misses = hit, 0
            nxt = at + 1 if 0 <= at < len(lines.sets) - 1 and lines.poems[at + 1] == lines.poems[at] else None
            out.append((key[0], r.sequence, at, new, misses, nxt, language))
        state.update((at, misses, language))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["session_id", "sequence", "line_no", "new_poem", "misses", "next_line", "language"]).astype({"next_line": "Int32"})

    return run


def followed(events: DataFrame, lines: Sequence[tuple[str, str]], **how) -> DataFrame:
    """Each text of a stream of events (EVENTS) with its session's place in the lines (poem, text), a bounded table."""
    return events.groupBy("session_id").applyInPandasWithState(follow(Lines(lines), **how), FOLLOWED, "line_no int, misses int, language string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def with_suggestions(matched: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Matched lines with the suggestions computed beforehand (line_no, suggestions): a join of a stream with a table."""
    return matched.join(neighbours, "line_no", "left")


def progress(events: DataFrame, idle: str = "30 seconds") -> DataFrame:
    """The last snapshot (task_id, percent, elapsed) of each running task with the seconds left; finished tasks go after idle."""
    from ..operators.segments import remaining_time

    w = events.withWatermark("ts", idle).groupBy(F.session_window("ts", idle), "task_id").agg(F.max_by(F.struct("percent", "elapsed"), "ts").alias("s"), F.max("ts").alias("ts"))
    return w.select("task_id", "ts", F.col("s.percent").alias("percent"), remaining_time(F.col("s.elapsed"), F.col("s.percent")).alias("left"), (F.col("s.percent") >= 100).alias("finished"))
