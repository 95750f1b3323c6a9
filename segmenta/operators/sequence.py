"""Sequence operators: islands, gaps, folds, captions, ordered joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Rows numbered by island: a new one starts where more than gap passes since the row before."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("island", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def split_long(df: DataFrame, start: str, end: str, longest: float) -> DataFrame:
    """Spans over longest cut into the fewest equal parts."""
    n = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) / longest)).cast("int")
    size = (F.col(end) - F.col(start)) / n
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("part_start", F.col(start) + F.col("part") * size).withColumn("part_end", F.col(start) + (F.col("part") + 1) * size)


def gaps(df: DataFrame, key: str, start: str, end: str, longest: float = 1.0) -> DataFrame:
    """A gap row wherever more than longest passes between a row's end and the next one's start."""
    w = Window.partitionBy(key).orderBy(start)
    nxt = df.withColumn("_next", F.lead(start).over(w)).filter(F.col("_next") - F.col(end) > longest)
    return nxt.select(key, F.col(end).alias(start), F.col("_next").alias(end), F.lit("gap").alias("type"))


def runs_of_overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows numbered by run: a new one starts where a row begins at or after all ends before it, so runs never touch."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_fresh", F.coalesce((F.col(start) >= before).cast("int"), F.lit(1))).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def repair_overlaps(df: DataFrame, key: str) -> DataFrame:
    """Ordered (key, start, end, confidence) with overlaps cut: the less confident row yields.

    Each repair sees the rows repaired before it, so it is a fold, in the JVM, over the
    rows of one run of overlaps; rows of different runs never touch.
    """
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "confidence")))
    kind = "array<struct<start:double,end:double,confidence:double>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        head = F.slice(acc, 1, F.size(acc) - 1)
        make = lambda s, e, c: F.array(F.struct(s.alias("start"), e.alias("end"), c.alias("confidence")))
        cut_last = F.when(x.start > last.start, F.concat(head, make(last.start, x.start, last.confidence), F.array(x))).otherwise(F.concat(head, F.array(x)))
        cut_self = F.when(x.end > last.end, F.concat(acc, make(last.end, x.end, x.confidence))).otherwise(acc)
        return F.when((F.size(acc) == 0) | (x.start >= F.try_element_at(acc, F.lit(-1)).end), F.concat(acc, F.array(x))).when(x.confidence > F.try_element_at(acc, F.lit(-1)).confidence, cut_last).otherwise(cut_self)

    folded = runs_of_overlaps(df, [key], "start", "end").groupBy(key, "run").agg(F.aggregate(rows, F.array().cast(kind), step).alias("r"))
    one = folded.select(key, "run", F.posexplode("r").alias("at", "s")).select(key, "run", "at", "s.*")
    return one.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("run", "at")) - 1).select(key, "pos", "start", "end", "confidence")


def match_one_to_one(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidate pairs (keys, p_id, p_pos, g_id, iou) a greedy one-to-one matching, predictions in order.

    A prediction's choice depends on those before it, so the candidates of one group of
    keys go through one Arrow group; the caller groups by runs of overlaps, which are
    independent. Ties: greater iou, smaller g_id.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for _, group in rows.sort_values(["p_pos", "p_id", "iou", "g_id"], ascending=[True, True, False, True]).groupby(["p_pos", "p_id"], sort=True):
            free = [r for r in group.itertuples() if r.g_id not in taken]
            if free:
                taken.add(free[0].g_id)
                out.append((*(getattr(free[0], k) for k in keys), free[0].p_id, free[0].g_id, free[0].iou))
        return pd.DataFrame(out, columns=[*keys, "p_id", "g_id", "iou"])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(run, f"{kinds}, p_id long, g_id long, iou double")


def scan_match(p: DataFrame, g: DataFrame, key: str) -> DataFrame:
    """Predictions (key, p_id, p_start, p_end) with the truth (key, g_id, g_start, g_end) of most overlap, scanning forward.

    Both sides in order of start; the scan for a prediction begins at the truth matched
    last, the first of equal overlaps wins, no overlap gives null. One file is one group.
    """

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        truth = b.sort_values(["g_start", "g_id"])[["g_id", "g_start", "g_end"]].to_numpy().tolist()
        at, out = 0, []
        for r in a.sort_values(["p_start", "p_id"]).itertuples():
            best, where = 0.0, None
            for i in range(at, len(truth)):
                if truth[i][1] >= r.p_end:
                    break
                shared = min(r.p_end, truth[i][2]) - max(r.p_start, truth[i][1])
                if shared > best:
                    best, where = shared, i
            if where is not None:
                at = where
            out.append((k[0], r.p_id, None if where is None else int(truth[where][0]), best))
        return pd.DataFrame(out, columns=[key, "p_id", "g_id", "overlap"]).astype({"g_id": "Int64"})

    kind = p.schema[key].dataType.simpleString()
    return p.groupBy(key).cogroup(g.groupBy(key)).applyInPandas(run, f"{key} {kind}, p_id long, g_id long, overlap double")


def ordered_join(df: DataFrame, key: str, at: str, text: Column, sep: str = " ") -> DataFrame:
    """A key's texts joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), text.alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r.t), sep).alias("joined"), F.count("*").alias("n"))


def context_window(df: DataFrame, key: str, at: str, text: str, reach: int = 2) -> DataFrame:
    """Each row with the texts of the rows at most reach places before and after it."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-reach, reach)
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("t"))).over(w))
    return df.withColumn("context", F.array_join(F.transform(rows, lambda r: r.t), " | ")).withColumn("n_context", F.size(rows).cast("long"))
