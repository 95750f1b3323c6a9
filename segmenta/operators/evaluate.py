"""Evaluation: word and character errors, quote accuracy, validation of ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship


def word_edits(truth: list[str], said: list[str]) -> tuple[int, int, int, int]:
    """(substitutions, insertions, deletions, hits) of the alignment with fewest edits, and among those most hits.

    One row of the table at a time: edits weigh 2 ** 20, hits -1; the step along a row is a running minimum.
    """
    n, m = len(truth), len(said)
    code: dict[str, int] = {}
    a = [code.setdefault(x, len(code)) for x in truth]
    b = np.array([code.setdefault(x, len(code)) for x in said], np.int64)
    edit = np.int64(1 << 20)
    along = edit * np.arange(m + 1, dtype=np.int64)
    row = along.copy()
    for x in a:
        best = row + edit
        best[1:] = np.minimum(best[1:], row[:-1] + np.where(b == x, -1, edit))
        row = np.minimum.accumulate(best - along) + along
    edits = -(-int(row[-1]) // int(edit))
    hits = edits * int(edit) - int(row[-1])
    subs = n + m - 2 * hits - edits
    return subs, m - hits - subs, n - hits - subs, hits


def edits_column(truth: Column, said: Column) -> Column:
    """(substitutions, insertions, deletions, hits) of two arrays of words."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [word_edits([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["substitutions", "insertions", "deletions", "hits"])

    ship(SparkSession.active())
    return F.pandas_udf(run, "substitutions long, insertions long, deletions long, hits long")(truth, said)


def segment_errors(pairs: DataFrame, truth: str = "truth", said: str = "said", pattern: str = T.WORD) -> DataFrame:
    """pairs with word edits, n_words, wer, and the character error rate cer (code points); empty truth: 0 if said is empty, else 1."""
    d = pairs.withColumns({"_a": T.words(F.col(truth), pattern), "_b": T.words(F.col(said), pattern)}).withColumn("_e", edits_column(F.col("_a"), F.col("_b")))
    d = d.select(*pairs.columns, "_e.*", F.size("_a").cast("long").alias("n_words"))
    a, b = F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(said), F.lit(""))
    d = d.withColumns({"char_edits": F.levenshtein(a, b).cast("long"), "n_chars": F.length(a).cast("long")})
    edits = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    rate = lambda e, n: F.when(n > 0, e / n).when(e > 0, 1.0).otherwise(0.0)
    return d.withColumns({"wer": rate(edits, F.col("n_words")), "cer": rate(F.col("char_edits"), F.col("n_chars"))})


def totals(errors: DataFrame, *by: str) -> DataFrame:
    """Summed edits over summed lengths (overall_wer, overall_cer), mean rates and counts, by the given columns."""
    edits = F.sum(F.col("substitutions") + F.col("insertions") + F.col("deletions"))
    return errors.groupBy(*by).agg(
        F.count("*").alias("segments"),
        *(F.sum(c).alias(c) for c in ("substitutions", "insertions", "deletions", "hits", "n_words")),
        T.ratio(edits, F.sum("n_words")).alias("overall_wer"),
        T.ratio(F.sum("char_edits"), F.sum("n_chars")).alias("overall_cer"),
        F.avg("wer").alias("mean_wer"),
        F.avg("cer").alias("mean_cer"),
    )


def macro(errors: DataFrame, file: str = "file") -> DataFrame:
    """The mean over files of each file's own totals."""
    per_file = totals(errors, file)
    return per_file.agg(F.count("*").alias("files"), F.avg("overall_wer").alias("wer"), F.avg("overall_cer").alias("cer"))


def precision_recall(matches: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of rows with an outcome, 0 where a denominator is 0."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    d = matches.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    p, r = T.ratio(F.col("tp"), F.col("tp") + F.col("fp")), T.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return d.withColumns({"precision": p, "recall": r, "f1": T.ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def outcomes(pred: DataFrame, truth: DataFrame, matched: DataFrame) -> DataFrame:
    """A row for each match (tp), prediction without one (fp) and truth without one (fn), with the source it counts for.

    pred (p_id, source, line_id), truth (g_id, expected_source, expected_line), matched (p_id, g_id). A missed truth counts for its expected source.
    """
    both = pred.join(matched, "p_id", "left").join(truth, "g_id", "left")
    hit = both.select(F.when(F.col("g_id").isNull(), "fp").otherwise("tp").alias("outcome"), F.coalesce("source", F.lit("Unknown")).alias("source"), (F.col("line_id") == F.col("expected_line")).alias("right_line"))
    lost = truth.join(matched, "g_id", "left_anti").select(F.lit("fn").alias("outcome"), F.coalesce("expected_source", F.lit("Unknown")).alias("source"), F.lit(None).cast("boolean").alias("right_line"))
    return hit.unionByName(lost)


def replacement_accuracy(matches: DataFrame, *by: str) -> DataFrame:
    """The share of matched quotes whose line is the expected one; 0 without matches."""
    return matches.filter("outcome = 'tp'").groupBy(*by).agg(F.count("*").alias("matched"), F.coalesce(F.avg(F.col("right_line").cast("int")), F.lit(0.0)).alias("accuracy"))


def truth_problems(segments: DataFrame, key: str, start: str, end: str, text: str) -> DataFrame:
    """segments with an array of what is wrong with each: order, range, overlap with the one before, missing text."""
    w = Window.partitionBy(key).orderBy(start, end)
    rule = lambda c, t: F.when(c, F.lit(t))
    before: Column = F.lag(end).over(w)
    found = F.array(
        rule(F.col(start) < 0, "negative start"),
        rule(F.col(end) <= F.col(start), "end not after start"),
        rule(F.col(start) < before, "overlaps the segment before"),
        rule(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0, "no text"),
    )
    return segments.withColumn("problems", F.array_compact(found))


def quote_problems(quotes: DataFrame) -> DataFrame:
    """quotes (segment_start, segment_end, quote_start, quote_end, canonical_line_id), times relative to the segment, with their problems."""
    rule = lambda c, t: F.when(c, F.lit(t))
    long = F.col("segment_end") - F.col("segment_start")
    found = F.array(rule(F.col("quote_end") <= F.col("quote_start"), "end not after start"), rule((F.col("quote_start") < 0) | (F.col("quote_end") > long), "outside of the segment"), rule(F.coalesce(F.col("canonical_line_id"), F.lit("")) == "", "no line"))
    return quotes.withColumn("problems", F.array_compact(found))
