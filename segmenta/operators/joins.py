"""Joins: fuzzy by shared words, intervals by buckets, nearest neighbours, at most one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: sides of at most so many bytes (by the size Spark's own statistics give) may be broadcast
SMALL_BYTES = 32 << 20


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """df marked for broadcast if its estimated size is at most limit, else as it is, for a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def at_most_one_left(left: DataFrame, right: DataFrame, key: str, *order: Column) -> DataFrame:
    """A left join that keeps one row of right for each key."""
    return left.join(first_per(right, [key], *order), key, "left")


def word_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word) for every distinct word of every row."""
    return df.select(key, F.explode(F.array_distinct(T.words(F.col(text)))).alias("word"))


def rare_shingle_candidates(texts: DataFrame, lines: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, item_id, common) pairs that share runs of n words; an equi-join, never all pairs.

    The lines' runs are the smaller side; a run that many texts hold is pre-aggregated
    to one row a text.
    """

    def runs(df: DataFrame, key: str, text: str) -> DataFrame:
        # the words are a column of their own: inside the lambda every run would extract them again
        d = df.select(key, T.words(F.col(text)).alias("w"))
        made = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
        return d.select(key, F.explode(F.array_distinct(made)).alias("run"))

    return runs(texts, "doc_id", "text").join(small(runs(lines, "item_id", "line")), "run").groupBy("doc_id", "item_id").agg(F.count("*").alias("common"))


def passage_match(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """The best canonical line that each text quotes, its score and what follows from it.

    Score: the share of the line's distinct words that the text holds, over the candidates
    that share a run of four words; at least 0.6; ties go to the smaller item_id.
    """
    pairs = rare_shingle_candidates(texts, lines)
    t = texts.select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("tw"))
    ln = lines.select("item_id", F.array_distinct(T.words(F.col("line"))).alias("lw"))
    scored = pairs.join(small(ln), "item_id").join(t, "doc_id").withColumn("score", F.round(T.overlap(F.col("tw"), F.col("lw")) / F.size("lw"), 6)).filter("score >= 0.6")
    best = first_per(scored, ["doc_id"], F.desc("score"), F.asc("item_id"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("common").cast("long").alias("common_runs"),
        "score",
        F.when(F.col("score") >= 0.9, "replace").otherwise("keep").alias("decision"),
        (F.col("score") < 0.95).alias("needs_review"),
    )


def overlapping(p: DataFrame, g: DataFrame, key: str, bucket: float) -> DataFrame:
    """Pairs of intervals of p and g (same key) that overlap, each once.

    Both sides are dealt out to buckets of time, joined by bucket, and a pair counts in the
    first bucket that both touch only.
    """

    def dealt(df: DataFrame, s: str) -> DataFrame:
        lo, hi = F.floor(F.col(s + "_start") / bucket), F.floor(F.col(s + "_end") / bucket)
        return df.withColumn(s + "_first", lo).withColumn("bucket", F.explode(F.sequence(lo, hi)))

    a, b = dealt(p, "p"), dealt(g, "g")
    both = a.join(b, [key, "bucket"]).filter(F.col("bucket") == F.greatest("p_first", "g_first")).filter("p_start < g_end and g_start < p_end")
    return both.drop("bucket", "p_first", "g_first")


def interval_best(p: DataFrame, g: DataFrame, key: str, bucket: float) -> DataFrame:
    """For each interval of p the one of g (same key) with most overlap; ties: earlier start, smaller id."""
    both = overlapping(p, g, key, bucket).withColumn("overlap", F.least("p_end", "g_end") - F.greatest("p_start", "g_start"))
    return first_per(both, ["p_id"], F.desc("overlap"), F.asc("g_start"), F.asc("g_id"))


def edit_candidates(words: DataFrame, lexicon: DataFrame, max_distance: int = 2, top: int = 10) -> DataFrame:
    """Lexicon entries near each word: (word, entry, distance, confidence, rank).

    Entries are found by deletion neighbourhoods (an equi-join): two words at most d edits
    apart share a form with at most d letters deleted.
    """

    def forms(df: DataFrame, col: str) -> DataFrame:
        def cut(arr: Column) -> Column:
            return F.flatten(F.transform(arr, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))

        arr = F.array(F.col(col))
        out = arr
        for _ in range(max_distance):
            arr = F.array_distinct(cut(arr))
            out = F.array_union(out, arr)
        return df.withColumn("form", F.explode(out))

    pairs = forms(words, "word").join(forms(lexicon, "entry"), "form").select("word", "entry", "freq").distinct()
    d = F.levenshtein("word", "entry")
    scored = pairs.withColumn("distance", d).filter((F.col("distance") > 0) & (F.col("distance") <= max_distance))
    freq = F.when(F.col("freq") == 0, 0.1).otherwise(F.least(F.lit(1.0), F.col("freq") / 100))
    scored = scored.withColumn("confidence", F.round(0.5 * (1 - F.col("distance") / (max_distance + 1)) + 0.5 * freq, 6))
    w = Window.partitionBy("word").orderBy(F.desc("confidence"), "distance", "entry")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("word", "entry", F.col("distance").cast("int").alias("distance"), "confidence", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def nearest(queries: DataFrame, vectors: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best vectors (b, bv, bl) for each stated query (a, av, al); ties: smaller b.

    A stated query set is compared with all rows; rank filters are pushed into each task.
    """
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    pairs = vectors.join(small(queries), F.col("a") != F.col("b")).withColumn("score", F.round(score, 6))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_rows(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")
