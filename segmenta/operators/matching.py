"""Matching spoken segments with canonical lines: candidates, re-ranking, verification, alignment, translations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .joins import first_per, first_rows, small


def tokens(df: DataFrame, key: str, text: str, pattern: str = T.WORD) -> DataFrame:
    """(key, text, w) with the words as a column of their own."""
    return df.select(key, F.col(text).alias("text"), T.words(F.col(text), pattern).alias("w"))


def shared_run_pairs(a: DataFrame, b: DataFrame, ka: str, kb: str, n: int) -> DataFrame:
    """(ka, kb) pairs of rows with words w that share a run of n words; an equi-join on runs, each once a row."""

    def runs(df: DataFrame, key: str) -> DataFrame:
        made = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
        return df.select(key, F.explode(F.array_distinct(made)).alias("run"))

    return runs(a, ka).join(small(runs(b, kb)), "run").select(ka, kb).distinct()


def contained(segments: DataFrame, lines: DataFrame, seg: str, line: str, seg_id: str, line_id: str, n: int = 3, pattern: str = T.WORD) -> DataFrame:
    """(seg_id, line_id) where the line holds the segment's words as one run.

    Segments of n words or more meet lines by a shared run; shorter ones by their rarest
    word in the lines. Then the whole run is looked for.
    """
    a, b = tokens(segments, seg_id, seg, pattern).filter(F.size("w") > 0), tokens(lines, line_id, line, pattern)
    long = shared_run_pairs(a.filter(F.size("w") >= n), b, seg_id, line_id, n)
    words = b.select(line_id, F.explode(F.array_distinct("w")).alias("word"))
    rare = words.groupBy("word").agg(F.count("*").alias("many"))
    first = a.filter(F.size("w") < n).select(seg_id, F.size("w").alias("n_w"), F.explode(F.array_distinct("w")).alias("word")).join(rare, "word")
    first = first.groupBy(seg_id).agg(F.min_by("word", F.struct("many", "word")).alias("word"))
    short = first.join(words, "word").select(seg_id, line_id)
    both = long.union(short).distinct().join(a.withColumnRenamed("w", "sw").drop("text"), seg_id).join(b.withColumnRenamed("w", "lw").drop("text"), line_id)
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return both.filter(F.contains(padded("lw"), padded("sw"))).select(seg_id, line_id)


def sorted_ratio(a: Column, b: Column) -> Column:
    """Similarity of two arrays of words in order of the alphabet: 1 less the share of edits."""
    join = lambda w: F.array_join(F.array_sort(w), " ")
    return T.similarity(join(a), join(b))


def fuzzy_candidates(segments: DataFrame, lines: DataFrame, seg_id: str, line_id: str, run: int = 2, cutoff: float = 0.5, top: int = 20) -> DataFrame:
    """Stage A over (id, text, w) rows: the best lines by sorted-word similarity, each once, with their words."""
    pairs = shared_run_pairs(segments, lines, seg_id, line_id, run)
    both = pairs.join(segments.select(seg_id, F.col("w").alias("sw")), seg_id).join(lines.select(line_id, F.col("w").alias("lw")), line_id)
    scored = both.withColumn("fuzzy", F.round(sorted_ratio(F.col("sw"), F.col("lw")), 6)).filter(F.col("fuzzy") >= cutoff)
    return first_rows(scored, [seg_id], top, F.desc("fuzzy"), F.asc(line_id))


def reranked(candidates: DataFrame, keywords: Sequence[str], vector: Column | None = None, keep: float = 0.6) -> DataFrame:
    """Stage B: fuzzy, shared words over the longer text's, and whether both hold the same keywords; with a vector score other weights."""
    keys = F.array(*map(F.lit, keywords)) if keywords else F.array().cast("array<string>")
    sw, lw = F.array_distinct("sw"), F.array_distinct("lw")
    shared = T.ratio(F.size(F.array_intersect(sw, lw)).cast("double"), F.greatest(F.size(sw), F.size(lw)))
    mine, theirs = F.array_sort(F.array_intersect(sw, keys)), F.array_sort(F.array_intersect(lw, keys))
    keyed = F.when(mine == theirs, 1.0).otherwise(0.5)
    score = 0.5 * F.col("fuzzy") + 0.3 * shared + 0.2 * keyed if vector is None else 0.4 * F.col("fuzzy") + 0.2 * shared + 0.4 * vector
    return candidates.withColumns({"overlap": F.round(shared, 6), "keyword": keyed}).withColumn("score", F.round(score, 6)).filter(F.col("score") >= keep)


def verified_best(ranked: DataFrame, seg_id: str, line_id: str, important: Sequence[str], floor: float = 0.7, semantic_at: float = 0.85) -> DataFrame:
    """Stage C on the best line of each segment: penalties for a word count that differs and for missing important words; alternates kept."""
    w = Window.partitionBy(seg_id).orderBy(F.desc("score"), F.asc(line_id))
    top = ranked.withColumn("_rn", F.row_number().over(w))
    others = top.filter("_rn between 2 and 4").groupBy(seg_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", line_id))), lambda r: r[line_id]).alias("alternates"))
    keys = F.array(*map(F.lit, important)) if important else F.array().cast("array<string>")
    ratio = F.least(F.size("sw"), F.size("lw")) / F.greatest(F.size("sw"), F.size("lw"))
    lost = F.size(F.array_except(F.array_intersect(F.array_distinct("lw"), keys), F.col("sw"))) > 0
    score = F.col("score") * F.when(ratio < 0.8, 0.8).otherwise(1.0) * F.when(lost, 0.9).otherwise(1.0)
    best = top.filter("_rn = 1").withColumn("confidence", F.round(score, 6)).filter(F.col("confidence") >= floor)
    best = best.select(seg_id, line_id, "fuzzy", "overlap", "keyword", "score", "confidence", F.when(F.col("confidence") < semantic_at, "fuzzy").otherwise("semantic").alias("method"))
    return best.join(others, seg_id, "left").withColumn("alternates", F.coalesce("alternates", F.array().cast(f"array<{ranked.schema[line_id].dataType.simpleString()}>")))


def assisted_match(segments: DataFrame, lines: DataFrame, seg: str, line: str, seg_id: str, line_id: str, keywords: Sequence[str] = (), pattern: str = T.WORD, run: int = 2) -> DataFrame:
    """All three stages: the line each segment quotes, with its scores, method and alternates."""
    a = fuzzy_candidates(tokens(segments, seg_id, seg, pattern), tokens(lines, line_id, line, pattern), seg_id, line_id, run)
    return verified_best(reranked(a, keywords), seg_id, line_id, keywords)


def primary_of(candidates: DataFrame, seg_id: str) -> DataFrame:
    """The hypothesis with most confidence for each segment and the texts of the others, best first."""
    w = Window.partitionBy(seg_id).orderBy(F.desc("confidence"), F.asc("text"))
    d = candidates.withColumn("_rn", F.row_number().over(w))
    rest = F.array_sort(F.collect_list(F.when(F.col("_rn") > 1, F.struct("_rn", "text"))))
    return d.groupBy(seg_id).agg(F.min_by("text", "_rn").alias("primary"), F.transform(rest, lambda r: r["text"]).alias("alternates"))


def repaired(text: Column, patterns: Sequence[tuple[str, str]] = ()) -> Column:
    """Known recognition errors replaced in turn, white space squeezed."""
    for pattern, to in patterns:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def constrained_align(pairs: DataFrame, seg_id: str, line_id: str, text: str, line: str, hint: str | None = None, page: str | None = None, least: float = 0.5, sure: float = 0.85, pattern: str = T.WORD, edit_weight: float = 0.6) -> DataFrame:
    """The best line of each segment among candidate pairs: edits and shared words; ties go to the hinted page, then the longer line.

    Below least there is no row; confident from sure on.
    """
    d = pairs.withColumns({"_a": F.array_distinct(T.words(F.col(text), pattern)), "_b": F.array_distinct(T.words(F.col(line), pattern))})
    score = edit_weight * T.similarity(F.col(text), F.col(line)) + (1 - edit_weight) * T.jaccard(F.col("_a"), F.col("_b"))
    off = (F.coalesce(F.col(page) != F.col(hint), F.lit(True))).cast("int") if hint and page else F.lit(0)
    d = d.withColumns({"score": F.round(score, 6), "_off": off}).filter(F.col("score") >= least)
    best = first_per(d, [seg_id], F.desc("score"), F.asc("_off"), F.desc(F.length(line)), F.asc(line_id))
    return best.select(seg_id, line_id, "score", (F.col("score") >= sure).alias("confident"))


def aligned(segments: DataFrame, lines: DataFrame, seg: str, line: str, seg_id: str, line_id: str, patterns: Sequence[tuple[str, str]] = (), run: int = 2, force_at: float = 0.85, **how) -> DataFrame:
    """Segments repaired, then aligned with the lines that share a run of words; action: force, suggest or none."""
    s = segments.withColumn(seg, repaired(F.col(seg), patterns))
    pattern = how.get("pattern", T.WORD)
    pairs = shared_run_pairs(tokens(s, seg_id, seg, pattern), tokens(lines, line_id, line, pattern), seg_id, line_id, run)
    sides = pairs.join(s, seg_id).join(lines, line_id)
    best = constrained_align(sides, seg_id, line_id, seg, line, **how)
    return s.select(seg_id).join(best, seg_id, "left").withColumn("action", F.when(F.col("score") >= force_at, "force").when(F.col("score").isNotNull(), "suggest").otherwise("none"))


def similar(queries: DataFrame, vectors: DataFrame, score: Column | None, k: int, excluded: Column, shared_keywords: Column, over: int = 3, boost: float = 0.05) -> DataFrame:
    """The k nearest of the over * k nearest that are not excluded; the score shown is raised for shared keywords, the rank is not. Without a score: by cosine."""
    from .joins import nearest
    from .vectors import cosine_nearest

    near = (cosine_nearest(queries, vectors, over * k) if score is None else nearest(queries, vectors, score, over * k)).filter(~excluded)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("rank"))).filter(F.col("place") <= k)
    return near.withColumn("shown", F.round(F.least(F.lit(1.0), F.col("score") + boost * shared_keywords), 6))


def translated(lines: DataFrame, cache: DataFrame, key: str, language: str, provider=None) -> DataFrame:
    """(key, translation, origin): from the cache (key, language, translation) if it is there, else from the provider, else missing.

    provider is a function over iterators of pandas frames (key, text) that adds translation; it sees the misses only.
    """
    got = cache.filter(F.col("language") == language).groupBy(key).agg(F.min("translation").alias("translation"))
    both = lines.join(got, key, "left")
    hit = both.filter("translation is not null").select(key, "translation", F.lit("cached").alias("origin"))
    miss = both.filter("translation is null").select(key, "text")
    if provider is None:
        return hit.unionByName(miss.select(key, F.lit(None).cast("string").alias("translation"), F.lit("missing").alias("origin")))
    kind = lines.schema[key].dataType.simpleString()
    made = miss.mapInPandas(provider, f"{key} {kind}, translation string").withColumn("origin", F.when(F.col("translation").isNull(), "missing").otherwise("translated"))
    return hit.unionByName(made)


def context_lines(lines: DataFrame, poem: str, order: str, text: str, line_id: str, window: int = 2, most: int = 4) -> DataFrame:
    """Each line with those around it in its poem, itself left out, the first few; start is its place in the poem."""
    w = Window.partitionBy(poem).orderBy(order)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(line_id).alias("id"), F.col(text).alias("t"))).over(w.rangeBetween(-window, window)))
    others = F.slice(F.filter(rows, lambda r: r["id"] != F.col(line_id)), 1, most)
    return lines.select(poem, line_id, (F.row_number().over(w) - 1).alias("start"), F.transform(others, lambda r: r["t"]).alias("context"))
