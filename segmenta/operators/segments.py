"""Segments of a recording: routes, review, gates, context, sections, chunks, tokens, fusion, accounts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Further engines by route, and severities in order.
ENGINES = {"punjabi_speech": ("indic",), "english_speech": ("english",), "scripture_quote_likely": ("indic",), "mixed": ("indic", "english")}
FAILED, SILENT = "[Transcription error]", "[No speech detected]"


def flattened(segments: DataFrame, quote: str = "quote_match") -> DataFrame:
    """Segments with the fields of their quote beside them, under names that do not clash."""
    fields = [f.name for f in segments.schema[quote].dataType.fields]
    return segments.select(*[c for c in segments.columns if c != quote], *(F.col(f"{quote}.{f}").alias(f if f not in segments.columns else f"{quote}_{f}") for f in fields))


def needs_review(confidence: Column, agreement: Column, converted: Column, quoted: Column) -> Column:
    return (confidence < 0.7) | (agreement < 0.5) | F.coalesce(converted, F.lit(False)) | F.coalesce(quoted, F.lit(False))


def engines(route: Column, table: Mapping[str, Sequence[str]] = ENGINES) -> Column:
    """The further engines of a route; none for an unknown one."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), route), F.array().cast("array<string>"))


def looks_like_scripture(text: Column, block: str = r"\x{0A00}-\x{0A7F}", markers: Sequence[str] = ("॥", "।", "ੴ"), least: float = 0.5) -> Column:
    """Over half of the letters and digits in the block, or any of the markers."""
    x = F.coalesce(text, F.lit(""))
    letters = F.regexp_count(x, F.lit(r"[\p{L}\p{M}\p{N}]"))
    share = F.when(letters > 0, F.regexp_count(x, F.lit(f"[{block}]")) / letters).otherwise(0.0)
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(x, F.lit(m))
    return (share > least) | marked


def placeholder(text: Column, error: Column) -> Column:
    """What stands in for a failed or an empty text."""
    return F.when(error.isNotNull(), FAILED).when(F.trim(F.coalesce(text, F.lit(""))) == "", SILENT).otherwise(text)


def gates(route: Column, likely: Column, context: Column, confidence: Column) -> dict[str, Column]:
    """Whether quotes are looked for in a segment, and whether it is aligned."""
    return {"detect": (route == "scripture_quote_likely") | (likely & (context >= 0.4)), "align": confidence >= 0.5}


def context_signals(text: Column, intro: Sequence[str], inside: Sequence[str], density: Column, dense_at: float = 0.25) -> dict[str, Column]:
    """Confidence that a quote stands here: .3 for each introduction, .4 for each pattern inside, a share of a high density."""
    hit = lambda patterns: sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in patterns), F.lit(0))
    n_intro, n_inside = hit(intro), hit(inside)
    score = F.least(F.lit(1.0), 0.3 * n_intro + 0.4 * n_inside + F.when(density >= dense_at, 0.3 * density).otherwise(0.0))
    return {"confidence": F.round(score, 6), "likely": score >= 0.3 - 1e-9, "kind": F.when(n_intro > 0, "intro").when(n_inside > 0, "internal").when(density >= dense_at, "dense").otherwise("none")}


def continued_context(rows: DataFrame, key: str, order: str, dense_at: float = 0.15) -> DataFrame:
    """Contexts (confidence, kind, density) carried on: after an introduction +.3 and a start, after a start or middle a dense row +.2 and a middle.

    A row's kind depends on the kind given to the row before, so it is a fold over a key's
    rows in the JVM. A kind is forgotten where a row is neither, so rows are cut into runs
    that begin where nothing can be carried on: the row before is no introduction and this one is not dense.
    """
    w = Window.partitionBy(key).orderBy(order)
    cut = F.coalesce((F.lag("kind").over(w) != "intro") & (F.col("density") < dense_at), F.lit(True))
    d = rows.withColumn("_run", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct(F.col(order).alias("at"), "confidence", "kind", "density")

    def step(acc: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(acc, F.lit(-1))["kind"], F.lit("none"))
        start, middle = before == "intro", before.isin("quote_start", "quote_middle") & (x["density"] >= dense_at)
        raised = F.least(F.lit(1.0), x["confidence"] + F.when(start, 0.3).when(middle, 0.2).otherwise(0.0))
        made = F.struct(x["at"].alias("at"), F.round(raised, 6).alias("confidence"), F.when(start, "quote_start").when(middle, "quote_middle").otherwise(x["kind"]).alias("kind"))
        return F.concat(acc, F.array(made))

    kind = f"array<struct<at:{rows.schema[order].dataType.simpleString()},confidence:double,kind:string>>"
    folded = d.groupBy(key, "_run").agg(F.aggregate(F.array_sort(F.collect_list(one)), F.array().cast(kind), step).alias("r"))
    return folded.select(key, F.inline("r")).withColumnRenamed("at", order)


def sections(rows: DataFrame, key: str, topics: Sequence[str], greeting: str, early: float = 120.0, topic_until: float = 300.0) -> DataFrame:
    """Segments (start, text, has_quote) with a label and its confidence: opening, quote, greeting, topic or talk."""
    w = Window.partitionBy(key).orderBy("start")
    greet = F.lower("text").rlike(greeting)
    n_words = F.size(T.words(F.col("text"), T.WORD))
    hits = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in topics), F.lit(0))
    d = rows.withColumns({"_greet": F.coalesce(greet, F.lit(False)), "_pos": F.row_number().over(w)})
    d = d.withColumn("_seen", F.coalesce(F.max("_greet").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    score = F.when(hits > 0, 0.3).otherwise(0.0) + F.when(F.col("_seen"), 0.2).otherwise(0.0) + F.when(n_words >= 5, 0.2).otherwise(0.0) + F.when(F.col("_pos") <= 10, 0.2).otherwise(0.0)
    topic = (F.col("start") < topic_until) & (score > 0.6)
    opening = F.col("has_quote") & ~F.col("_seen") & (F.col("start") < early)
    label = F.when(opening, "opening_gurbani").when(F.col("has_quote"), "quote").when(F.col("_greet"), "fateh").when(topic, "topic").otherwise("katha")
    sure = F.when(F.col("has_quote"), 0.95).when(F.col("_greet"), 0.9).when(topic, score).otherwise(0.8)
    return d.select(*rows.columns, label.alias("section_type"), F.round(sure, 6).alias("confidence"))


def picked(labelled: DataFrame, key: str) -> DataFrame:
    """For each key its openings in order, the first greeting, and the first topic that is surer than .6."""
    first = lambda c: F.min_by("text", F.when(c, F.col("start")))
    openings = F.array_sort(F.collect_list(F.when(F.col("section_type") == "opening_gurbani", F.struct("start", "text"))))
    return labelled.groupBy(key).agg(
        F.transform(openings, lambda r: r["text"]).alias("openings"),
        first(F.col("section_type") == "fateh").alias("fateh"),
        first((F.col("section_type") == "topic") & (F.col("confidence") > 0.6)).alias("topic"),
    )


def with_gaps(rows: DataFrame, key: str, start: str, end: str, longest: float = 1.0) -> DataFrame:
    """Rows and, wherever more than longest passes before the next one, a row of type gap."""
    w = Window.partitionBy(key).orderBy(start)
    nxt = rows.withColumn("_next", F.lead(start).over(w)).filter(F.col("_next") - F.col(end) > longest)
    return rows.withColumn("type", F.lit("speech")).unionByName(nxt.select(key, F.col(end).alias(start), F.col("_next").alias(end), F.lit("gap").alias("type")), allowMissingColumns=True)


def voiced_chunks(frames: DataFrame, key: str, at: str, voiced: str, frame: float, shortest: float = 1.0, longest: float = 30.0) -> DataFrame:
    """Runs of voiced frames as spans: short ones dropped, long ones cut into the fewest equal parts."""
    w = Window.partitionBy(key).orderBy(at)
    fresh = F.coalesce((F.col(voiced) != F.lag(voiced).over(w)).cast("int"), F.lit(1))
    d = frames.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(voiced))
    runs = d.groupBy(key, "_run").agg(F.min(at).alias("start"), (F.max(at) + frame).alias("end")).filter(F.col("end") - F.col("start") >= shortest)
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest)).cast("int")
    size = (F.col("end") - F.col("start")) / n
    parts = runs.withColumn("_p", F.explode(F.sequence(F.lit(0), n - 1)))
    return parts.select(key, (F.col("start") + F.col("_p") * size).alias("start"), (F.col("start") + (F.col("_p") + 1) * size).alias("end"))


def padded(chunks: DataFrame, key: str, overlap: float = 0.5, shortest: float = 1.0) -> DataFrame:
    """Spans widened by overlap: to the left but for the first, to the right but for the last and never past the next start."""
    w = Window.partitionBy(key).orderBy("start", "end")
    first, nxt = F.lag("start").over(w).isNull(), F.lead("start").over(w)
    start = F.when(first, F.col("start")).otherwise(F.greatest(F.lit(0.0), F.col("start") - overlap))
    end = F.when(nxt.isNull(), F.col("end")).otherwise(F.least(F.col("end") + overlap, nxt))
    return chunks.select(key, start.alias("start"), end.alias("end")).filter(F.col("end") - F.col("start") >= shortest)


def token_words(frames: DataFrame, key: str, frame_no: str, token: str, p: str, seconds: float, blank: str = "|", pad: str = "<pad>") -> DataFrame:
    """Runs of tokens between blanks as words: equal neighbours and pads count once, with times and the mean probability."""
    w = Window.partitionBy(key).orderBy(frame_no)
    d = frames.withColumns({"_word": F.sum((F.col(token) == blank).cast("int")).over(w), "_new": F.coalesce(F.col(token) != F.lag(token).over(w), F.lit(True))})
    d = d.filter((F.col(token) != blank) & (F.col(token) != pad))
    spelled = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(frame_no, token, "_new"))), lambda r: r["_new"]), lambda r: r[token]), "")
    return d.groupBy(key, "_word").agg(spelled.alias("word"), (F.min(frame_no) * seconds).alias("start"), ((F.max(frame_no) + 1) * seconds).alias("end"), F.avg(p).alias("confidence")).drop("_word")


def engine_confidence(given: Column, segment_mean: Column, default: float = 0.9) -> Column:
    """What the service says, else the segments' mean, else the default."""
    return F.coalesce(given, segment_mean, F.lit(default))


def frame_confidence(frames: DataFrame, key: str, token: str, p: str, pad: str = "<pad>") -> DataFrame:
    """The mean of frame probabilities, pads left out, and the plain mean."""
    return frames.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col(token) != pad, F.col(p))), F.lit(0.0)).alias("confidence"), F.avg(p).alias("plain"))


def clipped(segments: DataFrame, chunk_start: str, chunk_end: str) -> DataFrame:
    """Segments cut to their chunk, those outside dropped; confidence from the share of no speech."""
    start, end = F.greatest(F.col("start"), F.col(chunk_start)), F.least(F.col("end"), F.col(chunk_end))
    return segments.withColumns({"start": start, "end": end, "confidence": 1 - F.col("no_speech")}).filter(F.col("end") > F.col("start"))


def fused(hyps: DataFrame, seg: str = "seg", agreed_at: float = 0.85, boost: float = 0.1) -> DataFrame:
    """One hypothesis (hyp_id, text, confidence) of each segment: among those that agree with the others if there are any, the surest, the first of equals.

    The hypotheses of a segment are few (one an engine and attempt), so they are compared in one row's array.
    """
    rows = hyps.groupBy(seg).agg(F.array_sort(F.collect_list(F.struct("hyp_id", "text", "confidence"))).alias("h"))
    rows = rows.withColumn("m", F.transform("h", lambda x: F.when(F.size("h") > 1, F.aggregate(F.filter("h", lambda y: y["hyp_id"] != x["hyp_id"]), F.lit(0.0), lambda a, y: a + T.similarity(x["text"], y["text"])) / (F.size("h") - 1)).otherwise(1.0)))
    one = rows.select(seg, F.inline(F.arrays_zip("h", "m"))).select(seg, "h.*", F.round("m", 6).alias("agreement"))
    some = F.max("agreement").over(Window.partitionBy(seg)) >= agreed_at
    best = one.withColumn("_some", some).filter((~F.col("_some")) | (F.col("agreement") >= agreed_at))
    best = best.withColumn("_rn", F.row_number().over(Window.partitionBy(seg).orderBy(F.desc("confidence"), "hyp_id"))).filter("_rn = 1")
    sure = F.least(F.lit(1.0), F.col("confidence") + F.when(F.col("agreement") >= agreed_at, boost).otherwise(0.0))
    return best.select(seg, "hyp_id", "text", "agreement", F.round(sure, 6).alias("fused"), ((F.col("confidence") < 0.6) | (F.col("agreement") < 0.5)).alias("redecode"))


def fused_again(hyps: DataFrame, decode, seg: str = "seg", attempts: int = 2) -> DataFrame:
    """Fusion, and for segments that ask for it a further hypothesis of decode (DataFrame of segments, attempt -> hypotheses) at most attempts times."""
    out = fused(hyps, seg)
    for k in range(attempts):
        more = decode(out.filter("redecode").select(seg), k)
        hyps = hyps.unionByName(more)
        out = fused(hyps, seg)
    return out


def rescored(hyps: DataFrame, seg: str, confidence: Column, lm: Column, block_share: Column, gate: float = 0.3) -> DataFrame:
    """Hypotheses with a score blended from confidence and language model where enough of the text is in the block; the best of each segment first."""
    blend = F.when(block_share >= gate, T.log_sigmoid_blend(confidence, lm)).otherwise(confidence)
    d = hyps.withColumn("score", F.round(blend, 6))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(seg).orderBy(F.desc("score"), "hyp_id")))


def processed_before(files: DataFrame, log: DataFrame) -> DataFrame:
    """files (filename, file_hash) with done: whether the first log entry of the name (by pos) is of the same file and a success."""
    from .joins import first_per

    first = first_per(log.select("filename", F.col("file_hash").alias("_hash"), "status", "pos"), ["filename"], F.asc("pos"))
    return files.join(first, "filename", "left").withColumn("done", F.coalesce((F.col("status") == "success") & (F.col("_hash") == F.col("file_hash")), F.lit(False))).select(*files.columns, "done")


def not_done(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files without a successful run of the same content."""
    return files.join(log.filter("status = 'success'").select("filename", "file_hash").distinct(), ["filename", "file_hash"], "left_anti")


def invitable(wanted: DataFrame, invitations: DataFrame, now: Column) -> DataFrame:
    """Addresses without an open invitation."""
    return wanted.join(invitations.filter(F.col("used_at").isNull() & (F.col("expires_at") >= now)).select("email"), "email", "left_anti")


def remaining_time(elapsed: Column, percent: Column) -> Column:
    """Seconds left of a run at percent of its work; null before anything is done."""
    return F.when(percent > 0, F.greatest(F.lit(0.0), elapsed / (percent / 100) - elapsed))


def prompt(words: Column, context: Column, before: Column, most: int = 224) -> Column:
    """The words given to a recognizer: the end of the text before, a phrase for the context, the vocabulary; cut to most characters."""
    tail = F.nullif(F.trim(F.right(before, F.lit(50))), F.lit(""))
    return F.substring(F.concat_ws(" ", tail, context, words), 1, most)


def mode_scores(text: Column, talk: Sequence[str], verse: Sequence[str], density: Column, dense_at: float = 0.35) -> Column:
    """Whether a text is talk or verse, by its markers: one for each of talk, two for each of verse, one for a dense text."""
    n = lambda ps: sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in ps), F.lit(0))
    t, v = n(talk), 2 * n(verse) + (density >= dense_at).cast("int")
    return F.struct(F.when(v > t, "verse").when(t > v, "talk").otherwise("unknown").alias("mode"), F.round(F.when(t + v > 0, F.greatest(t, v) / (t + v)).otherwise(0.0), 6).alias("confidence"))


def themes(words: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The themes any of whose words is among words, in the table's order."""
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, v))), F.lit(k)) for k, v in table.items())))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots and dashes; everything else is one underscore."""
    return F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}.-]+", "_")


def rounded_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm, rounded to milliseconds."""
    ms = F.round(seconds * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3_600_000)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
