"""Sinks: documents in several formats, results, logs, reports, and the registry of formats."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: fixed values: headers of sections by type
HEADERS = {"opening_gurbani": "Opening Gurbani", "fateh": "Fateh", "topic": "Topic", "quote": "Quote", "katha": "Katha"}


def _in_order(part: Column, sep: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return F.array_join(F.transform(rows, lambda r: r["part"]), sep)


def _body() -> Column:
    """A section's text: its quote's, if it has one."""
    return F.coalesce(F.col("quote_text"), F.col("text"), F.lit(""))


def _header() -> Column:
    pairs = [F.lit(x) for kv in HEADERS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("section_type")), F.initcap(F.replace("section_type", F.lit("_"), F.lit(" "))))


def json_document(sections: DataFrame) -> DataFrame:
    """(title, content) of sections (title, created_at, pos, section_type, text, quote_text, start_time, confidence); nulls are left out."""
    one = F.struct("pos", F.col("section_type").alias("type"), _body().alias("text"), "start_time", "confidence")
    d = sections.groupBy("title", "created_at").agg(F.array_sort(F.collect_list(one)).alias("sections"))
    return d.select("title", F.to_json(F.struct("title", "created_at", "sections"), {"pretty": "true"}).alias("content"))


def markdown_document(sections: DataFrame) -> DataFrame:
    """(title, content): title, a block of metadata, a header for each section, quotes as quotes, times as MM:SS."""
    time = F.when(F.col("start_time").isNotNull(), F.concat(F.lit("\n\n[Time: "), T.short_time(F.col("start_time")), F.lit("]"))).otherwise("")
    quoted = F.concat(F.lit("> "), F.replace(_body(), F.lit("\n"), F.lit("\n> ")))
    part = F.concat(F.lit("## "), _header(), F.lit("\n\n"), F.when(F.col("quote_text").isNotNull(), quoted).otherwise(_body()), time)
    d = sections.groupBy("title", "created_at").agg(F.count("*").alias("n"), _in_order(part, "\n\n").alias("body"))
    meta = F.concat(F.lit("**Created:** "), F.coalesce("created_at", F.lit("")), F.lit("\n**Sections:** "), F.col("n").cast("string"))
    return d.select("title", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), meta, F.lit("\n\n---\n\n"), F.col("body"), F.lit("\n")).alias("content"))


def html_document(sections: DataFrame) -> DataFrame:
    """(title, content): a whole page, all text escaped."""
    tag = F.when(F.col("quote_text").isNotNull(), "blockquote").otherwise("p")
    part = F.concat(F.lit('<section class="'), F.col("section_type"), F.lit('"><h2>'), T.escaped(_header()), F.lit("</h2><"), tag, F.lit(">"), T.escaped(_body()), F.lit("</"), tag, F.lit("></section>"))
    d = sections.groupBy("title", "created_at").agg(_in_order(part, "\n").alias("body"))
    title = T.escaped(F.col("title"))
    return d.select("title", F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>\n<h1>"), title, F.lit("</h1>\n"), F.col("body"), F.lit("\n</body></html>")).alias("content"))


def captions(segments: DataFrame, key: str = "file", vtt: bool = False) -> DataFrame:
    """(key, content): numbered captions by start; an empty text falls back to roman; quotes get a class in VTT."""
    from pyspark.sql import Window

    said = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("text")).otherwise(F.coalesce("roman", F.lit("")))
    said = F.when(F.col("type") == "scripture_quote", F.concat(F.lit("<c.quote>"), said, F.lit("</c>"))).otherwise(said) if vtt else said
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "end"))
    mark = "." if vtt else ","
    cue = F.concat(n.cast("string"), F.lit("\n"), T.caption_time(F.col("start"), mark), F.lit(" --> "), T.caption_time(F.col("end"), mark), F.lit("\n"), said, F.lit("\n"))
    d = segments.select(key, n.alias("pos"), cue.alias("cue")).groupBy(key).agg(_in_order(F.col("cue"), "\n").alias("content"))
    return d.withColumn("content", F.concat(F.lit("WEBVTT\n\n"), F.col("content"))) if vtt else d


#: document formats by name; each makes (title, content) of sections
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"json": json_document, "markdown": markdown_document, "html": html_document}


def export(sections: DataFrame, name: str) -> DataFrame:
    """Documents in a registered format; an unknown one names those there are."""
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown format {name!r}; there are: {', '.join(sorted(FORMATS))}")
    return FORMATS[name.lower()](sections)


def write_results(segments: DataFrame, path: str, key: str = "file") -> None:
    """Each file's text and its segments as JSON lines, in folders by file."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda r: r["text"]), " ")
    segments.groupBy(key).agg(said.alias("value")).write.partitionBy(key).mode("overwrite").text(f"{path}/text")
    segments.write.partitionBy(key).mode("overwrite").json(f"{path}/json")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_by_language(translations: DataFrame, path: str) -> None:
    translations.write.partitionBy("target_language").mode("overwrite").json(path)


def write_review_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("overwrite").option("header", True).csv(path)


def save_table(df: DataFrame, path: str) -> None:
    """Lexicon, counts or vectors as parquet."""
    df.write.mode("overwrite").parquet(path)


def error_report(per_segment: DataFrame, path: str) -> dict:
    """Segments as CSV and JSON below path; the totals are returned and written as one JSON line."""
    from ..operators.evaluate import totals

    per_segment.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    per_segment.write.mode("overwrite").json(f"{path}/json")
    one = totals(per_segment)
    one.write.mode("overwrite").json(f"{path}/total")
    return one.first().asDict()


def quote_report(matches: DataFrame, path: str, examples: int = 10) -> dict:
    """Counts of quote matches (outcome tp, fp, fn) with the first examples of each kind of error, as JSON."""
    from ..operators.evaluate import precision_recall

    scores = precision_recall(matches).first().asDict()
    bad = {kind: [r.asDict() for r in matches.filter(F.col("outcome") == kind).orderBy("file", "start", "line_id").limit(examples).collect()] for kind in ("fp", "fn")}
    report = {"scores": scores, "examples": bad}
    matches.sparkSession.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return report


def push(session_updates: DataFrame, send: Callable[[str, list[dict]], None], checkpoint: str):
    """A stream of updates handed on in batches, by room (session_id), in order of sequence; send runs on the executors."""

    def batch(df: DataFrame, _: int) -> None:
        def rooms(rows):
            room: list[dict] = []
            for r in rows:
                if room and room[0]["session_id"] != r["session_id"]:
                    send(room[0]["session_id"], room)
                    room = []
                room.append(r.asDict())
            if room:
                send(room[0]["session_id"], room)

        df.repartition("session_id").sortWithinPartitions("session_id", "sequence").foreachPartition(rooms)

    return session_updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def truth_template(audio: DataFrame) -> DataFrame:
    """An empty ground truth for each audio file, to be filled in."""
    return audio.select("audio_file", F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit("").alias("ground_truth_gurmukhi"), F.lit(None).cast("string").alias("ground_truth_roman"))


def with_segment(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """Ground truth with further segments, in order."""
    return truth.unionByName(rows).orderBy("audio_file", "start")
