"""Sources: searches of a corpus, records with varying columns, logs, truth, transcripts, audio files, settings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: the columns a line may have its parts in, the preferred name first
LINE_NAMES = {
    "line_id": ("id", "line_id", "item_id"),
    "text": ("gurmukhi", "text", "line", "content"),
    "ang": ("source_page", "ang", "page", "page_number"),
    "roman": ("roman", "transliteration", "pronunciation"),
    "author": ("author", "writer", "name_english"),
    "raag": ("raag", "section"),
}
AUDIO_GLOB = "*.{mp3,wav,m4a,flac,ogg,aac,wma,mp4,webm}"
TRUTH = "audio_file string, segments array<struct<start:double,end:double,ground_truth_gurmukhi:string,ground_truth_roman:string,quotes:array<struct<quote_start:double,quote_end:double,canonical_line_id:string,expected_ang:int,expected_source:string>>>>"
TRANSCRIPT = "file string, transcription string, segments array<struct<start:double,end:double,text:string,confidence:double,language:string>>"
LOG = "filename string, file_hash string, timestamp string, status string, model_used string, language_detected string, text_file string, json_file string, error string"


def search_lines(lines: DataFrame, text: str, column: str = "text", order: str = "line_no", k: int = 10, case_sensitive: bool = False, encode: Callable[[str], str] | None = None) -> DataFrame:
    """The first k lines, in the order of a column, that hold text literally; a blank text finds nothing.

    encode turns the searched text into the corpus's search encoding.
    """
    wanted = (encode(text) if encode else text) if text and text.strip() else None
    if wanted is None:
        return lines.filter(F.lit(False))
    col, lit = F.col(column), F.lit(wanted)
    hit = F.contains(col, lit) if case_sensitive else F.contains(F.lower(col), F.lower(lit))
    return lines.filter(hit).orderBy(order).limit(k)


def search_sources(lines: DataFrame, text: str, source: str = "source", order: str = "line_no", k: int = 10, sources: Sequence[str] | None = None, **how) -> DataFrame:
    """The first k hits of each source, sources after each other (one table with a source column)."""
    from ..operators.joins import first_rows

    if not text or not text.strip():
        return lines.filter(F.lit(False))
    some = lines.filter(F.col(source).isin(list(sources))) if sources else lines
    hit = F.contains(F.lower(F.col(how.get("column", "text"))), F.lit(text.lower()))
    return first_rows(some.filter(hit), [source], k, F.asc(order))


def resolve(df: DataFrame, names: Sequence[str], default: str | None = None) -> str | None:
    """The first of names that is a column; else default, else the first column."""
    return next((n for n in names if n in df.columns), default or (df.columns[0] if df.columns else None))


def first_of(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first value that is there among the columns of names; values that do not fit kind count as missing."""
    found = [F.col(n).try_cast(kind) if kind != "string" else F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def line_records(df: DataFrame) -> DataFrame:
    """line_id, text, ang, roman, author, raag from whatever columns a corpus has."""
    kinds = {"ang": "int"}
    return df.select(*(first_of(df, names, kinds.get(field, "string")).alias(field) for field, names in LINE_NAMES.items()))


def text_scan(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows with a text, trimmed; null and blank ones are skipped."""
    return df.withColumn(column, F.trim(F.regexp_replace(column, r"^\s+|\s+$", ""))).filter(F.col(column) != "")


def embedding_input(df: DataFrame, column: str, order: str, most: int = 100_000, longer_than: int = 5) -> DataFrame:
    """The first texts of more than a few characters, for a vector index of a bounded size."""
    return df.filter(F.length(F.trim(F.col(column))) > longer_than).orderBy(order).limit(most)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Run log, files of a JSON array or of JSON lines; broken records, and those without a file name, are left out."""
    value, whole = F.col("value"), spark.read.text(path, wholetext=True)
    rows = F.when(F.ltrim(value).startswith("["), F.from_json(value, f"array<struct<{LOG.replace(' string', ':string')}>>")).otherwise(F.transform(F.split(value, "\n"), lambda x: F.from_json(x, LOG)))
    return whole.select(F.explode(rows).alias("r")).select("r.*").filter("filename is not null")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, quotes) of ground-truth documents; quote times are relative to their segment."""
    docs = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    seg = docs.select("audio_file", F.posexplode_outer("segments").alias("pos", "s")).filter("s is not null")
    quotes = seg.select("audio_file", "pos", F.col("s.start").alias("segment_start"), F.col("s.end").alias("segment_end"), F.explode("s.quotes").alias("q")).select("audio_file", "pos", "segment_start", "segment_end", "q.*")
    return seg.select("audio_file", "pos", "s.*").drop("quotes"), quotes


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Segments of saved transcripts; one without segments is a single one with the whole text."""
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)
    return segments_of(docs)


def segments_of(docs: DataFrame) -> DataFrame:
    """(file, pos, start, end, text, confidence, language) of transcript documents."""
    kind = docs.schema["segments"].dataType.simpleString()
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.coalesce("transcription", F.lit("")).alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("language"))).cast(kind)
    return docs.select("file", F.posexplode(F.when(F.coalesce(F.size("segments"), F.lit(0)) <= 0, whole).otherwise(F.col("segments"))).alias("pos", "s")).select("file", "pos", "s.*")


def name_key(name: Column) -> Column:
    """A file name without its suffix, blanks, underscores and case."""
    return F.lower(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), " _-", ""))


def resolve_outputs(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file) of wanted names: the file of the same name, else the first with the same normalized name; null if none."""
    a = wanted.withColumn("key", name_key(F.col("name")))
    b = files.withColumn("key", name_key(F.col("file")))
    best = F.min_by("file", F.struct((F.col("file") != F.col("name")).cast("int"), F.col("file")))
    return a.join(b, "key", "left").groupBy("name").agg(best.alias("file"))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, md5) of the audio files below a folder; the bytes stay on the executors."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", AUDIO_GLOB).option("recursiveFileLookup", True).load(path)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("md5"))


def overlay(defaults: dict, saved: dict | None) -> dict:
    """Settings: saved ones over defaults, one level deep."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for k, v in (saved or {}).items():
        out[k] = out[k] | v if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_speech_set(spark: SparkSession, path: str, audio: Sequence[str] = ("audio", "path", "file", "filename"), text: Sequence[str] = ("text", "sentence", "transcription")) -> DataFrame:
    """(audio, text) of a speech set's metadata file; delimiter and header are read off its first line."""
    first = spark.read.text(path).first()
    line = first.value if first else ""
    sep = max(("\t", ",", "|", ";"), key=line.count)
    head = {c.strip().strip('"').lower() for c in line.split(sep)}
    known = bool(head & {*audio, *text})
    d = spark.read.option("sep", sep).option("header", known).csv(path)
    d = d.toDF(*(c.strip().lower() for c in d.columns)) if known else d
    return d.select(F.col(resolve(d, audio)).alias("audio"), F.col(resolve(d, text, d.columns[min(1, len(d.columns) - 1)])).alias("text"))
