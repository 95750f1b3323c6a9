"""Column expressions over text: edit distance, word sets, scripts, signals, captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: letters, digits and underscores make words; everything else separates them
WORD = r"[\p{L}\p{M}\p{N}_]+"


def words(text: Column, pattern: str = "[a-z]+") -> Column:
    """All lower-cased words of a text that match pattern, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, 0 where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(a, b) / longest).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """1 less the share of edits."""
    return 1 - edit_share(a, b)


def sorted_words(text: Column) -> Column:
    """The words of a text in order of the alphabet, joined by spaces."""
    return F.array_join(F.array_sort(words(text)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements of two arrays, 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def alignment(text: Column, line: Column, edit_weight: float = 0.6) -> Column:
    """Weighted mean of edit similarity and word overlap."""
    return edit_weight * similarity(text, line) + (1 - edit_weight) * jaccard(F.array_distinct(words(text)), F.array_distinct(words(line)))


def share_of(text: Column, pattern: str, whole: str = r"\p{L}") -> Column:
    """Characters that match pattern over those that match whole; 0 if there are none."""
    n = F.regexp_count(text, F.lit(whole))
    return F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(0.0)


def script_census(text: Column, scripts: dict[str, str]) -> dict[str, Column]:
    """The number of characters in each class of scripts (name: character class)."""
    return {name: F.regexp_count(text, F.lit(cls)) for name, cls in scripts.items()}


def dominant(counts: dict[str, Column], mixed_above: float = 0.2) -> Column:
    """The class with most characters; mixed if two have over a fifth; unknown without any."""
    total = sum(counts.values(), F.lit(0))
    big = sum(((c > mixed_above * total).cast("int") for c in counts.values()), F.lit(0))
    top = F.greatest(*counts.values())
    named = F.coalesce(*(F.when(c == top, F.lit(n)) for n, c in counts.items()))
    return F.when(total == 0, "unknown").when(big >= 2, "mixed").otherwise(named)


def overlap(a: Column, b: Column) -> Column:
    """Common distinct elements of two arrays."""
    return F.size(F.array_intersect(a, b))


def caption_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds, truncated."""
    s = F.floor(seconds).cast("long")
    ms = F.floor((seconds - s) * 1000 + 1e-6).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit(mark), F.lpad(ms.cast("string"), 3, "0"))


def short_time(seconds: Column) -> Column:
    """MM:SS."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def escaped(text: Column) -> Column:
    """Text safe inside markup."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def reasons(pairs: Sequence[tuple[Column, str]], default: str) -> Column:
    """The texts whose condition holds, joined by '; ', or default."""
    return F.coalesce(F.nullif(F.concat_ws("; ", *(F.when(c, F.lit(t)) for c, t in pairs)), F.lit("")), F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def review_priority(confidence: Column, match: Column, script: Column, review: Column) -> Column:
    """How urgently a segment needs review, 0 to 1; match and script may be null."""
    base = F.when(confidence < 0.7, 0.4).otherwise(0.0)
    base += F.when(match.isNull(), 0.0).when(match < 0.9, 0.3).otherwise(-0.1)
    return clamp(base + F.when(script < 0.7, 0.2).otherwise(0.0) + F.when(review, 0.1).otherwise(0.0))


def replacement(text: Column, canonical: Column, confidence: Column, match: Column, replace_at: float = 0.90, sure_at: float = 0.95) -> dict[str, Column]:
    """Text, type, confidence and review mark after canonical replacement."""
    done = F.coalesce(match >= replace_at, F.lit(False))
    return {
        "text": F.when(done, canonical).otherwise(text),
        "type": F.when(done, "scripture_quote").otherwise("speech"),
        "confidence": F.when(done, F.greatest(confidence, match)).otherwise(confidence),
        "needs_review": ~(done & (match >= sure_at)),
    }


def route(language: Column, confidence: Column, scripture_like: Column, sure: float = 0.6) -> Column:
    """The route of a segment by its language."""
    local = F.when(scripture_like, "scripture_quote_likely").otherwise("punjabi_speech")
    return F.when((language == "pa") & (confidence >= sure), local).when((language == "en") & (confidence >= sure), "english_speech").when(language.isin("pa", "hi", "ur"), local).otherwise("mixed")


def log_sigmoid_blend(asr: Column, lm: Column, weight: float = 0.3) -> Column:
    """Confidence blended with a language-model score."""
    return (1 - weight) * asr + weight / (1 + F.exp(-lm / 100))


def boost(perplexity: Column, top: float = 0.1) -> Column:
    """The gain in confidence for a text of low perplexity."""
    return F.when(perplexity < 50, top).when(perplexity < 100, top / 2).when(perplexity < 200, top / 4).otherwise(0.0)
