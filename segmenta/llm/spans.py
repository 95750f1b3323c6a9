"""Substring dedup by sliding spans of sentences.

A text is a row of sentences. A sentence ends with a word that ends in . ! or ? or
that a line break follows; where LONG words pass without such an end, words whose
hash is divisible by 4 end one too, so that also text without punctuation falls into
the same sentences wherever it stands. After LIMIT words a sentence ends in any case:
a run of one word that no hash ends would else be one sentence, equal only to runs of
just its length. From every sentence starts a span: the fewest
consecutive sentences, two at least, that hold MIN_WORDS words. Spans are hashed
(words with A-Z lower-cased) and joined over all texts; of equal spans the first is
the one with the smallest (doc_id, place), and the sentences of all others go. Text
between kept sentences stays as it was.

Hashes of all spans are counted by a partial aggregation, so a passage in a third of
all texts reaches the reducers as one row a task. Only spans whose hash may repeat (a
bitmap of MAP_BITS bits) are dealt out a second time.

Defined results: null stays null, empty and blank texts stay as they are; texts with
fewer than MIN_WORDS words have no spans; a row that repeats another's id and text is
the same document and loses what that loses; rows that share an id but not the text
are told apart by the text's hash; rows without an id are dropped; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .store import ready, saved, tidied
from .textnp import LOWER, NOT_BLANK, U, mix, slices, word_hashes, words

MIN_SENTENCES = 2
MIN_WORDS = 24
LONG = 12
LIMIT = 24
MAP_BITS = 27

_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F]] = True


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash and number of words before each word, word starts, first word of each sentence and an end, first sentence of each row and an end)."""
    low = LOWER[data]
    starts, ends, first = words(low, offs, NOT_BLANK)
    n = len(starts)
    h = word_hashes(low, starts, ends)
    if not n:
        return h, starts, np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    breaks = np.flatnonzero(low == 0x0A)
    stop = _STOP[low[ends - 1]]
    stop[:-1] |= np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, ends[:-1])
    last = np.zeros(n, bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    stop |= last
    # words since the last stop, the word itself not counted
    at = np.arange(n)
    prev = np.maximum.accumulate(np.where(np.append(True, stop[:-1]), at, 0))
    end = stop | ((at - prev >= LONG) & (h & U(3) == 0))
    # words since the last end, whichever made it
    prev = np.maximum.accumulate(np.where(np.append(True, end[:-1]), at, 0))
    end |= (at - prev) % LIMIT == LIMIT - 1
    begin = np.append(0, np.flatnonzero(end) + 1)
    return h, starts, begin, np.searchsorted(begin, first)


def spans(h: np.ndarray, begin: np.ndarray, rows: np.ndarray, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentence past the last, hash) of every span."""
    m = len(begin) - 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    i = np.arange(m)
    j = np.maximum(np.searchsorted(begin, begin[:-1] + min_words), i + min_sentences)
    row_end = np.repeat(rows[1:], np.diff(rows))
    ok = j <= row_end
    i, j = i[ok], j[ok]
    # polynomial hash over words: prefix sums, divided by the power at the start
    from .textnp import _powers

    p, inv = _powers(len(h) + 1)
    c = np.append(U(0), np.cumsum(h * p[: len(h)]))
    a, b = begin[i], begin[j]
    return i, j, mix((c[b] - c[a]) * inv[a] + (b - a).astype(U) * U(0x94D049BB133111EB))


@tidied
def _hashes(repeated) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if repeated is None else repeated.value
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for a, _, data, offs in slices(batch.column(1)):
                h, _, begin, rows = sentences(data, offs)
                i, j, x = spans(h, begin, rows)
                if bits is not None:
                    k = (x >> U(64 - MAP_BITS)).astype(np.int64)
                    ok = ((bits[k >> 6] >> (k & 63).astype(U)) & U(1)).astype(bool)
                    i, j, x = i[ok], j[ok], x[ok]
                row = np.searchsorted(rows, i, "right") - 1
                for o, v in zip(out, (x.view(np.int64), ids[a + row], hs[a + row], (i - rows[row]).astype(np.int32), (j - i).astype(np.int32)), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["span", "id", "h", "at", "size"])

    return run


@tidied
def _cut() -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = batch.column(1).to_pylist(), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            marks = batch.column(2)
            for a, b, data, offs in slices(batch.column(1)):
                _, starts, begin, rows = sentences(data, offs)
                counts[a:b] = np.diff(rows)
                for k in range(a, b):
                    if marks[k].is_valid and (m := marks[k].as_py()):
                        lo, hi = rows[k - a], rows[k - a + 1]
                        out = np.zeros(hi - lo, bool)
                        for s in m:
                            out[s["at"] : s["at"] + s["size"]] = True
                        gone[k] = out.sum()
                        # a sentence reaches from its first word to that of the next one; the first also has what stands before it
                        edges = np.append(starts[begin[lo:hi]], offs[k - a + 1])
                        edges[0] = offs[k - a]
                        raw = data
                        texts[k] = b"".join(raw[edges[s] : edges[s + 1]].tobytes() for s in np.flatnonzero(~out)).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts), pa.array(gone)], ["id", "text", "n_sentences", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text without repeated spans, n_sentences, n_removed."""
    spark = ready(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter("id is not null")
    schema = "span long, id long, h long, at int, size int"
    place = F.struct("id", "at", "h")
    every = d.mapInArrow(_hashes(None), schema)
    firsts = saved(every.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("span", "first"), "firsts")
    k = F.shiftrightunsigned("span", 64 - MAP_BITS)
    marks = firsts.groupBy(F.shiftright(k, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(span, {64 - MAP_BITS}) & 63 as int))")).alias("m")).toArrow()
    repeated = np.zeros(1 << (MAP_BITS - 6), U)
    repeated[marks.column("w").to_numpy()] = marks.column("m").to_numpy().astype(np.int64).view(U)
    again = d.mapInArrow(_hashes(spark.sparkContext.broadcast(repeated)), schema)
    later = again.join(firsts, "span").filter(place != F.col("first")).select(F.col("id").alias("i2"), F.col("h").alias("h2"), F.struct("at", "size").alias("s"))
    later = later.groupBy("i2", "h2").agg(F.collect_set("s").alias("spans"))
    out = d.join(later, (F.col("id") == F.col("i2")) & (F.col("h") == F.col("h2")), "left").select("id", "text", "spans")
    return out.mapInArrow(_cut(), "id long, text string, n_sentences long, n_removed long").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
