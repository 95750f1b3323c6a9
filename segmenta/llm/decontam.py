"""Benchmark decontamination by a prefix-filtered set join.

Each item is cut into windows of 13 consecutive words (an item of fewer words is
one window). A window occurs in a document only if all of its words do, in
order, so the prefix of a window's shingle set is a single shingle: the rarest by
its count over all documents. A document position with that shingle is a
candidate; the shingle's place in the window fixes where the window must start
(positional bound), the window must end inside the document (length bound), and
then all words of the item-sized window are compared.

Defined results: null, empty and wordless texts have no words, no hits and are not
contaminated; wordless items and items without an id give no windows; repeated
items and repeated documents count for themselves; an empty item table leaves
every document clean; further columns of either table are ignored. Long texts are
read whole. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .store import ready, tidied
from .textnp import ALNUM, LOWER, U, runs, slices, word_hashes, words

WINDOW = 13
#: words in a shingle (fewer if the window has fewer)
SHINGLE = 3
#: items are broadcast in blocks of about so many bytes of text; more items make more blocks
BLOCK_BYTES = 16 << 20


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, first = words(low, offs, ALNUM)
    return word_hashes(low, starts, ends), first


class Lookup:
    """Sorted 64-bit keys behind a bitmap that turns most misses away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(keys >> U(20)).astype(np.int64) & ((1 << 20) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h whose value is a key, and which key."""
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(h >> U(20)).astype(np.int64) & ((1 << 20) - 1)])
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[i] == h[at]
        return at[ok], i[ok]


class Windows:
    """The distinct windows of a block of items, and which items have each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        seen: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.items: list[set[str]] = []
        for a, b, data, offs in slices(pa.array([t for _, t in items], pa.large_string())):
            h, first = _tokens(data, offs)
            for (name, _), x, y in zip(items[a:b], first[:-1].tolist(), first[1:].tolist(), strict=True):
                size = min(window, y - x)
                for i in range(x, y - size + 1) if size else ():
                    k = seen.setdefault((w := h[i : i + size]).tobytes(), len(seen))
                    if k == len(self.words):
                        self.words.append(w)
                        self.items.append(set())
                    self.items[k].add(name)
        self.by_size = sorted({min(SHINGLE, len(w)) for w in self.words})

    def shingles(self) -> dict[int, np.ndarray]:
        return {g: np.unique(np.concatenate([runs(w, g) for w in self.words if min(SHINGLE, len(w)) == g])) for g in self.by_size}

    def prefixes(self, counts: dict[int, dict[int, int]]) -> list[tuple[int, Lookup, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shingle size: (size, prefix shingles, row bounds, windows, offsets of the shingle)."""
        out = []
        for g in self.by_size:
            rows = []
            for k, w in enumerate(self.words):
                if min(SHINGLE, len(w)) == g:
                    s = runs(w, g).tolist()
                    i = min(range(len(s)), key=lambda i, s=s, g=g: (counts[g].get(s[i], 0), s[i], i))
                    if counts[g].get(s[i], 0):
                        rows.append((s[i], k, i))
            rows.sort()
            keys = np.array([r[0] for r in rows], U)
            uniq, at = np.unique(keys, return_index=True)
            out.append((g, Lookup(uniq), np.append(at, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)))
        return out


@tidied
def _counter(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {g: Lookup(k) for g, k in shared.value.items()}
        sums = {g: np.zeros(len(t.keys), np.int64) for g, t in tables.items()}
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                h, first = _tokens(data, offs)
                for g, t in tables.items():
                    at, i = t.find(runs(h, g))
                    inside = at + g <= first[np.searchsorted(first, at, "right")] if len(at) else np.zeros(0, bool)
                    sums[g] += np.bincount(i[inside], minlength=len(t.keys))
        for g, s in sums.items():
            if len(some := np.flatnonzero(s)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(some.astype(np.int64)), pa.array(s[some])], ["g", "i", "n"])

    return run


@tidied
def _hits(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, flat, begin, tables, names = shared.value
        for batch in batches:
            n_words, spans, items = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for a, b, data, offs in slices(batch.column(1)):
                h, first = _tokens(data, offs)
                n_words[a:b] = first[1:] - first[:-1]
                starts, which = [], []
                for g, t, bounds, wins, off in tables:
                    at, key = t.find(runs(h, g))
                    many = bounds[key + 1] - bounds[key]
                    pick = np.repeat(bounds[key] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
                    starts.append(np.repeat(at, many) - off[pick])
                    which.append(wins[pick])
                start, win = np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(which or [np.zeros(0, np.int64)])
                ok = start >= 0
                start, win = start[ok], win[ok]
                row = np.searchsorted(first, start, "right") - 1
                ok = (row < b - a) & (start + sizes[win] <= first[np.minimum(row + 1, b - a)])
                start, win, row = start[ok], win[ok], row[ok]
                for i in range(int(sizes.max(initial=0))):
                    live = sizes[win] > i
                    ok = ~live
                    ok[live] = h[start[live] + i] == flat[begin[win[live]] + i]
                    start, win, row = start[ok], win[ok], row[ok]
                order = np.lexsort((start, row))
                for s, w, r in zip(start[order].tolist(), win[order].tolist(), row[order].tolist(), strict=True):
                    lo = s - int(first[r])
                    hi, mine = lo + int(sizes[w]), spans[a + r]
                    if mine and lo <= mine[-1][1]:
                        mine[-1][1] = max(mine[-1][1], hi)
                    else:
                        mine.append([lo, hi])
                    items[a + r].extend(names[w])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n_words),
                    pa.array([[{"lo": x, "hi": y} for x, y in s] for s in spans], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                ],
                ["id", "h", "n_words", "spans", "items"],
            )

    return run


def _found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, h, n_words, spans, items), a row for each document; h is the text's hash, ids of any type stay as they are."""
    spark = ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    its = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    n_blocks = 1 + int((its.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes)
    id_type = d.schema["id"].dataType.simpleString()
    parts = []
    for k in range(n_blocks):
        block = Windows([(r.i, r.t) for r in its.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k).collect()], window)
        keys = block.shingles()
        counted = d.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(keys)), "g int, i long, n long").groupBy("g", "i").agg(F.sum("n").alias("n")).collect()
        counts: dict[int, dict[int, int]] = {g: {} for g in keys}
        for r in counted:
            counts[r.g][int(keys[r.g][r.i])] = r.n
        sizes = np.array([len(w) for w in block.words], np.int64)
        flat = np.concatenate(block.words) if block.words else np.zeros(0, U)
        shared = spark.sparkContext.broadcast((sizes, flat, np.cumsum(sizes) - sizes, block.prefixes(counts), [sorted(x) for x in block.items]))
        parts.append(d.mapInArrow(_hits(shared), f"id {id_type}, h long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"))
    out = parts[0]
    if n_blocks > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        # each row came once from every block; rows that repeat with id and text stay as many as they were
        out = out.groupBy("id", "h", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("k"))
        out = out.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("k") / n_blocks).cast("int"))))
    return out.select("id", "h", "n_words", "spans", "items")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """(id_col, n_words, spans of hit words, items as sorted strings), a row for each document."""
    return _found(docs, items, id_col=id_col, **names).drop("h").withColumnRenamed("id", id_col)


def _judged(h: DataFrame, min_share: int) -> DataFrame:
    """Rows of _found with n_hit, n_items, items_sha256 and contaminated."""
    # spans sorted by start: a word counts once even where spans of several blocks overlap
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), s.hi - F.greatest(s.lo, acc.end))).alias("n"), F.greatest(acc.end, s.hi).alias("end")),
        lambda acc: acc.n,
    )
    return h.select(
        "id",
        "h",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, min_share: int = 20, id_col: str = "doc_id", **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and min_share * n_hit >= n_words)."""
    return _judged(_found(docs, items, id_col=id_col, **names), min_share).drop("h").withColumnRenamed("id", id_col)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with all columns they came with.

    Rows are judged one by one: of rows that share an id only those with a contaminated text
    go, all rows that repeat id and text with them. Rows without an id are judged like any
    other; null, empty and wordless texts stay; no documents give no rows.
    """
    bad = _judged(_found(docs, table(spark, sf_dir, "benchmark")), 20).filter("contaminated").select(F.col("id").alias("_bad_id"), F.col("h").alias("_bad_h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_bad_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_bad_h")), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sha_of(ids: list[str]) -> str:
    """The digest of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, size, array_to_string(w[p + 1 : p + size], ' ') AS win FROM (
    SELECT item, w, least(13, len(w)) AS size, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, size, p, array_to_string(w[p + 1 : p + size], ' ') AS win FROM (
    SELECT r, w, size, unnest(range(0, len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT r, p, dw.size, item FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
