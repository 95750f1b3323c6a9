"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (MIN_N to MAX_N code points, with word
borders) of its distinct lower-cased words, each counted once a word. An n-gram's
log-count ratio r compares its share among the words of toxic and of other training
texts; its feature is r times its count over the square root of the text's number of
distinct words, and a logistic regression with an L2 penalty weighs these features.
As the score is a sum over words, a word's part is computed once and kept.

The classifier is fitted in one task on at most TRAIN_ROWS labelled texts, those
with the smallest hashes of their ids; every text is scored in full. Defined results:
null, empty and wordless texts get the score of the bias alone; a label of null is no
label; an id with several labels counts as toxic if one of them says so; with no
labelled rows, or rows of one class only, every score is the share of toxic labels (0
if there are none); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .store import ready, tidied
from .textnp import U, mix, slices, word_hashes, words

MIN_N, MAX_N = 3, 6
BITS = 18
#: the classifier's bound: training texts, and bytes of text among them
TRAIN_ROWS = 2_500
TRAIN_BYTES = 12 << 20
ALPHA = 0.5
L2 = 2e-4
STEPS = 80
#: words whose scores a task keeps
KEPT_WORDS = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x27] = True
_LETTER[0x80:] = True


def _ngrams(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed n-gram) of words given as code points, each with a border on both sides."""
    rows, cols = [], []
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = np.zeros(len(chars), U)
    for n in range(1, MAX_N + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ (h[:m] >> U(29))) * U(0x9E3779B97F4A7C15) + chars[n - 1 :].astype(U) + U(1)
        if n >= MIN_N:
            ok = word[:m] == word[n - 1 :]
            rows.append(word[:m][ok])
            cols.append((mix(h[ok] + U(n)) >> U(64 - BITS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64),) * 2


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a batch, lower-cased, as code points with borders."""
    raw = data.tobytes()
    text = ["\x01" + raw[a:b].decode("utf-8", "replace").lower() + "\x01" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    chars = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.append(0, np.cumsum([len(t) for t in text])).astype(np.int64)


def _distinct(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch (hash, start, end) and the distinct (row, word) pairs."""
    starts, ends, first = words(data, offs, _LETTER)
    h = word_hashes(data, starts, ends)
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pairs = np.unique(row * max(len(uniq), 1) + inv)
    return uniq, starts[at], ends[at], pairs // max(len(uniq), 1), pairs % max(len(uniq), 1)


class Model:
    """Weights of hashed n-grams and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        chars, bounds = _spelled(data, starts, ends)
        rows, cols = _ngrams(chars, bounds)
        return np.bincount(rows, self.weights[cols], len(starts))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit by accelerated gradient steps with a fixed order, so equal rows give equal weights."""
    y = toxic.astype(np.float64)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BITS), np.log(max(p, 1e-12) / max(1 - p, 1e-12)))
    vocab: dict[int, int] = {}
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    drow, dword = [], []
    for a, _, data, offs in slices(pa.array(texts, pa.large_string())):
        uniq, s, e, row, w = _distinct(data, offs)
        new = [i for i, x in enumerate(uniq.tolist()) if x not in vocab]
        base = len(vocab)
        for k, i in enumerate(new):
            vocab[int(uniq[i])] = base + k
        r, c = _ngrams(*_spelled(data, s[new], e[new]))
        grams.append(((r + base).astype(np.int32), c.astype(np.int32)))
        ids = np.array([vocab[x] for x in uniq.tolist()], np.int64)
        drow.append(row + a)
        dword.append(ids[w])
    drow, dword = np.concatenate(drow), np.concatenate(dword)
    grow, gcol = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    del grams
    used, gcol = np.unique(gcol, return_inverse=True)
    gcol = gcol.astype(np.int32)
    n, v, f = len(y), len(vocab), len(used)
    size = np.bincount(drow, minlength=n)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    class_of = lambda side: np.bincount(gcol, np.bincount(dword, side[drow], v)[grow], f) + ALPHA
    pos, neg = class_of(y), class_of(1 - y)
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratio[(pos + neg) < 2 + 2 * ALPHA] = 0  # an n-gram of one word of one text says nothing about others

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(drow, np.bincount(grow, (w * ratio)[gcol], v)[dword], n) * scale

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(gcol, np.bincount(dword, (g * scale)[drow], v)[grow], f) * ratio

    w, b = np.zeros(f), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2, c1, c2 = np.zeros(f), np.zeros(f), 0.0, 0.0
    for t in range(1, STEPS + 1):
        err = (1 / (1 + np.exp(-np.clip(forward(w) + b, -30, 30))) - y) / n
        g, gb = back(err) + L2 * w, err.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        rate = 0.05 * (1 - 0.9 * (t - 1) / STEPS)
        w = w - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-10)
        b -= rate * (c1 / (1 - 0.9**t)) / (np.sqrt(c2 / (1 - 0.99**t)) + 1e-10)
    out = np.zeros(1 << BITS)
    out[used] = w * ratio
    return Model(out, b)


@tidied
def _scorer(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        known, value = np.zeros(0, U), np.zeros(0)
        for batch in batches:
            z = np.zeros(len(batch))
            for a, b, data, offs in slices(batch.column(1)):
                uniq, s, e, row, w = _distinct(data, offs)
                i = np.searchsorted(known, uniq)
                i[i == len(known)] = 0
                have = known[i] == uniq if len(known) else np.zeros(len(uniq), bool)
                part = np.empty(len(uniq))
                part[have] = value[i[have]]
                new = np.flatnonzero(~have)
                for k in range(0, len(new), 1 << 14):
                    some = new[k : k + (1 << 14)]
                    part[some] = model.words(data, s[some], e[some])
                if len(known) + len(new) > KEPT_WORDS:
                    known, value = uniq, part
                elif len(new):
                    both = np.concatenate([known, uniq[new]])
                    order = np.argsort(both, kind="stable")
                    known, value = both[order], np.concatenate([value, part[new]])[order]
                size = np.bincount(row, minlength=b - a)
                z[a:b] = np.bincount(row, part[w], b - a) / np.sqrt(np.maximum(size, 1))
            score = 1 / (1 + np.exp(-np.clip(z + model.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return run


@tidied
def _fitted() -> object:
    """The model of all rows (h, y, text) of one task, whose worker has the room that the driver lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[:2])
        if found:
            model = fit([r[2] for r in found], np.array([r[1] for r in found]))
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([float(model.bias)])], ["weights", "bias"])

    return run


def held_out(id_col: str, folds: int = 5) -> F.Column:
    """Whether a row's id falls into the fold that no training sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows outside the held-out fold."""
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    # the sample's ids are chosen before any text is moved
    ids = marks.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows).collect()
    if not ids:
        return fit([], np.zeros(0))
    spark = ready(docs.sparkSession)
    some = spark.createDataFrame([(r.doc_id, int(r.y)) for r in ids], "mark_id long, y int")
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("mark_id")).select("doc_id", "y", "text", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h"))
    total = got.agg(F.sum("n")).first()[0] or 0
    if total > TRAIN_BYTES:
        got = got.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * TRAIN_BYTES / total))
    found = got.select("h", "y", "text").repartition(1).mapInArrow(_fitted(), "weights binary, bias double").collect()
    return Model(np.frombuffer(found[0].weights), found[0].bias) if found else fit([], np.zeros(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_scorer(shared), f"id {d.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keeper(shared, at: int) -> object:
    run = _scorer(shared)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                last.append(batch)
                yield pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["id", "text"])

        for part in run(texts()):
            yield last.pop().filter(pa.array(part.column(1).to_numpy() < 0.5))

    return keep


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic (score below 0.5), with all columns they came with.

    Null and empty texts have the score of the model's bias alone; rows that repeat share
    their score; rows without an id are scored like any other; without labels, or with
    labels of one class, the share of label 1 decides; no documents give no rows.
    """
    ready(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    return docs.mapInArrow(_keeper(shared, docs.columns.index("text")), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
