"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The vocabulary is a public model's, whose path is a parameter; nothing is trained. A
text is cut into units, each a run of spaces with the other characters up to the next
space, as no piece has a space behind another character. All pieces that match
inside a unit are the edges of its lattice; a piece weighs 1 / (rank + RANK_SHIFT) to
the power of alpha, by its rank in the vocabulary. Forward filtering sums the weights
of all ways to each place; backward sampling draws the last piece in proportion, then
the one before it, to the unit's start, so a segmentation is drawn in proportion to the
product of its pieces' weights. The numbers drawn are hashes of (seed, row key, unit's
number in the row, place), so a row's segmentation is the same in every run, batch and
partition; alpha = None takes the best way instead of drawing.

A character that no piece has is coded by its UTF-8 bytes' pieces; so is the mark that
stands for a space in the vocabulary, which keeps decoding lossless. Lattices are
built once for each distinct unit of a slice of texts, for all units at once.

Defined results: null and empty texts have no pieces; a null key counts as 0; rows that
repeat a key and a text repeat its segmentation; very long texts and units are read
whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .store import ready, tidied
from .textnp import U, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
SEED = 20
RANK_SHIFT = 2.7
SPACE = 0x2581
#: stands for a U+2581 of the text itself, which is no space
_ESCAPED = 0x10FFFF + 1
#: bytes of text whose lattices a worker holds at once, at about 140 bytes for each
SLICE = 1 << 18

#: bits of a character in a key of the vocabulary's tree, and of the slots that keys are found by
CHAR_BITS, SLOT_BITS = 21, 18

_B = 0x5851F42D4C957F2D
_BI = pow(_B, -1, 1 << 64)


def _slots(key: np.ndarray) -> np.ndarray:
    return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - SLOT_BITS)).astype(np.int64)


class Vocabulary:
    """Pieces as a tree of their characters, and the bytes that each id decodes to."""

    def __init__(self, pieces: list[str], kinds: list[int], ranks: np.ndarray):
        """kinds: 0 normal, 1 byte, 2 neither."""
        normal = [i for i, k in enumerate(kinds) if k == 0 and pieces[i]]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        self.ids, self.rank = np.array(normal, np.int64), ranks[normal]
        # states of the tree are beginnings of pieces, 0 the empty one
        tree: dict[int, int] = {}
        piece = [-1]
        for n, i in enumerate(normal):
            state = 0
            for c in pieces[i]:
                state = tree.setdefault(state << CHAR_BITS | ord(c), len(tree) + 1)
                if state == len(piece):
                    piece.append(-1)
            if piece[state] < 0:
                piece[state] = n
        #: the piece that a state is, or -1; whether longer pieces begin with it
        self.piece = np.array(piece, np.int64)
        self.longer = np.zeros(len(piece), bool)
        keys = np.array(list(tree), np.int64)
        self.longer[keys >> CHAR_BITS] = True
        slot = _slots(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.to = np.append(keys[order], -1), np.append(np.array(list(tree.values()), np.int64)[order], 0)
        many = np.bincount(slot, minlength=1 << SLOT_BITS)
        self.first, self.shared = (np.cumsum(many) - many).astype(np.int32), many > 1
        self.byte_ids = np.zeros(256, np.int64)
        decoded = []
        for i, p in enumerate(pieces):
            if kinds[i] == 1:
                self.byte_ids[int(p[1:-1], 16)] = i
                decoded.append(bytes([int(p[1:-1], 16)]))
            else:
                decoded.append(p.replace(chr(SPACE), " ").encode() if kinds[i] == 0 else b"")
        self.size = np.array([len(b) for b in decoded])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(decoded), np.uint8)
        self.byte_rank = float(len(pieces))

    @staticmethod
    def load(path: str) -> "Vocabulary":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        kinds = [1 if p.is_byte(i) else 2 if p.is_unknown(i) or p.is_control(i) or p.is_unused(i) else 0 for i in range(n)]
        score = np.array([p.get_score(i) for i in range(n)])
        # a merge's score is minus its rank; pieces outside the order of merges count as the rarest
        return Vocabulary([p.id_to_piece(i) for i in range(n)], kinds, np.where(score > -n, -score, n))

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The state that each state's next character leads to, or 0 where no piece goes on so."""
        key = state << CHAR_BITS | char
        slot = _slots(key)
        i = self.first[slot].astype(np.int64)
        hit = self.keys[i] == key
        # slots that several keys share
        miss = np.flatnonzero(self.shared[slot] & ~hit)
        while len(miss):
            i[miss] += 1
            found = self.keys[i[miss]]
            hit[miss[found == key[miss]]] = True
            miss = miss[(found != key[miss]) & (found >= 0) & (_slots(found) == slot[miss])]
        return np.where(hit, self.to[i], 0)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[at]


_pw: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _prefix(chars: np.ndarray) -> np.ndarray:
    if len(_pw[0]) < len(chars) + 1:
        for i, b in enumerate((_B, _BI)):
            a = np.full(2 * len(chars) + 2, U(b))
            a[0] = 1
            _pw[i] = np.multiply.accumulate(a)
    c = np.zeros(len(chars) + 1, U)
    np.cumsum(mix(chars.astype(U) + U(1)) * _pw[0][: len(chars)], out=c[1:])
    return c


def _range_hashes(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((c[b] - c[a]) * _pw[1][a] + (b - a).astype(U))


class Lattices:
    """Edges of all given units (concatenated characters), in the order of their ends, with drawing odds.

    Nodes are places between characters, numbered by place in the unit, so that all units
    move on together, and longer units first: the units that have a place are the first
    ones of those that have the place before, and the next node is a column's width away.
    """

    def __init__(self, v: Vocabulary, chars: np.ndarray, bounds: np.ndarray, alpha: float | None):
        size = np.diff(bounds)
        self.units = m = len(size)
        by_size = np.argsort(-size, kind="stable")
        width = m - np.cumsum(np.append(0, np.bincount(size)))
        # units with at least so many characters, all for 0; none beyond the longest
        width[0] = m
        width = width[: int(size.max(initial=0)) + 2]
        base = np.append(0, np.cumsum(width))
        n = int(base[-1])
        self.place = np.repeat(np.arange(len(width)), width)
        unit = np.arange(n) - base[self.place]
        self.last = np.empty(m, np.int64)
        self.last[by_size] = base[size[by_size]] + np.arange(m)
        # the character before each node
        char = np.zeros(n, np.int64)
        char[m:] = chars[bounds[by_size][unit[m:]] + self.place[m:] - 1]
        on = unit < width[self.place + 1] if n else np.zeros(0, bool)
        step = width[self.place]
        del unit
        scale = 1.0 if alpha is None else alpha
        weight = -scale * np.log(v.rank + RANK_SHIFT)
        begins, ends, ids, logs = [], [], [], []
        many = np.zeros(n, np.int64)
        at = end = np.flatnonzero(on)
        state = np.zeros(len(at), np.int64)
        for k in range(1, v.longest + 1):
            if not len(at):
                break
            end = end + step[end]
            state = v.step(state, char[end])
            i = v.piece[state]
            hit = i >= 0
            if k == 1:
                # whatever no piece has is coded by bytes
                utf = char[end]
                n_bytes = 1 + (utf > 0x7F) + (utf > 0x7FF) + (utf > 0xFFFF)
                n_bytes = np.where(utf == _ESCAPED, 3, n_bytes)
                begins.append(at.astype(np.int32))
                ends.append(end.astype(np.int32))
                ids.append(np.where(hit, v.ids[i], -1 - utf).astype(np.int32))
                logs.append(np.where(hit, weight[i], -scale * n_bytes * np.log(v.byte_rank + RANK_SHIFT)))
            else:
                i = i[hit]
                begins.append(at[hit].astype(np.int32))
                ends.append(end[hit].astype(np.int32))
                ids.append(v.ids[i].astype(np.int32))
                logs.append(weight[i])
            many[ends[-1]] += 1
            live = np.flatnonzero(v.longer[state] & (state > 0) & on[end])
            at, end, state = at[live], end[live], state[live]
        del at, end, state, char, step, on
        #: first edge of each node; edges that end at a node are in the order of their lengths
        self.begin = np.append(0, np.cumsum(many))
        self.back = np.empty(self.begin[-1], np.int32)
        self.id = np.empty(self.begin[-1], np.int32)
        log = np.empty(self.begin[-1])
        free = self.begin[:-1].copy()
        while ends:
            e = ends.pop(0)
            to = free[e]
            free[e] = to + 1
            self.back[to], self.id[to], log[to] = begins.pop(0), ids.pop(0), logs.pop(0)
        del free
        forward = np.zeros(n)
        self.odds = np.empty(len(log))
        # the sum of weights at a unit's start is 1
        for g in range(1, len(width) - 1):
            a, b = base[g], base[g + 1]
            lo, hi = self.begin[a], self.begin[b]
            x = log[lo:hi] + forward[self.back[lo:hi]]
            at = self.begin[a:b] - lo
            top = np.maximum.reduceat(x, at)
            if alpha is None:
                # the best edge, the longest of equals, is drawn surely
                best = x == np.repeat(top, many[a:b])
                size = np.where(best, g - self.place[self.back[lo:hi]], 0)
                self.odds[lo:hi] = best & (size == np.repeat(np.maximum.reduceat(size, at), many[a:b]))
                forward[a:b] = top
                continue
            y = np.exp(x - np.repeat(top, many[a:b]))
            total = np.add.reduceat(y, at)
            self.odds[lo:hi] = y / np.repeat(total, many[a:b])
            forward[a:b] = top + np.log(total)
        # running sums of odds within each end
        e = self.begin[:-1][many > 1] + 1
        left = many[many > 1] - 1
        while len(e):
            self.odds[e] += self.odds[e - 1]
            more = np.flatnonzero(left > 1)
            e, left = e[more] + 1, left[more] - 1
        self.odds[self.begin[1:][many > 0] - 1] = 2.0

    def draw(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, id) of the pieces of units, each unit's pieces in order."""
        occ, at = np.arange(len(unit)), self.last[unit]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        taken = np.zeros(len(unit), np.int64)
        while len(occ):
            u = (mix(key[occ] + self.place[at].astype(U) * U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) / (1 << 53)
            e = self.begin[at]
            more = np.flatnonzero(self.odds[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.odds[e[more]] <= u[more]]
            steps.append((occ, self.id[e]))
            taken[occ] += 1
            at = self.back[e]
            live = at >= self.units
            occ, at = occ[live], at[live]
        stop = np.cumsum(taken)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.int64)
        for t, (o, ids) in enumerate(steps):
            out[stop[o] - 1 - t] = ids
        return np.repeat(np.arange(len(unit)), taken), out


def encode_slice(v: Vocabulary, data: np.ndarray, offs: np.ndarray, keys: np.ndarray, alpha: float | None = ALPHA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, bounds of rows)."""
    m = len(offs) - 1
    text = data.tobytes().decode("utf-8")
    if not text:
        return np.zeros(0, np.int64), np.zeros(m + 1, np.int64)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    rows = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offs]
    chars[chars == SPACE] = _ESCAPED
    space = chars == 0x20
    chars[space] = SPACE
    start = np.zeros(len(chars), bool)
    start[0] = True
    start[1:] = space[1:] & ~space[:-1]
    start[rows[:-1][rows[:-1] < len(chars)]] = True
    a = np.flatnonzero(start)
    b = np.append(a[1:], len(chars))
    h = _range_hashes(_prefix(chars), a, b)
    _, first, inv = np.unique(h, return_index=True, return_inverse=True)
    size = b[first] - a[first]
    bounds = np.append(0, np.cumsum(size))
    lat = Lattices(v, chars[np.repeat(a[first] - bounds[:-1], size) + np.arange(bounds[-1])], bounds, alpha)
    unit_row = np.searchsorted(rows, a, "right") - 1
    number = np.arange(len(a)) - np.searchsorted(a, rows)[unit_row]
    key = mix(mix(keys.astype(np.int64).view(U)[unit_row] + U(seed)) + number.astype(U) * U(0xD6E8FEB86659FD93))
    occ, ids = lat.draw(inv, key)
    coded = np.flatnonzero(ids < 0)
    if len(coded):
        points = -1 - ids[coded]
        points[points == _ESCAPED] = SPACE
        raw = [chr(c).encode() for c in points.tolist()]
        many = np.ones(len(ids), np.int64)
        many[coded] = [len(r) for r in raw]
        ids = np.repeat(ids, many)
        occ = np.repeat(occ, many)
        at = np.flatnonzero(ids < 0)
        ids[at] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.searchsorted(unit_row[occ], np.arange(m + 1))


@tidied
def _encoder(shared, alpha: float | None, seed: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offs in slices(batch.column(1), SLICE):
                ids, bounds = encode_slice(v, data, offs, keys[a:b], alpha, seed)
                back = v.decode(ids)
                # bytes up to each row's last piece: where they end tells whether a row came back whole
                ends = np.append(0, np.cumsum(v.size[ids]))[bounds]
                same = np.array_equal(ends, offs)
                wrong = np.append(0, np.cumsum(back != data)) if same and len(back) == len(data) else None
                whole = (wrong[offs[1:]] == wrong[offs[:-1]]) if wrong is not None else np.array([np.array_equal(back[ends[i] : ends[i + 1]], data[offs[i] : offs[i + 1]]) for i in range(b - a)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(np.diff(bounds)), pa.array(whole)],
                    ["id", "ids", "n_pieces", "lossless"],
                )

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float | None = ALPHA, seed: int = SEED) -> DataFrame:
    """id_col, ids (array of int), n_pieces, lossless (the pieces decode to the very text)."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_encoder(shared, alpha, seed), "id long, ids array<int>, n_pieces long, lossless boolean").withColumnRenamed("id", id_col)


@tidied
def _decoder(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [v.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id_col, text; ids that no text has decode to replacement characters."""
    spark = ready(coded.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))
    d = coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return d.mapInArrow(_decoder(shared), "id long, text string").withColumnRenamed("id", id_col)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless for every document that came.

    Null and empty texts have no pieces; rows without an id are drawn as those of id 0;
    rows that repeat id and text repeat their pieces; no documents give no rows.
    """
    return encode(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
