"""N-gram Jaccard join by filtering under multiple global orders of the tokens.

A text's set holds its distinct five-word shingles (48-bit hashes); equal sets are one
class from the start. If two sets have a Jaccard similarity of at least t, then under
every global order of the tokens the first n - ceil(t * n) + 1 tokens of each share
one. Orders used: by rarity (the class of a token's count, then a hash), by two plain hashes that know nothing of rarity, and by ten more of which only first tokens
count.

1. One pass over the texts gives every row its class, the first token under each
   random order, and its tokens in ranges; the ranges give each token's exact count
   over all texts. The HEAVY most frequent tokens are broadcast as the rarity order,
   with a bitmap of tokens that occur twice or more.
2. Classes that share first tokens under two or more random orders with the least or
   greatest class of their block are candidates, each class with the HUBS it shares most
   with. This joins dense groups along a few hubs: as many pairs as blocks have members,
   not all pairs.
3. Exact step, for pairs of classes that are not connected yet: prefixes under the
   rarity order are joined, and a pair is a candidate if its lengths fit and the place of
   the common token leaves room for enough common tokens. Blocks whose members are
   all connected are left out, so a group of copies adds no pairs. Rounds between
   hubs of blocks come first, then all pairs that are left.
4. Candidates of either step are intersected with the filters of the two plain orders:
   a pair whose prefixes, token by token, share none under one of them goes. Only then whole sets are
   compared; links give components.

No link is lost by steps 2 to 4: only pairs already connected, or without a common
prefix token under one of the orders, go unverified. Defined results: null, empty and
blank texts have an empty set and are linked with nothing (each its own component);
texts of one to four words have their whole sequence as the only shingle; repeated rows
are equal sets; rows without an id are dropped; further columns are ignored. Class ids
are 64-bit hashes of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .graph import components
from .store import drop_saved, ready, saved, shuffles_dropped, tidied
from .textnp import U, mix, set_id, shingle_sets, slices

SHINGLE = 5
THRESHOLD = 75
RANDOM_ORDERS = 10
#: tokens whose counts the rarity order knows; all others count as equally rare
HEAVY = 1_000_000
#: tokens handed on at once by a task, and tokens that one reduce task counts
FLUSH = 1_000_000
RANGE_TOKENS = 1_000_000
#: log2 bits of the bitmap of repeated tokens, at most (16 MB)
MAP_BITS = 27
#: log2 bits of the bitmap of classes to verify (1 MB)
NEED_BITS = 23
HUB_ROUNDS = 3
#: hubs of step 2 that a class is compared with, of the 20 at most that it may have
HUBS = 2

#: the two plain orders
_PLAIN = mix(np.array([101, 102], U) * U(0xA0761D6478BD642F))
_SEEDS = mix(np.arange(1, RANDOM_ORDERS + 1, dtype=U) * U(0xA0761D6478BD642F))


def _packed(tokens: np.ndarray) -> bytes:
    """Sorted 48-bit tokens of one range as byte planes of differences."""
    d = np.diff(tokens, prepend=tokens[:1])
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :6].T)
    return np.uint64(tokens[0]).tobytes() + planes.tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8, offset=8).reshape(6, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :6] = planes.T
    return np.cumsum(d.view(np.uint64).reshape(-1)) + np.frombuffer(body, np.uint64, 1)[0]


@tidied
def _sets(n_ranges: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pend: list[np.ndarray] = []
        held = 0

        def ranges() -> pa.RecordBatch:
            t = np.concatenate(pend)
            t.sort()
            cut = np.searchsorted(t, np.array([(i << 48) // n_ranges for i in range(1, n_ranges)], U))
            parts = [(r, p) for r, p in enumerate(np.split(t, cut)) if len(p)]
            m = len(parts)
            empty = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, empty, pa.nulls(m, pa.list_(pa.int64())), empty, pa.array([r for r, _ in parts], pa.int32()), pa.array([_packed(p) for _, p in parts], pa.binary())], names)

        names = ["id", "sid", "n", "firsts", "h", "r", "body"]
        for batch in batches:
            sids, ns, firsts = [], [], []
            for _, _, data, offs in slices(batch.column(1)):
                for s in shingle_sets(data, offs, SHINGLE):
                    sids.append(set_id(s))
                    ns.append(len(s))
                    if len(s):
                        pend.append(s)
                        held += len(s)
                        firsts.append([int(s[np.argmin(mix(s ^ seed))]) for seed in _SEEDS])
                    else:
                        firsts.append([])
                if held > FLUSH:
                    yield ranges()
                    pend, held = [], 0
            m = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), batch.column(2), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if pend:
            yield ranges()

    return run


def _count(bits: int) -> object:
    """Counts of a range's tokens: those of four or more as rows, and the bitmap's words with repeated tokens."""

    def run(rows: pa.Table) -> pa.Table:
        t = np.concatenate([_unpacked(b.as_py()) for b in rows.column("body")])
        t.sort()
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        n = np.diff(np.append(first, len(t)))
        t = t[first]
        often = n >= 4
        at = np.unique((t[n >= 2] >> U(48 - bits)).astype(np.int64))
        word, begin = np.unique(at >> 6, return_index=True)
        mask = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), begin) if len(at) else np.zeros(0, U)
        return pa.table({"tok": np.concatenate([t[often].astype(np.int64), word]), "n": np.concatenate([n[often].astype(np.int64), mask.view(np.int64)]), "is_map": np.repeat([False, True], [int(often.sum()), len(word)])})

    return run


class Orders:
    """The rarity order: by the class of a token's count, then by a hash."""

    def __init__(self, heavy: np.ndarray, klass: np.ndarray, repeated: np.ndarray, bits: int):
        self.heavy, self.klass, self.repeated, self.bits = heavy, klass, repeated, bits
        self.near = np.zeros(1 << 22, bool)
        self.near[(heavy >> U(26)).astype(np.int64)] = True

    def classes(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), U)
        at = np.flatnonzero(self.near[(s >> U(26)).astype(np.int64)])
        if len(at) and len(self.heavy):
            i = np.minimum(np.searchsorted(self.heavy, s[at]), len(self.heavy) - 1)
            hit = self.heavy[i] == s[at]
            out[at[hit]] = self.klass[i[hit]]
        return out

    def twice(self, s: np.ndarray) -> np.ndarray:
        i = (s >> U(48 - self.bits)).astype(np.int64)
        return ((self.repeated[i >> 6] >> (i & 63).astype(U)) & U(1)).astype(bool)


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def first_under(seed: U, s: np.ndarray, threshold: int) -> np.ndarray:
    """The prefix of a set under a plain order, as 32-bit tokens."""
    p = prefix_length(len(s), threshold)
    t = s if p >= len(s) else s[np.argpartition(mix(s ^ seed), p - 1)[:p]]
    return t.astype(np.uint32).view(np.int32)


@tidied
def _prefixes(shared, threshold: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(*shared.value)
        for batch in batches:
            seen: set[int] = set()
            toks, sids, ns, places = [], [], [], []
            for _, _, data, offs in slices(batch.column(0)):
                sets = list(shingle_sets(data, offs, SHINGLE))
                sizes = [len(s) for s in sets]
                if not sum(sizes):
                    continue
                flat = np.concatenate(sets)
                twice = orders.twice(flat)
                base = orders.classes(flat) << U(58)
                rank = base | (mix(flat + U(1)) >> U(6))
                a = 0
                for s, n in zip(sets, sizes, strict=True):
                    sid = set_id(s)
                    b = a + n
                    if n and sid not in seen and twice[a:b].any():
                        seen.add(sid)
                        p = prefix_length(n, threshold)
                        top = np.argpartition(rank[a:b], p - 1)[:p] if p < n else np.arange(n)
                        first = top[np.argsort(rank[a:b][top])]
                        place = np.flatnonzero(twice[a:b][first])
                        toks.append(s[first[place]])
                        places.append(place)
                        sids.append(np.full(len(place), sid, np.int64))
                        ns.append(np.full(len(place), n, np.int32))
                    a = b
            if toks:
                cols = [np.concatenate(x) for x in (toks, sids, ns, places)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3].astype(np.int32))], ["tok", "sid", "n", "place"])

    return run


@tidied
def _needed(shared, threshold: int) -> object:
    """Rows (sid, body, p2, p3) of sets that may be among the needed ones: tokens, and the prefixes under the plain orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = shared.value
        for batch in batches:
            found: dict[int, bytes] = {}
            firsts: list[list[np.ndarray]] = [[], []]
            # one text of each class is enough, and only texts that may be one are made into sets
            i = batch.column(1).to_numpy() & ((1 << NEED_BITS) - 1)
            hit = pa.array((need[i >> 6] >> (i & 63)) & 1 == 1)
            for _, _, data, offs in slices(batch.column(0).filter(hit)):
                for s in shingle_sets(data, offs, SHINGLE):
                    if len(s):
                        sid = set_id(s)
                        if sid not in found:
                            found[sid] = np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                            for f, seed in zip(firsts, _PLAIN, strict=True):
                                f.append(first_under(seed, s, threshold))
            lists = []
            for f in firsts:
                bounds = np.append(0, np.cumsum([len(x) for x in f])).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *f]))))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary()), *lists], ["sid", "body", "p2", "p3"])

    return run


def _tokens(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


@tidied
def _linked(threshold: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, U)
        for batch in batches:
            keep = []
            for i, (a, sa, sb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, x = a, _tokens(sa.as_py())
                y = _tokens(sb.as_py())
                p, q = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def sets_of(pairs: DataFrame, texts: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """(sid, body, p2, p3) of the classes that pairs (a, b) name; texts has text and h, classes the h of one text of each sid."""
    spark = pairs.sparkSession
    low = (1 << NEED_BITS) - 1
    both = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    both = classes.select("sid", "h").join(both, "sid", "left_semi").select(F.col("h").bitwiseAND(low).alias("i"))
    words = both.groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("m")).toArrow()
    need = np.zeros(1 << (NEED_BITS - 6), np.int64)
    need[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(need)
    return saved(texts.mapInArrow(_needed(shared, threshold), "sid long, body binary, p2 array<int>, p3 array<int>").dropDuplicates(["sid"]), "sets")


def intersected(pairs: DataFrame, sets: DataFrame, orders: tuple[str, ...] = ("p2", "p3")) -> DataFrame:
    """(a, b, sa, sb) of those pairs (a, b) whose prefixes share a token under each of the plain orders, with their sets."""
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("sid").alias(side), F.col("body").alias(f"s{side}"), *(F.col(p).alias(f"{p}_{side}") for p in orders)), side)
    for p in orders:
        pairs = pairs.filter(F.arrays_overlap(f"{p}_a", f"{p}_b"))
    return pairs.select("a", "b", "sa", "sb")


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Those distinct pairs of classes (a, b) whose whole sets are similar enough."""
    sets = sets_of(pairs, texts, classes, threshold)
    out = saved(intersected(pairs, sets).mapInArrow(_linked(threshold), "a long, b long"), "links")
    drop_saved(sets)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """id_col, n_shingles, component_id, text_hash, group_hash (the least class of the component) for every row; see the module's text."""
    with shuffles_dropped(ready(docs.sparkSession)):
        return _jaccard_components(docs, id_col, text_col, threshold, heavy)


def _jaccard_components(docs: DataFrame, id_col: str, text_col: str, threshold: int, heavy: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null").withColumn("h", F.xxhash64("text"))
    n_bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(32, int(n_bytes // (6 * RANGE_TOKENS)))
    bits = int(min(MAP_BITS, max(16, math.ceil(math.log2(n_bytes + 2)))))

    got = saved(d.mapInArrow(_sets(n_ranges), "id long, sid long, n long, firsts array<long>, h long, r int, body binary"), "rows")
    rows = saved(got.filter("id is not null").select("id", "sid", "n", "firsts", "h"), "ids")
    counts = saved(got.filter("r is not null").select("r", "body").groupBy("r").applyInArrow(_count(bits), "tok long, n long, is_map boolean"), "counts")

    drop_saved(got)

    repeated = np.zeros(1 << (bits - 6), U)
    part = counts.filter("is_map").groupBy("tok").agg(F.bit_or("n").alias("n")).toArrow()
    repeated[part.column("tok").to_numpy()] = part.column("n").to_numpy().astype(np.int64).view(U)
    many = counts.filter("not is_map")
    hist = sorted(((r.k, r.c) for r in many.groupBy(F.floor(F.log2("n") * 2).cast("int").alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for k, c in hist:
        total += c
        if total > heavy:
            break
        least = k
    top = many.select("tok", F.floor(F.log2("n") * 2).cast("int").alias("k")).filter(F.col("k") >= least).toArrow()
    order = np.argsort(top.column("tok").to_numpy())
    klass = np.clip(top.column("k").to_numpy()[order], 0, 63).astype(np.uint8)
    shared = sc.broadcast((top.column("tok").to_numpy()[order].astype(np.int64).view(U), klass, repeated, bits))

    # step 2: hubs of blocks under random orders
    texts = d.select("text", "h")
    classes = rows.filter("n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.min("h").alias("h"), F.first("firsts").alias("firsts"))
    classes = saved(classes, "classes")
    e = classes.select("sid", F.posexplode("firsts").alias("k", "tok"))
    hubs = e.groupBy("k", "tok").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi")
    near = e.join(hubs, ["k", "tok"]).select("k", "sid", F.explode(F.array("lo", "hi")).alias("hub")).filter("sid <> hub")
    near = near.groupBy("sid", "hub").agg(F.count("*").alias("c")).filter("c >= 2")
    # each class meets the hubs it shares most first tokens with; what that leaves open is left to the exact step
    near = near.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "hub")), asc=False), 1, HUBS).alias("h")).select("sid", F.explode("h.hub").alias("hub"))
    near = near.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()
    near = saved(near, "near")
    links, tried = [verified(near, texts, classes, threshold)], [near]

    # step 3: prefixes under the rarity orders, pairs of different components only
    prefixes = saved(texts.select("text").mapInArrow(_prefixes(shared, threshold), "tok long, sid long, n int, place int").dropDuplicates(["tok", "sid"]), "prefixes")
    for turn in range(HUB_ROUNDS + 1):
        label = components(_all(links))
        if turn:
            # blocks whose members were all connected stay so
            shut, prefixes = prefixes, saved(t.join(blocks.select("tok"), "tok", "left_semi").drop("comp"), "open")
            drop_saved(shut)
        t = prefixes.join(label.withColumnsRenamed({"node": "sid", "root": "comp"}), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        # hubs: of the least and greatest component at first, then drawn anew for each block
        rank = F.col("comp") if turn == 0 else F.xxhash64("sid", "tok", F.lit(turn))
        member = F.struct(rank.alias("rank"), "comp", "sid", "n", "place")
        blocks = t.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(member).alias("first"), F.max(member).alias("last")).filter("lo < hi")
        if turn < HUB_ROUNDS:
            # each member against the block's first and last one
            mine = t.join(blocks.select("tok", F.array("first", "last").alias("hubs")), "tok").select("*", F.explode("hubs").alias("y"))
            x, y = mine, "y."
        else:
            x = t.join(blocks.select("tok"), "tok", "left_semi").alias("x").join(t.select("tok", F.struct("comp", "sid", "n", "place").alias("y")), "tok")
            y = "y."
        need = F.ceil((F.col("n") + F.col(y + "n")) * threshold / (100 + threshold) - 1e-9)
        room = F.least(F.col("n") - F.col("place"), F.col(y + "n") - F.col(y + "place"))  # at most so many tokens in common if this is the first
        fits = (
            (F.col("comp") < F.col(y + "comp") if turn == HUB_ROUNDS else F.col("comp") != F.col(y + "comp"))
            & (100 * F.least("n", y + "n") >= threshold * F.greatest("n", y + "n"))
            & ((room >= need) if turn == HUB_ROUNDS else F.lit(True))
        )
        pairs = saved(x.filter(fits).select(F.least("sid", y + "sid").alias("a"), F.greatest("sid", y + "sid").alias("b")).distinct().join(_all(tried), ["a", "b"], "left_anti"), "pairs")
        if not pairs.head(1):
            drop_saved(pairs)
            continue
        links.append(verified(pairs, texts, classes, threshold))
        tried.append(pairs)

    label = components(_all(links)).withColumnsRenamed({"node": "sid"})
    named = classes.select("sid", "rep").join(label, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = saved(named.join(least_id, "root").select("sid", "component_id", "root"), "named")
    drop_saved(prefixes, counts, *tried, *links)
    out = rows.select("id", "sid", "n", "h").join(of, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("h").alias("text_hash"), F.col("root").alias("group_hash"))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the least id, with all columns documents came with.

    Null, empty and blank texts are linked with nothing and stay, a row for each id and text;
    of rows that repeat id and text one stays. Rows without an id stay as they are, as no
    group can name them; no documents give no rows.
    """
    found = saved(jaccard_components(docs), "groups")
    # by the group itself, as texts of different groups may share an id
    one = found.filter("n_shingles > 0").groupBy("group_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    keep = one.union(found.filter("n_shingles = 0").select("doc_id", "text_hash").distinct()).withColumnsRenamed({"doc_id": "_keep_id", "text_hash": "_keep_hash"})
    out = docs.join(keep, (docs["doc_id"] == F.col("_keep_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_keep_hash")), "left_semi").select(*docs.columns)
    # rows that repeat both id and text are copies too
    if found.groupBy("doc_id").count().filter("count > 1").head(1):
        out = out.dropDuplicates(["doc_id", "text"])
    return out.union(docs.filter("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash", "group_hash")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM d),
c AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM s GROUP BY list_sort(s)),
x AS (SELECT rep, len(s) AS n, md5_number_lower(unnest(s)) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS nab FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * nab >= 75 * (na + nb - nab)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a),
k AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s JOIN c ON list_sort(s.s) = c.s JOIN k ON c.rep = k.rep
"""
