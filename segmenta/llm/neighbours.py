"""Embedding near-dedup by NN-descent.

Equal vectors are one class with a weight. A neighbour graph of the K most similar
vectors of each is started in small leaves: random hyperplanes cut the vectors into
cells of about LEAF rows, ROUNDS times anew, and a cell's rows are compared with each
other. Then the graph is refined: at each vector all its neighbours, and those whose
neighbour it is, are compared with each other, as neighbours of neighbours, and each
keeps its K best. Refinement stops when few lists change. An audit takes a sample of
vectors, compares each with all vectors, and measures the recall of its links; below
TARGET more leaves and refinements follow.

A vector whose whole list is at or above the threshold is saturated: it may have more
links than the list holds. Lists are then enlarged to the whole group: groups are the
components of links that hold a saturated vector, joined with each other where their
centres are near, and all pairs of blocks of a group's rows are compared, a task a pair
of blocks, which gives numbers of links, not pairs. Every link in the result is a
cosine in double precision of at least the threshold.

At the end the result itself is audited: the numbers of links of SAMPLE vectors, those of
dense groups among them, are held against a comparison with all vectors. The recall is
logged; below TARGET all blocks of all vectors are compared, which is exact and slow, and
the log says so.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (n_links 0, component their own id); vectors of different
length are not compared; repeated rows are each other's links; rows without an id are
dropped; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .graph import components
from .store import ready, saved, tidied

THRESHOLD = 0.9
K = 12
LEAF = 128
#: a cell with more rows than this is dealt out again at random
FULL = 512
ROUNDS = 4
REFINEMENTS = 4
TARGET = 0.99
AUDITS = 3
SAMPLE = 256
BLOCK = 2048
SEED = 7

log = logging.getLogger(__name__)


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def usable(vec: Column) -> Column:
    """Whether a vector can have links."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) > 0) & whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled to length one; scaled by the largest component first, so that squares stay finite."""
    for batch in batches:
        rows = [np.array(x, np.float64) for x in batch.column(2).to_pylist()]
        rows = [x / np.abs(x).max() for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x / np.sqrt((x * x).sum()) for x in rows], pa.list_(pa.float64()))], ["id", "w", "vec"])


@tidied
def _cells(round_no: int, bits: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(len(batch), np.int64)
            size = np.array([len(x) for x in batch.column(1)])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = _matrix(batch.column(1).take(pa.array(at)))
                planes = np.random.default_rng((SEED, round_no, int(d))).standard_normal((int(d), bits)) if bits else np.zeros((int(d), 0))
                cells[at] = ((x @ planes > 0) @ (1 << np.arange(bits)) if bits else 0) + (int(d) << 32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells)], ["id", "cell"])

    return run


def _best(ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of each row's k most similar others, only above its floor."""
    n = len(ids)
    s = np.clip(x @ x.T, -1, 1)
    np.fill_diagonal(s, -2)
    if mask is not None:
        s[~mask] = -2
    k = min(k, n - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    v = np.take_along_axis(s, top, 1)
    ok = v > (np.full(n, -2.0) if floor is None else floor)[:, None]
    r = np.repeat(np.arange(n), k).reshape(n, k)
    return ids[r[ok]], ids[top[ok]], v[ok]


def _leaf(k: int) -> object:
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        if len(ids) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        order = np.argsort(ids)
        a, b, s = _best(ids[order], _matrix(rows.column("vec"))[order], k)
        return pa.table({"a": a, "b": b, "s": s})

    return run


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar b of each a, repeated pairs once."""
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return edges.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def start(v: DataFrame, n: int, rounds: range, k: int = K) -> DataFrame:
    """Edges (a, b, s) of the best neighbours in random cells."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    out = None
    for r in rounds:
        c = v.select("id", "vec").mapInArrow(_cells(r, bits), "id long, cell long")
        c = saved(c, "cells")
        many = c.groupBy("cell").agg(F.ceil(F.count("*") / FULL).alias("parts"))
        c = c.join(many, "cell").select("id", "cell", F.pmod(F.xxhash64("id", F.lit(r)), F.col("parts")).alias("part"))
        e = v.select("id", "vec").join(c, "id").groupBy("cell", "part").applyInArrow(_leaf(k), "a long, b long, s double")
        out = e if out is None else out.union(e)
    return saved(_top(out, k), "start")


@tidied
def _around(k: int) -> object:
    """Compare all neighbours of one vector; rows come sorted by that vector."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            u = batch.column(0).to_numpy()
            cut = int(np.searchsorted(u, u[-1]))
            if cut or (rest and rest[0].column(0)[0].as_py() != u[0]):
                yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield pa.Table.from_batches(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            u, ids, floor, fresh = (t.column(i).to_numpy() for i in range(4))
            x = _matrix(t.column(4))
            cut = np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1 and fresh[a:b].any():
                    # pairs of which at least one neighbour is new
                    out.append(_best(ids[a:b], x[a:b], k, floor[a:b], fresh[a:b][:, None] | fresh[a:b][None, :]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["a", "b", "s"])

    return run


def refine(v: DataFrame, graph: DataFrame, fresh: DataFrame, k: int = K) -> DataFrame:
    """One round of neighbours of neighbours; fresh: the edges (a, b) that are new."""
    new = fresh.select("a", "b", F.lit(True).alias("new"))
    g = graph.join(new, ["a", "b"], "left").withColumn("new", F.coalesce("new", F.lit(False)))
    # of the vectors whose neighbour u is, the nearest 2 K take part; links beyond are kept in their own lists
    back = g.select(F.col("b").alias("u"), F.col("a").alias("v"), "s", "new").withColumn("rn", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).filter(F.col("rn") <= 2 * k).drop("rn")
    around = g.select(F.col("a").alias("u"), F.col("b").alias("v"), "s", "new").union(back)
    around = around.groupBy("u", "v").agg(F.max("new").alias("new"))
    # the vector itself stands among its neighbours, so that it meets theirs
    around = around.union(around.select("u", F.col("u").alias("v"), F.lit(False)).distinct())
    floor = graph.groupBy("a").agg(F.min("s").alias("low"), F.count("*").alias("n")).select(F.col("a").alias("id"), F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("floor"))
    far = v.select("id", "vec").join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    rows = around.join(far, around.v == far.id).select("u", "v", "floor", "new", "vec")
    parts = max(1, int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    better = rows.repartition(parts, "u").sortWithinPartitions("u", "v").mapInArrow(_around(k), "a long, b long, s double")
    return saved(_top(graph.union(better), k), "graph")


@tidied
def _compare(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, threshold = shared.value
        for batch in batches:
            size = np.array([len(r) for r in batch.column(1)])
            at = np.flatnonzero(size == x.shape[1])
            if len(at):
                mine = batch.column(0).to_numpy()[at]
                i, j = np.nonzero(x @ _matrix(batch.column(1).take(pa.array(at))).T >= threshold)
                ok = ids[i] != mine[j]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[ok]]), pa.array(mine[j[ok]])], ["a", "b"])

    return run


def recall(v: DataFrame, links: DataFrame, threshold: float, sample: int = SAMPLE) -> tuple[int, int]:
    """(links of sampled vectors by comparison with all vectors, those among them that links has); saturated vectors are left out by the caller."""
    some = v.orderBy(F.xxhash64("id", F.lit(SEED))).limit(sample).collect()
    true = hit = 0
    for d in {len(r.vec) for r in some}:
        ids = np.array([r.id for r in some if len(r.vec) == d])
        x = np.array([r.vec for r in some if len(r.vec) == d])
        shared = v.sparkSession.sparkContext.broadcast((ids, x, threshold))
        got = v.select("id", "vec").mapInArrow(_compare(shared), "a long, b long")
        got = got.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("k")).first()
        true, hit = true + got.n, hit + got.k
    return true, hit


@tidied
def _partners(shared) -> object:
    """(a, n): the weights of all vectors linked with each sampled one, a row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, threshold = shared.value
        for batch in batches:
            size = np.array([len(r) for r in batch.column(2)])
            at = np.flatnonzero(size == x.shape[1])
            if len(at):
                mine, w = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
                hit = (x @ _matrix(batch.column(2).take(pa.array(at))).T >= threshold) & (ids[:, None] != mine[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ w)], ["a", "n"])

    return run


def audit(v: DataFrame, counted: DataFrame, threshold: float, sample: int = SAMPLE) -> tuple[int, int]:
    """(links of sampled vectors (id, w, vec) by comparison with all, those that counted (id, n) has), weights counted."""
    some = v.orderBy(F.xxhash64("id", F.lit(SEED + 1))).limit(sample).collect()
    true = 0
    for d in {len(r.vec) for r in some}:
        ids = np.array([r.id for r in some if len(r.vec) == d])
        shared = v.sparkSession.sparkContext.broadcast((ids, np.array([r.vec for r in some if len(r.vec) == d]), threshold))
        true += v.select("id", "w", "vec").mapInArrow(_partners(shared), "a long, n long").agg(F.sum("n")).first()[0] or 0
    found = counted.filter(F.col("id").isin([r.id for r in some])).agg(F.sum("n")).first()[0] if some else 0
    return true, found or 0


def _blocks(threshold: float) -> object:
    """Numbers of links between two blocks of a group, and a spanning forest (id, to) of the components that links between them join."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, side, w, comp = (rows.column(c).to_numpy() for c in ("id", "side", "w", "comp"))
        out_id, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        names, code = np.unique(comp, return_inverse=True)
        parent = np.arange(len(names))
        forest: list[tuple[int, int]] = []

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        sizes = np.array([len(r) for r in rows.column("vec")])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = _matrix(rows.column("vec").take(pa.array(at)))
            p, q = at[side[at] <= 0], at[side[at] >= 0]
            xp, xq = x[side[at] <= 0], x[side[at] >= 0]
            same = bool((side == 0).any())
            for a in range(0, len(p), 512):
                mine = p[a : a + 512]
                s = xp[a : a + 512] @ xq.T >= threshold
                if same:
                    s &= ids[mine][:, None] != ids[q][None, :]
                out_id.append(ids[mine])
                out_n.append(s @ w[q])
                if not same:
                    out_id.append(ids[q])
                    out_n.append(w[mine] @ s)
                i, j = np.nonzero(s & (code[mine][:, None] != code[q][None, :]))
                for pair in np.unique(code[mine[i]] * len(names) + code[q[j]]).tolist():
                    u, v = (root(c) for c in divmod(pair, len(names)))
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        forest.append((max(u, v), min(u, v)))
        u, v = (names[np.array([e[k] for e in forest], np.int64)] for k in range(2))
        n = np.concatenate(out_n).astype(np.int64)
        return pa.table({"id": np.concatenate([*out_id, u]), "n": np.concatenate([n, np.zeros(len(u), np.int64)]), "to": pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(v, pa.int64())])})

    return run


def group_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, n, to) of members (grp, comp, id, w, vec): rows without to have weights of links within the group, summed; those with to join two components, of which comp is the least id."""
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    m = members.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a row goes to every pair of blocks that its block is part of
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.signum(F.col("mine") - F.col("other")).cast("int").alias("side"), "comp", "id", "w", "vec")
    got = m.groupBy("grp", "i", "j").applyInArrow(_blocks(threshold), "id long, n long, to long")
    return got.groupBy("id", "to").agg(F.sum("n").alias("n")).select("id", "n", "to")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, k: int = K, target: float = TARGET) -> DataFrame:
    """id_col, n_links, component_id, kept for every row; see the module's text."""
    spark = ready(rows.sparkSession)
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("id is not null").withColumn("ok", usable(F.col("vec")))
    # equal rows are one class, named by its least id
    classes = d.filter("ok").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("w"))
    classes = saved(classes.select("id", "w", "vec"), "classes")
    v = saved(classes.mapInArrow(_unit, "id long, w long, vec array<double>"), "units")
    n = v.count()
    graph = start(v, n, range(ROUNDS), k)
    fresh, edge = graph, n * k
    for turn in range(AUDITS):
        for _ in range(REFINEMENTS):
            nxt = refine(v, graph, fresh, k)
            fresh = saved(nxt.select("a", "b").join(graph.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
            graph, changed = nxt, fresh.count()
            if changed <= 0.01 * edge:
                break
        # lists are one-sided: a link counts for both ends
        links = graph.filter(F.col("s") >= threshold).select("a", "b")
        links = saved(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
        full = graph.filter(F.col("s") >= threshold).groupBy("a").count().filter(F.col("count") >= k).select(F.col("a").alias("id"))
        true, hit = recall(v.join(full, "id", "left_anti"), links, threshold) if n else (0, 0)
        if hit >= target * true or turn == AUDITS - 1:
            break
        more = start(v, n, range(ROUNDS * (turn + 1), ROUNDS * (turn + 2)), k)
        merged = saved(_top(graph.union(more), k), "graph")
        fresh = saved(merged.select("a", "b").join(graph.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
        graph = merged

    # saturated lists: whole groups, block by block
    label = components(links)
    marked = saved(full.join(label, full.id == label.node).select("root").distinct(), "saturated")
    extra = None
    if marked.head(1):
        inside = v.join(label, v.id == label.node).join(marked, "root").select(F.col("root").alias("grp"), F.col("root").alias("comp"), "id", "w", "vec")
        inside = saved(inside, "inside")
        centre = inside.select("grp", F.posexplode("vec").alias("i", "x")).groupBy("grp", "i").agg(F.sum("x").alias("x")).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
        centre = centre.select(F.col("grp").alias("id"), F.lit(1).cast("long").alias("w"), F.transform("c", lambda c: c.x).alias("vec")).filter(usable(F.col("vec")))
        centre = saved(centre.mapInArrow(_unit, "id long, w long, vec array<double>"), "centres")
        near = start(centre, centre.count(), range(ROUNDS), k).filter(F.col("s") >= 2 * threshold**2 - 1).select("a", "b")
        joined = components(near).withColumnsRenamed({"node": "grp", "root": "joined"})
        inside = inside.join(joined, "grp", "left").withColumn("grp", F.coalesce("joined", "grp")).drop("joined")
        extra = saved(group_counts(inside, threshold), "extra")

    weight = classes.select(F.col("id").alias("b"), "w")
    counted = links.join(weight, "b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("n"))
    edges = links

    def with_groups(counted: DataFrame, edges: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = counted.join(extra.filter("to is null").select("id", F.col("n").alias("m")), "id", "full").select("id", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("n"))
        return both, edges.union(extra.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))

    if extra is not None:
        counted, edges = with_groups(counted, edges, extra)
    counted = saved(counted, "counted")
    true, hit = audit(v, counted, threshold) if n else (0, 0)
    log.info("recall of sampled links: %d of %d", hit, true)
    if hit < target * true:
        log.warning("recall %.3f below %.2f: comparing all blocks", hit / true, target)
        named = v.join(components(edges), v.id == F.col("node"), "left").select(F.lit(0).cast("long").alias("grp"), F.coalesce("root", "id").alias("comp"), "id", "w", "vec")
        counted, edges = with_groups(counted, edges, saved(group_counts(saved(named, "inside"), threshold), "extra"))
        counted = saved(counted, "counted")
    label = components(edges).withColumnsRenamed({"node": "id"})
    of = classes.join(counted, "id", "left").join(label, "id", "left")
    of = saved(of.select("vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "named")
    good = d.filter("ok").join(of, "vec").select("id", "n_links", "component_id")
    out = good.union(d.filter("not ok").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL),
g AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a, g b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
