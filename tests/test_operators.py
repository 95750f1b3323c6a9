"""Small tables with values worked out by hand, and the streams against batches."""

import random

from pyspark.sql import functions as F

from segmenta.functions import text as T
from segmenta.operators import joins as J
from segmenta.operators import sequence as S
from segmenta.streaming import sessions


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_expressions(spark):
    lit = F.lit
    assert one(spark, F.levenshtein(lit("ਪੁਰਖੁ"), lit("ਪੁਰਖ"))) == 1 and one(spark, F.levenshtein(lit("kitten"), lit("sitting"))) == 3
    assert one(spark, T.jaccard(T.words(lit("a b c")), T.words(lit("b c d")))) == 0.5 and one(spark, T.jaccard(T.words(lit("")), T.words(lit("a")))) == 0.0
    assert one(spark, T.alignment(lit("one two"), lit("one two"))) == 1.0
    assert one(spark, T.caption_time(lit(3661.5))) == "01:01:01,500" and one(spark, T.short_time(lit(65.9))) == "01:05"
    assert one(spark, T.escaped(lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert abs(one(spark, T.review_priority(lit(0.6), lit(0.8), lit(0.65), lit(True))) - 1.0) < 1e-9
    assert one(spark, T.review_priority(lit(0.9), lit(0.95), lit(None).cast("double"), lit(False))) == 0.0
    assert abs(one(spark, T.log_sigmoid_blend(lit(0.8), lit(0.0))) - 0.71) < 1e-9
    for match, want in ((0.85, ("t", True)), (0.92, ("c", True)), (0.96, ("c", False))):
        r = T.replacement(lit("t"), lit("c"), lit(0.5), lit(match))
        assert (one(spark, r["text"]), one(spark, r["needs_review"])) == want


def test_overlap_repair(spark):
    rows = [(1, 0.0, 5.0, 0.5), (1, 4.0, 8.0, 0.9), (2, 0.0, 5.0, 0.9), (2, 4.0, 8.0, 0.5), (3, 0.0, 5.0, 0.9), (3, 4.0, 5.0, 0.5)]
    got = sorted((r.k, r.start, r.end) for r in S.repair_overlaps(spark.createDataFrame(rows, "k int, start double, end double, confidence double"), "k").collect())
    assert got == [(1, 0.0, 4.0), (1, 4.0, 8.0), (2, 0.0, 5.0), (2, 5.0, 8.0), (3, 0.0, 5.0)]


def _repaired(rows):
    """The fold of one key's rows (start, end, confidence), in order."""
    out = []
    for s, e, c in sorted(rows):
        if not out or s >= out[-1][1]:
            out.append((s, e, c))
        elif c > out[-1][2]:
            a, _, d = out.pop()
            out += ([(a, s, d)] if s > a else []) + [(s, e, c)]
        elif e > out[-1][1]:
            out.append((out[-1][1], e, c))
    return out


def test_overlap_repair_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, float(s := rng.randrange(200)), float(s + rng.randrange(1, 9)), rng.randrange(5) / 5) for k in range(6) for _ in range(40)]
    got = sorted((r.k, r.pos, r.start, r.end, r.confidence) for r in S.repair_overlaps(spark.createDataFrame(rows, "k int, start double, end double, confidence double"), "k").collect())
    assert got == [(k, i, *x) for k in range(6) for i, x in enumerate(_repaired([r[1:] for r in rows if r[0] == k]))]


def test_matching_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, i % 3, float(s := rng.randrange(120)), float(s + rng.randrange(2, 9))) for i in range(120)]
    df = S.runs_of_overlaps(spark.createDataFrame(rows, "event_id long, user_id long, s double, e double"), ["user_id"], "s", "e")
    side = lambda c, rest: df.filter(f"event_id % 2 = {rest}").select("user_id", F.col("run").alias(f"{c}_run"), F.col("event_id").alias(f"{c}_id"), F.col("s").alias(f"{c}_start"), F.col("e").alias(f"{c}_end"))
    both = J.overlapping(side("p", 0), side("g", 1), "user_id", 5.0)
    iou = (F.least("p_end", "g_end") - F.greatest("p_start", "g_start")) / (F.greatest("p_end", "g_end") - F.least("p_start", "g_start"))
    pairs = both.select("user_id", F.col("p_run").alias("run"), "p_id", F.col("p_start").alias("p_pos"), "g_id", iou.alias("iou")).filter("iou > 0.5")
    got = {(r.p_id, r.g_id) for r in S.match_one_to_one(pairs, ["user_id", "run"]).collect()}
    want, taken = set(), set()
    for i, u, s, e in sorted((r for r in rows if r[0] % 2 == 0), key=lambda r: (r[2], r[0])):
        free = [((min(e, f) - max(s, t)) / (max(e, f) - min(s, t)), -j) for j, v, t, f in rows if j % 2 and v == u and j not in taken and min(e, f) > max(s, t)]
        if free and max(free)[0] > 0.5:
            taken.add(-max(free)[1])
            want.add((i, -max(free)[1]))
    assert got == want and want


def test_scan_match(spark):
    p = spark.createDataFrame([("f", 1, 0.0, 5.0), ("f", 2, 5.0, 9.0), ("f", 3, 20.0, 21.0), ("g", 4, 0.0, 1.0)], "file string, p_id long, p_start double, p_end double")
    g = spark.createDataFrame([("f", 1, 0.0, 2.0), ("f", 2, 2.0, 6.0), ("f", 3, 6.0, 8.0)], "file string, g_id long, g_start double, g_end double")
    got = {r.p_id: (r.g_id, r.overlap) for r in S.scan_match(p, g, "file").collect()}
    assert got == {1: (2, 3.0), 2: (3, 2.0), 3: (None, 0.0), 4: (None, 0.0)}


def test_gaps(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 7.0, 9.0), (1, 9.5, 10.0)], "k int, start double, end double")
    assert [tuple(r) for r in S.gaps(df, "k", "start", "end").collect()] == [(1, 5.0, 7.0, "gap")]


def test_edit_candidates_against_all_pairs(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)})

    def dist(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    w, lex = spark.createDataFrame([(x,) for x in words[:15]], "word string"), spark.createDataFrame([(x, 5) for x in words], "entry string, freq int")
    got = {(r.word, r.entry, r.distance) for r in J.edit_candidates(w, lex, 2, top=1000).collect()}
    assert got == {(a, b, dist(a, b)) for a in words[:15] for b in words if 0 < dist(a, b) <= 2}


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, 1_700_000_000 + 97 * i, i % 3, "ab"[i % 2], float(i)) for i in range(200)], "event_id long, s long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r.window.start, r.event_type, r.n) for r in sessions.windowed(events).collect())
    assert sorted((r.window.start, r.event_type, r.n) for r in spark.table("w").collect()) == want


def test_stream_cursor(spark, tmp_path):
    lines = ["a b c", "d e f", "g h i"]
    rows = [("s", 0, "a b c"), ("s", 1, "d e f"), ("s", 2, "zzz"), ("s", 3, "a b c"), ("t", 0, "g h i")]
    df = spark.createDataFrame(rows, "session_id string, sequence long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.cursor(stream, lines).writeStream.format("memory").queryName("c").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.session_id, r.sequence, r.line_no, r.new_poem, r.misses) for r in spark.table("c").collect())
    assert got == [("s", 0, 0, True, 0), ("s", 1, 1, False, 0), ("s", 2, 1, False, 1), ("s", 3, 0, False, 0), ("t", 0, 2, True, 0)]


def test_latest(spark):
    df = spark.createDataFrame([("a", "draft", "x"), ("a", "verified", "y"), ("b", "draft", "z")], "segment_id string, phase string, text string")
    assert {r.segment_id: r.text for r in sessions.latest(df).collect()} == {"a": "y", "b": "z"}
