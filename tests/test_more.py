"""Sources, sinks, evaluation, matching, scripts, segments and live sessions, on small tables and against brute force."""

import json
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmenta.functions import registry
from segmenta.functions import scripts as X
from segmenta.operators import evaluate as E
from segmenta.operators import matching as M
from segmenta.operators import segments as G
from segmenta.sources import readers as R
from segmenta.sources import sinks as K
from segmenta.streaming import live


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# sources and sinks


def test_search(spark):
    lines = table(spark, [(1, "siq nwmu", "a"), (2, "SIQ x", "b"), (3, "50% siq", "a"), (4, None, "a")], "line_no int, text string, source string")
    ids = lambda df: [r.line_no for r in df.collect()]
    assert ids(R.search_lines(lines, "siq")) == [1, 2, 3] and ids(R.search_lines(lines, "siq", case_sensitive=True)) == [1, 3]
    assert ids(R.search_lines(lines, "  ")) == ids(R.search_lines(lines, "")) == [] and ids(R.search_lines(lines, "0%")) == [3]
    assert ids(R.search_lines(lines, "ਸਤਿ", encode=lambda t: X.SEARCH_WORDS.get(t, t))) == [1, 2, 3]
    assert ids(R.search_sources(lines, "siq", k=1).orderBy("line_no")) == [1, 2] and ids(R.search_sources(lines, "siq", sources=["b"])) == [2]


def test_records(spark):
    d = table(spark, [("7", " a ", "12", "w"), ("8", "", "x", None)], "id string, gurmukhi string, page string, writer string")
    got = [tuple(r) for r in R.line_records(d).collect()]
    assert got == [("7", "a", 12, None, "w", None), ("8", None, None, None, None, None)]
    assert R.resolve(d, ["none", "page"]) == "page" and R.resolve(d, ["none"]) == "id"


def test_read_log_truth_transcripts(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps([{"filename": "a", "status": "success", "file_hash": "1"}]))
    (tmp_path / "bad.json").write_text("{oops")
    assert [r.filename for r in R.read_log(spark, str(tmp_path / "log.json")).collect()] == ["a"] and R.read_log(spark, str(tmp_path / "bad.json")).count() == 0
    truth = {"audio_file": "f", "segments": [{"start": 0.0, "end": 5.0, "ground_truth_gurmukhi": "x", "quotes": [{"quote_start": 1.0, "quote_end": 2.0, "canonical_line_id": "L"}]}, {"start": 5.0, "end": 6.0, "ground_truth_gurmukhi": "y"}]}
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    seg, quotes = R.read_truth(spark, str(tmp_path / "truth.json"))
    assert [(r.start, r.ground_truth_gurmukhi) for r in seg.orderBy("pos").collect()] == [(0.0, "x"), (5.0, "y")]
    assert [(r.segment_start, r.quote_start, r.canonical_line_id) for r in quotes.collect()] == [(0.0, 1.0, "L")]
    for i, doc in enumerate(({"file": "a", "transcription": "all of it"}, {"file": "b", "transcription": "t", "segments": [{"start": 1.0, "end": 2.0, "text": "one"}]})):
        (tmp_path / f"t{i}.json").write_text(json.dumps(doc))
    got = {(r.file, r.text) for r in R.read_transcripts(spark, str(tmp_path / "t[01].json")).collect()}
    assert got == {("a", "all of it"), ("b", "one")}


def test_output_paths_audio_settings_speech_sets(spark, tmp_path):
    files = table(spark, [("My Talk 1.txt",), ("my_talk-1.TXT",), ("other.txt",)], "file string")
    got = {r.name: r.file for r in R.resolve_outputs(table(spark, [("my_talk-1.TXT",), ("mytalk1.json",), ("none.txt",)], "name string"), files).collect()}
    assert got == {"my_talk-1.TXT": "my_talk-1.TXT", "mytalk1.json": "My Talk 1.txt", "none.txt": None}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.mp3").write_bytes(b"12")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert [(r.name, r.length) for r in R.audio_files(spark, str(tmp_path)).collect()] == [("a.mp3", 2)]
    assert R.overlay({"a": {"x": 1, "y": 2}, "b": 3}, {"a": {"y": 5}, "c": 1}) == {"a": {"x": 1, "y": 5}, "b": 3, "c": 1} and R.overlay({"a": 1}, None) == {"a": 1}
    (tmp_path / "m.tsv").write_text("path\tsentence\nx.mp3\thello there\n")
    (tmp_path / "n.csv").write_text("x.mp3|hello\ny.mp3|bye\n")
    assert [tuple(r) for r in R.read_speech_set(spark, str(tmp_path / "m.tsv")).collect()] == [("x.mp3", "hello there")]
    assert [tuple(r) for r in R.read_speech_set(spark, str(tmp_path / "n.csv")).collect()] == [("x.mp3", "hello"), ("y.mp3", "bye")]


def _sections(spark):
    rows = [("T & t", "2024", 1, "quote", None, "q <1>", 65.0, 0.5), ("T & t", "2024", 0, "opening_gurbani", "first", None, None, None)]
    return table(spark, rows, "title string, created_at string, pos int, section_type string, text string, quote_text string, start_time double, confidence double")


def test_documents(spark):
    md = K.export(_sections(spark), "Markdown").first().content
    assert md.startswith("# T & t\n\n**Created:** 2024\n**Sections:** 2\n\n---\n\n## Opening Gurbani\n\nfirst\n\n## Quote\n\n> q <1>\n\n[Time: 01:05]")
    page = K.export(_sections(spark), "html").first().content
    assert "<h1>T &amp; t</h1>" in page and "<blockquote>q &lt;1&gt;</blockquote>" in page
    doc = json.loads(K.export(_sections(spark), "json").first().content)
    assert [s["text"] for s in doc["sections"]] == ["first", "q <1>"] and "start_time" not in doc["sections"][0] and doc["sections"][1]["confidence"] == 0.5
    with pytest.raises(ValueError, match="html, json, markdown"):
        K.export(_sections(spark), "docx")


def test_captions(spark):
    d = table(spark, [("f", 2.0, 3.5, "", "rom", "speech"), ("f", 0.0, 1.0, "hi", None, "scripture_quote")], "file string, start double, end double, text string, roman string, type string")
    assert K.captions(d).first().content == "1\n00:00:00,000 --> 00:00:01,000\nhi\n\n2\n00:00:02,000 --> 00:00:03,500\nrom\n"
    assert K.captions(d, vtt=True).first().content.startswith("WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\n<c.quote>hi</c>")


def test_writes(spark, tmp_path):
    seg = table(spark, [("a", 1.0, "two"), ("a", 0.0, "one"), ("b", 0.0, "x")], "file string, start double, text string")
    K.write_results(seg, str(tmp_path / "out"))
    assert {(r.file, r.value) for r in spark.read.text(str(tmp_path / "out/text")).collect()} == {("a", "one two"), ("b", "x")} and spark.read.json(str(tmp_path / "out/json")).count() == 3
    for _ in range(2):
        K.append_log(table(spark, [("a", "success")], "filename string, status string"), str(tmp_path / "log"))
    assert R.read_log(spark, str(tmp_path / "log")).count() == 2
    K.write_by_language(table(spark, [("en", "x"), ("hi", "y")], "target_language string, text string"), str(tmp_path / "tr"))
    assert sorted(p.name for p in (tmp_path / "tr").iterdir() if p.is_dir()) == ["target_language=en", "target_language=hi"]
    K.write_review_queue(seg, str(tmp_path / "q"))
    K.save_table(seg, str(tmp_path / "lex"))
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == spark.read.parquet(str(tmp_path / "lex")).count() == 3
    truth = K.with_segment(K.truth_template(table(spark, [("a",)], "audio_file string")), table(spark, [("a", 2.0, 3.0, "t", None)], "audio_file string, start double, end double, ground_truth_gurmukhi string, ground_truth_roman string"))
    assert [len(r.problems) for r in E.truth_problems(truth, "audio_file", "start", "end", "ground_truth_gurmukhi").orderBy("start").collect()] == [2, 0]


# evaluation


def _edits(a, b):
    """All of (edits, -hits) by plain dynamic programming."""
    d = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                ways = []
                if i and j:
                    e, h = d[i - 1][j - 1]
                    ways.append((e, h - 1) if a[i - 1] == b[j - 1] else (e + 1, h))
                if i:
                    ways.append((d[i - 1][j][0] + 1, d[i - 1][j][1]))
                if j:
                    ways.append((d[i][j - 1][0] + 1, d[i][j - 1][1]))
                d[i][j] = min(ways)
    return d[-1][-1]


def test_word_edits_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        s, i, d, h = E.word_edits(a, b)
        assert (s + i + d, -h) == _edits(a, b) and s + d + h == len(a) and s + i + h == len(b) and min(s, i, d, h) >= 0


def test_error_rates(spark, tmp_path):
    rows = [("f", "pa", "a b c d", "a x c"), ("f", "en", "one", "one"), ("g", "en", "", ""), ("g", "en", "", "x"), ("g", "pa", None, None)]
    e = E.segment_errors(table(spark, rows, "file string, language string, truth string, said string"))
    got = [(r.substitutions, r.insertions, r.deletions, r.hits, r.wer) for r in e.collect()]
    assert got == [(1, 0, 1, 2, 0.5), (0, 0, 0, 1, 0.0), (0, 0, 0, 0, 0.0), (0, 1, 0, 0, 1.0), (0, 0, 0, 0, 0.0)]
    by = {r.language: (r.segments, r.overall_wer) for r in E.totals(e, "language").collect()}
    assert by == {"pa": (2, 0.5), "en": (3, 1.0)}
    assert E.macro(e.filter("file = 'f'")).first().wer == pytest.approx(0.4)
    assert K.error_report(e, str(tmp_path / "r"))["overall_wer"] == pytest.approx(0.6) and spark.read.option("header", True).csv(str(tmp_path / "r/csv")).count() == 5


def test_quote_outcomes(spark, tmp_path):
    p = table(spark, [(1, "A", "x"), (2, None, "y")], "p_id long, source string, line_id string")
    t = table(spark, [(7, "A", "x"), (8, "B", "z"), (9, None, "z")], "g_id long, expected_source string, expected_line string")
    o = E.outcomes(p, t, table(spark, [(1, 7)], "p_id long, g_id long"))
    assert sorted((r.outcome, r.source, r.right_line) for r in o.collect()) == [("fn", "B", None), ("fn", "Unknown", None), ("fp", "Unknown", None), ("tp", "A", True)]
    m = E.precision_recall(o).first()
    assert (m.tp, m.fp, m.fn, m.precision, round(m.recall, 4), round(m.f1, 4)) == (1, 1, 2, 0.5, 0.3333, 0.4)
    rep = K.quote_report(o.withColumns({"file": F.lit("f"), "start": F.lit(0.0), "line_id": F.lit("x")}), str(tmp_path / "q"), examples=1)
    assert rep["scores"]["fp"] == 1 and len(rep["examples"]["fn"]) == 1
    q = table(spark, [(0.0, 5.0, 1.0, 2.0, "L"), (0.0, 5.0, 4.0, 6.0, ""), (0.0, 5.0, 2.0, 1.0, "L")], "segment_start double, segment_end double, quote_start double, quote_end double, canonical_line_id string")
    assert [len(r.problems) for r in E.quote_problems(q).collect()] == [0, 2, 1]


# matching


def test_matching_in_native_script(spark):
    lines = table(spark, [(1, "ਸਤਿ ਨਾਮੁ ਕਰਤਾ ਪੁਰਖੁ ਨਿਰਭਉ", 5), (2, "ਆਦਿ ਸਚੁ ਜੁਗਾਦਿ ਸਚੁ", 1), (3, "ਸਤਿ ਨਾਮੁ ਹੈ", 9)], "item_id long, line string, ang int")
    seg = table(spark, [(10, "ਸਤਿ  ਨਾਮੁ ਕਰਤਾ ਪੁਰਖੁ ਨਿਰਭਉ", 5), (11, "ਕੁਝ ਹੋਰ", 5), (12, "ਸਤਿ ਨਾਮੁ", 9)], "seg_id long, said string, hint int")
    got = {r.seg_id: (r.item_id, r.confidence, r.method, r.alternates) for r in M.assisted_match(seg, lines, "said", "line", "seg_id", "item_id").collect()}
    assert got[10] == (1, 1.0, "semantic", []) and 11 not in got
    al = {r.seg_id: (r.item_id, r.confident, r.action) for r in M.aligned(seg, lines, "said", "line", "seg_id", "item_id", hint="hint", page="ang").collect()}
    assert al[10] == (1, True, "force") and al[11] == (None, None, "none") and al[12][0] == 3
    con = {(r.seg_id, r.item_id) for r in M.contained(seg, lines, "said", "line", "seg_id", "item_id").collect()}
    assert con == {(10, 1), (12, 1), (12, 3)}
    h = table(spark, [(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.7)], "seg_id long, text string, confidence double")
    assert tuple(M.primary_of(h, "seg_id").first()) == (1, "b", ["c", "a"])


def test_contained_against_brute_force(spark):
    rng = random.Random(3)
    seg = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    lines = [(i, " ".join(rng.choice("abcd") for _ in range(8))) for i in range(40)]
    got = {(r.s, r.i) for r in M.contained(table(spark, seg, "s long, t string"), table(spark, lines, "i long, l string"), "t", "l", "s", "i").collect()}
    assert got == {(s, i) for s, t in seg for i, line in lines if f" {t} " in f" {line} "}


def test_translations(spark):
    lines = table(spark, [(1, "a"), (2, "b"), (3, "c")], "key long, text string")
    cache = table(spark, [(1, "en", "A"), (2, "hi", "B")], "key long, language string, translation string")

    def provider(batches):
        for b in batches:
            yield pd.DataFrame({"key": b.key, "translation": [t.upper() if t != "c" else None for t in b.text]})

    assert {(r.key, r.translation, r.origin) for r in M.translated(lines, cache, "key", "en", provider).collect()} == {(1, "A", "cached"), (2, "B", "translated"), (3, None, "missing")}


# scripts


def test_scripts(spark):
    lit = F.lit
    assert one(spark, X.tokens(lit("ਸਤਿ-ਨਾਮੁ, Ek"))) == ["ਸਤਿ", "ਨਾਮੁ", "ek"] and one(spark, X.tokens(lit("ਸਤਿ"), keep_marks=False)) == ["ਸਤ"]
    assert one(spark, X.block_words(lit("ab ਸਤਿ c ਨਾਮੁ"))) == ["ਸਤਿ", "ਨਾਮੁ"]
    assert one(spark, X.search_encoding(lit("ਸਤਿ ਨਾਮੁ ਕਲ x"))) == "siq nwmu kl x"
    n = {k: one(spark, v) for k, v in X.census(lit("ਸਤਿ ab अ ا 1!漢")).items()}
    assert n == {"gurmukhi": 3, "latin": 2, "devanagari": 1, "arabic": 1, "neutral": 6, "other": 1}
    assert one(spark, X.purity(X.census(lit("12 !")))) == 1.0 and one(spark, X.valid(X.census(lit("ਸਤਿਨਾਮੁ")))) and not one(spark, X.valid(X.census(lit("ਸਤਿ abc")), strict=False))
    for text, want in (("ਸਤਿ ਨਾਮੁ ਕਰਤਾ ਪੁਰਖੁ", ("gurmukhi", 1.0)), ("abc", ("latin", 0.8)), ("ਸਤਿ abcd", ("mixed", 0.571429)), ("", ("unknown", 0.0)), ("12", ("unknown", 0.0))):
        assert tuple(one(spark, X.detected(lit(text)))) == want
    assert one(spark, X.detected(lit("abcdef"), lit("pa"))).confidence == 0.9
    assert X.romanize_text("ਸਤਿ ਨਾਮੁ ਪੱਕਾ ਸੰਤ 1") == "Sati Nāmu Pkā Saṃta 1" and X.romanize_text("ਜ਼ੋਰ", capitals=False) == "zora"
    assert X.repair_text("ਸਤਿ  nam सत internationally 漢 !") == "ਸਤਿ ਨਾਮ ਸਤ !"
    text, sure = X.from_arabic("کھبَ ع9", {"x": "y"})
    assert text == "ਖ਼ਬਾ 9" and abs(sure - ((0.9 + 0.9 + 0.8) / 3 + 1.0) / 2) < 1e-9
    assert X.from_arabic("رام", {"رام": "ਰਾਮ"}) == ("ਰਾਮ", 0.95)
    got = one(spark, X.converted(lit("رام جی")))
    assert got.script == "arabic" and got.gurmukhi and got.roman and got.needs_review in (True, False)
    assert one(spark, X.nasal_signs(lit("ਸਂਤ ਮੰਾ ਹੈਂ"))) == "ਸੰਤ ਮਂਾ ਹੈੰ"
    assert one(spark, X.normalized(lit("é"))) == "é"
    assert one(spark, X.page_reference(lit("see Ang ੧੨੩."))) == 123 and one(spark, X.page_reference(lit("page: 45"))) == 45 and one(spark, X.page_reference(lit("none"))) is None
    f = {k: one(spark, v) for k, v in X.drift(lit("see http://x.org"), lit(0.0), lit(0)).items()}
    assert f["severity"] == "critical" and f["action"] == "reject" and "link" in f["types"]
    assert one(spark, X.drift(lit("ਸਤਿ ਨਾਮੁ"), lit(0.0), lit(0))["severity"]) == "none"
    assert one(spark, X.acceptable(lit("medium"), "medium")) and not one(spark, X.acceptable(lit("high"), "medium"))
    assert one(spark, X.correct_words(lit("The teh, cat!"), F.create_map(lit("teh"), lit("the")))) == "The the, cat!"


# segments


def test_segments(spark):
    lit = F.lit
    d = table(spark, [(1, ("L", 0.9))], "confidence int, quote_match struct<line_id:string,confidence:double>")
    assert G.flattened(d).columns == ["confidence", "line_id", "quote_match_confidence"]
    assert one(spark, G.looks_like_scripture(lit("ਸਤਿ ਨਾਮੁ a"))) and one(spark, G.looks_like_scripture(lit("abc ॥"))) and not one(spark, G.looks_like_scripture(lit("abc")))
    assert one(spark, G.placeholder(lit(" "), lit(None))) == G.SILENT and one(spark, G.placeholder(lit("x"), lit("e"))) == G.FAILED
    s = {k: one(spark, v) for k, v in G.context_signals(lit("as it is said"), ["it is said"], ["nanak"], lit(0.0)).items()}
    assert s == {"confidence": 0.3, "likely": True, "kind": "intro"}
    m = one(spark, G.mode_scores(lit("we say nanak"), ["we say"], ["nanak"], lit(0.5)))
    assert (m.mode, m.confidence) == ("verse", 0.75)
    assert one(spark, G.rounded_time(lit(3661.2346))) == "01:01:01.235" and one(spark, G.safe_name(lit(" a b/c.mp3"))) == "a_b_c.mp3"
    assert one(spark, G.engine_confidence(lit(None).cast("double"), lit(None).cast("double"))) == 0.9
    assert one(spark, G.remaining_time(lit(30.0), lit(25.0))) == 90.0 and one(spark, G.remaining_time(lit(30.0), lit(0.0))) is None
    assert one(spark, F.length(G.prompt(lit("w " * 200), lit(None).cast("string"), lit("z" * 80)))) == 224


def test_continued_context_against_fold(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice(["intro", "none", "dense"]), rng.randrange(4) / 10, rng.randrange(4) / 10) for k in range(5) for i in range(30)]
    got = {(r.k, r.i): (r.kind, r.confidence) for r in G.continued_context(table(spark, rows, "k int, i int, kind string, confidence double, density double"), "k", "i").collect()}
    for k in range(5):
        before = "none"
        for _, i, kind, c, dense in [r for r in rows if r[0] == k]:
            if before == "intro":
                kind, c = "quote_start", min(1.0, c + 0.3)
            elif before in ("quote_start", "quote_middle") and dense >= 0.15:
                kind, c = "quote_middle", min(1.0, c + 0.2)
            assert got[k, i] == (kind, round(c, 6))
            before = kind


def test_sections_and_picks(spark):
    rows = [("f", 0.0, "a quote", True), ("f", 5.0, "hello all", False), ("f", 7.0, "the topic of today is long", False), ("f", 30.0, "quote", True), ("f", 400.0, "talk", False)]
    got = G.sections(table(spark, rows, "file string, start double, text string, has_quote boolean"), "file", ["topic"], r"\bhello\b")
    assert [(r.section_type, r.confidence) for r in got.orderBy("start").collect()] == [("opening_gurbani", 0.95), ("fateh", 0.9), ("topic", 0.9), ("quote", 0.95), ("katha", 0.8)]
    p = G.picked(got, "file").first()
    assert (p.openings, p.fateh, p.topic) == (["a quote"], "hello all", "the topic of today is long")


def test_chunks_and_tokens(spark):
    f = table(spark, [("f", i / 10, i < 700) for i in range(720)], "file string, at double, voiced boolean")
    got = [(round(r.start, 3), round(r.end, 3)) for r in G.voiced_chunks(f, "file", "at", "voiced", 0.1).orderBy("start").collect()]
    assert got == [(0.0, 23.333), (23.333, 46.667), (46.667, 70.0)]
    p = table(spark, [("f", 0.2, 3.0), ("f", 3.2, 6.0), ("f", 9.0, 9.2)], "file string, start double, end double")
    assert [(r.start, r.end) for r in G.padded(p, "file").orderBy("start").collect()] == [(0.2, 3.2), (2.7, 6.5)]
    t = table(spark, [("f", i, x, 0.5) for i, x in enumerate("aab|cc")] + [("f", 6, "<pad>", 0.1), ("f", 7, "c", 1.0)], "file string, n int, tok string, p double")
    assert [(r.word, round(r.start, 2), round(r.end, 2)) for r in G.token_words(t, "file", "n", "tok", "p", 0.1).orderBy("start").collect()] == [("ab", 0.0, 0.3), ("cc", 0.4, 0.8)]
    c = table(spark, [(0.0, 2.0, 0.25, 1.0, 5.0), (6.0, 7.0, 0.0, 1.0, 5.0)], "start double, end double, no_speech double, a double, b double")
    assert [(r.start, r.end, r.confidence) for r in G.clipped(c, "a", "b").collect()] == [(1.0, 2.0, 0.75)]


def test_fusion(spark):
    h = table(spark, [(1, 0, "same text", 0.8), (1, 1, "same text", 0.9), (2, 0, "abc", 0.5), (2, 1, "xyz", 0.4), (3, 0, "alone", 0.95)], "seg long, hyp_id long, text string, confidence double")
    got = {r.seg: (r.hyp_id, r.agreement, r.fused, r.redecode) for r in G.fused(h).collect()}
    assert got == {1: (1, 1.0, 1.0, False), 2: (0, 0.0, 0.5, True), 3: (0, 1.0, 1.0, False)}
    asked = []

    def decode(segs, k):
        asked.append(sorted(r.seg for r in segs.collect()))
        return segs.select("seg", F.lit(10 + k).cast("long").alias("hyp_id"), F.lit("abc").alias("text"), F.lit(0.7).alias("confidence"))

    again = {r.seg: (r.hyp_id, r.text) for r in G.fused_again(h, decode).collect()}
    assert again[2] == (10, "abc") and asked[0] == [2]
    r = G.rescored(h, "seg", F.col("confidence"), F.lit(0.0), F.lit(0.5)).filter("rank = 1 and seg = 1").first()
    assert (r.hyp_id, r.score) == (1, 0.78)


def test_logs_and_accounts(spark):
    log = table(spark, [(0, "a", "1", "success"), (1, "a", "2", "success"), (2, "b", "1", "error")], "pos long, filename string, file_hash string, status string")
    files = table(spark, [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "filename string, file_hash string")
    assert {(r.filename, r.file_hash): r.done for r in G.processed_before(files, log).collect()} == {("a", "1"): True, ("a", "2"): False, ("b", "1"): False, ("c", "1"): False}
    assert {tuple(r) for r in G.not_done(files, log).collect()} == {("b", "1"), ("c", "1")}
    inv = table(spark, [("x", None, datetime(2030, 1, 1)), ("y", datetime(2020, 1, 1), datetime(2030, 1, 1)), ("z", None, datetime(2020, 1, 1))], "email string, used_at timestamp, expires_at timestamp")
    got = G.invitable(table(spark, [("x",), ("y",), ("z",), ("w",)], "email string"), inv, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.email for r in got.collect()) == ["w", "y", "z"]


# extension points and live sessions


def test_registry(spark):
    reg = registry.Registry()
    made = []

    def engine(batches):
        for b in batches:
            yield pd.DataFrame({"t": b.t.str.upper()})

    def broken(batches):
        for _ in batches:
            raise RuntimeError("down")

    reg.register(registry.Provider("up", lambda: made.append(1) or engine, languages=frozenset(["en"])))
    reg.register(registry.Provider("gone", lambda: engine, available=lambda: False))
    assert reg.names() == ["up"] and reg.names(language="pa") == [] and reg.get("gone", "up") is reg.get("up") and made == [1]
    with pytest.raises(ValueError, match="there are: up"):
        reg.get("gone")
    d = table(spark, [("a",), ("b",)], "t string")
    assert sorted(r.t for r in registry.run_with_fallback(d, [broken, engine], "t string").collect()) == ["A", "B"]


def _stream(spark, tmp_path, rows, schema, make, mode="append", name="out"):
    d = table(spark, rows, schema)
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = make(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_followed_sessions(spark, tmp_path):
    lines = [("p1", "a b c"), ("p1", "d e f"), ("p2", "g h i")]
    text = lambda s, n, t: (s, n, "text", t, None)
    rows = [text("s", 0, "a b c"), ("s", 1, "preference", None, "hi"), text("s", 2, "d e f"), text("s", 3, "zz"), ("s", 4, "reset", None, None), text("s", 5, "d e f"), text("t", 0, "g h i"), *(text("t", n, "?") for n in range(1, 5)), text("t", 5, "a b c")]
    got = sorted(tuple(r) for r in _stream(spark, tmp_path, rows, live.EVENTS, lambda s: live.followed(s, lines), name="followed").collect())
    assert [r[1:] for r in got if r[0] == "s"] == [(0, 0, True, 0, 1, ""), (2, 1, False, 0, None, "hi"), (3, 1, False, 1, None, "hi"), (5, 1, True, 0, None, "hi")]
    assert [r[1:5] for r in got if r[0] == "t"] == [(0, 2, True, 0), (1, 2, False, 1), (2, 2, False, 2), (3, 2, False, 3), (4, -1, False, 0), (5, 0, True, 0)]


def test_chunks_phases_and_push(spark, tmp_path):
    raw = table(spark, [("s", 1, datetime(2024, 1, 1), 1.5, None, "x")], "session_id string, sequence long, session_start timestamp, start_time double, end_time double, text string")
    c = live.chunks(raw, "verse")
    r = c.first()
    assert (r.end_time, r.segment_id) == (3.5, "seg_1.50_3.50")
    both = live.two_phases(c, lambda d: d.withColumn("text", F.upper("text")))
    assert [(r.segment_id, r.phase, r.text) for r in live.latest_view(both).collect()] == [("seg_1.50_3.50", "verified", "X")]
    sent = tmp_path / "sent"
    sent.mkdir()
    d = table(spark, [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "session_id string, sequence long, text string")
    d.write.parquet(str(tmp_path / "in"))
    send = lambda room, rows: (sent / room).write_text("".join(r["text"] for r in rows))
    K.push(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), send, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {p.name: p.read_text() for p in sent.iterdir()} == {"a": "xy", "b": "z"}


def test_counters_progress_suggestions(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    e = table(spark, [("s", at(1), "chunk"), ("s", at(2), "draft"), ("s", at(3), "chunk"), ("t", at(1), "verified")], "session_id string, ts timestamp, kind string")
    assert {r.session_id: (r.chunks, r.drafts, r.verified, r.detected) for r in live.counters(e).collect()} == {"s": (2, 1, 0, 0), "t": (0, 0, 1, 0)}
    p = table(spark, [("x", at(1), 10.0, 1.0), ("x", at(5), 50.0, 5.0), ("y", at(2), 100.0, 2.0)], "task_id string, ts timestamp, percent double, elapsed double")
    assert {r.task_id: (r.percent, r.left, r.finished) for r in live.progress(p).collect()} == {"x": (50.0, 5.0, False), "y": (100.0, 0.0, True)}
    near = table(spark, [(3, ["l4", "l5"])], "line_no int, suggestions array<string>")
    got = _stream(spark, tmp_path, [("s", 3), ("s", 4)], "session_id string, line_no int", lambda s: live.with_suggestions(s, near), name="suggested")
    assert {r.line_no: r.suggestions for r in got.collect()} == {3: ["l4", "l5"], 4: None}


def test_batch_sessions_and_dedup(spark, tmp_path):
    from segmenta.streaming import sessions

    at = lambda m: datetime(2024, 1, 1, m // 60, m % 60)
    rows = [(1, at(0), 5), (2, at(10), 5), (2, at(10), 5), (3, at(100), 5), (4, at(0), 6)]
    got = _stream(spark, tmp_path, rows, "event_id long, ts timestamp, user_id long", sessions.deduplicated, name="dedup")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]
    d = table(spark, rows, "event_id long, ts timestamp, user_id long").distinct()
    assert sorted((r.user_id, r.n) for r in sessions.sessions(d).collect()) == [(5, 1), (5, 2), (6, 1)]
