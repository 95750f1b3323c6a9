"""Further queries: sources, documents, evaluation, matching, scripts, sequences, accounts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts as X
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import vectors as V
from ..operators import matching as M
from ..operators import segments as G
from ..session import table
from ..sources import readers as R
from ..sources import sinks as K
from .catalog import _KEYS, W_SQL, _intervals, _lines, _r, _vectors, query

# one corpus with a source column
_CORPUS_SQL = "corpus AS (SELECT 'benchmark' AS source, item_id AS line_no, text FROM benchmark UNION ALL SELECT 'conversation', conv_id * 1000 + turn, text FROM conversations)"


def _corpus(spark, d) -> DataFrame:
    a = table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("line_no"), "text")
    return a.unionByName(table(spark, d, "conversations").select(F.lit("conversation").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), "text"))


@query("SELECT item_id AS line_no, text FROM benchmark WHERE contains(lower(text), 'than') ORDER BY item_id LIMIT 10")
def line_search(spark, d):
    return R.search_lines(table(spark, d, "benchmark").select(F.col("item_id").alias("line_no"), "text"), "Than")


@query("SELECT item_id AS line_no, text FROM benchmark WHERE contains(text, 'That') ORDER BY item_id LIMIT 10")
def line_search_case(spark, d):
    return R.search_lines(table(spark, d, "benchmark").select(F.col("item_id").alias("line_no"), "text"), "That", case_sensitive=True)


@query(f"WITH {_CORPUS_SQL} SELECT source, line_no, text FROM corpus WHERE contains(lower(text), 'th') QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no) <= 10")
def corpus_search(spark, d):
    return R.search_sources(_corpus(spark, d), "th").select("source", "line_no", "text")


@query("SELECT doc_id, trim(text, ' \t\n\r') AS text FROM documents WHERE trim(text, ' \t\n\r') <> ''")
def text_scan(spark, d):
    return R.text_scan(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {_CORPUS_SQL} SELECT source, count(*) AS n_lines, sum(len({W_SQL.format('text')}))::BIGINT AS n_words FROM corpus GROUP BY source")
def corpus_lines(spark, d):
    c = _corpus(spark, d).select("source", T.words(F.col("text")).alias("w"))
    return c.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.size("w")).cast("long").alias("n_words"))


@query("SELECT doc_id, text FROM documents WHERE length(trim(text)) > 5 ORDER BY doc_id LIMIT 100000")
def embedding_input(spark, d):
    return R.embedding_input(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS line_id, nullif(trim(p_name), '') AS text, TRY_CAST(p_size AS INTEGER) AS ang, NULL::VARCHAR AS roman, nullif(trim(p_brand), '') AS author, nullif(trim(p_type), '') AS raag FROM part")
def line_records(spark, d):
    return R.line_records(table(spark, d, "part").selectExpr("p_partkey as id", "p_name as text", "p_size as page", "p_brand as writer", "p_type as section"))


def _sections(spark, d):
    c = table(spark, d, "conversations")
    return c.select(
        F.concat(F.lit("Session "), F.col("conv_id").cast("string")).alias("title"),
        F.lit("2024-01-01").alias("created_at"),
        F.col("turn").alias("pos"),
        F.when(F.col("role") == "user", "topic").otherwise("katha").alias("section_type"),
        F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"),
        F.when(F.col("turn") % 3 == 0, F.col("text")).alias("quote_text"),
        (F.col("turn") * 5).cast("double").alias("start_time"),
        F.lit(None).cast("double").alias("confidence"),
    )


_MMSS = "lpad(((turn * 5) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 5) % 60)::VARCHAR, 2, '0')"


@query(f"""SELECT 'Session ' || conv_id AS title, '# Session ' || conv_id || chr(10) || chr(10) || '**Created:** 2024-01-01' || chr(10) || '**Sections:** ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| string_agg('## ' || CASE WHEN role = 'user' THEN 'Topic' ELSE 'Katha' END || chr(10) || chr(10) || CASE WHEN turn % 3 = 0 AND text IS NOT NULL THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE coalesce(text, '') END || chr(10) || chr(10) || '[Time: ' || {_MMSS} || ']', chr(10) || chr(10) ORDER BY turn) || chr(10) AS content FROM conversations GROUP BY conv_id""")
def markdown_document(spark, d):
    return K.export(_sections(spark, d), "markdown")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query(f"""SELECT 'Session ' || conv_id AS title, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Session ' || conv_id || '</title></head><body>' || chr(10) || '<h1>Session ' || conv_id || '</h1>' || chr(10)
|| string_agg('<section class="' || CASE WHEN role = 'user' THEN 'topic' ELSE 'katha' END || '"><h2>' || CASE WHEN role = 'user' THEN 'Topic' ELSE 'Katha' END || '</h2><' || CASE WHEN turn % 3 = 0 AND text IS NOT NULL THEN 'blockquote' ELSE 'p' END || '>' || {_ESC.format("coalesce(text, '')")} || '</' || CASE WHEN turn % 3 = 0 AND text IS NOT NULL THEN 'blockquote' ELSE 'p' END || '></section>', chr(10) ORDER BY turn) || chr(10) || '</body></html>' AS content FROM conversations GROUP BY conv_id""")
def html_document(spark, d):
    return K.export(_sections(spark, d), "html")


@query()
def json_document(spark, d):
    return K.export(_sections(spark, d), "json")


@query("""SELECT conv_id AS file, 'WEBVTT' || chr(10) || chr(10) || string_agg(format('{}\n{} --> {}\n{}\n', turn + 1, '00:' || lpad(((turn * 5) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 5) % 60)::VARCHAR, 2, '0') || '.000',
'00:' || lpad(((turn * 5 + 4) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 5 + 4) % 60)::VARCHAR, 2, '0') || '.500', CASE WHEN role = 'user' THEN '<c.quote>' || coalesce(nullif(text, ''), '(roman)') || '</c>' ELSE coalesce(nullif(text, ''), '(roman)') END), '\n' ORDER BY turn) AS content FROM conversations GROUP BY conv_id""")
def vtt_captions(spark, d):
    start = (F.col("turn") * 5).cast("double")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), start.alias("start"), (start + 4.5).alias("end"), "text", F.lit("(roman)").alias("roman"), F.when(F.col("role") == "user", "scripture_quote").otherwise("speech").alias("type"))
    return K.captions(c, vtt=True)


# evaluation: what was said is the truth with words left out, exchanged and added by rule
def _said(spark, d):
    w = T.words(F.col("text"))
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", w.alias("w"))
    changed = F.transform(F.filter("w", lambda x, i: i % 7 != 6), lambda x, i: F.when(i % 5 == 4, F.concat(x, F.lit("x"))).otherwise(x))
    return c.select(F.col("conv_id").alias("file"), "turn", F.col("role").alias("language"), F.array_join("w", " ").alias("truth"), F.array_join(changed, " ").alias("said"), (F.lit(0.5) + (F.col("turn") % 5) / 10).alias("confidence"))


@query()
def word_errors(spark, d):
    return E.segment_errors(_said(spark, d))


@query()
def word_error_totals(spark, d):
    return E.totals(E.segment_errors(_said(spark, d)), "language")


@query()
def word_error_macro(spark, d):
    return E.macro(E.segment_errors(_said(spark, d).filter("language = 'user'")))


_OUT_SQL = """p AS (SELECT event_id AS p_id, event_id % 10 AS line_id, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS source FROM events WHERE event_id % 2 = 0),
t AS (SELECT event_id AS g_id, event_id % 10 AS expected_line, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS expected_source FROM events WHERE event_id % 3 = 0),
m AS (SELECT p_id, g_id FROM p JOIN t ON p_id = g_id),
o AS (SELECT CASE WHEN g_id IS NULL THEN 'fp' ELSE 'tp' END AS outcome, coalesce(source, 'Unknown') AS source, line_id = expected_line AS right_line FROM p LEFT JOIN m USING (p_id) LEFT JOIN t USING (g_id)
UNION ALL SELECT 'fn', coalesce(expected_source, 'Unknown'), NULL FROM t ANTI JOIN m USING (g_id))"""


def _outcomes(spark, d):
    e = table(spark, d, "events")
    src = lambda c, n: F.when(c % n == 0, "A").when(c % n == 1, "B")
    i = F.col("event_id")
    p = e.filter("event_id % 2 = 0").select(i.alias("p_id"), (i % 10).alias("line_id"), src(i, 3).alias("source"))
    t = e.filter("event_id % 3 = 0").select(i.alias("g_id"), (i % 10).alias("expected_line"), src(i, 4).alias("expected_source"))
    return E.outcomes(p, t, p.join(t, p.p_id == t.g_id).select("p_id", "g_id"))


@query(f"""WITH {_OUT_SQL}, c AS (SELECT source, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o GROUP BY source)
SELECT source, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1 FROM c""")
def source_metrics(spark, d):
    m = E.precision_recall(_outcomes(spark, d), "source")
    return m.select("source", "tp", "fp", "fn", *(_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_OUT_SQL} SELECT source, count(*) AS matched, avg(right_line::INT) AS accuracy FROM o WHERE outcome = 'tp' GROUP BY source")
def replacement_accuracy(spark, d):
    return E.replacement_accuracy(_outcomes(spark, d), "source")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS s, l_quantity * 10 + l_discount * 200 - 2 AS e FROM lineitem),
p AS (SELECT *, lag(e) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS before FROM s)
SELECT l_orderkey, s AS start, e AS "end", array_to_string(list_filter([CASE WHEN s < 0 THEN 'negative start' END, CASE WHEN e <= s THEN 'end not after start' END, CASE WHEN s < before THEN 'overlaps the segment before' END], lambda x: x IS NOT NULL), '; ') AS problems FROM p""")
def truth_validation(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") * 10).alias("start"), (F.col("l_quantity") * 10 + F.col("l_discount") * 200 - 2).alias("end"), F.lit("x").alias("text"))
    return E.truth_problems(li, "l_orderkey", "start", "end", "text").select("l_orderkey", "start", "end", F.array_join("problems", "; ").alias("problems"))


@query()
def scan_match(spark, d):
    from ..operators import sequence as S

    iv = _intervals(spark, d)
    side = lambda c, rest: iv.filter(f"event_id % 2 = {rest}").select("user_id", F.col("event_id").alias(f"{c}_id"), F.col("s").alias(f"{c}_start"), F.col("e").alias(f"{c}_end"))
    return S.scan_match(side("p", 0), side("g", 1), "user_id")


# matching
_A_SQL = f"""a AS (SELECT doc_id, {W_SQL.format("text")} AS w FROM documents), b AS (SELECT item_id, {W_SQL.format("text")} AS w FROM benchmark),
ar AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM a)),
br AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 3], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM b)),
pairs AS (SELECT DISTINCT doc_id, item_id FROM ar JOIN br USING (run)),
sim AS (SELECT doc_id, item_id, a.w AS sw, b.w AS lw, array_to_string(list_sort(a.w), ' ') AS x, array_to_string(list_sort(b.w), ' ') AS y FROM pairs JOIN a USING (doc_id) JOIN b USING (item_id)),
fz AS (SELECT *, round(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 6) AS fuzzy FROM sim),
ca AS (SELECT * FROM fz WHERE fuzzy >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fuzzy DESC, item_id) <= 20)"""
_B_SQL = f"""{_A_SQL}, ov AS (SELECT *, round(len(list_intersect(list_distinct(sw), list_distinct(lw)))::DOUBLE / greatest(len(list_distinct(sw)), len(list_distinct(lw))), 6) AS overlap,
CASE WHEN list_sort(list_intersect(list_distinct(sw), {_KEYS})) = list_sort(list_intersect(list_distinct(lw), {_KEYS})) THEN 1.0 ELSE 0.5 END::DOUBLE AS keyword FROM ca),
sc AS (SELECT *, round(0.5 * fuzzy + 0.3 * (len(list_intersect(list_distinct(sw), list_distinct(lw)))::DOUBLE / greatest(len(list_distinct(sw)), len(list_distinct(lw)))) + 0.2 * keyword, 6) AS score FROM ov), rb AS (SELECT * FROM sc WHERE score >= 0.6)"""


def _words_of(spark, d):
    a, b = table(spark, d, "documents"), _lines(spark, d)
    return M.tokens(a, "doc_id", "text", "[a-z]+"), M.tokens(b, "item_id", "line", "[a-z]+")


@query(f"WITH {_A_SQL} SELECT doc_id, item_id, fuzzy FROM ca")
def fuzzy_candidates(spark, d):
    a, b = _words_of(spark, d)
    return M.fuzzy_candidates(a, b, "doc_id", "item_id", run=4).select("doc_id", "item_id", "fuzzy")


@query(f"WITH {_B_SQL} SELECT doc_id, item_id, fuzzy, overlap, keyword, score FROM rb")
def reranked_candidates(spark, d):
    a, b = _words_of(spark, d)
    return M.reranked(M.fuzzy_candidates(a, b, "doc_id", "item_id", run=4), _KEYS).select("doc_id", "item_id", "fuzzy", "overlap", "keyword", "score")


@query(f"""WITH {_B_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rn FROM rb),
v AS (SELECT doc_id, item_id, round(score * CASE WHEN least(len(sw), len(lw))::DOUBLE / greatest(len(sw), len(lw)) < 0.8 THEN 0.8 ELSE 1.0 END
* CASE WHEN len(list_filter(list_intersect(list_distinct(lw), {_KEYS}), lambda k: NOT list_contains(sw, k))) > 0 THEN 0.9 ELSE 1.0 END, 6)::DOUBLE AS confidence FROM top WHERE rn = 1)
SELECT doc_id, item_id, confidence, CASE WHEN confidence < 0.85 THEN 'fuzzy' ELSE 'semantic' END AS method FROM v WHERE confidence >= 0.7""")
def assisted_match(spark, d):
    return M.assisted_match(table(spark, d, "documents"), _lines(spark, d), "text", "line", "doc_id", "item_id", _KEYS, "[a-z]+", run=4).select("doc_id", "item_id", "confidence", "method")


_LINE_SQL = f"""s AS (SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(text, '[^ -~]', '', 'g'), '[ \t\n\r]+', ' ', 'g')), '^ | $', '', 'g') AS t FROM documents), l AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS line FROM benchmark),
sw AS (SELECT doc_id, t, {W_SQL.format("t")} AS w FROM s), lw AS (SELECT item_id, line, {W_SQL.format("line")} AS w FROM l),
sr AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM sw)),
lr AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 3], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM lw)),
pr AS (SELECT DISTINCT doc_id, item_id FROM sr JOIN lr USING (run)),
al AS (SELECT doc_id, item_id, line, round(0.6 * (1 - levenshtein(t, line)::DOUBLE / greatest(length(t), length(line))) + 0.4 * (len(list_intersect(list_distinct(sw.w), list_distinct(lw.w)))::DOUBLE / len(list_distinct(list_concat(sw.w, lw.w)))), 6) AS score FROM pr JOIN sw USING (doc_id) JOIN lw USING (item_id)),
be AS (SELECT * FROM al WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(line) DESC, item_id) = 1)"""


@query(f"WITH {_LINE_SQL} SELECT s.doc_id, item_id, score, score >= 0.85 AS confident, CASE WHEN score >= 0.85 THEN 'force' WHEN score IS NOT NULL THEN 'suggest' ELSE 'none' END AS action FROM s LEFT JOIN be USING (doc_id)")
def constrained_alignment(spark, d):
    ascii_of = lambda c: F.regexp_replace(c, "[^ -~]", "")
    s = table(spark, d, "documents").select("doc_id", ascii_of("text").alias("text"))
    ln = _lines(spark, d).select("item_id", ascii_of("line").alias("line"))
    return M.aligned(s, ln, "text", "line", "doc_id", "item_id", run=4, pattern="[a-z]+")


@query(f"""WITH t AS (SELECT conv_id, turn, {W_SQL.format("text")} AS w FROM conversations), x AS (SELECT conv_id, turn, w[1:3] AS q FROM t WHERE len(w) > 0), b AS (SELECT item_id, ' ' || array_to_string({W_SQL.format("text")}, ' ') || ' ' AS line FROM benchmark)
SELECT conv_id * 1000 + turn AS seg_id, item_id FROM x JOIN b ON contains(line, ' ' || array_to_string(q, ' ') || ' ')""")
def containment(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg_id"), T.words(F.col("text")).alias("w"))
    return M.contained(c.select("seg_id", F.array_join(F.slice("w", 1, 3), " ").alias("q")), _lines(spark, d), "q", "line", "seg_id", "item_id", pattern="[a-z]+")


_CTX = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS start, list(struct_pack(a := turn, b := text)) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM conversations"


@query(f"SELECT conv_id, turn, start::BIGINT AS start, array_to_string(list_transform(list_filter(list_sort(r), lambda x: x.a <> turn)[1:4], lambda x: coalesce(x.b, '?')), ' | ') AS context FROM ({_CTX})")
def context_lines(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("?")))
    return M.context_lines(c, "conv_id", "turn", "text", "turn").select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.array_join("context", " | ").alias("context"))


@query("""WITH c AS (SELECT conv_id AS key, min(text) AS translation FROM conversations WHERE turn = 1 AND conv_id % 3 <> 0 GROUP BY conv_id)
SELECT key, CASE WHEN c.translation IS NOT NULL THEN c.translation END AS translation, CASE WHEN c.translation IS NOT NULL THEN 'cached' ELSE 'missing' END AS origin FROM (SELECT conv_id AS key FROM conversations WHERE turn = 0) LEFT JOIN c USING (key)""")
def translations(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "key")
    cache = c.filter("turn = 1 and key % 3 <> 0").select("key", F.lit("en").alias("language"), F.col("text").alias("translation"))
    return M.translated(c.filter("turn = 0").select("key", "text"), cache, "key", "en")


@query("""WITH n AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS al, b.label AS bl, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM n QUALIFY rank <= 15), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rank) AS place FROM t WHERE al <> bl)
SELECT a, b, score, round(least(1.0, score + 0.05 * (CASE WHEN al % 2 = bl % 2 THEN 1 ELSE 0 END)), 6)::DOUBLE AS shown FROM k WHERE place <= 5""")
def knn_boosted(spark, d):
    q, v = _vectors(spark, d)
    got = M.similar(q, v, None, 5, F.col("al") == F.col("bl"), (F.col("al") % 2 == F.col("bl") % 2).cast("int"))
    return got.select("a", "b", "score", "shown")


@query("""WITH n AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS al, b.label AS bl, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM n QUALIFY rank <= 1000), s AS (SELECT a, b FROM t WHERE rank <= 5)
SELECT a, b, round(1 - score, 6) AS dissimilarity FROM t ANTI JOIN s USING (a, b) WHERE score <= 0.7 AND al <> bl AND al % 4 <> bl % 4 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(1 - score, 6) DESC, b) <= 3""")
def combined_search(spark, d):
    # similar hits are taken out of the contrasts; themes are the label's class
    q, v = _vectors(spark, d)
    near = V.cosine_nearest(q, v, 1000).select("a", "b", "al", "bl", "score", "rank")
    far = near.filter("score <= 0.7 and al <> bl and al % 4 <> bl % 4").join(near.filter("rank <= 5").select("a", "b"), ["a", "b"], "left_anti")
    far = far.withColumn("dissimilarity", _r(1 - F.col("score")))
    return J.first_rows(far, ["a"], 3, F.desc("dissimilarity"), F.asc("b")).select("a", "b", "dissimilarity")


# scripts, on whatever letters the tables have
@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z\\\\^_`]', '', 'g')) AS latin, length(regexp_replace(coalesce(text, ''), '[^\\x{0A00}-\\x{0A7F}]', '', 'g')) AS gurmukhi, length(regexp_replace(coalesce(text, ''), '[^\\x{0900}-\\x{097F}]', '', 'g')) AS devanagari FROM documents")
def script_census(spark, d):
    n = X.census(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n["latin"].alias("latin"), n["gurmukhi"].alias("gurmukhi"), n["devanagari"].alias("devanagari"))


@query()
def script_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", X.detected(F.col("text"), F.col("lang")).alias("s")).select("doc_id", "s.*")


@query()
def script_conversion(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.converted(X.normalized(F.col("text"))).alias("c")).select("conv_id", "turn", "c.*")


@query()
def script_repair(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.repair(F.col("text")).alias("repaired"))


@query("SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '') AS w FROM conversations")
def unicode_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("w"))


@query()
def drift_diagnosis(spark, d):
    lex = J.word_rows(_lines(spark, d), "item_id", "line").select("word").distinct().withColumn("known", F.lit(1))
    w = table(spark, d, "conversations").select("conv_id", "turn", "text", F.explode_outer(T.words(F.col("text"))).alias("word"))
    oov = w.join(J.small(lex), "word", "left").groupBy("conv_id", "turn").agg(F.first("text").alias("text"), F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0)).alias("oov"))
    f = X.drift(F.col("text"), F.col("oov"), F.lit(0))
    return oov.select("conv_id", "turn", *(v.alias(k) for k, v in f.items())).withColumn("kept", X.acceptable(F.col("severity"), "medium"))


def _corrections(spark, d):
    best = J.edit_candidates(table(spark, d, "conversations").select(F.explode(T.words(F.col("text"))).alias("word")).distinct(), table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("entry")).groupBy("entry").agg(F.count("*").alias("freq")), max_distance=1, top=1)
    known = J.word_rows(_lines(spark, d), "item_id", "line").select("word")
    return best.filter("confidence >= 0.3").join(known, "word", "left_anti").select("word", "entry")


@query()
def corrected_texts(spark, d):
    # each text meets the corrections of its own words only
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    mine = c.select("conv_id", "turn", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).join(_corrections(spark, d), "word")
    mine = mine.groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("word", "entry"))).alias("m"))
    both = c.join(mine, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", F.when(F.col("m").isNull(), F.col("text")).otherwise(X.correct_words(F.col("text"), F.col("m"), "[a-z]+")).alias("corrected"), F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n"))


@query()
def correction_stats(spark, d):
    n = corrected_texts(spark, d)
    return n.agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("corrected"), _r(F.avg((F.col("n") > 0).cast("int"))).alias("rate"), F.sum("n").alias("words"))


# segments
@query("""WITH g AS (SELECT event_id, user_id, event_type AS route, value / 100 AS conf FROM events)
SELECT event_id, conf < 0.7 OR (event_id % 10) / 10.0 < 0.5 OR event_id % 7 = 0 AS review, route IN ('click') OR (conf >= 0.4 AND event_id % 2 = 0) AS detect, conf >= 0.5 AS align FROM g""")
def review_gates(spark, d):
    e = table(spark, d, "events").withColumn("conf", F.col("value") / 100)
    route = F.when(F.col("event_type") == "click", "scripture_quote_likely").otherwise("mixed")
    g = G.gates(route, F.col("event_id") % 2 == 0, F.col("conf"), F.col("conf"))
    return e.select("event_id", G.needs_review(F.col("conf"), (F.col("event_id") % 10) / 10, F.col("event_id") % 7 == 0, F.lit(False)).alias("review"), g["detect"].alias("detect"), g["align"].alias("align"))


@query("SELECT route, engine, count(*) AS n FROM (SELECT route, unnest(CASE route WHEN 'punjabi_speech' THEN ['indic'] WHEN 'english_speech' THEN ['english'] ELSE ['indic', 'english'] END) AS engine FROM (SELECT CASE lang WHEN 'en' THEN 'english_speech' WHEN 'es' THEN 'punjabi_speech' ELSE 'mixed' END AS route FROM documents)) GROUP BY ALL")
def route_engines(spark, d):
    r = table(spark, d, "documents").select(F.when(F.col("lang") == "en", "english_speech").when(F.col("lang") == "es", "punjabi_speech").otherwise("mixed").alias("route"))
    return r.select("route", F.explode(G.engines(F.col("route"))).alias("engine")).groupBy("route", "engine").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN turn % 11 = 10 THEN '[Transcription error]' WHEN trim(coalesce(text, '')) = '' THEN '[No speech detected]' ELSE text END AS shown FROM conversations")
def placeholders(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", G.placeholder(F.col("text"), F.when(F.col("turn") % 11 == 10, "timeout")).alias("shown"))


@query()
def continued_context(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "intro").otherwise("none").alias("kind"), F.when(F.col("role") == "user", 0.3).otherwise(0.0).alias("confidence"), (F.col("turn") % 4 / 10).alias("density"))
    return G.continued_context(c, "conv_id", "turn")


@query()
def section_labels(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 40).cast("double").alias("start"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 5 == 0).alias("has_quote"))
    return G.sections(c, "conv_id", ["the", "que"], r"\b(hello|hi|and)\b")


@query()
def section_picks(spark, d):
    return G.picked(section_labels(spark, d), "conv_id").select("conv_id", F.size("openings").alias("n_openings"), "fateh", "topic")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS start, epoch_us(ts) + 60000000 AS "end" FROM events), n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM s)
SELECT user_id, start, "end", 'speech' AS type FROM s UNION ALL SELECT user_id, "end", nxt, 'gap' FROM n WHERE nxt - "end" > 21600000000""")
def gaps_united(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("start"), (F.unix_micros("ts") + 60_000_000).alias("end"))
    return G.with_gaps(e, "user_id", "start", "end", 6 * 3600 * 1_000_000)


_FRAMES_SQL = "f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value > 20 AS voiced FROM events)"


def _frames(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select("user_id", "event_id", n.cast("double").alias("at"), (F.col("value") > 20).alias("voiced"), "value")


_CHUNK_SQL = f"""{_FRAMES_SQL}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, voiced ORDER BY pos) AS run FROM f),
r AS (SELECT user_id, min(pos)::DOUBLE AS s, max(pos)::DOUBLE + 1 AS e FROM i WHERE voiced GROUP BY user_id, run HAVING max(pos) + 1 - min(pos) >= 2),
c AS (SELECT user_id, s, e, greatest(1, ceil((e - s) / 4)) AS n, unnest(range(0, greatest(1, ceil((e - s) / 4))::BIGINT)) AS p FROM r),
ch AS (SELECT user_id, s + p * (e - s) / n AS start, s + (p + 1) * (e - s) / n AS "end" FROM c)"""


@query(f'WITH {_CHUNK_SQL} SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end" FROM ch')
def voiced_chunks(spark, d):
    got = G.voiced_chunks(_frames(spark, d), "user_id", "at", "voiced", 1.0, shortest=2.0, longest=4.0)
    return got.select("user_id", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"))


@query(f"""WITH {_CHUNK_SQL}, p AS (SELECT user_id, CASE WHEN lag(start) OVER w IS NULL THEN start ELSE greatest(0.0, start - 0.5) END AS s, CASE WHEN lead(start) OVER w IS NULL THEN "end" ELSE least("end" + 0.5, lead(start) OVER w) END AS e FROM ch WINDOW w AS (PARTITION BY user_id ORDER BY start, "end"))
SELECT user_id, round(s, 6) AS start, round(e, 6) AS "end" FROM p WHERE e - s >= 1""")
def padded_chunks(spark, d):
    got = G.padded(G.voiced_chunks(_frames(spark, d), "user_id", "at", "voiced", 1.0, shortest=2.0, longest=4.0), "user_id")
    return got.select("user_id", _r(F.col("start")).alias("start"), _r(F.col("end")).alias("end"))


@query()
def token_words(spark, d):
    f = _frames(spark, d).withColumn("token", F.when(F.col("event_id") % 5 == 0, "|").when(F.col("event_id") % 7 == 0, "<pad>").otherwise(F.substring(F.lit("abcdefgh"), (F.col("event_id") % 8 + 1).cast("int"), F.lit(1))))
    return G.token_words(f.withColumn("at", F.col("at").cast("long")), "user_id", "at", "token", "value", 0.02)


@query("SELECT user_id, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN value END), 0.0), 4) AS confidence, round(avg(value), 4) AS plain FROM events GROUP BY user_id")
def frame_confidence(spark, d):
    return G.frame_confidence(table(spark, d, "events"), "user_id", "event_type", "value", pad="error").select("user_id", _r(F.col("confidence"), 4).alias("confidence"), _r(F.col("plain"), 4).alias("plain"))


@query()
def fused_hypotheses(spark, d):
    h = table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 4).alias("seg"), F.col("item_id").alias("hyp_id"), "text", (0.5 + (F.col("item_id") % 50) / 100).alias("confidence"))
    return G.fused_again(h, lambda segs, k: segs.select("seg", F.lit(1_000_000 + k).cast("long").alias("hyp_id"), F.lit("again").alias("text"), F.lit(0.95).alias("confidence")))


@query("""WITH f AS (SELECT event_id, event_type, event_type || '-' || (event_id % 20) AS filename, (event_id % 3)::VARCHAR AS file_hash, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM events),
w AS (SELECT DISTINCT filename, file_hash FROM f WHERE event_id % 2 = 0), g AS (SELECT filename, file_hash, status FROM f WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY filename ORDER BY event_id) = 1)
SELECT w.filename, w.file_hash, coalesce(g.status = 'success' AND g.file_hash = w.file_hash, false) AS done FROM w LEFT JOIN g USING (filename)""")
def processed_before(spark, d):
    f = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat_ws("-", "event_type", (F.col("event_id") % 20).cast("string")).alias("filename"), (F.col("event_id") % 3).cast("string").alias("file_hash"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
    return G.processed_before(f.filter("pos % 2 = 0").select("filename", "file_hash").distinct(), f.filter("pos % 2 = 1"))


@query("SELECT DISTINCT o_orderpriority AS email FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 490000)")
def invitable(spark, d):
    o = table(spark, d, "orders")
    inv = o.filter("o_orderstatus = 'P' and o_totalprice > 490000").select(F.col("o_orderpriority").alias("email"), F.lit(None).cast("timestamp").alias("used_at"), F.lit("2100-01-01").cast("timestamp").alias("expires_at"))
    return G.invitable(o.select(F.col("o_orderpriority").alias("email")).distinct(), inv, F.lit("2024-01-01").cast("timestamp"))


@query("SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active, (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT round(sum(o_totalprice) / 60, 2) FROM orders) AS minutes")
def admin_totals(spark, d):
    c = table(spark, d, "customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    o = table(spark, d, "orders").agg(F.count("*").alias("records"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), _r(F.sum("o_totalprice") / 60, 2).alias("minutes"))
    return c.join(F.broadcast(o))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 20")
def own_records(spark, d):
    return J.first_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], 20, F.desc("o_orderdate"), F.asc("o_orderkey"))


@query("SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM orders")
def page_totals(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("pages"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def run_outcomes(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(greatest(0.0, 60 / (least(value, 100) / 100) - 60), 6) END AS seconds FROM events")
def time_left(spark, d):
    return table(spark, d, "events").select("event_id", _r(G.remaining_time(F.lit(60.0), F.least("value", F.lit(100.0)))).alias("seconds"))


@query("""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, substr(concat_ws(' ', nullif(trim(right(before, 50)), ''), CASE WHEN turn = 0 THEN 'start' END, 'the and that'), 1, 224) AS prompt FROM t""")
def prompts(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", G.prompt(F.lit("the and that"), F.when(F.col("turn") == 0, "start"), before).alias("prompt"))


@query("SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9.à-ÿÀ-ß-]+', '_', 'g') AS name FROM pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", G.safe_name(F.col("url")).alias("name"))


@query("SELECT item_id, array_to_string(list_filter([CASE WHEN list_has_any(w, ['the', 'and']) THEN 'small' END, CASE WHEN list_has_any(w, ['that', 'from']) THEN 'place' END], lambda x: x IS NOT NULL), ',') AS themes FROM (SELECT item_id, " + W_SQL.format("text") + " AS w FROM benchmark)")
def line_themes(spark, d):
    w = _lines(spark, d).select("item_id", T.words(F.col("line")).alias("w"))
    return w.select("item_id", F.array_join(G.themes(F.col("w"), {"small": ["the", "and"], "place": ["that", "from"]}), ",").alias("themes"))


@query(f"WITH t AS (SELECT array_agg(w ORDER BY item_id, i) AS w FROM (SELECT item_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, {W_SQL.format('text')} AS w FROM benchmark))), s AS (SELECT list_concat(list_concat(['<s>', '<s>'], w), ['</s>']) AS w FROM t) SELECT w[i] || ' ' || w[i + 1] AS context, w[i + 2] AS token, count(*) AS n FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM s) GROUP BY ALL")
def stream_ngrams(spark, d):
    # one stream over all lines: the last two words of each line are carried to the next ones, so no global sort of words is needed
    w = _lines(spark, d).select("item_id", T.words(F.col("line")).alias("w")).filter(F.size("w") > 0)
    order = Window.orderBy("item_id")
    ends = w.select("item_id", F.reverse(F.slice(F.reverse("w"), 1, 2)).alias("t"))
    prev = F.flatten(F.collect_list("t").over(order.rowsBetween(-2, -1)))
    before = ends.select("item_id", F.concat(F.array(F.lit("<s>"), F.lit("<s>")), prev).alias("b"), F.lead("item_id").over(order).isNull().alias("last"))
    full = w.join(before, "item_id").select(F.concat(F.reverse(F.slice(F.reverse("b"), 1, 2)), "w", F.when(F.col("last"), F.array(F.lit("</s>"))).otherwise(F.array().cast("array<string>"))).alias("x"))
    at = F.sequence(F.lit(1), F.size("x") - 2)
    g = F.transform(at, lambda i: F.struct(F.concat(F.get("x", i - 1), F.lit(" "), F.get("x", i)).alias("context"), F.get("x", i + 1).alias("token")))
    return full.select(F.explode(g).alias("g")).groupBy("g.context", "g.token").agg(F.count("*").alias("n"))


@query("SELECT role AS language, count(*) AS total, count(*) FILTER (text IS NOT NULL AND turn % 3 = 0) AS cached, CASE WHEN role = 'assistant' THEN 'unavailable' WHEN count(*) = count(*) FILTER (text IS NOT NULL AND turn % 3 = 0) THEN 'cached' ELSE 'will_translate' END AS status FROM conversations GROUP BY role")
def language_status(spark, d):
    n, k = F.count("*"), F.count_if(F.col("text").isNotNull() & (F.col("turn") % 3 == 0))
    return table(spark, d, "conversations").groupBy(F.col("role").alias("language")).agg(n.alias("total"), k.alias("cached"), F.when(F.col("language") == "assistant", "unavailable").when(n == k, "cached").otherwise("will_translate").alias("status"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_quantities(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@query("SELECT c_custkey, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM customer")
def nth_values(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "customer").select("c_custkey", F.nth_value("c_custkey", 2).over(w).alias("second"))


@query("""WITH f AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(us) AS first_us, count(*) AS n FROM i GROUP BY user_id, s""")
def session_windows(spark, d):
    from ..streaming.sessions import sessions

    return sessions(table(spark, d, "events")).select("user_id", F.unix_micros("session_window.start").alias("first_us"), "n")
