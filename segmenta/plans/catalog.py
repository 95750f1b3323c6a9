"""All queries of the engine's own operators over the provided tables, with their SQL.

Role of the tables: documents and conversations are transcript text (a conversation is a
session, a turn a place in it), benchmark the canonical lines, embeddings line vectors
(label: poem), labels truth, events live chunks and usage, customer, orders, nation and
region accounts and their dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import vectors as V
from ..operators import sequence as S
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("line"))


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


W_SQL = "regexp_extract_all(lower(coalesce({}, '')), '[a-z]+')"


@query(f"""
WITH d AS (SELECT doc_id, {W_SQL.format("text")} AS w FROM documents), l AS (SELECT item_id, {W_SQL.format("text")} AS w FROM benchmark),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)),
lr AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 3], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM l)),
c AS (SELECT doc_id, item_id, count(*) AS common FROM dr JOIN lr USING (run) GROUP BY ALL),
s AS (SELECT doc_id, item_id, common, round(len(list_intersect(list_distinct(d.w), list_distinct(l.w)))::DOUBLE / len(list_distinct(l.w)), 6) AS score FROM c JOIN d USING (doc_id) JOIN l USING (item_id))
SELECT doc_id, item_id, common AS common_runs, score, CASE WHEN score >= 0.9 THEN 'replace' ELSE 'keep' END AS decision, score < 0.95 AS needs_review
FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1""")
def passage_match(spark, d):
    return J.passage_match(table(spark, d, "documents"), _lines(spark, d))


@query("SELECT item_id, text AS line FROM benchmark WHERE contains(lower(text), 'the in') ORDER BY item_id LIMIT 10")
def substring_search(spark, d):
    return _lines(spark, d).filter(F.contains(F.lower("line"), F.lit("the in"))).orderBy("item_id").limit(10)


@query("SELECT * FROM part WHERE p_partkey = 17")
def exact_lookup(spark, d):
    return table(spark, d, "part").filter("p_partkey = 17")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def multi_lookup(spark, d):
    some = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders")
    return o.join(some, o.o_custkey == some.c_custkey, "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def dim_enrich_left(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").filter("r_name <> 'ASIA'")
    c = table(spark, d, "customer").join(J.small(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(J.small(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ON c_custkey = o_custkey""")
def at_most_one_left(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return J.at_most_one_left(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", F.desc("o_orderdate"), F.asc("o_orderkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS used FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL ORDER BY used DESC, c_custkey LIMIT 5")
def top_users(spark, d):
    used = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_r(F.sum("o_totalprice"), 2).alias("used"))
    return used.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").orderBy(F.desc("used"), "c_custkey").limit(5).select("c_custkey", "c_name", "used")


_LEX = f"lex AS (SELECT DISTINCT unnest({W_SQL.format('text')}) AS word FROM benchmark)"


@query(f"""WITH {_LEX}, w AS (SELECT doc_id, unnest({W_SQL.format("text")}) AS word FROM documents)
SELECT doc_id, count(*) AS n, round(avg(CASE WHEN lex.word IS NULL THEN 1.0 ELSE 0.0 END), 6) AS oov FROM w LEFT JOIN lex USING (word) GROUP BY doc_id""")
def oov_rate(spark, d):
    lex = J.word_rows(_lines(spark, d), "item_id", "line").select("word").distinct().withColumn("known", F.lit(True))
    w = table(spark, d, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    return w.join(lex, "word", "left").groupBy("doc_id").agg(F.count("*").alias("n"), _r(F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0))).alias("oov"))


@query(f"WITH {_LEX} SELECT DISTINCT word FROM (SELECT unnest({W_SQL.format('text')}) AS word FROM documents) SEMI JOIN lex USING (word)")
def vocab_semi(spark, d):
    lex = J.word_rows(_lines(spark, d), "item_id", "line").select("word")
    return J.word_rows(table(spark, d, "documents"), "doc_id", "text").select("word").distinct().join(lex, "word", "left_semi")


@query(f"WITH {_LEX} SELECT word, count(*) AS n FROM (SELECT unnest({W_SQL.format('text')}) AS word FROM conversations) ANTI JOIN lex USING (word) GROUP BY word")
def vocab_anti(spark, d):
    lex = J.word_rows(_lines(spark, d), "item_id", "line").select("word")
    return table(spark, d, "conversations").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(lex, "word", "left_anti")


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({W_SQL.format('text')}) AS word FROM documents) WHERE length(word) >= 2 GROUP BY word")
def word_freq(spark, d):
    return table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).filter(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("freq"))


@query(f"""SELECT word, sum(n)::BIGINT AS freq, count(*) AS n_sources FROM (SELECT word, 'a' AS s, count(*) AS n FROM (SELECT unnest({W_SQL.format("text")}) AS word FROM benchmark) GROUP BY word
UNION ALL SELECT word, 'b', count(*) FROM (SELECT unnest({W_SQL.format("text")}) AS word FROM conversations) GROUP BY word) GROUP BY word""")
def lexicon_merge(spark, d):
    def counted(df):
        return df.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    both = counted(table(spark, d, "benchmark")).unionByName(counted(table(spark, d, "conversations")))
    return both.groupBy("word").agg(F.sum("n").alias("freq"), F.count("*").alias("n_sources"))


_GRAM_SQL = f"""t AS (SELECT item_id, list_concat(list_concat(['<s>', '<s>'], {W_SQL.format("text")}), ['</s>']) AS w FROM benchmark),
g AS (SELECT w[i] || ' ' || w[i + 1] AS context, w[i + 2] AS token FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM t))"""


def _grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """Trigrams of each text with two start marks and one end mark: (key, context, token)."""
    d = df.select(key, F.concat(F.array(F.lit("<s>"), F.lit("<s>")), T.words(F.col(text)), F.array(F.lit("</s>"))).alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - 2)
    g = F.transform(at, lambda i: F.struct(F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)).alias("context"), F.get("w", i + 1).alias("token")))
    return d.select(key, F.explode(g).alias("g")).select(key, "g.*")


@query(f"WITH {_GRAM_SQL} SELECT context, token, count(*) AS n FROM g GROUP BY ALL")
def ngram_counts(spark, d):
    return _grams(_lines(spark, d), "item_id", "line").groupBy("context", "token").agg(F.count("*").alias("n"))


@query(f"WITH {_GRAM_SQL} SELECT context, count(*) AS n FROM g GROUP BY ALL")
def context_counts(spark, d):
    return _grams(_lines(spark, d), "item_id", "line").groupBy("context").agg(F.count("*").alias("n"))


_LM_SQL = f"""WITH {_GRAM_SQL}, c AS (SELECT context, token, count(*) AS n FROM g GROUP BY ALL), x AS (SELECT context, count(*) AS m FROM g GROUP BY ALL), v AS (SELECT count(DISTINCT token) AS v FROM g),
q AS (SELECT conv_id, turn, list_concat(list_concat(['<s>', '<s>'], {W_SQL.format("text")}), ['</s>']) AS w FROM conversations),
h AS (SELECT conv_id, turn, w[i] || ' ' || w[i + 1] AS context, w[i + 2] AS token FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) - 1)) AS i FROM q)),
s AS (SELECT conv_id, turn, count(*) AS n_tokens, sum(ln((coalesce(n, 0) + 0.01) / (coalesce(m, 0) + 0.01 * v))) AS lm FROM h LEFT JOIN c USING (context, token) LEFT JOIN x USING (context), v GROUP BY ALL)"""


def _lm(spark, d):
    g = _grams(_lines(spark, d), "item_id", "line")
    c, x = g.groupBy("context", "token").agg(F.count("*").alias("n")), g.groupBy("context").agg(F.count("*").alias("m"))
    v = g.agg(F.countDistinct("token").alias("v"))
    conv = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    # equal trigrams of a text are one row before the joins, which also thins out the contexts of starts
    h = _grams(conv, "key", "text").groupBy("key", "context", "token").agg(F.count("*").alias("k"))
    h = h.join(J.small(c), ["context", "token"], "left").join(J.small(x), "context", "left").join(F.broadcast(v))
    p = (F.coalesce("n", F.lit(0)) + 0.01) / (F.coalesce("m", F.lit(0)) + 0.01 * F.col("v"))
    return h.groupBy("key").agg(F.sum("k").alias("n_tokens"), F.sum(F.col("k") * F.log(p)).alias("lm")).select("key.conv_id", "key.turn", "n_tokens", "lm")


@query(_LM_SQL + " SELECT conv_id, turn, n_tokens, round(lm, 4) AS lm FROM s")
def lm_score(spark, d):
    return _lm(spark, d).withColumn("lm", _r(F.col("lm"), 4))


@query(_LM_SQL + """ SELECT conv_id, turn, round(exp(-lm / n_tokens), 3) AS perplexity, round(0.7 * 0.8 + 0.3 / (1 + exp(-lm / 100)), 6) AS blended,
CASE WHEN exp(-lm / n_tokens) < 50 THEN 0.1 WHEN exp(-lm / n_tokens) < 100 THEN 0.05 WHEN exp(-lm / n_tokens) < 200 THEN 0.025 ELSE 0.0 END::DOUBLE AS gain FROM s""")
def perplexity(spark, d):
    pp = F.exp(-F.col("lm") / F.col("n_tokens"))
    return _lm(spark, d).select("conv_id", "turn", _r(pp, 3).alias("perplexity"), _r(T.log_sigmoid_blend(F.lit(0.8), F.col("lm"))).alias("blended"), T.boost(pp).alias("gain"))


# four hypotheses a segment; letters beyond ASCII go, as the other engine counts bytes
_HYP_SQL = "h AS (SELECT item_id // 4 AS seg, item_id, lower(regexp_replace(text, '[^ -~]', '', 'g')) AS t, round(0.5 + (item_id % 50) / 100.0, 4)::DOUBLE AS conf FROM benchmark)"


def _hyps(spark, d):
    t = F.lower(F.regexp_replace("text", "[^ -~]", ""))
    return table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 4).alias("seg"), "item_id", t.alias("t"), _r(0.5 + (F.col("item_id") % 50) / 100, 4).alias("conf"))


@query(f"WITH {_HYP_SQL} SELECT a.seg, a.item_id AS a, b.item_id AS b, round(1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t)), 6) AS agreement FROM h a JOIN h b ON a.seg = b.seg AND a.item_id < b.item_id")
def pairwise_agreement(spark, d):
    h = _hyps(spark, d)
    a, b = h.select("seg", F.col("item_id").alias("a"), F.col("t").alias("ta")), h.select("seg", F.col("item_id").alias("b"), F.col("t").alias("tb"))
    return a.join(b, "seg").filter("a < b").select("seg", "a", "b", _r(T.similarity(F.col("ta"), F.col("tb"))).alias("agreement"))


@query(f"""WITH {_HYP_SQL}, m AS (SELECT a.seg, a.item_id, any_value(a.conf) AS conf, round(avg(1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t))), 6) AS agreement FROM h a JOIN h b ON a.seg = b.seg AND a.item_id <> b.item_id GROUP BY ALL),
k AS (SELECT *, max(agreement) OVER (PARTITION BY seg) >= 0.85 AS any_ok FROM m)
SELECT seg, item_id, agreement, least(1.0, conf + CASE WHEN agreement >= 0.85 THEN 0.1 ELSE 0 END)::DOUBLE AS fused, conf < 0.6 OR agreement < 0.5 AS redecode FROM k WHERE NOT any_ok OR agreement >= 0.85 QUALIFY row_number() OVER (PARTITION BY seg ORDER BY conf DESC, item_id) = 1""")
def fuse_best(spark, d):
    h = _hyps(spark, d)
    b = h.select("seg", F.col("item_id").alias("b"), F.col("t").alias("tb"))
    m = h.join(b, "seg").filter("item_id <> b").groupBy("seg", "item_id").agg(F.first("conf").alias("conf"), _r(F.avg(T.similarity(F.col("t"), F.col("tb")))).alias("agreement"))
    k = m.withColumn("any_ok", F.max("agreement").over(Window.partitionBy("seg")) >= 0.85).filter("not any_ok or agreement >= 0.85")
    best = J.first_per(k, ["seg"], F.desc("conf"), F.asc("item_id"))
    fused = F.least(F.lit(1.0), F.col("conf") + F.when(F.col("agreement") >= 0.85, 0.1).otherwise(0.0))
    return best.select("seg", "item_id", "agreement", fused.alias("fused"), ((F.col("conf") < 0.6) | (F.col("agreement") < 0.5)).alias("redecode"))


@query(f"""WITH l AS (SELECT word AS entry, count(*) AS freq FROM (SELECT unnest({W_SQL.format("text")}) AS word FROM benchmark) GROUP BY word),
w AS (SELECT DISTINCT word FROM (SELECT unnest({W_SQL.format("text")}) AS word FROM conversations)),
s AS (SELECT word, entry, levenshtein(word, entry)::INTEGER AS distance, freq FROM w JOIN l ON abs(length(word) - length(entry)) <= 2 WHERE levenshtein(word, entry) BETWEEN 1 AND 2),
c AS (SELECT word, entry, distance, round(0.5 * (1 - distance / 3.0) + 0.5 * least(1.0, freq / 100.0), 6)::DOUBLE AS confidence FROM s)
SELECT word, entry, distance, confidence, row_number() OVER (PARTITION BY word ORDER BY confidence DESC, distance, entry)::INTEGER AS rank FROM c QUALIFY rank <= 10""")
def correction_candidates(spark, d):
    lex = table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("entry")).groupBy("entry").agg(F.count("*").alias("freq"))
    w = table(spark, d, "conversations").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return J.edit_candidates(w, lex, max_distance=2)


@query(f"""SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS jaccard
FROM (SELECT conv_id, turn, list_distinct({W_SQL.format("text")}) AS w FROM conversations) a JOIN (SELECT conv_id, turn, list_distinct({W_SQL.format("text")}) AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jaccard_turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.words(F.col("text"))).alias("w"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", _r(T.jaccard(F.col("w"), F.col("v"))).alias("jaccard"))


_CENSUS = "regexp_replace(coalesce(text, ''), '[^{}]', '', 'g')"
_DRIFT_SQL = f"""c AS (SELECT doc_id, length({_CENSUS.format("a-zA-Z")}) AS latin, length({_CENSUS.format("à-ÿÀ-ß")}) AS accented, regexp_matches(text, 'https?://|[a-z0-9]@[a-z]') AS link,
length({_CENSUS.format("0-9")}) AS digits, length(text) AS n FROM documents),
f AS (SELECT doc_id, latin, accented, CASE WHEN latin + accented > 0 THEN round(latin::DOUBLE / (latin + accented), 6) ELSE 1.0 END AS purity, link, digits > 0.05 * n AS numeric, n < 100 AS short FROM c)"""


def _drift(spark, d):
    x = F.coalesce("text", F.lit(""))
    n = T.script_census(x, {"latin": "[a-zA-Z]", "accented": "[à-ÿÀ-ß]"})
    both = n["latin"] + n["accented"]
    return table(spark, d, "documents").select(
        "doc_id",
        n["latin"].cast("long").alias("latin"),
        n["accented"].cast("long").alias("accented"),
        F.when(both > 0, _r(n["latin"] / both)).otherwise(1.0).alias("purity"),
        F.col("text").rlike("https?://|[a-z0-9]@[a-z]").alias("link"),
        (F.regexp_count("text", F.lit("[0-9]")) > 0.05 * F.length("text")).alias("numeric"),
        (F.length("text") < 100).alias("short"),
    )


def _severity() -> Column:
    high = (F.col("purity") < 0.9).cast("int") + F.col("numeric").cast("int")
    return F.when((F.col("purity") < 0.5) | F.col("link"), "critical").when(high >= 2, "high").when(high + F.col("short").cast("int") >= 1, "medium").otherwise("none")


_SEV_SQL = "CASE WHEN purity < 0.5 OR link THEN 'critical' WHEN (purity < 0.9)::INT + numeric::INT >= 2 THEN 'high' WHEN (purity < 0.9)::INT + numeric::INT + short::INT >= 1 THEN 'medium' ELSE 'none' END"


@query(f"WITH {_DRIFT_SQL} SELECT *, {_SEV_SQL} AS severity FROM f")
def drift_flags(spark, d):
    return _drift(spark, d).withColumn("severity", _severity())


@query(f"WITH {_DRIFT_SQL} SELECT {_SEV_SQL} AS severity, count(*) AS n FROM f GROUP BY ALL")
def severity_hist(spark, d):
    return _drift(spark, d).groupBy(_severity().alias("severity")).agg(F.count("*").alias("n"))


@query(f"WITH {_DRIFT_SQL} SELECT doc_id, CASE WHEN latin + accented = 0 THEN 'unknown' WHEN (latin > 0.2 * (latin + accented)) AND (accented > 0.2 * (latin + accented)) THEN 'mixed' WHEN latin >= accented THEN 'latin' ELSE 'accented' END AS script FROM f")
def script_share(spark, d):
    return _drift(spark, d).select("doc_id", T.dominant({"latin": F.col("latin"), "accented": F.col("accented")}).alias("script"))


_KEYS = ["the", "and", "that", "with", "was"]
_KEY_SQL = "['the', 'and', 'that', 'with', 'was']"


@query(f"""SELECT item_id, len(list_intersect(list_distinct(w), {_KEY_SQL}))::BIGINT AS shared, len(list_distinct(w)) - len(list_intersect(list_distinct(w), {_KEY_SQL})) AS others, len(list_intersect(list_distinct(w), ['the', 'and'])) = 2 AS has_all
FROM (SELECT item_id, {W_SQL.format("text")} AS w FROM benchmark)""")
def keyword_overlap(spark, d):
    w, keys = F.array_distinct(T.words(F.col("line"))), F.array(*map(F.lit, _KEYS))
    need = F.array(F.lit("the"), F.lit("and"))
    return _lines(spark, d).select("item_id", T.overlap(w, keys).cast("long").alias("shared"), F.size(F.array_except(w, keys)).cast("long").alias("others"), (F.size(F.array_except(need, w)) == 0).alias("has_all"))


_SIG_SQL = """s AS (SELECT conv_id, turn, unnest([CASE WHEN role = 'user' THEN {'reason': 'route', 'conf': 0.7::DOUBLE} END, CASE WHEN regexp_matches(lower(text), '\\bthe [a-z]+ of\\b') THEN {'reason': 'phrase', 'conf': 0.75::DOUBLE} END,
CASE WHEN length(text) BETWEEN 40 AND 400 THEN {'reason': 'length', 'conf': 0.4::DOUBLE} END]) AS x FROM conversations)"""


def _signals(spark, d):
    one = lambda c, r, v: F.when(c, F.struct(F.lit(r).alias("reason"), F.lit(v).alias("conf")))
    found = F.array_compact(F.array(one(F.col("role") == "user", "route", 0.7), one(F.lower("text").rlike(r"\bthe [a-z]+ of\b"), "phrase", 0.75), one(F.length("text").between(40, 400), "length", 0.4)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(found).alias("x")).select("conv_id", "turn", "x.*")


@query(f"WITH {_SIG_SQL} SELECT x.reason AS reason, count(*) AS n FROM s WHERE x IS NOT NULL GROUP BY ALL")
def quote_signals(spark, d):
    return _signals(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_SIG_SQL} SELECT conv_id, turn, x.reason AS reason, x.conf AS conf FROM s WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY x.conf DESC, x.reason) = 1")
def dedup_best(spark, d):
    return J.first_per(_signals(spark, d), ["conv_id", "turn"], F.desc("conf"), F.asc("reason"))


@query("SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS digits, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS page_no FROM pages")
def page_ref_extract(spark, d):
    n = F.regexp_extract("url", r"/(\p{Nd}+)", 1)
    return table(spark, d, "pages").select("page_id", n.alias("digits"), n.try_cast("long").alias("page_no"))


_SEG_SQL = "seg AS (SELECT l_orderkey, l_linenumber, l_returnflag AS route, l_discount * 10 AS confidence, CASE WHEN l_tax > 0.04 THEN l_tax * 12 END AS match, CASE WHEN l_quantity > 25 THEN l_quantity / 50 END AS script, l_linestatus = 'O' AS review FROM lineitem)"
_PRIO_SQL = "round(greatest(0.0, least(1.0, CASE WHEN confidence < 0.7 THEN 0.4 ELSE 0 END + CASE WHEN match IS NULL THEN 0 WHEN match < 0.9 THEN 0.3 ELSE -0.1 END + CASE WHEN script < 0.7 THEN 0.2 ELSE 0 END + CASE WHEN review THEN 0.1 ELSE 0 END)), 4)::DOUBLE"


def _segments(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("route"), (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_tax") > 0.04, F.col("l_tax") * 12).alias("match"), F.when(F.col("l_quantity") > 25, F.col("l_quantity") / 50).alias("script"), (F.col("l_linestatus") == "O").alias("review"))
    return li.withColumn("priority", _r(T.review_priority(F.col("confidence"), F.col("match"), F.col("script"), F.col("review")), 4))


@query(f"""WITH {_SEG_SQL}, p AS (SELECT *, {_PRIO_SQL} AS priority FROM seg)
SELECT l_orderkey, l_linenumber, priority, coalesce(nullif(concat_ws('; ', CASE WHEN confidence < 0.7 THEN 'low confidence' END, CASE WHEN match < 0.9 THEN 'weak match' END, CASE WHEN script < 0.7 THEN 'weak script' END), ''), 'High priority') AS reason
FROM p WHERE review OR priority > 0.3 ORDER BY priority DESC, l_orderkey, l_linenumber""")
def review_queue(spark, d):
    p = _segments(spark, d).filter("review or priority > 0.3")
    why = T.reasons([(F.col("confidence") < 0.7, "low confidence"), (F.col("match") < 0.9, "weak match"), (F.col("script") < 0.7, "weak script")], "High priority")
    return p.select("l_orderkey", "l_linenumber", "priority", why.alias("reason")).orderBy(F.desc("priority"), "l_orderkey", "l_linenumber")


@query(f"WITH {_SEG_SQL}, p AS (SELECT *, {_PRIO_SQL} AS priority FROM seg) SELECT count(*) AS total, count(*) FILTER (review) AS needs_review, count(*) FILTER (priority > 0.5) AS high, round(avg(confidence), 4) AS avg_conf, min(confidence) AS low, max(confidence) AS top FROM p")
def review_summary(spark, d):
    return _segments(spark, d).agg(F.count("*").alias("total"), F.count_if("review").alias("needs_review"), F.count_if(F.col("priority") > 0.5).alias("high"), _r(F.avg("confidence"), 4).alias("avg_conf"), F.min("confidence").alias("low"), F.max("confidence").alias("top"))


@query(f"""WITH {_SEG_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN match >= 0.9 THEN 'canonical' ELSE 'spoken' END AS text, CASE WHEN match >= 0.9 THEN 'scripture_quote' ELSE 'speech' END AS type,
round(CASE WHEN match >= 0.9 THEN greatest(confidence, match) ELSE confidence END, 6) AS confidence, NOT (coalesce(match, 0) >= 0.95) AS needs_review FROM seg""")
def canonical_replacement(spark, d):
    out = T.replacement(F.lit("spoken"), F.lit("canonical"), F.col("confidence"), F.col("match"))
    return _segments(spark, d).select("l_orderkey", "l_linenumber", out["text"].alias("text"), out["type"].alias("type"), _r(out["confidence"]).alias("confidence"), out["needs_review"].alias("needs_review"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND n_chars >= 100 THEN 'english_speech' WHEN lang IN ('pa', 'hi', 'ur') THEN CASE WHEN contains(text, ' | ') THEN 'scripture_quote_likely' ELSE 'punjabi_speech' END ELSE 'mixed' END AS route FROM documents""")
def language_routes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.route(F.col("lang"), F.when(F.col("n_chars") >= 100, 0.9).otherwise(0.5), F.contains("text", F.lit(" | "))).alias("route"))


@query("SELECT count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'X') AS x FROM lineitem")
def route_hist(spark, d):
    return table(spark, d, "lineitem").agg(*(F.count_if(F.col("l_returnflag") == v).alias(v.lower()) for v in ("A", "N", "R", "X")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS avg_qty, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def metrics_rollup(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupingSets([[li.l_returnflag], [li.l_linestatus], []], li.l_returnflag, li.l_linestatus).agg(F.count("*").alias("n"), _r(F.avg("l_quantity"), 4).alias("avg_qty"), _r(F.sum("l_extendedprice"), 2).alias("total"))


_SCORE_SQL = "s AS (SELECT doc_id, quality, toxic, ((doc_id * 7919) % 1000) / 1000.0 AS conf FROM labels), t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) AS threshold)"


def _scored(spark, d):
    return table(spark, d, "labels").withColumn("conf", ((F.col("doc_id") * 7919) % 1000) / 1000)


@query(f"""WITH {_SCORE_SQL}, m AS (SELECT threshold, count(*) FILTER (conf >= threshold AND quality = 1) AS tp, count(*) FILTER (conf >= threshold AND quality = 0) AS fp, count(*) FILTER (conf < threshold AND quality = 1) AS fn FROM s, t GROUP BY threshold)
SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS p, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS r, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1 FROM m""")
def threshold_sweep(spark, d):
    # each score is counted at the six thresholds as it passes, so nothing is multiplied before the aggregation
    s = _scored(spark, d)
    hit = lambda t, c: F.count_if(c & (F.col("conf") >= t))
    ts = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
    pos = F.col("quality") == 1
    one = s.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), hit(t, pos).alias("tp"), hit(t, F.col("quality") == 0).alias("fp"), F.count_if(pos & (F.col("conf") < t)).alias("fn")) for t in ts)).alias("m"))
    m = one.select(F.inline("m"))
    return m.select("*", _r(T.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("p"), _r(T.ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("r"), _r(T.ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


@query(f"WITH {_SCORE_SQL} SELECT quality, toxic, count(*) AS n, round(sum(conf * quality) / sum(conf), 6)::DOUBLE AS weighted FROM s GROUP BY quality, toxic")
def weighted_error(spark, d):
    return _scored(spark, d).groupBy("quality", "toxic").agg(F.count("*").alias("n"), _r(F.sum(F.col("conf") * F.col("quality")) / F.sum("conf")).alias("weighted"))


_IV_SQL = "iv AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 + (event_id % 7) * 600000000 AS e FROM events)"


def _intervals(spark, d):
    s = F.unix_micros("ts") / 1e6
    return table(spark, d, "events").select("event_id", "user_id", s.alias("s"), (s + 3600 + (F.col("event_id") % 7) * 600).alias("e"))


@query(f"""WITH {_IV_SQL} SELECT p.event_id AS p_id, g.event_id AS g_id, least(p.e, g.e) - greatest(p.s, g.s) AS overlap FROM iv p JOIN iv g ON p.user_id = g.user_id AND p.event_id % 2 = 0 AND g.event_id % 2 = 1 AND p.s < g.e AND g.s < p.e
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY least(p.e, g.e) - greatest(p.s, g.s) DESC, g.s, g.event_id) = 1""")
def interval_overlap_best(spark, d):
    # whole microseconds, so that equal overlaps are equal
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros("ts").alias("s"))
    e = e.withColumn("e", F.col("s") + F.lit(3_600_000_000).cast("long") + (F.col("event_id") % 7) * 600_000_000)
    p = e.filter("event_id % 2 = 0").select("user_id", F.col("event_id").alias("p_id"), F.col("s").alias("p_start"), F.col("e").alias("p_end"))
    g = e.filter("event_id % 2 = 1").select("user_id", F.col("event_id").alias("g_id"), F.col("s").alias("g_start"), F.col("e").alias("g_end"))
    return J.interval_best(p, g, "user_id", bucket=7_200_000_000).select("p_id", "g_id", "overlap")


@query()
def iou_match(spark, d):
    # runs of overlapping rows of both sides share no pair, so each is matched on its own
    iv = S.runs_of_overlaps(_intervals(spark, d), ["user_id"], "s", "e")
    side = lambda c, rest: iv.filter(f"event_id % 2 = {rest}").select("user_id", F.col("run").alias(f"{c}_run"), F.col("event_id").alias(f"{c}_id"), F.col("s").alias(f"{c}_start"), F.col("e").alias(f"{c}_end"))
    both = J.overlapping(side("p", 0), side("g", 1), "user_id", bucket=7200.0)
    iou = (F.least("p_end", "g_end") - F.greatest("p_start", "g_start")) / (F.greatest("p_end", "g_end") - F.least("p_start", "g_start"))
    pairs = both.select("user_id", F.col("p_run").alias("run"), "p_id", F.col("p_start").alias("p_pos"), "g_id", iou.alias("iou")).filter("iou > 0.5")
    return S.match_one_to_one(pairs, ["user_id", "run"]).drop("run")


@query("""SELECT conv_id, turn, string_agg(text, ' | ' ORDER BY turn) OVER w AS context, count(*) OVER w AS n_context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def context_window(spark, d):
    return S.context_window(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context", "n_context")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn, row_number() OVER w AS ordinal, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def next_prev_turn(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"), F.row_number().over(w).cast("long").alias("ordinal"), F.count("*").over(Window.partitionBy("conv_id")).alias("total"))


@query("""WITH f AS (SELECT conv_id, turn, regexp_matches(lower(text), '\\b(hello|hi|the)\\b') AS greet, length(text) > 200 AS long FROM conversations),
p AS (SELECT *, coalesce(bool_or(greet) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM f)
SELECT conv_id, turn, CASE WHEN long AND NOT seen AND pos < 10 THEN 'opening' WHEN greet THEN 'greeting' WHEN pos < 4 THEN 'topic' ELSE 'talk' END AS label FROM p""")
def section_label(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    greet = F.lower("text").rlike(r"\b(hello|hi|the)\b")
    p = table(spark, d, "conversations").select("conv_id", "turn", greet.alias("greet"), (F.length("text") > 200).alias("long"))
    p = p.withColumn("seen", F.coalesce(F.max("greet").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).withColumn("pos", F.row_number().over(w))
    return p.select("conv_id", "turn", F.when(F.col("long") & ~F.col("seen") & (F.col("pos") < 10), "opening").when(F.col("greet"), "greeting").when(F.col("pos") < 4, "topic").otherwise("talk").alias("label"))


_EV_SQL = "ev AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS at FROM events)"


def _at(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.unix_micros("ts").alias("us"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id, us AS gap_start, nxt AS gap_end, 'gap' AS type FROM g WHERE nxt - us > 21600000000""")
def gap_fill(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    g = _at(spark, d).withColumn("nxt", F.lead("us").over(w)).filter(F.col("nxt") - F.col("us") > 6 * 3600 * 1_000_000)
    return g.select("user_id", F.col("us").alias("gap_start"), F.col("nxt").alias("gap_end"), F.lit("gap").alias("type"))


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000, false) AS overlaps FROM events")
def overlap_flags(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return _at(spark, d).select("event_id", F.coalesce(F.col("us") - F.lag("us").over(w) < 3600 * 1_000_000, F.lit(False)).alias("overlaps"))


@query()
def overlap_repair(spark, d):
    iv = _intervals(spark, d).select("user_id", F.col("s").alias("start"), F.col("e").alias("end"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return S.repair_overlaps(iv, "user_id")


@query("""WITH f AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
i AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f)
SELECT user_id, island, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM i GROUP BY ALL""")
def islands_chunks(spark, d):
    e = S.islands(_at(spark, d), "user_id", "us", 7200.0 * 1_000_000)
    return e.groupBy("user_id", "island").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


@query("SELECT epoch_us(ts) // 30000000 AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_30s(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.unix_micros("ts") / 30_000_000).cast("long").alias("bucket")).agg(F.count("*").alias("n"), _r(F.sum("value"), 2).alias("total"))


def _vectors(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", x.alias("x"), "label")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("x").alias("av"), F.col("label").alias("al")), e.select(F.col("vec_id").alias("b"), F.col("x").alias("bv"), F.col("label").alias("bl"))


_KNN = """SELECT a.vec_id AS a, b.vec_id AS b, {score} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} DESC, b.vec_id)::INTEGER AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 {where} QUALIFY rank <= {k}"""
_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_L2 = "round(1 / (1 + list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6)"


@query(_KNN.format(score=_COS, where="", k=5))
def knn_cosine(spark, d):
    q, v = _vectors(spark, d)
    return V.cosine_nearest(q, v, 5).select("a", "b", "score", "rank")


@query(_KNN.format(score=_L2, where="", k=5))
def knn_l2(spark, d):
    q, v = _vectors(spark, d)
    return J.nearest(q, v, 1 / (1 + J.squared_distance(F.col("av"), F.col("bv"))), 5).select("a", "b", "score", "rank")


@query(_KNN.format(score=_COS, where="AND a.label <> b.label", k=5))
def knn_excl(spark, d):
    q, v = _vectors(spark, d)
    pairs = v.join(J.small(q), (F.col("a") != F.col("b")) & (F.col("al") != F.col("bl"))).withColumn("score", _r(J.cosine(F.col("av"), F.col("bv"))))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("a", "b", "score", "rank")


@query(f"""WITH n AS ({_KNN.format(score=_COS, where="", k=1000)}) SELECT n.a, n.b, round(1 - score, 6) AS dissimilarity, row_number() OVER (PARTITION BY n.a ORDER BY round(1 - score, 6) DESC, n.b)::INTEGER AS rank
FROM n JOIN embeddings x ON n.a = x.vec_id JOIN embeddings y ON n.b = y.vec_id WHERE score <= 0.7 AND abs(x.label - y.label) >= 2 QUALIFY row_number() OVER (PARTITION BY n.a ORDER BY round(1 - score, 6) DESC, n.b) <= 3""")
def knn_contrast(spark, d):
    q, v = _vectors(spark, d)
    n = V.cosine_nearest(q, v, 1000).filter((F.col("score") <= 0.7) & (F.abs(F.col("al") - F.col("bl")) >= 2))
    n = n.withColumn("dissimilarity", _r(1 - F.col("score")))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("dissimilarity"), "b"))).filter("rank <= 3").select("a", "b", "dissimilarity", "rank")


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS joined, count(*) AS n FROM conversations GROUP BY conv_id")
def merge_transcript(spark, d):
    return S.ordered_join(table(spark, d, "conversations"), "conv_id", "turn", F.coalesce("text", F.lit("")))


@query("""SELECT conv_id, string_agg(format('{}\n{} --> {}\n{}\n', turn + 1, '00:' || lpad(((turn * 5) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 5) % 60)::VARCHAR, 2, '0') || ',000',
'00:' || lpad(((turn * 5 + 4) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 5 + 4) % 60)::VARCHAR, 2, '0') || ',500', coalesce(text, '')), '\n' ORDER BY turn) AS srt FROM conversations GROUP BY conv_id""")
def srt_lines(spark, d):
    start = (F.col("turn") * 5).cast("double")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("cue", F.concat(n.cast("string"), F.lit("\n"), T.caption_time(start), F.lit(" --> "), T.caption_time(start + 4.5), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")))
    return S.ordered_join(c, "conv_id", "turn", F.col("cue"), "\n").select("conv_id", F.col("joined").alias("srt"))


@query("""SELECT conv_id, '# Session ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || '> ' || coalesce(text, '') || chr(10) || '[Time: ' || lpad(((turn * 5) // 60)::VARCHAR, 2, '0') || ':' || lpad(((turn * 5) % 60)::VARCHAR, 2, '0') || ']', chr(10) || chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id""")
def md_export(spark, d):
    c = table(spark, d, "conversations").withColumn("part", F.concat(F.lit("## "), F.col("role"), F.lit("\n> "), F.coalesce("text", F.lit("")), F.lit("\n[Time: "), T.short_time((F.col("turn") * 5).cast("double")), F.lit("]")))
    return S.ordered_join(c, "conv_id", "turn", F.col("part"), "\n\n").select("conv_id", F.concat(F.lit("# Session "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.col("joined")).alias("md"))


@query("SELECT conv_id, turn, '<p class=\"' || role || '\">' || replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') || '</p>' AS html FROM conversations")
def html_export(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit('<p class="'), F.col("role"), F.lit('">'), T.escaped(F.coalesce("text", F.lit(""))), F.lit("</p>")).alias("html"))


@query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS json FROM nation")
def json_export(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("json"))


@query("""SELECT c_custkey, round(greatest(0.0, c_acctbal - coalesce(used, 0)), 2) AS remaining, round(CASE WHEN c_acctbal > 0 THEN least(100.0, 100 * coalesce(used, 0) / c_acctbal) ELSE 100.0 END, 4) AS percent, c_acctbal - coalesce(used, 0) >= 60 AS can_run
FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice) / 1000, 4) AS used FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def quota_usage(spark, d):
    used = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_r(F.sum("o_totalprice") / 1000, 4).alias("used"))
    u, limit = F.coalesce("used", F.lit(0.0)), F.col("c_acctbal")
    c = table(spark, d, "customer").join(used, "c_custkey", "left")
    return c.select("c_custkey", _r(F.greatest(F.lit(0.0), limit - u), 2).alias("remaining"), _r(F.when(limit > 0, F.least(F.lit(100.0), 100 * u / limit)).otherwise(100.0), 4).alias("percent"), (limit - u >= 60).alias("can_run"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS reset, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def month_rollover(spark, d):
    m = F.date_trunc("month", "o_orderdate").cast("date")
    return table(spark, d, "orders").groupBy(m.alias("month")).agg(F.count("*").alias("n"), _r(F.sum("o_totalprice"), 2).alias("total")).withColumn("reset", F.add_months("month", 1))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'used' WHEN o_orderdate + INTERVAL 7 DAY < TIMESTAMP '1997-01-01' THEN 'expired' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def invitation_status(spark, d):
    gone = F.col("o_orderdate") + F.expr("interval 7 days") < F.lit("1997-01-01").cast("timestamp")
    return table(spark, d, "orders").groupBy(F.when(F.col("o_orderstatus") == "F", "used").when(gone, "expired").otherwise("pending").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_records(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY user_id")
def latest_per_segment(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def session_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), _r(F.sum("value"), 2).alias("total"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_watermark(spark, d):
    from ..streaming.sessions import windowed

    return windowed(table(spark, d, "events")).select(F.col("window.start").alias("w"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes' * k AS w, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def sliding(spark, d):
    from ..streaming.sessions import windowed

    return windowed(table(spark, d, "events"), "10 minutes", "5 minutes").select(F.col("window.start").alias("w"), "event_type", "n")


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(avg(CASE WHEN value < p THEN 1.0 ELSE 0.0 END), 6) AS noise FROM events JOIN (SELECT event_type AS t, quantile_cont(value, 0.25) AS p FROM events GROUP BY 1) ON event_type = t GROUP BY ALL")
def noise_share(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    p = e.groupBy("event_type").agg(F.percentile("value", 0.25).alias("p"))
    return e.join(J.small(p), "event_type").groupBy("event_type").agg(_r(F.first("p")).alias("p25"), _r(F.avg(F.when(F.col("value") < F.col("p"), 1.0).otherwise(0.0))).alias("noise"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


def _sides(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


for _name, _op, _sql in (
    ("set_union", lambda a, b: a.union(b).distinct(), "UNION"),
    ("set_union_all", lambda a, b: a.unionAll(b), "UNION ALL"),
    ("set_intersect", lambda a, b: a.intersect(b), "INTERSECT"),
    ("set_intersect_all", lambda a, b: a.intersectAll(b), "INTERSECT ALL"),
    ("set_except_all", lambda a, b: a.exceptAll(b), "EXCEPT ALL"),
):
    QUERIES[_name] = lambda spark, d, op=_op: op(*_sides(spark, d))
    ORACLE_SQL[_name] = f"{_A} {_sql} {_B}"


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k")))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)")
def cube_counts(spark, d):
    c = QUERIES["dim_join"](spark, d)
    return c.cube("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_join(spark, d):
    n = table(spark, d, "nation").join(J.small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(J.small(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, first_value(c_custkey) OVER w AS f FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def rank_family(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("q"), _r(F.percent_rank().over(w)).alias("pr"), _r(F.cume_dist().over(w)).alias("cd"), F.first("c_custkey").over(w).alias("f"))


@query("SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
def full_join(spark, d):
    s = table(spark, d, "supplier")
    return table(spark, d, "nation").join(s, (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("s_acctbal") > 5000), "full").select("n_nationkey", "s_suppkey")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) RIGHT JOIN supplier ON n_nationkey = s_nationkey")
def right_join(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey < 3")
    return n.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT e.event_id, p.event_id AS prev_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts")
def asof_join(spark, d):
    # one sort by user and time: the last purchase before each event, never a pair join
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    buy = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return e.select("event_id", F.max(buy).over(w)["event_id"].alias("prev_id"))


@query("SELECT n_nationkey, c.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c")
def lateral_top(spark, d):
    c = table(spark, d, "customer").withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).filter("rn <= 2")
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "c_custkey")


@query()
def approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("SELECT md5(url) AS key, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY ALL")
def url_md5_dedup(spark, d):
    return table(spark, d, "pages").groupBy(F.md5("url").alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_text FROM pages")
def html_text_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n_text"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value < 0 THEN 'negative value' END, CASE WHEN value > 100 THEN 'large value' END, CASE WHEN user_id IS NULL THEN 'no user' END], lambda x: x IS NOT NULL), '; ') AS problems FROM events""")
def validation_rules(spark, d):
    rule = lambda c, t: F.when(c, F.lit(t))
    found = F.array_compact(F.array(rule(F.col("value") < 0, "negative value"), rule(F.col("value") > 100, "large value"), rule(F.col("user_id").isNull(), "no user")))
    return table(spark, d, "events").select("event_id", F.array_join(found, "; ").alias("problems"))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, text IS NOT NULL AND turn % 3 = 0 AS cached FROM conversations)
SELECT conv_id, count(*) AS total, count(*) FILTER (cached) AS n_cached, CASE WHEN count(*) FILTER (cached) = count(*) THEN 'cached' ELSE 'will_translate' END AS status, count(*) FILTER (length(t) > 100) > count(*) / 2.0 AS mostly_long FROM t GROUP BY conv_id""")
def translation_status(spark, d):
    c = table(spark, d, "conversations").withColumn("cached", F.col("text").isNotNull() & (F.col("turn") % 3 == 0))
    n, k = F.count("*"), F.count_if("cached")
    return c.groupBy("conv_id").agg(n.alias("total"), k.alias("n_cached"), F.when(k == n, "cached").otherwise("will_translate").alias("status"), (F.count_if(F.length("text") > 100) > n / 2).alias("mostly_long"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity AS len FROM lineitem)
SELECT l_orderkey, l_linenumber, p AS part, round(p * len / greatest(1, ceil(len / 30)), 6) AS part_start, round((p + 1) * len / greatest(1, ceil(len / 30)), 6) AS part_end FROM (SELECT *, unnest(range(0, greatest(1, ceil(len / 30))::BIGINT)) AS p FROM u)""")
def chunk_split(spark, d):
    u = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("s"), F.col("l_quantity").alias("e"))
    return S.split_long(u, "s", "e", 30.0).select("l_orderkey", "l_linenumber", F.col("part").cast("long").alias("part"), _r(F.col("part_start")).alias("part_start"), _r(F.col("part_end")).alias("part_end"))


@query(f"""SELECT conv_id, turn, round(100.0 * levenshtein(a, b) / greatest(length(b), 1), 4)::DOUBLE AS cer, a = b AS same FROM (SELECT conv_id, turn, array_to_string({W_SQL.format("text")}, ' ') AS a, array_to_string(list_sort({W_SQL.format("text")}), ' ') AS b FROM conversations)""")
def character_error(spark, d):
    a, b = F.array_join(T.words(F.col("text")), " "), T.sorted_words(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", a.alias("a"), b.alias("b")).select("conv_id", "turn", _r(100.0 * F.levenshtein("a", "b") / F.greatest(F.length("b"), F.lit(1)), 4).alias("cer"), (F.col("a") == F.col("b")).alias("same"))
