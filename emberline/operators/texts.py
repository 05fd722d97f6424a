"""Text, corpus statistics and vector operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.matching import best_products, carriers, contained_pairs, tokens
from emberline.plans.dialect import render, sql_query
from emberline.registry import query

TOK = "t AS (SELECT doc_id, source, lang, <<tokens:text>> AS toks FROM documents)"
TERMS = f"{TOK}, d AS (SELECT doc_id, source, <<explode:<<distinct:toks>>>> AS term FROM t), n AS (SELECT count(*) AS total FROM documents), st AS (SELECT term, count(*) AS df, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM d GROUP BY term)"
BTOK = "b AS (SELECT item_id, <<distinct:<<tokens:text>>>> AS toks FROM benchmark)"
DOT = "<<dot:<<dvec:{a}>>, <<dvec:{b}>>>>"



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jaccard_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return contained_pairs(documents.select("doc_id", tokens(F.col("text")).alias("toks")), items.select("item_id", tokens(F.col("text")).alias("toks")))


def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("quote"))
    found = carriers(_table(spark, sf_dir, "documents").filter("doc_id is not null"), items)
    return items.join(found, "quote", "left").groupBy("item_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("carriers"))


def _answers(spark: SparkSession, sf_dir: str, *rules) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return best_products(vectors, vectors, *rules)


def answer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, 5, 0.2, True).select("q", F.col("other").alias("answer"), F.round("s", 4).alias("score"))


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, 30).filter("s >= .25").select("q", "other")


#: Queries whose plan is not that of their text, which would compare every two rows.
PLANS = {f.__name__: f for f in (jaccard_brief, quote_grounding, answer_search, neighbourhood)}

for name, row, text in [
    ("tokenize", "I3", f"WITH {TOK} SELECT doc_id, cast(<<size:toks>> AS bigint) AS n, cast(<<size:<<distinct:toks>>>> AS bigint) AS n_distinct FROM t"),
    ("term_stats", "D16", f"WITH {TERMS} SELECT term, df, sources, first_doc FROM st"),
    ("idf", "I34", f"WITH {TERMS} SELECT term, round(ln((total + 1e0) / (df + 1e0)) + 1, 6) AS idf FROM st CROSS JOIN n"),
    ("keyword_weights", "D41", f"WITH {TERMS} SELECT source, term, round(sum(power(.5e0, doc_id / 450e0)), 6) AS weight FROM d GROUP BY source, term HAVING count(*) >= 3"),
    ("jaccard_brief", "I5, C18", f"WITH {TOK}, {BTOK}, dt AS (SELECT doc_id, <<explode:<<distinct:toks>>>> AS term FROM t), bt AS (SELECT item_id, <<explode:toks>> AS term FROM b), o AS (SELECT dt.doc_id, bt.item_id, count(*) AS overlap FROM dt JOIN bt ON dt.term = bt.term GROUP BY 1, 2) SELECT o.doc_id, o.item_id, round(overlap * 1e0 / least(<<size:b.toks>>, <<size:<<distinct:t.toks>>>>), 6) AS containment FROM o JOIN b ON o.item_id = b.item_id JOIN t ON o.doc_id = t.doc_id WHERE overlap * 1e0 / least(<<size:b.toks>>, <<size:<<distinct:t.toks>>>>) >= .92e0"),
    ("echo_count", "G10, I6", f"WITH h AS (SELECT doc_id, source, <<sha:lower(text)>> AS fp FROM documents) SELECT doc_id, cast(count(*) OVER (PARTITION BY fp) AS bigint) AS copies FROM h"),
    ("collapse_copies", "G9", "SELECT <<sha:lower(text)>> AS fp, min(doc_id) AS head, count(*) AS n FROM documents GROUP BY 1"),
    ("lang_ascii_gate", "B7, B8", "SELECT doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) * 1e0 / greatest(length(text), 1) >= .75e0 AS english FROM documents"),
    ("text_normalize", "I1, I2", "SELECT doc_id, trim(regexp_replace(translate(lower(text), 'àâäáãçéèêëíìîïñóòôöõúùûüÿ', 'aaaaaceeeeiiiinooooouuuuy'), '[^a-z0-9]+', ' ', 'g')) AS text FROM documents"),
    ("question_filter", "B15", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (text LIKE '%?%' OR length(text) >= 40)"),
    ("demand_clusters", "D18, D43", "SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS roles, max(turn) AS last_turn, round(count(*) + ln(1 + sum(length(text))), 6) AS volume FROM conversations GROUP BY conv_id"),
    ("sparkline", "E5", "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source"),
    ("html_extract", "A19", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'html lang=\"([a-z]+)\"', 1) AS lang, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages"),
    ("quote_grounding", "I20", "SELECT b.item_id, count(d.doc_id) AS carriers FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id"),
    ("entity_resolve", "D33", f"WITH {TERMS} SELECT term, first_doc, sources, sources >= 2 AS corroborated FROM st"),
    ("centroid", "I53", "WITH x AS (SELECT label, <<explode:embedding>> AS v, vec_id FROM embeddings) SELECT label, count(*) AS n, round(sum(cast(v AS double) * v), 4) AS norm2 FROM x GROUP BY label"),
    ("cosine", "I52", f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT.format(a='a.embedding', b='b.embedding')}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0"),
    ("vector_assign", "C14", f"WITH h AS (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label), q AS (SELECT e.* FROM embeddings e JOIN h ON e.vec_id = h.vec_id), r AS (SELECT e.vec_id, q.vec_id AS head, {DOT.format(a='e.embedding', b='q.embedding')} AS s FROM embeddings e CROSS JOIN q WHERE e.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 6) DESC, head) AS place FROM r WHERE s >= .2e0) SELECT vec_id, head, round(s, 4) AS score FROM k WHERE place = 1"),
    ("answer_search", "C15, C16", f"WITH q AS (SELECT * FROM embeddings), r AS (SELECT q.vec_id AS q, e.vec_id AS answer, {DOT.format(a='e.embedding', b='q.embedding')} AS s FROM q JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label <> q.label), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, answer) AS place FROM r WHERE s >= .2e0) SELECT q, answer, round(s, 4) AS score FROM k WHERE place <= 5"),
    ("neighbourhood", "C17", f"WITH q AS (SELECT * FROM embeddings), r AS (SELECT q.vec_id AS q, e.vec_id AS other, {DOT.format(a='e.embedding', b='q.embedding')} AS s FROM q CROSS JOIN embeddings e WHERE e.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, other) AS place FROM r) SELECT q, other FROM k WHERE place <= 30 AND s >= .25e0"),
]:
    if name in PLANS:
        PLANS[name].__doc__ = f"Inventory row {row}."
        query(render(text, 1), name)(PLANS[name])
    else:
        sql_query(name, text, row)
