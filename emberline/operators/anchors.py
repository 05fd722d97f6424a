"""Anchors: the terms that set a cluster of documents apart from the background of all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.families import tokens_of
from emberline.plans.tables import bounded, even_join, written
from emberline.registry import query

# Days of background, gates and weights of an anchor, anchors of a cluster.
BACKGROUND_DAYS, LEAST_SUPPORT, MOST_SHARE, LEAST_PART_IDF, NOVELTY_WEIGHT, MOST_ANCHORS = 365, 2, 0.10, 4.0, 1.0, 3
#: Bytes of text of a cluster that is counted in one task, bytes of text for each such task, and bytes of terms that are broadcast.
LOCAL, A_TASK, MOST_BROADCAST = 16 << 20, 4 << 20, 32 << 20


def terms_of(text: Column) -> Column:
    """The distinct tokens of a text and its distinct pairs of neighbouring tokens."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zà-ÿ0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    # The last token meets null and makes no pair.
    pairs = F.zip_with(found, F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.array_distinct(F.concat(found, pairs)))


def _supported(documents: DataFrame, sizes: DataFrame, volume: int) -> DataFrame:
    """(cluster, term, hits, support) of the terms that two support keys of a cluster use.

    The texts of clusters of up to LOCAL bytes are brought together by cluster and their terms counted where
    they are, so terms are not moved; larger clusters' terms are counted in shares and moved.
    """

    def counted(rows: DataFrame) -> DataFrame:
        each = rows.select("cluster", "support_key", F.explode(terms_of(F.col("text"))).alias("term"))
        each = each.groupBy("cluster", "term", "support_key").agg(F.count("*").alias("hits"))
        return each.groupBy("cluster", "term").agg(F.sum("hits").alias("hits"), F.count("support_key").alias("support")).filter(F.col("support") >= LEAST_SUPPORT)

    texts, large = documents.select("cluster", "support_key", "text"), sizes.filter((F.col("bytes") > LOCAL) & F.col("cluster").isNotNull()).select("cluster")
    tasks = max(volume // A_TASK, documents.sparkSession.sparkContext.defaultParallelism)
    if large.isEmpty():
        return counted(texts.repartition(tasks, "cluster"))
    small = even_join(texts, large, ["cluster"], "support_key", "left_anti")
    return counted(small.repartition(tasks, "cluster")).union(counted(even_join(texts, large, ["cluster"], "support_key", "left_semi")))


def anchors(documents: DataFrame, most: int = MOST_ANCHORS) -> DataFrame:
    """(cluster, rank, term, score, lift, idf, novelty, support) of each cluster's best terms, from documents (cluster, support_key, text, age_days).

    The background is every document of the last year (age_days from 0 to 365); its counts and first sightings are
    only taken for terms that some cluster supports, which are found first, see `_supported`.  A term needs two support keys, at most a
    tenth of the background and, if it is a pair, two rare parts; score = ln(1 + lift) idf (1 + novelty).  A
    single token goes if a better pair of the cluster holds it.  Ties go to the lesser term.  Null and
    empty texts have no terms but count as documents; null clusters are left out, a null key supports nothing.
    """
    inside = F.coalesce(F.col("age_days").between(0, BACKGROUND_DAYS), F.lit(False))
    held = documents.select("cluster", "support_key", "text", inside.alias("inside"), "age_days")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if("inside").alias("inside"))
    sizes = written(sizes, "sizes")
    seen = sizes.agg(F.sum("inside"), F.sum(F.when(F.col("cluster").isNotNull(), F.col("bytes")))).first()
    total, volume = seen[0] or 0, seen[1] or 0
    supported = written(_supported(held.filter("cluster is not null"), sizes, volume), "supported")
    # The parts of a supported pair are supported in its cluster too, so these are all terms that are asked for.
    asked = written(supported.select("term").distinct(), "asked")
    terms = held.filter("inside").select("age_days", F.explode(terms_of(F.col("text"))).alias("term"))
    few = bounded(asked, MOST_BROADCAST)
    terms = terms if few is asked else terms.join(few, "term", "left_semi")
    counts = terms.groupBy("term").agg(F.count("*").alias("df"), F.max("age_days").alias("age"))
    idf = F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0
    stats = asked.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    stats = stats.select("term", ((F.col("df") + 0.5) / (total + 0.5)).alias("share"), idf.alias("idf"), F.coalesce(1.0 / F.log(F.col("age") + math.e), F.lit(1.0)).alias("novelty"))
    stats = written(stats, "stats")
    sizes = sizes.select("cluster", "size")
    found = even_join(supported, stats.filter(F.col("share") <= MOST_SHARE), ["term"], "cluster")
    parts = F.split("term", " ")
    rare = stats.filter(F.col("idf") >= LEAST_PART_IDF).select(F.col("term").alias("part"))
    single, pairs = found.filter(~F.contains("term", F.lit(" "))), found.filter(F.contains("term", F.lit(" ")))
    for at in (0, 1):
        pairs = even_join(written(pairs.withColumn("part", F.get(parts, F.lit(at))), "pairs"), rare, ["part"], "term", "left_semi").drop("part")
    lift = F.col("hits") / F.col("size") / F.col("share")
    scored = even_join(single.unionByName(pairs), sizes, ["cluster"], "term").withColumn("lift", lift)
    scored = written(scored.withColumn("score", F.round(F.log1p("lift") * F.col("idf") * (1.0 + NOVELTY_WEIGHT * F.col("novelty")), 6)), "scored")
    # The best pair that holds a token, by score and then by name.
    covers = scored.filter(F.contains("term", F.lit(" "))).select("cluster", F.explode(parts).alias("token"), F.struct((-F.col("score")).alias("s"), F.col("term").alias("t")).alias("by"))
    covers = covers.groupBy("cluster", "token").agg(F.min("by").alias("by"))
    kept = scored.join(covers.withColumnRenamed("token", "term"), ["cluster", "term"], "left").filter(F.col("by").isNull() | (F.struct((-F.col("score")).alias("s"), F.col("term").alias("t")) < F.col("by")))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "term"))).filter(F.col("rank") <= most)
    return ranked.select("cluster", "rank", "term", "score", F.round("lift", 6).alias("lift"), F.round("idf", 6).alias("idf"), F.round("novelty", 6).alias("novelty"), "support")


@query(
    """WITH d AS (SELECT doc_id // 20 AS cluster, source, doc_id % 500 AS age, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ0-9]+'), lambda t: length(t) >= 2) AS w FROM documents),
t AS (SELECT cluster, source, age, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM d),
n AS (SELECT count(*) AS n FROM d WHERE age <= 365), z AS (SELECT cluster, count(*) AS size FROM d GROUP BY cluster),
g AS (SELECT term, (count(*) FILTER (age <= 365) + .5) / (n + .5) AS share, ln((n + 1e0) / (count(*) FILTER (age <= 365) + 1)) + 1 AS idf, coalesce(1 / ln(exp(1) + max(age) FILTER (age <= 365)), 1e0) AS novelty FROM t, n GROUP BY term, n),
c AS (SELECT cluster, term, count(*) AS hits, count(DISTINCT source) AS support FROM t GROUP BY cluster, term HAVING support >= 2),
s AS (SELECT c.cluster, c.term, support, hits / size / g.share AS lift, g.idf, g.novelty, round(ln(1 + hits / size / g.share) * g.idf * (1 + g.novelty), 6) AS score
  FROM c JOIN g ON g.term = c.term JOIN z ON z.cluster = c.cluster WHERE g.share <= .1),
a AS (SELECT s.* FROM s LEFT JOIN g x ON x.term = split_part(s.term, ' ', 1) LEFT JOIN g y ON y.term = split_part(s.term, ' ', 2) WHERE NOT contains(s.term, ' ') OR (x.idf >= 4 AND y.idf >= 4)),
p AS (SELECT cluster, unnest(string_split(term, ' ')) AS part, score, term FROM a WHERE contains(term, ' ')),
k AS (SELECT * FROM a WHERE contains(term, ' ') OR NOT EXISTS (SELECT 1 FROM p WHERE p.cluster = a.cluster AND p.part = a.term AND (p.score > a.score OR p.score = a.score AND p.term < a.term)))
SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank, term, score, round(lift, 6) AS lift, round(idf, 6) AS idf, round(novelty, 6) AS novelty, support FROM k QUALIFY rank <= 3"""
)
def anchor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows D17, I4 and I35-I37: a run of twenty documents stands for a cluster, a source for a channel, a remainder of the id for the age."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return anchors(documents.select(F.floor(F.col("doc_id") / 20).alias("cluster"), F.col("source").alias("support_key"), "text", (F.col("doc_id") % 500).alias("age_days")))
