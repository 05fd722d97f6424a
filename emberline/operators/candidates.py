"""Candidate topics of a checkpoint: clusters, anchors, evidence, registry and the feature vector of each."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.adoption import burst_states, visible_only
from emberline.operators.anchors import anchors
from emberline.operators.clusters import LEAST_CHANNELS, UPLOADS, cohesive_clusters
from emberline.operators.families import evidence_verdicts, frequent, template_channels
from emberline.plans.dialect import render, spark_sql
from emberline.plans.tables import bounded, even_join, written
from emberline.registry import query

# Days of the recent and earlier window, of active uploads and of history, bounds of the acceleration.
RECENT, EARLIER, ACTIVE, HISTORY = 7, 28, 35, 180
SLOWEST, FASTEST = -2.0, 6.0
#: The features that a vector holds beside its topic.
FEATURES = (
    "log_active_supply", "log_recent_supply", "log_previous_weekly_supply", "supply_acceleration", "burst_state", "log_distinct_creators", "creator_diversity", "recent_creator_share",
    "new_creator_share", "channel_entropy", "mean_similarity", "minimum_similarity", "anchor_score_max", "anchor_novelty_max", "anchor_channel_support", "angle_diversity",
    "copy_family_ratio", "independent_channels", "has_view_baseline", "median_normalized_lift", "positive_lift_share", "log_topic_age_days",
)


def feature_vectors(members: DataFrame, history: DataFrame, terms: DataFrame, verdicts: DataFrame, topics: DataFrame, as_of: datetime) -> DataFrame:
    """(topic and the FEATURES) of every topic of members (topic, channel, published_at, lift).

    history: (topic, channel, published_at); terms: (topic, score, novelty, support) of anchors;
    verdicts: (topic, angle_diversity, copy_ratio, independent_channels); topics: (topic, mean_similarity, minimum_similarity, age_days).
    Raises if a member or a row of the history was published after the checkpoint.  Topics are those of the members;
    what a topic lacks elsewhere is 0, a member without a lift has no baseline.  Rows with a null topic are left out, null channels are nobody.
    """
    seen = visible_only(members.filter("topic is not null"), "published_at", as_of)
    before = visible_only(history.filter("topic is not null"), "published_at", as_of)
    floor, earlier = (F.lit(as_of - timedelta(days=d)) for d in (RECENT, EARLIER))
    recent = F.coalesce(F.col("published_at") >= floor, F.lit(False))
    previous = F.coalesce((F.col("published_at") >= earlier) & (F.col("published_at") < floor), F.lit(False))
    known = before.filter(F.col("published_at") < floor).select("topic", "channel").distinct().withColumn("_known", F.lit(True))
    # By channel first, so that distinct creators and their entropy come from one row each.
    each = seen.groupBy("topic", "channel").agg(F.count("*").alias("n"), F.count_if(recent).alias("r"), F.count_if(previous).alias("p"))
    each = each.join(known, ["topic", "channel"], "left")
    fresh = (F.col("r") > 0) & F.col("channel").isNotNull()
    share = F.col("n") * F.log("n")
    totals = each.groupBy("topic").agg(
        F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("p").alias("p"), F.count("channel").alias("creators"), F.count_if(fresh).alias("recent_creators"),
        F.count_if(fresh & F.col("_known").isNull()).alias("new_creators"), F.sum(F.when(F.col("channel").isNotNull(), share)).alias("_share"), F.sum(F.when(F.col("channel").isNotNull(), F.col("n"))).alias("_named"),
    )
    lifts = seen.groupBy("topic").agg(F.count("lift").alias("lifts"), F.percentile("lift", F.lit(0.5)).alias("_median"), F.count_if(F.col("lift") > 0).alias("_up"))
    best = terms.groupBy("topic").agg(F.max("score").alias("_score"), F.max("novelty").alias("_novelty"), F.max("support").alias("_support"))
    bursts = burst_states(seen.select("topic", "published_at"), as_of)
    held = totals.join(lifts, "topic").join(bursts, "topic")
    for side in (best, verdicts.select("topic", "angle_diversity", "copy_ratio", F.col("independent_channels").alias("_independent")), topics.select("topic", F.col("mean_similarity").alias("_mean"), F.col("minimum_similarity").alias("_least"), "age_days")):
        held = held.join(side, "topic", "left")

    def over(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    weekly = F.col("p") / (EARLIER / RECENT)
    speed = F.least(F.lit(FASTEST), F.greatest(F.lit(SLOWEST), (F.col("r") - weekly) / F.greatest(weekly, F.lit(1.0))))
    # -sum(p ln p) = ln N - sum(n ln n) / N
    entropy = F.when(F.col("creators") > 1, (F.log("_named") - F.col("_share") / F.col("_named")) / F.log("creators"))
    values = (
        F.log1p("n"), F.log1p("r"), F.log1p(weekly), speed, F.col("burst"), F.log1p("creators"), over("creators", "n"), over("recent_creators", "creators"),
        over("new_creators", "recent_creators"), entropy, F.col("_mean"), F.col("_least"), F.col("_score"), F.col("_novelty"), F.col("_support").cast("double"), F.col("angle_diversity"),
        F.col("copy_ratio"), F.col("_independent").cast("double"), (F.col("lifts") > 0).cast("double"), F.col("_median"), over("_up", "lifts"), F.log1p(F.greatest("age_days", F.lit(0.0))),
    )
    return held.select("topic", *[F.round(F.coalesce(v, F.lit(0.0)), 6).alias(name) for name, v in zip(FEATURES, values)])


def build_candidates(videos: DataFrame, vectors: DataFrame, as_of: datetime) -> DataFrame:
    """(cluster, topic, label, status, reasons, members and the FEATURES) of every candidate at a checkpoint.

    videos: (id, channel, title, published_at, lift); vectors: (id, vector).  Uploads of the last 35 days are clustered; the
    background is all that is visible, template channels come from half a year.  Rows published later are
    left out, so what comes after the checkpoint changes nothing.  Every candidate is returned, rejected ones with their reasons.
    The label is the anchors' terms.  Clusters that the registry takes for one topic share its history.
    """
    from emberline.streaming.registry import topic_changes

    at = F.lit(as_of)
    visible = written(videos.filter((F.col("published_at") <= at) & F.col("id").isNotNull()).select("id", "channel", "title", F.col("published_at").cast("timestamp").alias("published_at"), "lift"), "visible")
    active = visible.filter(F.col("published_at") >= F.lit(as_of - timedelta(days=ACTIVE))).select("id", "channel")
    found = cohesive_clusters(vectors.join(active, "id"), UPLOADS)
    rows = found.select("cluster", "centroid", "mean_similarity", "minimum_similarity", F.explode("members").alias("id")).join(visible, "id")
    rows = written(rows, "rows")
    gated = rows.groupBy("cluster").agg(F.count_distinct("channel").alias("channels")).filter(F.col("channels") >= LEAST_CHANNELS)
    members = written(rows.join(bounded(gated.select("cluster")), "cluster", "left_semi"), "members")

    aged = visible.join(members.select("id", "cluster"), "id", "left")
    days = (F.unix_timestamp(at) - F.unix_timestamp("published_at")) / 86_400
    terms = written(anchors(aged.select("cluster", F.col("channel").alias("support_key"), F.col("title").alias("text"), days.alias("age_days"))), "anchors")
    # Copies follow the earliest upload, so ids are put in order of time.
    timed = F.concat(F.date_format("published_at", "yyyyMMddHHmmss"), F.lit("-"), F.lpad(F.col("id").cast("string"), 20, "0")).alias("id")
    recent = visible.filter(F.col("published_at") >= F.lit(as_of - timedelta(days=HISTORY)))
    common = frequent(visible.select("title"))  # one pass over all titles for both
    templates = written(template_channels(recent.select("channel", timed, "title"), common), "templates")
    verdicts = written(evidence_verdicts(members.select(F.col("cluster").alias("topic"), timed, "channel", "title"), common, templates), "verdicts")

    named = terms.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("anchors"))
    lists = members.groupBy("cluster").agg(F.first("centroid").alias("centroid"), F.collect_set(F.col("id").cast("string")).alias("members"), F.collect_set("channel").alias("channels"))
    asked = lists.join(named, "cluster", "left").select(F.lit("all").alias("niche"), at.alias("as_of"), F.lpad(F.col("cluster").cast("string"), 20, "0").alias("cluster"), "members", "channels", "anchors", "centroid")
    changes = written(topic_changes(asked), "changes")
    topic = changes.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(F.first("topic").alias("name"), F.min("first_seen").alias("first_seen"))
    age = (F.unix_timestamp(at) - F.unix_timestamp("first_seen")) / 86_400
    known = written(topic.select("cluster", "name", age.alias("age_days")), "topics")
    shared = members.join(known, "cluster").select("name", "channel", "published_at")
    history = even_join(shared, known.select("name", "cluster"), ["name"], "channel").select(F.col("cluster").alias("topic"), "channel", "published_at")

    cohesion = members.groupBy(F.col("cluster").alias("topic")).agg(F.first("mean_similarity").alias("mean_similarity"), F.first("minimum_similarity").alias("minimum_similarity")).join(known.select(F.col("cluster").alias("topic"), "age_days"), "topic")
    features = feature_vectors(members.select(F.col("cluster").alias("topic"), "channel", "published_at", "lift"), history, terms.withColumnRenamed("cluster", "topic"), verdicts, cohesion, as_of)
    label = F.array_join("anchors", " / ")
    joined = features.join(verdicts.select("topic", "status", "reasons", "members"), "topic").withColumnRenamed("topic", "cluster").join(known.select("cluster", F.col("name").alias("topic")), "cluster").join(named, "cluster", "left")
    return joined.select("cluster", "topic", F.coalesce(label, F.lit("")).alias("label"), "status", "reasons", "members", *FEATURES)


AS_OF = datetime.fromisoformat("2024-01-24 00:00:00+00:00")
#: Documents stand for uploads: a run of twenty for a topic, source for the channel, a remainder of the id for the age, length against 1,000 for the lift.
MEMBERS = "SELECT <<run:doc_id>> AS topic, source AS channel, TIMESTAMP '2024-01-24 00:00:00' - <<days:doc_id % 35>> AS published_at, CASE WHEN doc_id % 3 > 0 THEN ln((n_chars + 1) / 1001e0) END AS lift FROM documents"
EARLIER_ROWS = "SELECT <<run:doc_id>> AS topic, source AS channel, TIMESTAMP '2024-01-24 00:00:00' - <<days:8 + doc_id % 100>> AS published_at FROM documents WHERE doc_id % 2 = 0"
TERMS = "SELECT <<run:doc_id>> AS topic, (n_chars % 97) / 10e0 AS score, 1e0 / (1 + doc_id % 9) AS novelty, doc_id % 5 AS support FROM documents WHERE doc_id % 4 = 0"
VERDICTS = "SELECT <<run:doc_id>> AS topic, min(n_chars % 11) / 11e0 AS angle_diversity, max(n_chars % 7) / 7e0 AS copy_ratio, count(DISTINCT source) AS independent_channels FROM documents GROUP BY <<run:doc_id>>"
TOPICS = "SELECT <<run:doc_id>> AS topic, avg(n_chars % 5) / 5e0 AS mean_similarity, min(n_chars % 3) / 3e0 AS minimum_similarity, max(doc_id % 13) * 1e0 AS age_days FROM documents GROUP BY <<run:doc_id>>"


@query(
    render(
        f"""WITH RECURSIVE m AS ({MEMBERS}), h AS ({EARLIER_ROWS}), c AS (SELECT topic, channel, count(*) AS n, count(*) FILTER (published_at >= TIMESTAMP '2024-01-17') AS r,
  count(*) FILTER (published_at >= TIMESTAMP '2023-12-27' AND published_at < TIMESTAMP '2024-01-17') AS p FROM m GROUP BY topic, channel),
k AS (SELECT c.*, EXISTS (SELECT 1 FROM h WHERE h.topic = c.topic AND h.channel = c.channel AND h.published_at < TIMESTAMP '2024-01-17') AS old FROM c),
t AS (SELECT topic, sum(n) AS n, sum(r) AS r, sum(p) / 4e0 AS w, count(*) AS creators, count(*) FILTER (r > 0) AS rc, count(*) FILTER (r > 0 AND NOT old) AS nc, list(n) AS ns FROM k GROUP BY topic),
e AS (SELECT topic, -list_sum(list_transform(ns, lambda x: x / n * ln(x / n))) / ln(creators) AS entropy FROM t WHERE creators > 1),
l AS (SELECT topic, count(lift) AS lifts, median(lift) AS mid, count(*) FILTER (lift > 0) AS up FROM m GROUP BY topic),
d AS (SELECT topic, 28 - date_diff('day', published_at, TIMESTAMP '2024-01-24') AS i, count(*) AS n FROM m WHERE published_at >= TIMESTAMP '2023-12-27' GROUP BY ALL),
b AS (SELECT topic, sum(n) / 29e0 AS rate FROM d GROUP BY topic),
o AS (SELECT b.topic, r.i, rate - coalesce(d.n, 0) * ln(rate) AS a, 2 * rate - coalesce(d.n, 0) * ln(2 * rate) AS z FROM b CROSS JOIN (SELECT unnest(range(29)) AS i) r LEFT JOIN d ON d.topic = b.topic AND d.i = r.i),
v AS (SELECT topic, i, a AS x, z AS y, '0' AS f, '1' AS g FROM o WHERE i = 0 UNION ALL SELECT o.topic, o.i, least(v.x + o.a, v.y + 1 + o.a), least(v.x + 1 + o.z, v.y + o.z),
  CASE WHEN v.x + o.a <= v.y + 1 + o.a THEN v.f ELSE v.g END || '0', CASE WHEN v.x + 1 + o.z <= v.y + o.z THEN v.f ELSE v.g END || '1' FROM v JOIN o ON o.topic = v.topic AND o.i = v.i + 1),
s AS (SELECT topic, len(replace(right(CASE WHEN x <= y THEN f ELSE g END, 7), '0', '')) / 7e0 AS burst FROM v WHERE i = 28),
a AS (SELECT topic, max(score) AS score, max(novelty) AS novelty, max(support) AS support FROM ({TERMS}) q GROUP BY topic)
SELECT topic, round(ln(1 + n), 6) AS log_active_supply, round(ln(1 + r), 6) AS log_recent_supply, round(ln(1 + w), 6) AS log_previous_weekly_supply, round(least(6e0, greatest(-2e0, (r - w) / greatest(w, 1))), 6) AS supply_acceleration,
  round(coalesce(burst, 0e0), 6) AS burst_state, round(ln(1 + creators), 6) AS log_distinct_creators, round(creators / n, 6) AS creator_diversity, round(rc / greatest(creators, 1), 6) AS recent_creator_share,
  round(nc / greatest(rc, 1), 6) AS new_creator_share, round(coalesce(entropy, 0e0), 6) AS channel_entropy, round(mean_similarity, 6) AS mean_similarity, round(minimum_similarity, 6) AS minimum_similarity,
  round(coalesce(a.score, 0e0), 6) AS anchor_score_max, round(coalesce(a.novelty, 0e0), 6) AS anchor_novelty_max, coalesce(a.support, 0) * 1e0 AS anchor_channel_support, round(angle_diversity, 6) AS angle_diversity,
  round(copy_ratio, 6) AS copy_family_ratio, independent_channels * 1e0 AS independent_channels, CASE WHEN lifts > 0 THEN 1e0 ELSE 0e0 END AS has_view_baseline, round(coalesce(mid, 0e0), 6) AS median_normalized_lift,
  round(up / greatest(lifts, 1), 6) AS positive_lift_share, round(ln(1 + age_days), 6) AS log_topic_age_days
FROM t LEFT JOIN e USING (topic) JOIN l USING (topic) LEFT JOIN s USING (topic) LEFT JOIN a USING (topic) JOIN ({VERDICTS}) y USING (topic) JOIN ({TOPICS}) z USING (topic)""",
        1,
    )
)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row I48: anchors, verdicts and cohesion are made of the documents' lengths here."""
    sides = [spark_sql(spark, sf_dir, render(text, 0)) for text in (MEMBERS, EARLIER_ROWS, TERMS, VERDICTS, TOPICS)]
    return feature_vectors(*[s.withColumn("published_at", F.col("published_at").cast("timestamp")) if "published_at" in s.columns else s for s in sides], AS_OF)


@query()
def candidate_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row J14: documents and the vectors of the same number stand for uploads of the last 60 days."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ago = F.make_dt_interval((F.col("doc_id") % 60).cast("int"))
    videos = documents.select(F.col("doc_id").alias("id"), F.col("source").alias("channel"), F.col("text").alias("title"), (F.lit(AS_OF) - ago).alias("published_at"), F.log((F.col("n_chars") + 1) / 1001.0).alias("lift"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return build_candidates(videos, vectors, AS_OF)
