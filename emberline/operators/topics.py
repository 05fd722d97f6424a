"""Topic measurements, scores, gates and rankings over the event stream."""

from emberline.plans.dialect import sql_query
from emberline.sources.roles import AS_OF, SCORED, TOPIC_EVENTS, UPLOADS_AS_OF

MEASURED = f"""WITH e AS ({TOPIC_EVENTS}),
m AS (SELECT topic, count(*) AS n, count(DISTINCT channel) AS channels,
  count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 1 DAY) AS n24, count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 3 DAY) AS n72,
  count(*) FILTER (WHERE ts <= {AS_OF} - INTERVAL 1 DAY AND ts > {AS_OF} - INTERVAL 2 DAY) AS prev24,
  count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 7 DAY) AS n7, count(*) FILTER (WHERE ts <= {AS_OF} - INTERVAL 7 DAY) AS before7,
  count(DISTINCT CASE WHEN ts > {AS_OF} - INTERVAL 7 DAY THEN channel END) AS channels7,
  count(DISTINCT CASE WHEN large THEN channel END) AS large_channels, median(value) AS median_velocity, max(value) AS top_velocity, sum(value) AS total_velocity,
  min(ts) AS first_seen, max(ts) AS last_seen FROM e GROUP BY topic),
c AS (SELECT e.topic, sum(least(e.value, greatest(4 * m.median_velocity, 1e0))) AS capped FROM e JOIN m ON e.topic = m.topic GROUP BY e.topic)"""
#: What the events lack: one provider, complete snapshots and baselines, no transcripts, no demand, specificity 70.
#: A click stands for a search appearance; value over the channel's median for an outlier ratio.
EXTRA = f"""{MEASURED},
med AS (SELECT channel, median(value) AS typical FROM e GROUP BY channel),
x AS (SELECT e.topic, median(e.value / greatest(med.typical, 1e-6)) AS median_outlier, max(e.value / greatest(med.typical, 1e-6)) AS top_outlier,
  count(DISTINCT CASE WHEN e.channel < 10 THEN 'large' WHEN e.channel < 50 THEN 'medium' ELSE 'small' END) AS buckets,
  count(DISTINCT CASE WHEN e.ts > {AS_OF} - INTERVAL 3 DAY THEN e.channel END) AS channels72,
  count(*) FILTER (WHERE e.event_type = 'click' AND e.ts > {AS_OF} - INTERVAL 1 DAY) AS found24,
  count(*) FILTER (WHERE e.event_type = 'click' AND e.ts <= {AS_OF} - INTERVAL 1 DAY AND e.ts > {AS_OF} - INTERVAL 2 DAY) AS found_before
  FROM e JOIN med ON e.channel = med.channel GROUP BY e.topic),
pc AS (SELECT topic, max(k) AS top_channel FROM (SELECT topic, channel, count(*) AS k FROM e GROUP BY topic, channel) q GROUP BY topic),
f AS (SELECT m.*, c.capped, x.median_outlier, x.top_outlier, x.buckets, x.channels72, x.found24, x.found_before, pc.top_channel * 1e0 / n AS channel_share,
  top_velocity / greatest(total_velocity, 1e-6) AS velocity_share, (n24 - prev24) * 1e0 / greatest(prev24, 1) AS acceleration,
  (<<secs:{AS_OF}>> - <<secs:first_seen>>) / 86400e0 AS age FROM m JOIN c ON m.topic = c.topic JOIN x ON m.topic = x.topic JOIN pc ON m.topic = pc.topic)"""


def bounded(expression: str) -> str:
    return f"round(least(100e0, greatest(0e0, {expression})), 2)"


def log(base: str, value: str) -> str:
    return f"ln({value}) / ln({base})"


# The weights of the nine components and the steps of each.
COMPONENTS = {
    "momentum": bounded(f"n24 * 13 + n72 * 4 + {log('10e0', 'capped + 1')} * 11 + greatest(-10e0, least(20e0, acceleration * 18))"),
    "diversity": bounded("channels * 1e0 / greatest(n, 1) * 45 + least(channels * 6, 35) + least(buckets * 7, 20)"),
    "outliers": bounded(f"20 + {log('2e0', 'greatest(median_outlier, 1e0)')} * 32 + {log('2e0', 'greatest(top_outlier, 1e0)')} * 12"),
    "novelty": bounded(f"100 * exp(-greatest(0e0, age) / 21) * .45e0 + least(100e0, n72 * 100e0 / greatest(n, 1)) * .25e0 + least(100e0, channels72 * 100e0 / greatest(channels, 1)) * .15e0 + {bounded('50 + acceleration * 25')} * .15e0"),
    "spread": bounded("channels72 * 9 + buckets * 12"),
    "search": f"CASE WHEN found_before > 0 THEN {bounded('50 + (found24 * 1e0 / found_before - 1) * 35')} ELSE {bounded('25 + found24 * 8')} END",
    "saturation": bounded("n72 * 4 + large_channels * 9 + large_channels * 1e0 / greatest(channels, 1) * 30"),
    "fragility": bounded("velocity_share * 48 + channel_share * 34 + CASE n WHEN 1 THEN 30 WHEN 2 THEN 15 ELSE 0 END + 10 + 6"),
}
WEIGHTS = {"momentum": ".22e0", "diversity": ".16e0", "outliers": ".16e0", "novelty": ".12e0", "spread": ".10e0", "search": ".09e0", "saturation": "-.14e0", "fragility": "-.10e0"}
SCORE = f"""{EXTRA}, s AS (SELECT topic, n, n24, n72, channels, large_channels, {', '.join(f'{v} AS {k}' for k, v in COMPONENTS.items())} FROM f),
scored AS (SELECT *, round(least(100e0, greatest(0e0, {' + '.join(f'({w}) * {k}' for k, w in WEIGHTS.items())})), 1) AS score,
  CASE WHEN saturation >= 78 THEN 'Saturated' WHEN n24 = 0 AND n72 = 0 THEN 'Declining' WHEN large_channels >= 3 AND channels >= 7 THEN 'Mass Market'
    WHEN momentum >= 72 AND channels >= 5 THEN 'Breakout' WHEN channels >= 3 AND (n24 >= 2 OR momentum >= 46) THEN 'Emerging' ELSE 'Seed' END AS stage,
  CASE WHEN n >= 6 AND channels >= 5 THEN 'High' WHEN n >= 3 AND channels >= 3 THEN 'Medium' ELSE 'Low' END AS confidence FROM s)"""

for name, row, text in [
    ("topic_measurements", "D2, D3, D9", f"{MEASURED} SELECT m.topic, n, channels, n24, n72, prev24, n7, before7, large_channels, round(median_velocity, 6) AS median_velocity, round(capped, 4) AS capped_velocity FROM m JOIN c ON m.topic = c.topic"),
    ("topic_score", "I38, I40, F1", f"{SCORE} SELECT topic, n, channels, score, stage, confidence FROM scored"),
    ("topk_predictions", "F1", f"{SCORE} SELECT topic, score FROM scored ORDER BY score DESC, topic LIMIT 20"),
    ("top_quintile", "F4", f"{SCORE}, r AS (SELECT topic, score, row_number() OVER (ORDER BY score DESC, topic) AS place, count(*) OVER () AS total FROM scored) SELECT topic, score, cast(place AS bigint) AS place FROM r WHERE place <= greatest(1, floor(total / 5e0))"),
    ("top_fraction_ceil", "F13", f"{SCORE}, r AS (SELECT topic, score, row_number() OVER (ORDER BY score DESC, topic) AS place, count(*) OVER () AS total FROM scored) SELECT topic, score FROM r WHERE place <= greatest(1, ceil(total * .15e0))"),
    ("actionable_gate", "B12, B13", f"{SCORE} SELECT topic, score >= 40 AND (channels >= 3 OR stage = 'Breakout') AND stage <> 'Declining' AS actionable FROM scored"),
    ("window_counts", "B3", f"WITH e AS ({TOPIC_EVENTS}) SELECT topic, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 7 DAY) AS recent, count(*) FILTER (WHERE ts < {AS_OF} - INTERVAL 7 DAY AND ts >= {AS_OF} - INTERVAL 28 DAY) AS previous FROM e GROUP BY topic"),
    ("median_lift", "D3", f"WITH e AS ({TOPIC_EVENTS}) SELECT channel, round(median(value), 6) AS median_value FROM e GROUP BY channel"),
    ("percentile_interp", "D4", f"WITH e AS ({TOPIC_EVENTS}) SELECT event_type, round(percentile_cont(.2e0) WITHIN GROUP (ORDER BY value), 6) AS p20, round(percentile_cont(.9e0) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM e GROUP BY event_type"),
    ("percentile_nearest", "D5", f"WITH e AS ({TOPIC_EVENTS}), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e) SELECT event_type, max(CASE WHEN k = greatest(1, ceil(n * .5e0)) THEN value END) AS p50, max(CASE WHEN k = greatest(1, ceil(n * .95e0)) THEN value END) AS p95 FROM r GROUP BY event_type"),
    ("channel_entropy", "D7", f"WITH e AS ({TOPIC_EVENTS}), c AS (SELECT topic, channel, count(*) AS n FROM e GROUP BY topic, channel), t AS (SELECT topic, sum(n) AS total, count(*) AS k FROM c GROUP BY topic) SELECT c.topic, round(CASE WHEN max(k) <= 1 THEN 0e0 ELSE -sum((n * 1e0 / total) * ln(n * 1e0 / total)) / ln(greatest(max(k), 2)) END, 6) AS entropy FROM c JOIN t ON c.topic = t.topic GROUP BY c.topic"),
    ("top_share", "D8", f"WITH e AS ({TOPIC_EVENTS}), c AS (SELECT topic, channel, count(*) AS n, sum(value) AS v FROM e GROUP BY topic, channel) SELECT topic, round(max(n) * 1e0 / sum(n), 6) AS count_share, round(max(v) / greatest(sum(v), 1e0), 6) AS value_share FROM c GROUP BY topic"),
    ("group_count", "D1", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    ("daily_trend", "D23", f"WITH d AS (SELECT <<from_secs:<<secs:TIMESTAMP '2024-01-18 00:00:00'>> + k * 86400>> AS day FROM (SELECT <<explode:sequence(0, 6)>> AS k)), e AS (SELECT <<day:ts>> AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) SELECT d.day, coalesce(e.n, 0) AS n FROM d LEFT JOIN e ON d.day = e.day".replace("sequence(0, 6)", "<<seq:0, 6>>")),
    ("freshness", "D24", f"WITH e AS ({TOPIC_EVENTS}), f AS (SELECT channel, max(ts) AS last_seen FROM e GROUP BY channel) SELECT max(last_seen) AS newest, min(last_seen) AS oldest, count(*) FILTER (WHERE last_seen < {AS_OF} - INTERVAL 12 HOUR) AS stale, count(*) FILTER (WHERE last_seen < {AS_OF} - INTERVAL 3 DAY) AS dead FROM f"),
    ("dominant_pattern", "D27", f"WITH e AS ({TOPIC_EVENTS}), c AS (SELECT channel, event_type, count(*) AS n FROM e GROUP BY channel, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY channel) AS total FROM c) SELECT channel, event_type, round(n * 1e0 / total, 6) AS share FROM r WHERE k = 1"),
    ("snapshot_buckets", "D29, I27, K3", f"WITH e AS ({TOPIC_EVENTS}), a AS (SELECT event_type, event_id, ts, value, <<secs:ts>> AS t, <<secs:{AS_OF}>> - <<secs:ts>> AS age FROM e), s AS (SELECT *, CASE WHEN age <= 21600 THEN 900 WHEN age <= 259200 THEN 3600 WHEN age <= 1209600 THEN 21600 ELSE 86400 END AS res FROM a) SELECT event_type, cast(res AS bigint) AS resolution, cast(t - t % res AS bigint) AS bucket_start, count(*) AS n, round(min(value), 4) AS lowest, round(max(value), 4) AS highest, round(avg(value), 4) AS mean FROM s GROUP BY event_type, res, t - t % res"),
    ("lifecycle_summary", "D30", f"WITH e AS ({TOPIC_EVENTS}) SELECT topic, min(ts) AS first_seen, min(CASE WHEN large THEN ts END) AS first_large, min(CASE WHEN event_type = 'purchase' THEN ts END) AS first_purchase FROM e GROUP BY topic"),
    ("second_independent", "E12", f"WITH e AS ({TOPIC_EVENTS}), f AS (SELECT topic, channel, min(ts) AS t FROM e GROUP BY topic, channel), r AS (SELECT topic, t, row_number() OVER (PARTITION BY topic ORDER BY t, channel) AS k FROM f) SELECT topic, coalesce(min(CASE WHEN k = 2 THEN t END), min(t)) AS second_at FROM r GROUP BY topic"),
    ("velocity_acceleration", "E2", f"WITH e AS ({TOPIC_EVENTS}), l AS (SELECT channel, event_id, value, <<secs:ts>> AS t, lag(value, 1) OVER (PARTITION BY channel ORDER BY ts, event_id) AS v1, lag(value, 2) OVER (PARTITION BY channel ORDER BY ts, event_id) AS v2, <<secs:lag(ts, 1) OVER (PARTITION BY channel ORDER BY ts, event_id)>> AS t1, <<secs:lag(ts, 2) OVER (PARTITION BY channel ORDER BY ts, event_id)>> AS t2, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, event_id DESC) AS k FROM e), v AS (SELECT channel, greatest(0e0, (value - v1) / greatest((t - t1) / 3600e0, .01e0)) AS velocity, greatest(0e0, (v1 - v2) / greatest((t1 - t2) / 3600e0, .01e0)) AS previous FROM l WHERE k = 1) SELECT channel, round(velocity, 4) AS velocity, round(previous, 4) AS previous, round(greatest(-500e0, least(500e0, 100 * (velocity - previous) / greatest(previous, 1e0))), 4) AS acceleration FROM v"),
    ("momentum_change", "E4", f"WITH e AS ({TOPIC_EVENTS}), d AS (SELECT topic, <<day:ts>> AS day, sum(value) AS v FROM e GROUP BY 1, 2), l AS (SELECT topic, day, v, lag(v, 1) OVER (PARTITION BY topic ORDER BY day) AS p1, coalesce(lag(v, 3) OVER (PARTITION BY topic ORDER BY day), first_value(v) OVER (PARTITION BY topic ORDER BY day)) AS p3 FROM d) SELECT topic, day, round(v - p1, 4) AS change, round(100 * (v - p3) / greatest(p3, 1e0), 4) AS change_pct FROM l"),
    ("avg_percentile_rank", "E10", f"WITH e AS ({TOPIC_EVENTS}), v AS (SELECT topic, count(*) AS n FROM e GROUP BY topic), r AS (SELECT topic, rank() OVER (ORDER BY n) AS k, count(*) OVER (PARTITION BY n) AS same, count(*) OVER () AS total FROM v) SELECT topic, round(CASE WHEN total = 1 THEN 1e0 ELSE (k - 1 + (same - 1) / 2e0) / (total - 1) END, 6) AS percentile FROM r"),
    ("spearman", "E11", f"WITH e AS ({TOPIC_EVENTS}), v AS (SELECT channel, count(*) AS n, sum(value) AS s FROM e GROUP BY channel), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2e0 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS b FROM v) SELECT round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS rho, count(*) AS n FROM r"),
    ("evidence_roles", "E14", f"WITH e AS ({TOPIC_EVENTS}), r AS (SELECT topic, event_id, row_number() OVER (PARTITION BY topic ORDER BY value DESC, event_id) AS k FROM e) SELECT topic, event_id, CASE WHEN k <= 2 THEN 'driver' WHEN k <= 5 THEN 'amplifier' ELSE 'supporting' END AS role FROM r"),
    ("lifecycle_transitions", "E16", f"WITH e AS ({TOPIC_EVENTS}), l AS (SELECT channel, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY channel ORDER BY ts, event_id) AS before FROM e) SELECT channel, event_id, before, event_type FROM l WHERE before IS NULL OR before <> event_type"),
    ("hash_order", "F3", f"WITH e AS ({TOPIC_EVENTS}), t AS (SELECT DISTINCT topic FROM e) SELECT topic, <<sha:'2024-01-24|' || topic>> AS place FROM t"),
    ("coalesce_best", "G6", f"WITH e AS ({TOPIC_EVENTS}), r AS (SELECT topic, channel, event_id, value, row_number() OVER (PARTITION BY topic, channel ORDER BY value DESC, ts, event_id) AS k FROM e) SELECT topic, channel, event_id FROM r WHERE k = 1"),
    ("upsert_observation", "G11, K6", f"WITH e AS ({TOPIC_EVENTS}) SELECT topic, channel, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observations FROM e GROUP BY topic, channel"),
    ("new_channels", "G2", f"WITH e AS ({TOPIC_EVENTS}) SELECT DISTINCT a.topic, a.channel FROM e a LEFT ANTI JOIN (SELECT topic, channel FROM e WHERE ts < {AS_OF} - INTERVAL 7 DAY) b ON a.topic = b.topic AND a.channel = b.channel WHERE a.ts >= {AS_OF} - INTERVAL 7 DAY".replace("LEFT ANTI JOIN", "<<anti:JOIN>>")),
    ("adoption_outcome", "E6", f"WITH e AS ({TOPIC_EVENTS}), past AS (SELECT DISTINCT topic, channel FROM e WHERE ts <= {AS_OF} - INTERVAL 10 DAY), f AS (SELECT e.topic, e.channel, e.ts, e.event_id, p.channel IS NULL AS fresh FROM e LEFT JOIN past p ON e.topic = p.topic AND e.channel = p.channel WHERE e.ts > {AS_OF} - INTERVAL 10 DAY), o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY topic, channel ORDER BY ts, event_id) AS nth FROM f), s AS (SELECT topic, ts, n, sum(CASE WHEN fresh AND nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS new_channels, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS new_rows FROM o) SELECT topic, min(CASE WHEN n >= 4 AND new_channels >= 3 AND new_rows * 1e0 / n >= .5e0 THEN ts END) AS fired_at FROM s GROUP BY topic"),
    ("idempotency_bucket", "K2", "SELECT cast(floor(<<secs:ts>> / 900e0) AS bigint) AS bucket, count(*) AS n FROM events GROUP BY 1"),
    ("tumbling_window", "K3", "SELECT event_type, cast(<<secs:ts>> - <<secs:ts>> % 3600 AS bigint) AS bucket_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    ("consecutive_failures", "D47", f"WITH e AS ({TOPIC_EVENTS}), o AS (SELECT channel, event_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e) SELECT channel, event_id, cast(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY channel, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS failures FROM o"),
    ("budget_running_sum", "D49", f"WITH e AS ({TOPIC_EVENTS}) SELECT channel, event_id, round(sum(value) OVER (PARTITION BY channel, <<day:ts>> ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent_today FROM e"),
    ("circuit_state", "D48, H17", f"WITH e AS ({TOPIC_EVENTS}), r AS (SELECT channel, event_type, value, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, event_id DESC) AS k FROM e) SELECT channel, count(*) AS seen, count(*) >= 10 AND sum(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) * 1e0 / count(*) >= .3e0 AS open FROM r WHERE k <= 10 GROUP BY channel"),
    ("provider_metrics", "D20, F10", "SELECT event_type, count(*) AS requests, round(avg(value), 6) AS mean, round(percentile_cont(.5e0) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(.95e0) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events GROUP BY event_type"),
    ("product_funnel", "D22", "SELECT count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clickers, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers, round(median(CASE WHEN event_type = 'purchase' THEN value END), 6) AS median_purchase FROM events"),
    ("hash_jitter", "I33", "SELECT event_id, <<hex8:<<sha:cast(event_id AS string)>>>> % 900 AS jitter FROM events"),
    ("age_days", "I25, I26", f"SELECT event_id, round((<<secs:{AS_OF}>> - <<secs:ts>>) / 86400e0, 3) AS age, cast(floor((<<secs:{AS_OF}>> - <<secs:ts>>) / 86400e0) AS bigint) AS whole_days FROM events"),
    ("json_component", "I58", "SELECT event_id, coalesce(try_cast(<<json_k:props>> AS bigint), 0) AS k FROM events"),
    ("content_dedup", "A13, I59", "WITH h AS (SELECT event_id, ts, <<sha:event_type || '|' || props>> AS hash FROM events) SELECT hash, min(event_id) AS first_id, count(*) AS copies FROM h GROUP BY hash"),
    ("unpivot_metrics", "A15", "SELECT event_id, 'value' AS metric, value AS number FROM events UNION ALL SELECT event_id, 'k' AS metric, cast(<<json_k:props>> AS double) AS number FROM events"),
    ("checkpoint_manifest", "A26", f"WITH s AS (SELECT 'events' AS source, <<secs:ts>> AS t FROM events WHERE ts <= {AS_OF} UNION ALL SELECT 'orders' AS source, <<secs:cast(o_orderdate AS timestamp)>> AS t FROM orders WHERE o_orderdate <= {UPLOADS_AS_OF}) SELECT source, count(*) AS n, min(t) AS first_at, max(t) AS last_at FROM s GROUP BY source"),
    ("calibration_metrics", "D44", f"WITH s AS ({SCORED}), b AS (SELECT least(floor(p * 10), 9e0) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y * 1e0) AS rate, sum((p - y) * (p - y)) AS sq FROM s GROUP BY 1) SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b"),
    ("average_precision", "D44", f"WITH s AS ({SCORED}), r AS (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) AS k, sum(y) OVER (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM s) SELECT round(sum(CASE WHEN y = 1 THEN hits * 1e0 / k ELSE 0e0 END) / greatest(sum(y), 1), 6) AS average_precision FROM r"),
    ("label_report", "D26", f"WITH s AS ({SCORED}) SELECT count(*) FILTER (WHERE p >= .25e0 AND y = 1) AS tp, count(*) FILTER (WHERE p >= .25e0 AND y = 0) AS fp, count(*) FILTER (WHERE p < .25e0 AND y = 1) AS fn, round(count(*) FILTER (WHERE p >= .25e0 AND y = 1) * 1e0 / greatest(count(*) FILTER (WHERE p >= .25e0), 1), 6) AS precision_ FROM s"),
    ("early_signal_score", "I39", f"{SCORE} SELECT topic, momentum, diversity, outliers, novelty, spread, search, saturation, fragility, score FROM scored"),
    ("user_bucket", "I44", f"{SCORE} SELECT topic, CASE WHEN score >= 60 THEN 'act' WHEN score >= 40 THEN 'watch' ELSE 'skip' END AS bucket FROM scored"),
    ("digest_top3", "F12, H10", f"{SCORE}, r AS (SELECT topic, stage, .65e0 * score + .35e0 * least(channels * 5, 100) AS v, row_number() OVER (PARTITION BY stage ORDER BY .65e0 * score + .35e0 * least(channels * 5, 100) DESC, topic) AS k FROM scored) SELECT stage, topic, round(v, 4) AS value FROM r WHERE k <= 3"),
    ("opportunity_window", "I29", f"{SCORE} SELECT topic, CASE stage WHEN 'Seed' THEN 2 WHEN 'Emerging' THEN 1 ELSE 0 END AS from_day, CASE stage WHEN 'Seed' THEN 10 WHEN 'Emerging' THEN 7 WHEN 'Breakout' THEN 4 WHEN 'Mass Market' THEN 2 ELSE 1 END AS to_day FROM scored"),
]:
    sql_query(name, text, row)
