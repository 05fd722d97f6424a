"""Joins, panels, baselines, outcomes and reports over uploads and their observations."""

from emberline.plans.dialect import sql_query
from emberline.sources.roles import OBSERVATIONS, PANEL, UPLOADS_AS_OF, VIDEOS

T = UPLOADS_AS_OF
V, O, P = f"v AS ({VIDEOS})", f"o AS ({OBSERVATIONS})", f"p AS ({PANEL})"
#: Fixed values of the demand rule: ages that count, and the age that videos are projected to, in days.
YOUNGEST, OLDEST, REFERENCE_AGE = "0.5e0", "60e0", 7
#: Observations up to the checkpoint and of an age that counts, the median of each age-day, and each
#: video's projection to seven days; age-days without a curve (under 20 observations) have factor 1.
CURVE = f"""{V}, o0 AS ({OBSERVATIONS}), o AS (SELECT o0.* FROM o0 JOIN v ON o0.video_id = v.video_id
  WHERE <<secs:v.published_at>> + o0.age_days * 86400e0 <= <<secs:{T}>> AND o0.age_days BETWEEN {YOUNGEST} AND {OLDEST}),
b AS (SELECT floor(age_days) AS d, median(views) AS level, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 20),
ref AS (SELECT coalesce(nullif(max(CASE WHEN d = {REFERENCE_AGE} THEN level END), 0), median(level)) AS level FROM b),
near AS (SELECT video_id, views, age_days, row_number() OVER (PARTITION BY video_id ORDER BY abs(age_days - {REFERENCE_AGE}), line, age_days, views) AS k FROM o),
rv AS (SELECT near.video_id, greatest(near.views / coalesce(CASE WHEN b.level > 0 AND ref.level > 0 THEN b.level / ref.level END, 1e0), 0e0) AS ref_views
  FROM near CROSS JOIN ref LEFT JOIN b ON floor(near.age_days) = b.d WHERE k = 1),
base AS (SELECT v.channel_id, median(rv.ref_views) AS baseline, count(*) AS n FROM rv JOIN v ON rv.video_id = v.video_id GROUP BY v.channel_id HAVING count(*) >= 3 AND median(rv.ref_views) > 0)"""
CHECKPOINTS = "cp AS (SELECT TIMESTAMP '1999-01-03 00:00:00' + <<days:k * 7>> AS t FROM (SELECT <<explode:<<seq:0, 20>>>> AS k))"
WEEKLY = f"{V}, {CHECKPOINTS}, st AS (SELECT cp.t, v.topic, count(*) FILTER (WHERE v.published_at > cp.t - INTERVAL 7 DAY) AS n7, count(*) AS n35, count(DISTINCT v.channel_id) AS channels FROM cp JOIN v ON v.published_at <= cp.t AND v.published_at > cp.t - INTERVAL 35 DAY AND v.discovered_at <= cp.t GROUP BY cp.t, v.topic)"

for name, row, text in [
    ("asof_observable", "B1", f"WITH {V} SELECT video_id, channel_id FROM v WHERE discovered_at <= {T} AND published_at <= {T}"),
    ("panel_at", "B2", f"WITH {P} SELECT channel_id FROM p WHERE joined_at <= {T} AND (left_at IS NULL OR left_at > {T})"),
    ("panel_videos", "B2, C4", f"WITH {V}, {P} SELECT v.video_id FROM v WHERE v.discovered_at <= {T} AND v.channel_id IN (SELECT channel_id FROM p WHERE joined_at <= {T} AND (left_at IS NULL OR left_at > {T}))"),
    ("panel_coverage", "D31", f"WITH {V}, {P}, m AS (SELECT channel_id FROM p WHERE joined_at <= {T} AND (left_at IS NULL OR left_at > {T})), u AS (SELECT DISTINCT channel_id FROM v WHERE published_at <= {T} AND published_at > {T} - INTERVAL 90 DAY) SELECT count(*) AS members, count(u.channel_id) AS polled, round(count(u.channel_id) * 1e0 / greatest(count(*), 1), 6) AS share FROM m LEFT JOIN u ON m.channel_id = u.channel_id"),
    ("channel_evidence", "D32", f"WITH {V}, {P} SELECT p.channel_id, count(v.video_id) AS uploads_90d, max(v.published_at) AS last_upload FROM p LEFT JOIN v ON p.channel_id = v.channel_id AND v.published_at <= {T} AND v.published_at > {T} - INTERVAL 90 DAY GROUP BY p.channel_id"),
    ("panel_reconcile", "B14", f"WITH {V}, {P}, e AS (SELECT p.channel_id, count(v.video_id) AS uploads, max(v.published_at) AS last_upload, coalesce(avg(CASE WHEN v.topic IN ('1-URGENT', '2-HIGH') THEN 1e0 ELSE 0e0 END), 0e0) AS niche FROM p LEFT JOIN v ON p.channel_id = v.channel_id AND v.published_at <= {T} GROUP BY p.channel_id) SELECT channel_id, CASE WHEN last_upload IS NULL OR last_upload < {T} - INTERVAL 120 DAY THEN 'dormant' WHEN niche < .30e0 THEN 'off_niche' WHEN niche >= .50e0 AND uploads >= 3 THEN 'admit' ELSE 'keep' END AS verdict FROM e"),
    ("panel_apply", "G12", f"WITH {P}, {V}, c AS (SELECT channel_id, max(published_at) AS last_upload FROM v WHERE published_at <= {T} GROUP BY channel_id) SELECT p.channel_id, p.joined_at, CASE WHEN p.left_at IS NOT NULL THEN p.left_at WHEN c.last_upload < {T} - INTERVAL 120 DAY THEN {T} END AS left_at FROM p LEFT JOIN c ON p.channel_id = c.channel_id"),
    (
        "crawl_plan",
        "F6",
        f"""WITH {V}, {P}, l AS (SELECT p.channel_id, max(v.published_at) AS polled FROM p LEFT JOIN v ON p.channel_id = v.channel_id AND v.published_at <= {T}
  WHERE p.joined_at <= {T} AND (p.left_at IS NULL OR p.left_at > {T}) GROUP BY p.channel_id)
SELECT channel_id, polled FROM l WHERE polled IS NULL OR polled <= {T} - INTERVAL 20 HOUR
ORDER BY CASE WHEN channel_id % 50 = 0 THEN 0 ELSE 1 END, polled NULLS FIRST, channel_id LIMIT 8000""",
    ),
    ("join_multi", "C1", "SELECT n.n_name AS nation, p.p_brand AS brand, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey GROUP BY n.n_name, p.p_brand"),
    ("left_join_agg", "C2", f"WITH {V}, {O} SELECT v.video_id, count(o.line) AS observations, coalesce(max(o.views), 0e0) AS best FROM v LEFT JOIN o ON v.video_id = o.video_id GROUP BY v.video_id"),
    ("left_join_temporal", "C3", f"WITH {V}, {O} SELECT v.video_id, o.line FROM v LEFT JOIN o ON v.video_id = o.video_id WHERE o.video_id IS NULL OR v.published_at + <<days:floor(o.age_days)>> <= {T}"),
    ("semi_join", "C4, A10", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    ("semi_join_baseline_channels", "A10, A12", f"WITH {V} SELECT v.video_id, v.channel_id FROM v WHERE v.channel_id IN (SELECT channel_id FROM v WHERE topic = '1-URGENT')"),
    ("anti_pending", "B17, C5", "SELECT o_orderkey FROM orders o <<anti:JOIN>> lineitem l ON o.o_orderkey = l.l_orderkey"),
    ("correlated_max", "C6", f"WITH {O}, m AS (SELECT video_id, max(views) AS best FROM o GROUP BY video_id) SELECT o.video_id, o.line FROM o JOIN m ON o.video_id = m.video_id AND o.views = m.best"),
    ("latest_per_key_ties", "C7", f"WITH {O}, r AS (SELECT video_id, line, rank() OVER (PARTITION BY video_id ORDER BY age_days DESC) AS k FROM o) SELECT video_id, line FROM r WHERE k = 1"),
    ("latest_per_key", "C8", f"WITH {O}, r AS (SELECT video_id, line, views, row_number() OVER (PARTITION BY video_id ORDER BY age_days DESC, line DESC, views DESC) AS k FROM o) SELECT video_id, line, views FROM r WHERE k = 1"),
    ("nearest_age_sample", "C10", f"WITH {O}, t AS (SELECT <<explode:<<targets:>>>> AS target), r AS (SELECT o.video_id, t.target, o.views, row_number() OVER (PARTITION BY o.video_id, t.target ORDER BY abs(o.age_days - t.target), o.age_days, o.line, o.views) AS k FROM o JOIN t ON o.age_days >= .5e0 * t.target AND o.age_days <= 1.75e0 * t.target) SELECT video_id, cast(target AS bigint) AS target, views FROM r WHERE k = 1"),
    ("snapshot_at_horizon", "C11", f"WITH {O}, r AS (SELECT video_id, views, row_number() OVER (PARTITION BY video_id ORDER BY abs(age_days - 7), age_days, line, views) AS k FROM o WHERE age_days <= 1.2e0 * 7) SELECT video_id, views FROM r WHERE k = 1"),
    ("future_window_join", "C12", f"WITH {V}, {CHECKPOINTS} SELECT cp.t, v.topic, count(*) AS n, count(DISTINCT v.channel_id) AS channels FROM cp JOIN v ON v.published_at > cp.t AND v.published_at <= cp.t + INTERVAL 42 DAY GROUP BY cp.t, v.topic"),
    ("weekly_checkpoints", "C13", f"WITH {CHECKPOINTS} SELECT t FROM cp"),
    ("age_curve", "D12", f"WITH {CURVE} SELECT cast(b.d AS bigint) AS day, b.n, round(b.level / ref.level, 6) AS factor FROM b CROSS JOIN ref"),
    ("reference_views", "D13", f"WITH {CURVE} SELECT video_id, round(ref_views, 4) AS ref_views FROM rv"),
    ("demand_channel_baseline", "D14", f"WITH {CURVE} SELECT channel_id, n, round(baseline, 4) AS baseline FROM base"),
    ("normalized_lift", "D15", f"WITH {CURVE} SELECT rv.video_id, round(ln((rv.ref_views + 1) / (base.baseline + 1)), 6) AS lift FROM rv JOIN v ON rv.video_id = v.video_id JOIN base ON v.channel_id = base.channel_id"),
    ("topic_lift", "D15", f"WITH {CURVE} SELECT v.topic, count(*) AS support, round(median(ln((rv.ref_views + 1) / (base.baseline + 1))), 5) AS lift FROM rv JOIN v ON rv.video_id = v.video_id JOIN base ON v.channel_id = base.channel_id GROUP BY v.topic"),
    ("age_curve_coeff", "D11", f"WITH {V}, {O} SELECT v.channel_id, round(median(o.views / power(o.age_days * 24, .65e0)), 4) AS worker, round(median(o.views / power(o.age_days * 24, .72e0)), 4) AS replay FROM o JOIN v ON o.video_id = v.video_id WHERE o.age_days * 24 >= 3 GROUP BY v.channel_id"),
    ("channel_baselines", "D10", f"WITH {V}, {O} SELECT v.channel_id, count(*) AS n, round(median(o.views), 4) AS median_views, round(percentile_cont(.75e0) WITHIN GROUP (ORDER BY o.views), 4) AS top_quartile FROM o JOIN v ON o.video_id = v.video_id WHERE o.age_days <= 7 GROUP BY v.channel_id"),
    ("outlier_ratio", "I46", f"WITH {V}, {O}, l AS (SELECT video_id, max(views) AS views FROM o GROUP BY video_id), b AS (SELECT v.channel_id, median(l.views) AS base, count(*) AS n FROM l JOIN v ON l.video_id = v.video_id GROUP BY v.channel_id) SELECT v.video_id, round(CASE WHEN b.n >= 3 THEN l.views / greatest(b.base, 1e0) ELSE 1e0 END, 4) AS ratio FROM l JOIN v ON l.video_id = v.video_id JOIN b ON v.channel_id = b.channel_id"),
    ("view_growth", "E3", f"WITH {O}, m AS (SELECT video_id, age_days, max(views) AS views FROM o GROUP BY video_id, age_days), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY age_days) AS a, row_number() OVER (PARTITION BY video_id ORDER BY age_days DESC) AS z FROM m) SELECT video_id, round(max(CASE WHEN z = 1 THEN views END) / greatest(max(CASE WHEN a = 1 THEN views END), 1e0), 6) AS growth FROM r GROUP BY video_id"),
    ("upload_cadence", "E13", f"WITH {V}, g AS (SELECT channel_id, (<<secs:published_at>> - <<secs:lag(published_at) OVER (PARTITION BY channel_id ORDER BY published_at, video_id)>>) / 86400e0 AS gap FROM v) SELECT channel_id, round(median(gap), 4) AS cadence, round(30 / greatest(median(gap), .5e0), 4) AS monthly FROM g WHERE gap IS NOT NULL GROUP BY channel_id"),
    ("topn_per_group", "B16", f"WITH {V}, r AS (SELECT topic, video_id, views, row_number() OVER (PARTITION BY topic ORDER BY views DESC, video_id) AS k FROM v) SELECT topic, video_id, views FROM r WHERE k <= 2"),
    ("panel_candidates", "B18", f"WITH {V}, {O}, c AS (SELECT video_id, count(*) AS n FROM o GROUP BY video_id) SELECT v.video_id, coalesce(c.n, 0) AS n, v.views FROM v LEFT JOIN c ON v.video_id = c.video_id WHERE v.published_at <= {T} ORDER BY v.views DESC, v.video_id LIMIT 100"),
    ("due_work", "B19", f"WITH {V} SELECT video_id, topic FROM v WHERE discovered_at <= {T} AND discovered_at > {T} - INTERVAL 30 DAY ORDER BY topic, discovered_at, video_id LIMIT 200"),
    ("expire_jobs", "B20", f"WITH {V} SELECT video_id, CASE WHEN <<secs:{T}>> - <<secs:published_at>> > greatest(900e0, .75e0 * (video_id % 30) * 86400) THEN 'expired' ELSE 'pending' END AS state FROM v WHERE published_at <= {T}"),
    ("snapshot_schedule", "B21", f"WITH {V}, h AS (SELECT <<explode:<<hours:>>>> AS hours) SELECT v.video_id, cast(h.hours AS bigint) AS hours, CASE WHEN h.hours * 3600 < <<secs:v.discovered_at>> - <<secs:v.published_at>> THEN 'skipped' ELSE 'pending' END AS state FROM v CROSS JOIN h WHERE v.published_at > {T} - INTERVAL 30 DAY AND v.published_at <= {T}"),
    ("eligible_videos", "B10", f"WITH {V} SELECT v.video_id FROM v JOIN customer c ON v.channel_id = c.c_custkey WHERE c.c_acctbal >= 0 AND v.published_at > {T} - INTERVAL 30 DAY AND v.published_at <= {T}"),
    ("cluster_gate", "B11", f"WITH {V} SELECT topic, <<day:published_at>> AS day FROM v GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT channel_id) >= 3"),
    ("demand_gap_outcome", "E9", f"WITH {V}, r AS (SELECT channel_id, views, row_number() OVER (PARTITION BY channel_id ORDER BY published_at, video_id) AS k, count(*) OVER (PARTITION BY channel_id) AS n FROM v) SELECT channel_id, round(median(CASE WHEN k <= greatest(1, floor(n / 2e0)) THEN views END), 4) AS early, round(median(CASE WHEN k > n - greatest(1, floor(n / 2e0)) THEN views END), 4) AS late FROM r GROUP BY channel_id"),
    ("structural_states", "J15", f"WITH {WEEKLY} SELECT t, topic, n7, n35, channels FROM st"),
    ("checkpoint_base_rate", "D50", f"WITH {WEEKLY} SELECT t, count(*) AS episodes, count(*) FILTER (WHERE n7 * 5 > n35) AS positives, round(count(*) FILTER (WHERE n7 * 5 > n35) * 1e0 / count(*), 6) AS rate FROM st GROUP BY t"),
    ("multi_ranking", "F2", f"WITH {WEEKLY}, u AS (SELECT t, topic, 'supply' AS method, n7 AS value FROM st UNION ALL SELECT t, topic, 'breadth', channels FROM st UNION ALL SELECT t, topic, 'volume', n35 FROM st) SELECT t, method, topic, cast(row_number() OVER (PARTITION BY t, method ORDER BY value DESC, topic) AS bigint) AS place FROM u"),
    ("ranking_comparison", "D35", f"WITH {WEEKLY}, u AS (SELECT t, topic, n7 * 5 > n35 AS fired, row_number() OVER (PARTITION BY t ORDER BY n35 DESC, topic) AS k FROM st) SELECT count(*) FILTER (WHERE k <= 2 AND fired) AS hits, round(count(*) FILTER (WHERE k <= 2 AND fired) * 1e0 / count(*) FILTER (WHERE k <= 2), 6) AS precision_at_2 FROM u"),
    ("temporal_split", "E17", f"WITH {WEEKLY}, d AS (SELECT t, dense_rank() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM st)), m AS (SELECT max(k) AS n FROM d) SELECT d.t, CASE WHEN d.k <= ceil(m.n * .7e0) THEN 'fit' ELSE 'calibrate' END AS part FROM d CROSS JOIN m"),
    (
        "purged_splits",
        "E18",
        f"""WITH {WEEKLY}, r AS (SELECT t, topic, row_number() OVER (ORDER BY t, topic) - 1 AS i, floor(count(*) OVER () / 5e0) AS block FROM st),
w AS (SELECT floor(i / block) AS fold, min(t) AS start, count(*) AS validation FROM r WHERE block >= 1 AND i >= block AND i < 5 * block GROUP BY 1)
SELECT cast(w.fold AS bigint) AS fold, count(*) AS train, max(w.validation) AS validation FROM w JOIN r ON r.i < w.fold * r.block AND r.t + INTERVAL 42 DAY <= w.start GROUP BY w.fold""",
    ),
    ("cohort_split", "E19", f"WITH {WEEKLY}, d AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS k FROM (SELECT DISTINCT t FROM st)) SELECT t, CASE WHEN k <= 6 THEN 'holdout' ELSE 'train' END AS part FROM d"),
    ("daily_cutoffs", "H6", f"WITH {V} SELECT <<day:published_at>> AS day, max(published_at) AS cutoff, count(*) AS n FROM v GROUP BY 1"),
    ("cross_market_states", "J15", f"WITH {V} SELECT v.topic, n.n_regionkey AS region, count(*) AS n, count(DISTINCT n.n_nationkey) AS countries, count(DISTINCT v.channel_id) AS channels FROM v JOIN customer c ON v.channel_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE v.published_at <= {T} AND v.published_at > {T} - INTERVAL 35 DAY GROUP BY v.topic, n.n_regionkey"),
    ("size_bucket", "I47", "SELECT c_custkey, CASE WHEN c_acctbal * 100 >= 500000 THEN 'mega' WHEN c_acctbal * 100 >= 250000 THEN 'large' WHEN c_acctbal * 100 >= 50000 THEN 'medium' ELSE 'small' END AS bucket FROM customer"),
    ("leads_report", "H1, E1, A18", f"WITH {V}, r AS (SELECT channel_id, video_id, row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id DESC) AS k FROM v), t AS (SELECT channel_id, max(CASE WHEN k = 1 THEN video_id END) AS newest, max(CASE WHEN k = 5 THEN video_id END) AS fifth, count(*) AS uploads FROM r GROUP BY channel_id) SELECT c.c_custkey, c.c_name, n.n_name, t.newest, t.fifth, coalesce(t.uploads, 0) AS uploads FROM customer c LEFT JOIN t ON c.c_custkey = t.channel_id LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal BETWEEN 1000 AND 9000"),
    ("paginate", "F8", f"WITH {V} SELECT video_id, views FROM v ORDER BY views DESC, video_id LIMIT 25 OFFSET 50"),
    ("union_distinct_sources", "C25, G1", "SELECT o_custkey AS id FROM orders UNION SELECT s_suppkey AS id FROM supplier UNION SELECT user_id AS id FROM events"),
    ("set_intersect", "G3", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id AS id FROM events"),
    ("set_except", "G2", "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id AS id FROM events"),
    ("rollup_metrics", "2.M", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    ("first_row_metadata", "A5", f"WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY age_days, line, views) AS k FROM o) SELECT video_id, max(CASE WHEN k = 1 THEN line END) AS first_line, max(views) AS best FROM r GROUP BY video_id"),
    ("reject_reason_counts", "A6, B22", f"WITH {V}, r AS (SELECT CASE WHEN views < 1000 THEN 'low_views' WHEN topic = '5-LOW' THEN 'category' WHEN published_at > {T} THEN 'future' ELSE 'accepted' END AS reason FROM v) SELECT reason, count(*) AS n FROM r GROUP BY reason"),
    ("mention_weight", "A24", f"WITH {V} SELECT video_id, round(1 + views / 100e0 / 1000 + (channel_id % 17) / 200e0, 8) AS weight FROM v"),
    (
        "comparable_peers",
        "C22",
        # A peer lies in the same half year or in the one before, so only these meet.
        f"""WITH {V}, s AS (SELECT *, cast(floor(<<secs:published_at>> / 15552000) AS bigint) AS half FROM v),
m AS (SELECT *, half AS meets FROM s UNION ALL SELECT *, half + 1 AS meets FROM s),
r AS (SELECT a.video_id, b.video_id AS peer, row_number() OVER (PARTITION BY a.video_id ORDER BY abs(a.views - b.views), b.published_at DESC, b.video_id) AS k
  FROM s a JOIN m b ON a.channel_id = b.channel_id AND a.half = b.meets AND b.published_at < a.published_at
    AND b.published_at >= a.published_at - INTERVAL 180 DAY AND b.views / greatest(a.views, 1e0) BETWEEN .6e0 AND 1.6e0)
SELECT video_id, peer FROM r WHERE k <= 20""",
    ),
]:
    sql_query(name, text, row)
