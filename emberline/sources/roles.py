"""How the test tables stand in for the analytic roles, as SQL texts."""

AS_OF = "TIMESTAMP '2024-01-24 00:00:00'"
UPLOADS_AS_OF = "TIMESTAMP '1999-06-01 00:00:00'"

#: topic = event type and JSON number, channel = user, velocity = value.
TOPIC_EVENTS = f"""SELECT event_id, ts, user_id AS channel, event_type || '-' || <<json_k:props>> AS topic, event_type, value,
  user_id < 10 AS large FROM events WHERE ts <= {AS_OF}"""
#: order = video, customer = channel.
VIDEOS = """SELECT o_orderkey AS video_id, o_custkey AS channel_id, cast(o_orderdate AS timestamp) AS published_at,
  cast(o_orderdate AS timestamp) + <<days:o_orderkey % 5>> AS discovered_at, o_totalprice AS views, o_orderpriority AS topic FROM orders"""
#: line = view observation of its order at a made-up age.
OBSERVATIONS = """SELECT l_orderkey AS video_id, l_linenumber AS line, ((l_orderkey * 7 + l_partkey * 31 + l_linenumber * 13) % 30) + .5e0 AS age_days,
  l_extendedprice AS views FROM lineitem"""
#: customer = panel member with a validity interval.
PANEL = """SELECT c_custkey AS channel_id, TIMESTAMP '1995-01-01 00:00:00' + <<days:c_custkey * 37 % 1500>> AS joined_at,
  CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1995-01-01 00:00:00' + <<days:c_custkey * 37 % 1500 + 700>> END AS left_at FROM customer"""
SCORED = """SELECT l.doc_id, least(1e0, d.n_chars / 8000e0) AS p, l.quality AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
