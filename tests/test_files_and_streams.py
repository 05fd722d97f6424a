"""Readers on small files, and streams run to their end with availableNow."""

import base64
import gzip
import json
import struct
from datetime import datetime

import pytest

from emberline.sources import files
from emberline.streaming.counts import once_each, trailing_counts


def test_discovery_and_cohort(spark, tmp_path):
    (tmp_path / "d.csv").write_text('v1,c,x,2024-01-02T03:00:00Z\nv1,c,x,2024-01-01T05:00:00+02:00\nv2,c,"a, ""b""",2024-01-05\nv3,c,x,\nv4,c\n')
    discovery = files.read_discovery(spark, str(tmp_path / "d.csv"))
    assert sorted((r.video_id, str(r.t)) for r in discovery.selectExpr("video_id", "cast(discovered_at as string) t").collect()) == [("v1", "2024-01-01 03:00:00"), ("v2", "2024-01-05 00:00:00")]
    rows = [{"video_id": "v1", "channel_id": 7, "title": "t", "upload_date": "2023-12-31", "description": "é" * 900}, {"video_id": "v3", "channel_id": "c", "title": "u", "upload_date": "2023-12-30T00:00:00"}]
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as out:
        out.write("\n\n".join(map(json.dumps, rows)) + "\n")
    got = files.read_cohort(spark, str(tmp_path / "c.jsonl.gz"), discovery).collect()
    assert [(r.video_id, r.channel_id, len(r.description)) for r in got] == [("v1", "7", 800)]
    naive = files.read_cohort(spark, str(tmp_path / "c.jsonl.gz"), None).collect()
    assert sorted((r.video_id, r.description[:1], r.discovered_at == r.published_at) for r in naive) == [("v1", "é", True), ("v3", "", True)]


def test_embeddings_and_snapshots(spark, tmp_path):
    line = lambda n, *v: json.dumps({"video_id": f"v{n}", "dimensions": n, "embedding_base64": base64.b64encode(struct.pack(f"<{len(v)}f", *v)).decode()})
    (tmp_path / "e.jsonl").write_text(line(2, .5, -1.25) + "\n\n" + line(0) + "\n")
    assert sorted((r.video_id, r.embedding) for r in files.read_embeddings(spark, str(tmp_path / "e.jsonl")).collect()) == [("v0", []), ("v2", [.5, -1.25])]
    (tmp_path / "bad.jsonl").write_text(line(3, 1.0) + "\n")
    with pytest.raises(Exception, match="another length"):
        files.read_embeddings(spark, str(tmp_path / "bad.jsonl")).collect()
    with gzip.open(tmp_path / "s.csv.gz", "wt") as out:
        out.write("v1,2024-01-02T00:00:00Z,43200,10\nv1,2024-01-03T00:00:00Z,86400,\nv2,2024-01-02T00:00:00Z\n")
    assert [(r.video_id, r.age_days, r.views) for r in files.read_snapshots(spark, str(tmp_path / "s.csv.gz")).collect()] == [("v1", .5, 10)]


def run(spark, tmp_path, name, build, batches):
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = spark.readStream.schema("event_id int, topic string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    started = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    started.awaitTermination(120)
    return spark.table(name).collect()


def test_trailing_counts_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    hour = lambda h, m=10: f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:{m:02d}:00Z"
    events = [{"event_id": i, "topic": t, "ts": hour(h)} for i, (t, h) in enumerate([("a", 0), ("a", 0), ("b", 1), ("a", 5), ("a", 30)])]
    end = [{"event_id": 99, "topic": "z", "ts": hour(100)}, {"event_id": 98, "topic": "a", "ts": None}]
    last = [{"event_id": 100, "topic": "z", "ts": hour(101)}]
    got = run(spark, tmp_path, "trailing", lambda s: trailing_counts(s, "24 hours"), [events, end, last])
    at = lambda r: int((r.as_of - datetime(2024, 1, 1)).total_seconds() // 3600)
    counts = {(r.topic, at(r)): r.n for r in got if r.topic != "z"}
    hours = {"a": [0, 0, 5, 30], "b": [1]}
    want = {(t, e): n for t, hs in hours.items() for e in range(1, 60) if (n := sum(e - 24 <= h < e for h in hs))}
    assert counts == want


def test_repeated_events_of_a_stream_count_once(spark, tmp_path):
    rows = [{"event_id": i, "topic": "a", "ts": "2024-01-01T00:00:00Z"} for i in (1, 1, 2)]
    assert sorted(r.event_id for r in run(spark, tmp_path, "once", once_each, [rows, rows[1:]])) == [1, 2]
