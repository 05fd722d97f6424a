"""Chunks against a loop, admission in order, archive records by hand, exports and late rows."""

import gzip
import json
import random
from datetime import datetime


from emberline.operators.folds import admitted, transcript_chunks
from emberline.sources.archive import CANDIDATE, candidate_and_outcome, export, ledger, read_records
from emberline.streaming.counts import counts_with_late_rows, punctual_and_late


def in_turn(rows):
    """The rule as it reads, one segment after the other."""
    chunks, open_chunk = [], None
    for video, at, start, end, text in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2], r[1])):
        words = " ".join(text.split())
        if not words:
            continue
        if open_chunk and (open_chunk[0] != video or end - open_chunk[1] > 35 or len(open_chunk[3] + " " + words) > 280):
            chunks.append(open_chunk)
            open_chunk = None
        open_chunk = (video, open_chunk[1], end, open_chunk[3] + " " + words) if open_chunk else (video, start, end, words)
    chunks += [open_chunk] if open_chunk else []
    return sorted((v, s, e, t if len(t) <= 280 else t[:279].rstrip() + "…") for v, s, e, t in chunks)


def test_chunks_equal_the_loop(spark):
    rng = random.Random(2)
    rows, clock = [], 0.0
    for i in range(500):
        clock += rng.choice([0.5, 3.0, 30.0])
        rows.append((rng.choice([1, 1, 1, 2, 3]), i, clock, clock + rng.random() * 20, rng.choice(["", "  ", "a\tb  c", "wörd " * rng.randrange(1, 40), "x" * 300, "y" * 279 + " z"])))
    rows += [(None, 1, 0.0, 1.0, "lost"), (4, 1, None, 1.0, "lost"), (4, 2, 0.0, 1.0, None), (5, 1, 0.0, 90.0, "long one"), (5, 2, 1.0, 91.0, "w " * 500_000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "video_id bigint, at int, start_at double, end_at double, text string, extra string")
    for parts in (1, 7):
        assert sorted(map(tuple, transcript_chunks(frame.repartition(parts)).collect())) == in_turn(rows)
    assert transcript_chunks(frame.limit(0)).count() == 0


def test_admission_by_hand(spark):
    rows = [(5, "New  One"), (3, "new one"), (1, "KNOWN"), (2, None), (4, "  "), (6, "third"), (7, "fourth"), (7, "beta")]
    known = spark.createDataFrame([(" known ",), (None,)], "name string")
    frame = spark.createDataFrame(rows, "id int, name string")
    assert sorted((r.place, r.name, r.id) for r in admitted(frame, known, 3).collect()) == [(1, "new one", 3), (2, "third", 6), (3, "beta", 7)]
    assert admitted(frame, known, 0).count() == 0 and admitted(frame.limit(0), known, 3).count() == 0


def test_records_under_both_key_names(spark, tmp_path):
    rows = [
        {"display_id": " v1 ", "video_id": "other", "channel_id": "c", "title": " T ", "categories": "Music", "upload_date": "2020-01-02", "crawl_date": "2020-02-03T04:05:06Z", "view_count": 12, "like_count": "3"},
        {"display_id": "", "video_id": "v2", "category": "News", "final_view_count": "7.9", "upload_date": "never", "tags": ["a"], "final_dislike_count": None},
        {},
    ]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as out:
        out.write("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    got = {r.video_id or (r.broken or "empty"): r for r in read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"v1", "v2", "empty", "{broken"}
    first = got["v1"]
    assert (first.title, first.category, first.description, first.final_view_count, first.final_like_count, first.final_dislike_count) == ("T", "Music", "", 12, 3, None)
    assert (first.upload_date, first.crawl_date) == (datetime(2020, 1, 2), datetime(2020, 2, 3, 4, 5, 6))
    assert (got["v2"].category, got["v2"].final_view_count, got["v2"].upload_date) == ("News", 7, None)
    candidate, outcome = candidate_and_outcome(read_records(spark, str(tmp_path)))
    assert candidate.columns == list(CANDIDATE) and "final_view_count" not in candidate.columns and "title" not in outcome.columns


def test_exports_come_back(spark, tmp_path):
    rows = [("a", 'say "hi", twice\nor more', 1), ("a", "", None), (None, None, 3), ("b", "é\\", 4)]
    frame = spark.createDataFrame(rows, "k string, text string, n int")
    assert export(frame, str(tmp_path / "j")) == 4
    assert sorted(map(str, spark.read.schema(frame.schema).json(str(tmp_path / "j")).collect())) == sorted(map(str, frame.collect()))
    assert export(frame, str(tmp_path / "c"), "csv", ["k"]) == 4
    back = spark.read.schema(frame.schema).options(header=True, escape='"', multiLine=True, nullValue="", emptyValue="").csv(str(tmp_path / "c"))
    assert sorted((r.k or "", r.text or "", r.n or 0) for r in back.collect()) == sorted((r[0] or "", r[1] or "", r[2] or 0) for r in rows)
    assert export(frame.limit(0), str(tmp_path / "e")) == 0


def test_a_ledger_keeps_first_values(spark, tmp_path):
    points = ledger(spark, f"file://{tmp_path}/l", ["k"], "v")
    for name, rows in (("1", [("a", 1), ("a", 2)]), ("2", [("a", 9), ("b", 3)]), ("2", [("c", 1)]), ("3", [("a", 9), ("b", 9)])):
        points.merge(spark.createDataFrame(rows, "k string, v int"), name)
    assert {r.k: r.v for r in points.read().collect()} == {"a": 2, "b": 3}


def test_punctual_and_late_rows(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, at, at.replace(minute=10)), (2, at, at.replace(minute=11)), (3, None, at), (4, at, None)]
    good, late = punctual_and_late(spark.createDataFrame(rows, "id int, ts timestamp, got timestamp"), "ts", "got", 600)
    assert sorted(r.id for r in good.collect()) == [1, 4] and {r.id: r.reason for r in late.collect()} == {2: "late", 3: "no_time"}


def test_a_late_row_of_a_stream_goes_to_the_side(spark, tmp_path):
    from emberline.operators.versions import VersionedTable

    (tmp_path / "in").mkdir()
    batches = [[("a", "2024-01-01T05:10:00Z"), ("a", "2024-01-01T05:20:00Z"), ("b", None)], [("a", "2024-01-01T05:30:00Z"), ("a", "2024-01-01T03:00:00Z"), ("b", "2024-01-01T09:00:00Z")]]
    for n, rows in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"topic": t, "ts": s}) + "\n" for t, s in rows))
        stream = spark.readStream.schema("topic string, ts timestamp").json(str(tmp_path / "in"))
        counts_with_late_rows(stream, f"file://{tmp_path}/counts", f"file://{tmp_path}/late", str(tmp_path / "state")).awaitTermination(120)
    read = lambda name: VersionedTable(spark, f"file://{tmp_path}/{name}", [], {}).read()
    assert {(r.topic, r.slide.hour): r.n for r in read("counts").collect()} == {("a", 5): 3, ("b", 9): 1}
    assert sorted((r.topic, r.reason, r.batch) for r in read("late").collect()) == [("a", "late", 1), ("b", "no_time", 0)]
