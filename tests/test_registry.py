"""The topic registry over a stream in batches, with a restart, against one plain registry."""

import json
import math
import random
from datetime import datetime, timedelta
from hashlib import sha256

from emberline.streaming.registry import topic_changes

SCHEMA = "niche string, as_of timestamp, cluster string, members array<string>, channels array<string>, anchors array<string>, centroid array<double>"


class Plain:
    """Every topic compared with every cluster, in memory."""

    def __init__(self):
        self.topics, self.log = {}, []

    def add(self, niche, as_of, cluster, members, channels, anchors, centroid):
        def cosine(a, b):
            return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)) if math.hypot(*a) * math.hypot(*b) else 0

        m, c = set(members), set(channels)
        matched = [t for t, v in self.topics.items() if v["niche"] == niche and cosine(centroid, v["centroid"]) >= 0.84 and (len(m & v["members"]) / max(len(m | v["members"]), 1) >= 0.1 or set(anchors) & set(v["anchors"]))]
        matched.sort(key=lambda t: (-len(self.topics[t]["members"]), t))
        if not matched:
            topic = "t_" + sha256("|".join((as_of.isoformat() + "+00:00", ",".join(sorted(m)), ",".join(anchors))).encode()).hexdigest()[:16]
            self.topics[topic] = {"niche": niche, "first": as_of, "centroid": centroid, "anchors": anchors, "members": m, "channels": c}
            self.log.append((niche, as_of, cluster, "created", topic, None, len(m), len(c)))
            return
        first, *rest = matched
        held = self.topics[first]
        for t in rest:
            loser = self.topics.pop(t)
            m, c = m | loser["members"], c | loser["channels"]
        mixed = [0.7 * x + 0.3 * y for x, y in zip(held["centroid"], centroid)]
        held |= {"centroid": [x / math.hypot(*mixed) for x in mixed], "anchors": anchors or held["anchors"], "members": held["members"] | m, "channels": held["channels"] | c}
        self.log += [(niche, as_of, cluster, "merge", first, t, len(held["members"]), len(held["channels"])) for t in rest] or [(niche, as_of, cluster, "continue", first, None, len(held["members"]), len(held["channels"]))]


def some_clusters(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        angle = rng.choice([0, 0.4, 0.9, 1.4]) + rng.random() * 0.2
        members = sorted(rng.sample([f"v{j}" for j in range(40)], rng.randrange(0, 7)))
        rows.append((rng.choice("xyz"), datetime(2024, 1, 1) + timedelta(days=i // 10), f"c{i % 10}", members, [m[:2] for m in members], rng.sample(["a1", "a2", "a3", "a4", "a5"], rng.randrange(3)), [math.cos(angle), math.sin(angle)]))
    return rows


def expected(rows):
    plain = Plain()
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        plain.add(*row)
    return sorted(plain.log, key=str)


def seen(rows):
    return sorted((tuple(r)[:8] for r in rows), key=str)


def test_a_table_equals_the_plain_registry(spark):
    rows = some_clusters(1)
    got = topic_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert seen(got) == expected(rows)
    assert {r.event for r in got} == {"created", "continue", "merge"}


def test_a_stream_in_batches_with_a_restart_equals_it_too(spark, tmp_path):
    rows = some_clusters(2)
    (tmp_path / "in").mkdir()
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    got = []
    for n, days in enumerate(((0, 3), (3, 5), (5, 99))):
        part = [r for r in rows if days[0] <= (r[1] - datetime(2024, 1, 1)).days < days[1]]
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(dict(zip(columns, r)) | {"as_of": r[1].isoformat() + "Z"}) + "\n" for r in part))
        # Every batch is a query of its own that goes on from the checkpoint.
        stream = topic_changes(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))
        done = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination(300)
        assert done.exception() is None
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got[0] < got[1] < got[2]
    assert seen(spark.read.parquet(str(tmp_path / "out")).collect()) == expected(rows)


def test_nulls_and_an_empty_table(spark):
    at = datetime(2024, 1, 1)
    rows = [("x", at, "c", None, None, None, None), ("x", at, "d", ["m", None], ["c"], [None], [1.0]), (None, at, "c", [], [], [], []), ("x", None, "c", [], [], [], []), ("x", at, None, [], [], [], []), ("x", at, "e", ["m"], [], ["a"], [1.0]), ("x", at, "e", ["m"], [], ["a"], [1.0])]
    got = topic_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.cluster, r.event, r.members) for r in sorted(got, key=lambda r: (r.cluster, r.event))] == [("c", "created", 0), ("d", "created", 1), ("e", "continue", 1), ("e", "continue", 1)]
    assert topic_changes(spark.createDataFrame([], SCHEMA)).count() == 0
