"""Persistent topics over a stream of clusters: match, create, continue and merge, with keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from hashlib import sha256

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.registry import query

# How alike a cluster and a topic must be, and the weight of a new centroid.
LEAST_COSINE, LEAST_JACCARD, NEW_WEIGHT = 0.84, 0.10, 0.30
#: Entries of a map that a task holds.
MOST_HELD = 100_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a change of a topic looks like: event is created, continue or merge (then `merged` is the topic that ends).
CHANGES = "niche string, as_of timestamp, cluster string, event string, topic string, merged string, members bigint, channels bigint, first_seen timestamp"
_TOPIC = "first_seen timestamp, centroid array<double>, anchors array<string>, members array<string>, channels array<string>"


def _cosine(a: list[float], b: list[float]) -> float:
    if not a or len(a) != len(b):
        return 0.0
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norms if norms else 0.0


def _blended(old: list[float], new: list[float]) -> list[float]:
    mixed = [(1 - NEW_WEIGHT) * x + NEW_WEIGHT * y for x, y in zip(old, new)]
    norm = math.sqrt(sum(x * x for x in mixed))
    return [x / norm for x in mixed] if norm else mixed


class Held:
    """A map of the state, read and written by entry, of which up to MOST_HELD entries stay in memory while a batch is worked on."""

    def __init__(self, state) -> None:
        self.state, self.entries, self.changed = state, {}, set()

    def get(self, name: str):
        """The entry, or None."""
        if name not in self.entries:
            if len(self.entries) >= MOST_HELD:
                self.flush()
            self.entries[name] = self.state.getValue((name,)) if self.state.containsKey((name,)) else None
        return self.entries[name]

    def put(self, name: str, value: tuple | None) -> None:
        """None takes the entry away."""
        self.get(name)
        self.entries[name] = value
        self.changed.add(name)

    def flush(self) -> None:
        for name in sorted(self.changed):
            if (value := self.entries[name]) is not None:
                self.state.updateValue((name,), value)
            elif self.state.containsKey((name,)):
                self.state.removeKey((name,))
        self.entries, self.changed = {}, set()


class TopicState(StatefulProcessor):
    """A niche's topics, each an entry of its own, with indexes from members and anchors to the topics that hold them.

    A cluster can only match topics that share a member or an anchor with it, so only those are read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.topics = handle.getMapState("topics", "topic string", _TOPIC)
        self.by_member = handle.getMapState("by_member", "member string", "topics array<string>")
        self.by_anchor = handle.getMapState("by_anchor", "anchor string", "topics array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        maps = (self.topics, self.by_member, self.by_anchor)
        self.topics, self.by_member, self.by_anchor = map(Held, maps)
        try:
            for cluster in sorted(rows, key=lambda r: (r.as_of, r.cluster)):
                yield from self._assign(key[0], cluster)
            for held in (self.topics, self.by_member, self.by_anchor):
                held.flush()
        finally:
            self.topics, self.by_member, self.by_anchor = maps

    def close(self) -> None:
        pass

    def _listed(self, index, names: list[str]) -> dict[str, int]:
        """Topics of an index, with the number of names that lead to each."""
        found: dict[str, int] = {}
        for name in names:
            for topic in (index.get(name) or ((),))[0]:
                found[topic] = found.get(topic, 0) + 1
        return found

    def _index(self, index, names: list[str], topic: str, add: bool) -> None:
        for name in names:
            held = list((index.get(name) or ((),))[0])
            if add != (topic in held):
                held = sorted([*held, topic]) if add else [t for t in held if t != topic]
                index.put(name, (held,) if held else None)

    def _matches(self, cluster: Row, members: list[str], anchors: list[str]) -> list[tuple[str, Row]]:
        shared, anchored = self._listed(self.by_member, members), self._listed(self.by_anchor, anchors)
        found = []
        for topic in shared.keys() | anchored.keys():
            held = self.topics.get(topic)
            common = shared.get(topic, 0)
            near = common / max(len(members) + len(held[3]) - common, 1) >= LEAST_JACCARD
            if (near or topic in anchored) and _cosine(list(cluster.centroid or []), list(held[1])) >= LEAST_COSINE:
                found.append((topic, held))
        return sorted(found, key=lambda m: (-len(m[1][3]), m[0]))

    def _assign(self, niche: str, cluster: Row) -> Iterator[Row]:
        members, channels = (sorted({x for x in values or [] if x is not None}) for values in (cluster.members, cluster.channels))
        anchors = list(dict.fromkeys(x for x in cluster.anchors or [] if x is not None))
        matches = self._matches(cluster, members, anchors)

        def change(event: str, topic: str, merged: str | None, held: tuple) -> Row:
            return Row(niche=niche, as_of=cluster.as_of, cluster=cluster.cluster, event=event, topic=topic, merged=merged, members=len(held[3]), channels=len(held[4]), first_seen=held[0])

        if not matches:
            at = (datetime.fromtimestamp(0, UTC) + timedelta(microseconds=cluster.micros)).isoformat()
            seed = "|".join((at, ",".join(members), ",".join(anchors)))
            topic = "t_" + sha256(seed.encode()).hexdigest()[:16]
            held = (cluster.as_of, list(cluster.centroid or []), anchors, members, channels)
            self._store(topic, held, [], [])
            yield change("created", topic, None, held)
            return
        (topic, winner), losers = matches[0], matches[1:]
        for name, loser in losers:
            members, channels = sorted({*members, *loser[3]}), sorted({*channels, *loser[4]})
            self._index(self.by_member, list(loser[3]), name, False)
            self._index(self.by_anchor, list(loser[2]), name, False)
            self.topics.put(name, None)
        held = (winner[0], _blended(list(winner[1]), list(cluster.centroid)), anchors or list(winner[2]), sorted({*members, *winner[3]}), sorted({*channels, *winner[4]}))
        self._store(topic, held, list(winner[3]), list(winner[2]))
        for name, _ in losers:
            yield change("merge", topic, name, held)
        if not losers:
            yield change("continue", topic, None, held)

    def _store(self, topic: str, held: tuple, old_members: list[str], old_anchors: list[str]) -> None:
        self.topics.put(topic, held)
        self._index(self.by_member, sorted({*held[3]} - {*old_members}), topic, True)
        self._index(self.by_anchor, [a for a in old_anchors if a not in held[2]], topic, False)
        self._index(self.by_anchor, [a for a in held[2] if a not in old_anchors], topic, True)


def topic_changes(clusters: DataFrame) -> DataFrame:
    """The changes that clusters (niche, as_of, cluster, members, channels, anchors, centroid) make to their niche's topics.

    A topic matches if the centroids' cosine is 0.84 at least and it shares an anchor or a tenth of all
    members.  The match with most members goes on, others end in it.  On a stream every niche keeps its topics from one
    batch to the next and over restarts; on a table all of a niche's clusters come in one batch.  A niche's clusters
    in a batch are taken in order of time and name.  Rows without a niche, time or name
    are left out, null lists count as empty; a repeated row is a second sighting.
    """
    session = clusters.sparkSession
    session.streams.active  # a table's state needs the session's stream manager as well, which starts on first use
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    held = clusters.select("niche", F.col("as_of").cast("timestamp").alias("as_of"), "cluster", "members", "channels", "anchors", "centroid", F.unix_micros(F.col("as_of").cast("timestamp")).alias("micros"))
    valid = held.filter("niche is not null and as_of is not null and cluster is not null")
    return valid.groupBy("niche").transformWithState(TopicState(), CHANGES, "append", "none")


@query()
def topic_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows J6 and K7: events of a type, a day and a last digit stand for a cluster, their users for its members, quarters of the day for its centroid."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    day, user = F.date_trunc("day", F.col("ts").cast("timestamp")), F.col("user_id").cast("string")
    parts = [F.count_if(F.floor(F.hour("ts") / 6) == n).cast("double") for n in range(4)]
    found = events.groupBy(F.col("event_type").alias("niche"), day.alias("as_of"), (F.col("k") % 10).cast("string").alias("cluster")).agg(
        F.sort_array(F.collect_set(user)).alias("members"), F.sort_array(F.collect_set(user)).alias("channels"), F.array(F.max(F.concat(F.lit("k"), "k"))).alias("anchors"), F.array(*parts).alias("centroid")
    )
    return topic_changes(found)
