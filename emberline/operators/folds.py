"""Folds that start anew: transcript chunks, and admission in order up to a capacity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.plans.tables import bounded, written
from emberline.registry import query

# The most seconds and characters of a chunk.
MOST_SECONDS, MOST_CHARACTERS = 35.0, 280
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_CHUNK = "video_id bigint, start_at double, end_at double, text string"


def _shortened(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1].rstrip(" ") + "…"


def transcript_chunks(segments: DataFrame, most_seconds: float = MOST_SECONDS, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """(video_id, start_at, end_at, text): consecutive segments (video_id, at, start_at, end_at, text) of a video joined while they fit.

    A segment opens a new chunk if with it the chunk would last longer or be longer than allowed, so where a
    chunk begins depends on all before it.  Segments are ordered by start, then by `at`; each video is
    one run of a sorted partition that is read as a stream, so a task holds one chunk however long a
    video is.  Blank and null texts are passed over, white space is folded, a text too long for a chunk is cut with
    an ellipsis; rows without a video or a time are left out, repeated rows repeat their text.
    """
    held = segments.select(F.col("video_id").cast("bigint").alias("video_id"), "at", F.col("start_at").cast("double").alias("start_at"), F.col("end_at").cast("double").alias("end_at"), "text").dropna()
    ordered = held.repartition("video_id").sortWithinPartitions("video_id", "start_at", "at", "end_at", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, start, end, text = None, 0.0, 0.0, ""
        for batch in batches:
            done = []
            for v, _, s, e, raw in zip(*(c.to_pylist() for c in batch.columns)):
                words = _SPACE.sub(" ", raw).strip(" ")
                if not words:
                    continue
                if text and (v != video or e - start > most_seconds or len(text) + 1 + len(words) > most_characters):
                    done.append((video, start, end, _shortened(text, most_characters)))
                    text = ""
                if not text:
                    video, start = v, s
                text, end = f"{text} {words}" if text else words, e
            yield _batch(done)
        yield _batch([(video, start, end, _shortened(text, most_characters))] if text else [])

    return ordered.mapInArrow(fold, _CHUNK)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["video_id", "start_at", "end_at", "text"])


def admitted(candidates: DataFrame, existing: DataFrame, capacity: int) -> DataFrame:
    """(name, place, id): the first `capacity` new names of candidates (id, name), in order of id, each by its first candidate.

    Names are compared in lower case with white space folded; those of existing (name) are not new.
    Null and blank names are passed over.  Names are grouped before they are put in order, and only as many as
    there is room for go to one task.
    """
    plain = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    first = candidates.select("id", plain.alias("name")).filter("name <> ''").groupBy("name").agg(F.min("id").alias("id"))
    known = written(existing.select(plain.alias("name")).filter("name is not null").distinct(), "known")
    new = first.join(bounded(known), "name", "left_anti").orderBy("id", "name").limit(capacity)
    return new.select("name", F.row_number().over(Window.orderBy("id", "name")).cast("bigint").alias("place"), "id")


#: Lines of documents stand for segments of four seconds with an overlap of two.
SEGMENTS = "SELECT doc_id AS video_id, at, 4e0 * at AS start_at, 4e0 * at + 6e0 AS end_at, text FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (at, text) FROM {documents})"


@query(
    r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
t AS (SELECT doc_id, seq, trim(regexp_replace(raw, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS x FROM s),
n AS (SELECT doc_id, 4e0 * seq AS a, 4e0 * seq + 6e0 AS b, x, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM t WHERE x <> ''),
w AS (SELECT doc_id, i, a, b, x, false AS fresh FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN f THEN n.a ELSE w.a END, n.b, CASE WHEN f THEN n.x ELSE w.x || ' ' || n.x END, f
  FROM (SELECT w.doc_id, w.i, n.b - w.a > 35 OR length(w.x) + 1 + length(n.x) > 280 AS f FROM w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1) c
  JOIN w ON w.doc_id = c.doc_id AND w.i = c.i JOIN n ON n.doc_id = c.doc_id AND n.i = c.i + 1),
e AS (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY doc_id ORDER BY i), true) AS last FROM w)
SELECT doc_id AS video_id, a AS start_at, b AS end_at, CASE WHEN length(x) <= 280 THEN x ELSE rtrim(substr(x, 1, 279), ' ') || '…' END AS text FROM e WHERE last"""
)
def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row E20."""
    return transcript_chunks(spark.sql(SEGMENTS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet")))


@query(
    """WITH c AS (SELECT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name, min(p_partkey) AS id FROM part GROUP BY 1),
k AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size > 48)
SELECT name, row_number() OVER (ORDER BY id, name) AS place, id FROM c ANTI JOIN k USING (name) WHERE name <> '' ORDER BY id, name LIMIT 25"""
)
def capped_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row F14: parts' names stand for suggested queries, those of the largest parts for known ones; room for 25."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return admitted(part, part.filter("p_size > 48"), 25)
