"""A logistic head fitted by plain gradient descent, and a slope and offset that later rows teach it."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.tables import written
from emberline.registry import query

#: Rows to a partition (about 80 MB for 100 features).  Where all rows fit in one, its task takes all steps.
PART_ROWS = 100_000
#: Parts whose sums, one short vector each, come to the driver as they are; sums of more parts are added up on the way.
MOST_SUMS = 64


@dataclass(frozen=True)
class Schedule:
    # Penalty, steps and step size of the head; steps, step size, pull to 1 and bounds of the slope; fewest rows of either.
    l2: float = 0.05
    steps: int = 1_500
    rate: float = 0.08
    slope_steps: int = 1_000
    slope_rate: float = 0.03
    slope_pull: float = 0.01
    slope_bounds: tuple[float, float] = (0.05, 5.0)
    fewest: int = 20


class CannotLearn(ValueError):
    """There are too few rows, or they all have one label."""


@dataclass(frozen=True)
class DescentHead:
    """What was learnt.  A feature without a column, or with a null value, counts as 0."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    offset: float
    slope: float
    shift: float
    calibrated: bool
    rows: int
    positives: int

    def log_odds(self, df: DataFrame) -> Column:
        terms = [w * (v - m) / s for w, v, m, s in zip(self.weights, values(df, self.features), self.means, self.scales, strict=True)]
        return sum(terms, F.lit(self.offset))

    def score(self, df: DataFrame) -> DataFrame:
        """The rows with probability (6 places); column expressions only."""
        odds = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), self.slope * self.log_odds(df) + self.shift))
        return df.withColumn("probability", F.round(1.0 / (1.0 + F.exp(-odds)), 6))


def values(df: DataFrame, features: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        matrix = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        yield pa.record_batch({"matrix": pa.array([matrix.tobytes()], pa.binary())})


def _blocks(columns: list[Column], rows: DataFrame, count: int, part_rows: int) -> RDD:
    """The rows as matrices, kept by the executors; a lost one is read again from the written table."""
    width = len(columns)
    packed = written(rows.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(_matrices, "matrix binary"), "matrices")
    few = packed.coalesce(max(1, -(-count // part_rows)))
    return few.rdd.map(lambda r: np.frombuffer(r["matrix"]).reshape(-1, width)).persist(StorageLevel.MEMORY_AND_DISK)


def _descend(blocks: RDD, start: np.ndarray, steps: int, change: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Follow the gradient: each step is one sum over all rows, of which one small vector comes back; one partition alone takes all steps in one job.

    A block's columns are the factors of the state (an offset's factor is 1) and the label at the end.
    """
    zero = np.zeros(len(start))

    def add(total: np.ndarray, block: np.ndarray, now: np.ndarray) -> np.ndarray:
        x = block[:, :-1]
        return total + x.T @ (_sigmoid(x @ now) - block[:, -1])

    def whole(own: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        rows, state = np.vstack(list(own)), start
        for step in range(steps):
            state = change(step, state, add(zero, rows, state))
        yield state

    if blocks.getNumPartitions() == 1:
        return blocks.mapPartitions(whole).collect()[0]
    state = start
    for step in range(steps):
        now = state
        if blocks.getNumPartitions() <= MOST_SUMS:
            sums = blocks.mapPartitions(lambda own, now=now: [functools.reduce(lambda t, b: add(t, b, now), own, zero)]).collect()
            total = functools.reduce(np.add, sums)
        else:
            total = blocks.treeAggregate(zero, lambda t, b, now=now: add(t, b, now), np.add)
        state = change(step, now, total)
    return state


def fit(training: DataFrame, features: list[str], later: DataFrame | None = None, label: str = "label", schedule: Schedule = Schedule(), part_rows: int = PART_ROWS) -> DescentHead:
    """Learn from `training`; then slope and shift of the log odds from `later` rows, which the caller must take from after it.

    Features are scaled to mean 0 and population deviation 1 (deviations below 1e-6 count as 1e-6) and are used in the
    order of their names.  Rows with a null label take no part; equal rows count each.  Fewer than 20 rows, or one label
    only, raise CannotLearn for training and leave slope 1 and shift 0 for later rows.  Sums over rows are
    rounded to 10 places at the end, so partitioning does not show: up to part_rows rows are one task, more are one job a step.
    """
    names = tuple(sorted(set(features)))
    if not names:
        raise CannotLearn("name at least one feature")
    known = training.filter(F.col(label).isNotNull())
    inputs, truth = values(known, names), (F.col(label).cast("double") > 0).cast("double")
    moments = [m for i, v in enumerate(inputs) for m in (F.mean(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))]
    seen = known.agg(F.count("*").alias("n"), F.sum(truth).alias("p"), *moments).first()
    count, positives = seen["n"], int(seen["p"] or 0)
    if count < schedule.fewest:
        raise CannotLearn(f"{count} labelled rows are fewer than {schedule.fewest}")
    if positives in (0, count):
        raise CannotLearn("all rows have the same label")
    means = tuple(seen[f"m{i}"] for i in range(len(names)))
    scales = tuple(max(seen[f"s{i}"], 1e-6) for i in range(len(names)))
    scaled = [(v - m) / s for v, m, s in zip(inputs, means, scales, strict=True)]
    penalty = np.array([0.0] + [schedule.l2] * len(names))

    def head_step(step: int, state: np.ndarray, total: np.ndarray) -> np.ndarray:
        return state - schedule.rate / math.sqrt(1 + step / 100) * (total / count + penalty * state)

    start = np.array([math.log(positives / (count - positives))] + [0.0] * len(names))
    blocks = _blocks([F.lit(1.0), *scaled, truth], known, count, part_rows)
    try:
        offset, *weights = (round(float(v), 10) for v in _descend(blocks, start, schedule.steps, head_step))
    finally:
        blocks.unpersist()
    raw = DescentHead(names, means, scales, tuple(weights), offset, 1.0, 0.0, False, count, positives)
    slope, shift, calibrated = (1.0, 0.0, False) if later is None else _slope(raw, later, label, schedule, part_rows)
    return DescentHead(names, tuple(round(m, 10) for m in means), tuple(round(s, 10) for s in scales), raw.weights, offset, slope, shift, calibrated, count, positives)


def _slope(head: DescentHead, later: DataFrame, label: str, schedule: Schedule, part_rows: int) -> tuple[float, float, bool]:
    known = later.filter(F.col(label).isNotNull())
    truth = (F.col(label).cast("double") > 0).cast("double")
    count, positives = known.agg(F.count("*"), F.sum(truth)).first()
    if count < schedule.fewest or positives in (0, count):
        return 1.0, 0.0, False
    low, high = schedule.slope_bounds

    def slope_step(step: int, state: np.ndarray, total: np.ndarray) -> np.ndarray:
        pull = np.array([schedule.slope_pull * (state[0] - 1.0), 0.0])
        moved = state - schedule.slope_rate / math.sqrt(1 + step / 100) * (total / count + pull)
        return np.array([min(high, max(low, moved[0])), moved[1]])

    blocks = _blocks([head.log_odds(known), F.lit(1.0), truth], known, count, part_rows)
    try:
        slope, shift = _descend(blocks, np.array([1.0, 0.0]), schedule.slope_steps, slope_step)
    finally:
        blocks.unpersist()
    return round(float(slope), 10), round(float(shift), 10), True


# The check: the same recurrence as two recursive tables over all labelled rows, one row a step.
_SQL = """WITH RECURSIVE e AS (SELECT d.doc_id, ln(1e0 + coalesce(n_chars, 0)) AS x1, (1e0 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', ''))) / (1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS x2,
    CASE WHEN quality > 0 THEN 1e0 WHEN quality IS NOT NULL THEN 0e0 END AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
half AS (SELECT max(doc_id) // 2 AS h FROM documents),
tr AS (SELECT e.* FROM e, half WHERE doc_id < h AND y IS NOT NULL),
m AS (SELECT count(*) AS n, sum(y) AS p, avg(x1) AS m1, avg(x2) AS m2, greatest(stddev_pop(x1), 1e-6) AS s1, greatest(stddev_pop(x2), 1e-6) AS s2 FROM tr),
z AS (SELECT (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y, n FROM tr, m),
g AS (SELECT 0 AS step, ln(p / (n - p)) AS b, 0e0 AS w1, 0e0 AS w2 FROM m
    UNION ALL SELECT step + 1, b - r * sum(f) / n, w1 - r * (sum(f * z1) / n + .05e0 * w1), w2 - r * (sum(f * z2) / n + .05e0 * w2)
    FROM (SELECT g.*, z1, z2, n, .08e0 / sqrt(1 + step / 100e0) AS r, 1e0 / (1e0 + exp(-(b + w1 * z1 + w2 * z2))) - y AS f FROM g, z WHERE step < 1500) GROUP BY step, b, w1, w2, n, r),
head AS (SELECT round(b, 10) AS b, round(w1, 10) AS w1, round(w2, 10) AS w2 FROM g WHERE step = 1500),
la AS (SELECT b + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2 AS q, y FROM e, half, m, head WHERE doc_id >= h AND y IS NOT NULL),
c AS (SELECT count(*) AS k, count(*) >= 20 AND count(DISTINCT y) = 2 AS enough FROM la),
t AS (SELECT 0 AS step, 1e0 AS a, 0e0 AS o FROM c WHERE enough
    UNION ALL SELECT step + 1, least(5e0, greatest(.05e0, a - r * (sum(f * q) / k + .01e0 * (a - 1)))), o - r * sum(f) / k
    FROM (SELECT t.*, q, k, .03e0 / sqrt(1 + step / 100e0) AS r, 1e0 / (1e0 + exp(-(a * q + o))) - y AS f FROM t, la, c WHERE step < 1000) GROUP BY step, a, o, k, r),
cal AS (SELECT coalesce(max(round(a, 10)), 1e0) AS a, coalesce(max(round(o, 10)), 0e0) AS o FROM t WHERE step = 1000)
SELECT doc_id, round(1e0 / (1e0 + exp(-(a * (b + w1 * (x1 - round(m1, 10)) / round(s1, 10) + w2 * (x2 - round(m2, 10)) / round(s2, 10)) + o))), 6) AS probability FROM e, m, head, cal"""


@query(_SQL)
def probability_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row J11: labelled documents stand for episodes; ids in the lower half are learnt from, the others set slope and shift, all are scored.

    Beyond 100,000 rows each of the 2,500 steps is a job: it reads rows that the executors hold and sends back one vector.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    text = F.coalesce("text", F.lit(""))
    spaces, breaks = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in (" ", "\n"))
    rows = documents.join(labels, "doc_id").select(
        "doc_id",
        F.log(1.0 + F.coalesce("n_chars", F.lit(0))).alias("log_length"),
        ((1.0 + spaces) / (1 + breaks)).alias("words_a_line"),
        (F.col("quality") > 0).cast("double").alias("label"),
    )
    rows = written(rows, "episodes")
    half = (documents.agg(F.max("doc_id")).first()[0] or 0) // 2
    head = fit(rows.filter(F.col("doc_id") < half), ["log_length", "words_a_line"], rows.filter(F.col("doc_id") >= half))
    return head.score(rows).select("doc_id", "probability")
