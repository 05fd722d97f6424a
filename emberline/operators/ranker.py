"""The adoption ranker: a regularised logistic head, isotonic calibration, and scores that abstain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.tables import written
from emberline.registry import query


@dataclass(frozen=True)
class Limits:
    # What a model needs before it is fitted, and what a score needs before it is shown.
    l2: float = 1.0
    minimum_training_examples: int = 60
    minimum_positive_examples: int = 10
    minimum_calibration_examples: int = 80
    minimum_anchor_score: float = 1.5


class TooFewRows(ValueError):
    """There are too few labelled rows to learn from, or nothing has been learnt yet."""


@dataclass
class OutcomeHead:
    """Logistic regression on features scaled to mean 0 and population deviation 1 (deviations below 1e-6 count as 1).

    Missing features and null values count as 0; rows with a null label take no part in fitting.
    """

    features: list[str]
    policy: Limits = field(default_factory=Limits)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    model: LogisticRegressionModel | None = None
    calibrator: IsotonicRegressionModel | None = None

    def _values(self, df: DataFrame) -> list[Column]:
        return [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in self.features]

    def _assembled(self, df: DataFrame) -> DataFrame:
        scaled = [((value - self.means[f]) / self.scales[f]).alias(f"_scaled{i}") for i, (f, value) in enumerate(zip(self.features, self._values(df), strict=True))]
        names = [f"_scaled{i}" for i in range(len(scaled))]
        return VectorAssembler(inputCols=names, outputCol="_features").transform(df.select("*", *scaled)).drop(*names)

    def fit(self, training: DataFrame, label: str = "label") -> OutcomeHead:
        known = training.filter(F.col(label).isNotNull())
        moments = [measure(value).alias(f"_{kind}{i}") for i, value in enumerate(self._values(known)) for kind, measure in (("m", F.mean), ("s", F.stddev_pop))]
        seen = known.agg(F.count("*").alias("_n"), F.count_if(F.col(label).cast("double") > 0).alias("_positive"), *moments).first()
        if seen["_n"] < self.policy.minimum_training_examples:
            raise TooFewRows(f"{seen['_n']} labelled rows, {self.policy.minimum_training_examples} are the least")
        if seen["_positive"] < self.policy.minimum_positive_examples:
            raise TooFewRows(f"{seen['_positive']} rows of label 1, {self.policy.minimum_positive_examples} are the least")
        self.means = {f: seen[f"_m{i}"] for i, f in enumerate(self.features)}
        self.scales = {f: seen[f"_s{i}"] if seen[f"_s{i}"] >= 1e-6 else 1.0 for i, f in enumerate(self.features)}
        # The loss is a mean over rows here, so the penalty of a summed loss is divided by their number.
        head = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=self.policy.l2 / seen["_n"], standardization=False, maxIter=2000, tol=1e-10)
        self.model = head.fit(self._assembled(known).withColumn("_label", F.col(label).cast("double")))
        return self

    def rank_scores(self, df: DataFrame) -> DataFrame:
        """The rows with rank_score: the log odds."""
        if self.model is None:
            raise TooFewRows("fit has not been called")
        judged = self.model.transform(self._assembled(df))
        return judged.select(*df.columns, F.element_at(vector_to_array("rawPrediction"), 2).alias("rank_score"))

    def calibrate(self, holdout: DataFrame, label: str = "label") -> bool:
        """Learn a monotone probability from rows that fit has not seen; without enough rows or with one label only there is none, and False."""
        self.calibrator = None
        known = self.rank_scores(holdout.filter(F.col(label).isNotNull())).select("rank_score", F.col(label).cast("double").alias("_label"))
        size, kinds = known.agg(F.count("*"), F.count_distinct("_label")).first()
        if size < self.policy.minimum_calibration_examples or kinds < 2:
            return False
        self.calibrator = IsotonicRegression(featuresCol="rank_score", labelCol="_label").fit(known)
        return True

    def score(self, candidates: DataFrame, status: str = "status", reasons: str = "reasons", anchor: str = "anchor_score") -> DataFrame:
        """The rows with rank_score, probability, abstained and reason_codes.

        A score abstains where the evidence is not accepted (its reasons, or evidence_not_accepted) or the
        best anchor is too weak; null counts as neither.  Only shown scores have a probability.
        Consumers order by (abstained, rank_score descending).
        """
        judged = self.rank_scores(candidates)
        own = F.when(F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0, F.col(reasons)).otherwise(F.array(F.lit("evidence_not_accepted")))
        none = F.array().cast("array<string>")
        weak = F.coalesce(F.col(anchor), F.lit(0.0)) < self.policy.minimum_anchor_score
        codes = F.concat(F.when(F.coalesce(F.col(status) == "accepted", F.lit(False)), none).otherwise(own), F.when(weak, F.array(F.lit("no_specific_anchor"))).otherwise(none))
        judged = judged.withColumn("reason_codes", F.array_distinct(codes)).withColumn("abstained", F.size("reason_codes") > 0)
        chance = F.lit(None).cast("double")
        if self.calibrator is not None:
            judged, chance = self.calibrator.transform(judged), F.when(~F.col("abstained"), F.round("prediction", 6))
        return judged.select(*candidates.columns, F.round("rank_score", 6).alias("rank_score"), chance.alias("probability"), "abstained", "reason_codes")


@query()
def adoption_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows J8 to J10: labelled documents stand for episodes, in the order of their ids.

    The first three fifths are learnt from, the next fifth calibrates, all are scored.  As the smallest
    table has few labels, 20 rows and 5 of label 1 suffice here (60 and 10 by default).  Fitting is
    iterative, so tests compare it with a direct solution instead of SQL.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    lines = F.size(F.split("text", "\n"))
    rows = documents.join(labels, "doc_id").select(
        "doc_id",
        F.log1p(F.col("n_chars")).alias("log_length"),
        (F.size(F.split("text", " ")) / lines).alias("words_a_line"),
        (F.length(F.regexp_replace("text", "[^.,]", "")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("stops"),
        (F.col("quality") > 0).cast("double").alias("label"),
        F.when(F.col("toxic") == 0, "accepted").otherwise("rejected").alias("status"),
        F.array().cast("array<string>").alias("reasons"),
        F.log10(F.greatest(F.col("n_chars"), F.lit(1))).alias("anchor_score"),
    )
    rows = written(rows, "episodes")  # texts are read once, not in each pass of the fit
    last = documents.agg(F.max("doc_id")).first()[0] or 0
    ranker = OutcomeHead(["log_length", "words_a_line", "stops"], Limits(minimum_training_examples=20, minimum_positive_examples=5))
    ranker.fit(rows.filter(F.col("doc_id") < last * 3 // 5))
    ranker.calibrate(rows.filter(F.col("doc_id").between(last * 3 // 5, last * 4 // 5)))
    return ranker.score(rows).select("doc_id", "rank_score", "probability", "abstained", "reason_codes")
