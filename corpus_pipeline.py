"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import BATCH, FILES, bounded, small_batches, table, without, written

#: A document is rejected for its language if no profile comes this near (or it has no letter).
LEAST_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that some language's profile fits; null texts and texts without a letter go."""
    from emberline.llm.language import in_known_language

    small_batches(spark, BATCH | FILES)  # for all stages
    return in_known_language(docs, LEAST_LANGUAGE_SCORE)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are not predicted to be toxic (rows without an id cannot be told apart and stay)."""
    from emberline.llm.toxicity import score_toxicity

    judged = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.filter("predicted = 1").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of the least doc_id, and one row of it (rows without an id stay)."""
    from emberline.llm.simhash import near_duplicates as groups

    found = written(groups(docs).select("doc_id", "component_id"), "groups")
    kept = without(docs, found.filter("doc_id <> component_id").select("doc_id"))
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    twice = kept.join(bounded(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return without(kept, repeated).unionByName(twice)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later copies of repeated passages out of the texts."""
    from emberline.llm.passages import remove_repeats

    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    import public_tokenizers

    from emberline.llm.packing import pack

    # By now an executor's memory is mostly taken, so a worker holds small slices and remembers few chunks.
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=30_000, forget=True, slice_bytes=1 << 20)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]
#: Profiles, language models and tokens cannot be expressed in SQL; the operators' own tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
