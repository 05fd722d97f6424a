"""The pipeline's stages one after the other, each against brute force or the rule it promises, on hard rows."""

import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from emberline.llm.common import written

SF = "/root/testdata/sf0.001"
LETTERLESS = {9001: None, 9002: "", 9003: "12 34 ... 56"}
COPY, NEAR, FIRST, SECOND = 9010, 9011, 9020, 9021


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) / 2)


def least_of_each_group(texts):
    marks = sorted((i, fingerprint(t)) for i, t in texts.items())
    group = {i: i for i, _ in marks}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, (a, x) in enumerate(marks):
        for b, y in marks[:n]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {i for i in group if root(i) == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    english = [r.text for r in documents.filter("lang = 'en' and n_chars > 2000").orderBy("doc_id").limit(4).collect()]
    passage = " ".join(f"{w}{i}" for i, w in enumerate(english[3].replace("\n", " ").split(" ")[:70]))
    planted = {**LETTERLESS, COPY: english[0], NEAR: english[0] + " End.", FIRST: f"{english[1]}\n{passage}", SECOND: f"{passage}\n{english[2][::-1]}", None: english[3][::-1]}
    rows = [(i, t, "en", "src", len(t or "")) for i, t in planted.items()] + [(COPY, english[0], "en", "src", len(english[0]))]
    documents.unionByName(spark.createDataFrame(rows, documents.schema)).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(path / "labels.parquet"))
    return str(path), passage


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The table before the first stage and after each."""
    tables = [spark.read.parquet(f"{folder[0]}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], folder[0]), name))
    return tables


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_all_stages_but_the_last_return_documents(stages):
    assert [name for name, _ in pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "passages", "packing"]
    assert all(df.schema == stages[0].schema for df in stages[1:-1])


def test_language_drops_what_no_profile_fits(stages):
    before, after = set(ids(stages[0])), set(ids(stages[1]))
    assert before - after == set(LETTERLESS)
    assert stages[0].count() - stages[1].count() == len(LETTERLESS)


def test_toxicity_drops_what_the_operator_predicts(spark, stages, folder):
    from emberline.llm.toxicity import score_toxicity

    judged = score_toxicity(stages[1], spark.read.parquet(f"{folder[0]}/labels.parquet"))
    toxic = {r.doc_id for r in judged.filter("predicted = 1").collect() if r.doc_id is not None}
    assert ids(stages[2]) == [i for i in ids(stages[1]) if i not in toxic]


def test_near_duplicates_keep_the_least_of_each_group(stages):
    before, after = texts(stages[2]), ids(stages[3])
    nameless = before.pop(None)
    assert after == sorted([*least_of_each_group(before), None], key=str)
    assert texts(stages[3])[None] == nameless
    assert COPY in before and COPY not in after and NEAR not in after


def test_passages_keep_the_first_copy_and_leave_others_alone(stages, folder):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after) and {FIRST, SECOND} <= set(after)
    words = folder[1].split(" ")
    left = [len(set(words) & set(after[i].split())) for i in (FIRST, SECOND)]
    assert left == [len(set(words)), 0]
    assert all(len(after[i]) <= len(before[i]) for i in after)


def test_packing_holds_each_id_once(stages):
    pieces = stages[5].collect()
    assert {p.doc_id for p in pieces} == set(ids(stages[4]))
    held = {}
    for p in pieces:
        held.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    for parts in held.values():
        parts.sort()
        at = 0
        for start, length, total in parts:
            assert start == at and total == parts[0][2]
            at += length
        assert at == parts[0][2]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096


def test_run_applies_the_stages(spark, stages, folder):
    count = lambda df: sorted((str(r.doc_id), r.n) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert count(pipeline.run(spark, folder[0])) == count(stages[5])
