"""The pipeline reads and writes whole texts in small parts, so that executors' heaps stay small."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from emberline.llm.common import written


def test_stages_read_and_write_in_small_parts(spark):
    names = ["spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        rng = random.Random(1)
        docs = spark.createDataFrame([(i, rng.randbytes(10_000).hex()) for i in range(1_000)], "doc_id long, text string").coalesce(1)
        corpus_pipeline.language(spark, docs.withColumn("lang", docs.text.substr(1, 1)), "")
        assert int(spark.conf.get(names[0])) <= 250
        (path,) = written(docs, "texts").inputFiles()
        file = pq.ParquetFile(path.removeprefix("file://"))
        assert file.metadata.num_rows == 1_000
        sizes = [sum(group.column(j).total_compressed_size for j in range(2)) for i in range(file.num_row_groups) for group in [file.metadata.row_group(i)]]
        assert len(sizes) > 1 and max(sizes) < 10 << 20
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value) if value else spark.conf.unset(name)
