"""What Python workers and Arrow batches hold between the stages of the pipeline."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rippleframe.llm import tables

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20


def largest(batches):
    yield pa.RecordBatch.from_arrays([pa.array([max(b.num_rows for b in batches)], pa.int64())], ["n"])


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_small_batches(spark, name):
    before = spark.conf.get(NAME)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        spark.conf.unset(NAME)
        dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        assert spark.range(9000).coalesce(1).mapInArrow(largest, "n long").first().n <= tables.ARROW_ROWS
        spark.conf.set(NAME, "7")
        tables.small_batches(spark)
        assert spark.conf.get(NAME) == "7"
    finally:
        spark.conf.set(NAME, before)


def test_freed_memory_goes_back(spark):
    def hold(batches):
        for batch in batches:
            blocks, pins = [], []
            for k in range(3000):  # a small block after each large one keeps the allocator from trimming by itself
                blocks.append(np.ones(8000))
                pins.append(bytes(1000 + k % 7))
            tables.kept_by_test = pins
            del blocks
            yield batch

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resident()] * batch.num_rows, pa.int64())], ["n"])

    one = spark.range(1).coalesce(1)
    start = one.mapInArrow(size, "n long").first().n
    assert tables.map_arrow(one, hold, "id long").collect() == one.collect()
    assert one.mapInArrow(size, "n long").first().n < start + 100  # 190 MB were held


def test_groups_with_and_without_key(spark):
    rows = spark.range(6).selectExpr("id % 2 as k", "id")
    plain = tables.map_groups(rows.groupBy("k"), lambda t: t.select(["id"]), "id long")
    keyed = tables.map_groups(rows.groupBy("k"), lambda key, t: pa.table({"k": [key[0].as_py()], "n": [t.num_rows]}), "k long, n long")
    assert sorted(r.id for r in plain.collect()) == list(range(6)) and sorted(map(tuple, keyed.collect())) == [(0, 3), (1, 3)]
