import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rippleframe.llm import bpe

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k} and thing{k}" for k in range(60))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)


def test_stages_keep_columns_and_act(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter(F.length("text") > 60).first().text
    rows = [(1, LONG), (2, LONG.replace("word7 ", "changed ").replace("\n", " ")), (3, "Some words before. " + item + " Some words after it, of another kind."), (4, None), (5, ""), (None, "a row without an id"), (6, LONG), (6, LONG)]
    docs = table(spark, rows)
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.columns == docs.columns and sorted(r.doc_id or -1 for r in near.collect()) == [-1, 1, 3, 4, 5]
    clean = corpus_pipeline.drop_leaks(spark, docs, SF)
    assert clean.columns == docs.columns and 3 not in {r.doc_id for r in clean.collect()} and clean.count() == len(rows) - 1
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and 6 not in got and got[1].text == LONG and got[1].n_chars == len(LONG) and got[4].text == ""
    clashing = docs.withColumns({c: F.lit(c) for c in ("n_removed", "n_lines", "gone", "th", "item", "h", "other_0", "doc", "key", "label")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, clashing, SF)
        if name == "toxicity":  # six labels say little
            assert out.columns == clashing.columns
        elif name != "byte_bpe":
            assert out.columns == clashing.columns and {r.n_removed for r in out.collect()} == {"n_removed"}


def test_toxic_documents_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(i not in kept for i, t in marks.items() if t) >= 0.7 * sum(marks.values())
    assert sum(i in kept for i, t in marks.items() if not t) >= 0.97 * sum(not t for t in marks.values())


def test_run_is_its_stages(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(at)
        docs = spark.read.parquet(at)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
    shutil.rmtree(tmp_path, ignore_errors=True)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_other_rank_files(spark, name):
    out = bpe.token_digests(table(spark, [(1, LONG)]), rank_path=bpe.vocabulary_path(name)).first()
    assert out.n_tokens > 0
