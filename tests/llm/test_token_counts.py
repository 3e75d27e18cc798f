"""Operator 11 against the library over whole texts."""

from collections import Counter

from pyspark.sql import functions as F

from rippleframe.llm import queries as registered
from rippleframe.llm import tokencount
from tests.llm.test_operators import HARD, SF, empty, frame, key, sample

PATH = tokencount.vocabulary_path(tokencount.VOCABULARY)
TRICKY = [
    "a<|endoftext|>  b<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext |> <|EndOfText|>", "it's 'tis we'll ''s", "  \n\n  a \t ", "a b " * 60000, "<|endoftext|> x " * 9000,
    "࢏౜ ab ₏ x՘y", "\U00018e00\U00018e01 1\U00018e02", " \x1c \x85 a　b  c", "́é ²½ Ⅷ", "no​space" * 500, "\r\n\r\n x\r",
]


def by_library(text):
    return len(tokencount.splitter(PATH).library.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    rows = sample(spark) + [(1000 + i, t) for i, t in enumerate(TRICKY)] + HARD
    got = Counter((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(frame(spark, rows), cut_chars=500).collect())
    library = tokencount.Splitter(PATH).library
    sizes = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == Counter((key(i), len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, sizes, strict=True))


def test_whole_tokens_are_single_tokens():
    whole = tokencount.whole_tokens(PATH)
    assert "hello" in whole and " the" in whole and "<|endoftext|>" not in whole and "a b" not in whole
    some = sorted(whole)[::97]
    assert all(by_library(t) == 1 for t in some)


def test_code_points_that_the_tables_read_differently_go_to_the_library():
    own = tokencount.Splitter(PATH)
    for first in range(0, 0x3000, 64):
        text = " ".join(f"x{chr(c)}7{chr(c)}-" for c in range(first, first + 64))
        assert own.split(text) == [text[a:b] for _, (a, b) in own.library.pre_tokenizer.pre_tokenize_str(text)]


def test_empty_table_and_columns(spark):
    out = tokencount.token_counts(empty(spark))
    assert out.count() == 0 and out.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_query_runs_over_the_whole_table(spark):
    out = registered.QUERIES["op11_token_counts"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() == docs.count()
    assert out.agg(F.sum("n_bytes")).first()[0] == docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert out.filter(F.col("n_whole") > F.col("n_pieces")).count() == 0
