"""Quality classifier (operator 8): regularised quadratic discriminant over document statistics.

Each document is reduced to a vector of transformed statistics. Class means and
covariances are sums that Spark aggregates over all labelled rows; covariances
shrink towards the pooled diagonal. A score is the logistic of the difference of
the class log densities, from Mahalanobis distances by Cholesky factors that are
computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.rules import LOUD, SEPARATORS, SYMBOLS, _sums, measures
from rippleframe.llm.tables import id_and_text, stored
from rippleframe.llm.toxicity import remainder
from rippleframe.llm.wordbytes import LOWERCASE, UPPER, Prefix, byte_table, mix, pieces, word_ranges

DIGITS = byte_table(b"0123456789")
STOPS = byte_table(b".,;:")
BREAKS = byte_table(b"\n")
#: That of the lowest log loss over folds of the training rows (tests/llm/choose_settings.py), like the choice of statistics.
SHRINKAGE = 0.3
THRESHOLD = 0.3
NAMES = ("log_words", "word_length", "symbols", "upper", "loud", "bars", "repeated", "distinct", "same_lines", "digits", "stops", "line_words", "failed_lines", "stutter")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents x statistics); zeros stand in where a text has no words."""
    m = measures(data, offsets)
    n, words = len(offsets) - 1, np.maximum(m["n_words"], 1)
    count = lambda table: _sums(table[data], offsets)
    upper, lower = count(UPPER), count(LOWERCASE)
    starts, ends, doc = word_ranges(data, offsets)
    key = mix(Prefix(data).of(starts, ends) ^ mix(doc.astype(np.uint64)))
    stutter = np.bincount(doc[1:][key[1:] == key[:-1]], minlength=n)
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=n)
    lines = count(BREAKS) + 1
    chars = np.maximum(m["word_chars"], 1)
    return np.stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, np.sqrt(count(SYMBOLS) / words), np.sqrt(upper / np.maximum(upper + lower, 1)),
        np.sqrt(count(LOUD) / words), np.sqrt(count(SEPARATORS) / words), m["n_repeat_words"] / words,
        (distinct / words) * np.log1p(words) ** 0.5, m["n_dup_lines"] / lines, np.sqrt(count(DIGITS) / chars), count(STOPS) / words,
        np.log1p(m["n_words"] / lines), m["n_lost_words"] / words,
        np.sqrt(stutter / words),
    ], axis=1)


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row."""
    docs = id_and_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.mapInArrow(run, f"doc_id {kind}, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label: (count, mean, covariance) of rows (label, x); one small row per label reaches the driver."""
    k = len(NAMES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]
    out = {}
    for row in rows.groupBy("label").agg(F.count("*").alias("n"), *sums).collect():
        mean = np.array([row[f"s{i}"] for i in range(k)]) / row["n"]
        cross = np.array([[row[f"p{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / row["n"]
        out[row["label"]] = float(row["n"]), mean, cross - np.outer(mean, mean)
    return out


class Discriminant:
    """Two Gaussian classes: log prior, mean, inverse Cholesky factor and log determinant of each."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        total = sum(m[0] for m in moments.values())
        self.parts = {}
        pooled = sum((m[0] * m[2] for m in moments.values()), np.zeros((len(NAMES),) * 2)) / max(total, 1)
        for label, (n, mean, cov) in moments.items():
            own = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(mean))
            factor = np.linalg.cholesky(own)
            self.parts[label] = np.log(n / total), mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all one class if only that was seen, 0.5 if none was."""
        if set(self.parts) != {0, 1}:
            return np.full(len(x), 1.0 if 1 in self.parts else 0.0 if self.parts else 0.5)
        logs = {}
        for label, (prior, mean, inverse, half_det) in self.parts.items():
            away = (x - mean) @ inverse.T
            logs[label] = prior - half_det - 0.5 * (away * away).sum(axis=1)
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -35, 35)))


def quality(df: DataFrame, labels: DataFrame, held_out: int = 0, modulus: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Moments come from all labelled rows whose crc32(id) mod `modulus` is not
    `held_out`. Null and empty texts have the statistics of no words and a score
    like any other. A null label is no label, an id labelled twice takes the
    higher label; without labels every score is 0.5. held_out is false for a null
    id. Repeated rows are scored one by one, other columns are ignored; an empty
    table gives an empty result.
    """
    vectors = stored(document_statistics(df, id_col, text_col))
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held_out)).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = Discriminant(class_moments(vectors.join(marks, "doc_id").select("label", "x")))
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = vectors.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
