"""Toxicity (operator 6): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased.
Features are the presence of a word, of a word's first bytes, of a word pair and
of a pair with one word between, hashed to 2**BITS places. Per-coordinate rates and L1 leave few
non-zero weights, broadcast to the tasks that score every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.tables import id_and_text, map_arrow
from rippleframe.llm.wordbytes import LOWER, PUNCTUATION, Prefix, chained, mix, pieces, word_ranges

BITS = 20
#: Of a longer word its first so many bytes count as features too.
STEMS = (4, 6, 7)
#: The fit takes at most so many labelled documents, those of the smallest hashed ids.
MAX_TRAIN = 12_000
#: Passes, rate, L1 and the word starts are those of the lowest log loss over folds of the training rows (tests/llm/choose_settings.py).
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 3.0, 0.5
THRESHOLD = 0.3


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, document) of every feature of each document; repeats are left in."""
    data = LOWER[data]
    starts, ends, doc = word_ranges(data, offsets, PUNCTUATION)
    prefix = Prefix(data)
    h = prefix.of(starts, ends)
    at, pairs = chained(h, doc, 2)
    far = np.flatnonzero(doc[: len(h) - 2] == doc[2:]) if len(h) > 2 else np.zeros(0, np.int64)
    skips = mix(mix(h[far] * np.uint64(5)) + h[far + 2])
    found, owner = [h, pairs, skips], [doc, doc[at], doc[far]]
    for length in STEMS:
        long = np.flatnonzero(ends - starts > length)
        found.append(mix(prefix.of(starts[long], starts[long] + length) + np.uint64(length)))
        owner.append(doc[long])
    place = np.concatenate(found) & np.uint64((1 << BITS) - 1)
    return place.astype(np.int64), np.concatenate(owner)


def distinct_places(place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc << BITS | place)
    return both & ((1 << BITS) - 1), both >> BITS


def fit(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights, the last one the bias, of FTRL-proximal over rows (places, label), in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full(len(z), L1)
    l1[-1] = 0.0

    def weights(at):
        push = np.maximum(np.abs(z[at]) - l1[at], 0.0)
        return -np.sign(z[at]) * push / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for places, label in rows:
            at = np.append(places, 1 << BITS)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def probabilities(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    place, doc = buckets(data, offsets)
    used = weights[place] != 0
    place, doc = distinct_places(place[used], doc[used])
    total = weights[-1] + np.bincount(doc, weights=weights[place], minlength=len(offsets) - 1)
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def remainder(id_col: F.Column, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def trained(df: DataFrame, labels: DataFrame, held_out: int = 2, modulus: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """(place, weight) of the non-zero weights, fitted on at most max_train labelled rows outside the held-out remainder."""
    chosen = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(F.col("label").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    docs = id_and_text(df, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most max_train ids
    docs = docs.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                place, doc = distinct_places(*buckets(data, offsets))
                ends = np.zeros(b - a + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=b - a), out=ends[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))], ["order_key", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            labels_of, lists = batch.column(1).to_pylist(), batch.column(2)
            rows += [(lists[k].values.to_numpy(), labels_of[k]) for k in range(batch.num_rows)]
        w = fit(rows)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["place", "weight"])

    features = map_arrow(docs.select(F.xxhash64("doc_id").alias("k"), "text", "label"), extract, "order_key bigint, label int, places array<int>")
    return map_arrow(features.repartition(1).sortWithinPartitions("order_key"), learn, "place bigint, weight double")


def _table(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero, of at most 2**BITS + 1 rows."""
    rows = weights.collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def _dense(compact: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = np.zeros((1 << BITS) + 1)
    w[compact[0]] = compact[1]
    return w


def clean(df: DataFrame, weights: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, whose score is below the threshold; null texts count as empty. Without weights, as no labels give, all stay."""
    compact, at = _table(weights), df.columns.index(text_col)
    if not len(compact[0]):
        return df
    sent = df.sparkSession.sparkContext.broadcast(compact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _dense(sent.value)
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(probabilities(data, offsets, w) < threshold))

    return map_arrow(df, run, df.schema)


def score(df: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row; weights are those of trained(), at most 2**BITS + 1 rows."""
    sent = df.sparkSession.sparkContext.broadcast(_table(weights))
    docs = id_and_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _dense(sent.value)
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                p = probabilities(data, offsets, w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(docs, run, f"doc_id {kind}, score double, predicted int")


def toxicity(df: DataFrame, labels: DataFrame, held_out: int = 2, modulus: int = 4, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The fit sees only labelled rows whose crc32(id) mod `modulus` is not
    `held_out`, at most max_train of them. Null and empty texts score by the
    bias alone; a null label is no label, an id labelled twice takes the higher
    label, a labelled id of several texts is learnt from the smallest, no labels
    at all give 0.5 to every text. held_out is false for a null
    id. Repeated rows are scored one by one, other columns are ignored; an empty
    table gives an empty result.
    """
    out = score(df, trained(df, labels, held_out, modulus, max_train=max_train))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
