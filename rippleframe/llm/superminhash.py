"""MinHash near-duplicates (operator 10): SuperMinHash, banding, verification, groups.

Each shingle of a document draws, level by level, a uniform number and a place
of a permutation of the signature (correlated ranks: level j gives values in
[j, j + 1)). A place keeps its smallest value. As soon as every place of a
document holds a value below the next level, no later level can change it and
the document stops. All documents of an Arrow piece go through a level together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.linking import Near, linked_groups
from rippleframe.llm.tables import alone, id_and_text, map_arrow, stored, with_ids
from rippleframe.llm.wordbytes import LOWER, Prefix, chained, mix, pieces, signed, word_ranges

PLACES, ROWS = 128, 4
WORDS, PERCENT = 5, 80
SKETCH_WORDS = 32
_LEVEL = 0xD6E8FEB86659FD93


def signatures(elements: np.ndarray, doc: np.ndarray, docs: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures (docs x places) of 64-bit elements, each with its document; infinity for no elements."""
    out = np.full(docs * places, np.inf)
    drawn: list[np.ndarray] = []  # of the elements still alive, the place drawn at each level so far
    for level in range(places):
        if not len(elements):
            break
        h = mix(elements ^ np.uint64((level + 1) * _LEVEL % (1 << 64)))
        value = level + (h >> np.uint64(11)) * 2.0**-53
        draw = level + ((mix(h) >> np.uint64(32)) * np.uint64(places - level) >> np.uint64(32)).astype(np.int64)
        place = draw.copy()
        for t in range(level - 1, -1, -1):
            place[drawn[t] == place] = t
        np.minimum.at(out, doc * places + place, value)
        alive_docs = np.unique(doc)
        done = out.reshape(docs, places)[alive_docs].max(axis=1) < level + 1
        if done.any():
            finished = np.zeros(docs, bool)
            finished[alive_docs[done]] = True
            alive = ~finished[doc]
            elements, doc, draw = elements[alive], doc[alive], draw[alive]
            drawn = [d[alive] for d in drawn]
        drawn.append(draw)
    return out.reshape(docs, places)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles of each document; a document of fewer words has one, of all of them."""
    docs = len(offsets) - 1
    data = LOWER[data]
    starts, ends, doc = word_ranges(data, offsets)
    h = Prefix(data).of(starts, ends)
    at, hashes = chained(h, doc, words)
    found, owners = [hashes], [doc[at]]
    count = np.bincount(doc, minlength=docs)
    for k in range(1, words):
        if (count == k).any():
            at, hashes = chained(h, doc, k)
            short = count[doc[at]] == k
            found.append(mix(hashes[short] + np.uint64(k)))
            owners.append(doc[at[short]])
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    first = np.unique(mix(hashes ^ mix(owner.astype(np.uint64))), return_index=True)[1]
    return hashes[first], owner[first]


def features(docs: DataFrame, words: int, places: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of rows (doc_id, text); set_a and set_b name the set, bands are bucket keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                n = b - a
                h, owner = shingles(data, offsets, words)
                count = np.bincount(owner, minlength=n)
                names = np.zeros((2, n), np.uint64)
                for k in range(2):
                    np.add.at(names[k], owner, mix(h * np.uint64(2 * k + 1) + np.uint64(k)))
                bits = signatures(h, owner, n, places).view(np.uint64)
                keys = np.zeros((n, places // rows), np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(3) + bits[:, r::rows])
                keys = mix(keys + np.arange(places // rows, dtype=np.uint64))
                ends = np.zeros(n + 1, np.int32)
                np.cumsum((count > 0) * (places // rows), out=ends[1:])
                bands = pa.ListArray.from_arrays(pa.array(ends), signed(keys[count > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(count.astype(np.int64)), signed(names[0]), signed(names[1]), bands], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return map_arrow(docs, run, f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def parity_sketches(h: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """(docs x SKETCH_WORDS) bits: each element flips one bit of its document.

    The sketches of two sets differ in at most as many bits as the sets have
    elements that are not common: an exact bound.
    """
    bit = mix(h + np.uint64(11)) % np.uint64(64 * SKETCH_WORDS)
    flips = np.bincount(owner * (64 * SKETCH_WORDS) + bit.astype(np.int64), minlength=docs * 64 * SKETCH_WORDS) % 2
    return np.packbits(flips.astype(np.uint8).reshape(docs, -1), axis=1).view(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles array<bigint>, sketch array<bigint>) of rows (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1), rows=1024):
                h, owner = shingles(data, offsets, words)
                h = h[np.argsort(owner, kind="stable")]
                ends = np.zeros(b - a + 1, np.int32)
                np.cumsum(np.bincount(owner, minlength=b - a), out=ends[1:])
                sketch = parity_sketches(h, np.repeat(np.arange(b - a), np.diff(ends)), b - a)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(sketch.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), signed(h)), sketch], ["doc_id", "shingles", "sketch"])

    return map_arrow(docs, run, f"doc_id {kind}, shingles array<bigint>, sketch array<bigint>")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, traits) of the rarest shingles of sets (doc_id, shingles): enough that two sets at the threshold share one.

    Of n shingles, n - ceil(percent * n / 100) + 1 are enough in any common
    order. The order is by the number of these sets that have a shingle, so a
    document with that many shingles of its own has no partner and drops out.
    """
    rows = sets.select(F.col("doc_id").alias("id"), F.size("shingles").cast("bigint").alias("size"), F.explode("shingles").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1")
    shared = rows.join(shared, "key")
    own = Window.partitionBy("id")
    alone = F.col("size") - F.count("*").over(own)
    enough = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
    rank = F.row_number().over(own.orderBy("sets", "key"))
    first = shared.withColumn("rank", rank).withColumn("alone", alone).filter(F.col("rank") <= enough - F.col("alone"))
    first = first.join(sets.select(F.col("doc_id").alias("id"), "sketch"), "id")
    return first.select("key", "id", F.struct("size", (F.col("size") - F.col("alone")).alias("shared"), "sketch").alias("traits"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| of their
    sets of word shingles (A-Z lower-cased, 64-bit hashes); component_id is the
    smallest id that links reach. Documents with equal sets fall together first,
    so that copies never meet in buckets. Bands of the signature are the buckets;
    where a bucket's star leaves several groups, its documents meet again over
    their rarest shingles (an exact filter) instead of all with all. With 32 bands of 4 a pair at 0.8 is
    missed with probability 5e-8. Null and empty texts have no shingles and link
    with nothing. Rows that repeat an id share that id's component; rows with a
    null id come back alone, component_id null and kept true. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = id_and_text(df, id_col, text_col)
    found = stored(features(docs, words, places, rows))
    named = found.filter("doc_id is not null and n_shingles > 0")
    twins = stored(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    leaders = named.join(twins.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    members = leaders.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.struct(F.col("n_shingles").alias("size")).alias("traits"))

    def verified(pairs: DataFrame) -> DataFrame:
        ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        sets = shingle_sets(with_ids(docs, ids, "doc_id"), words).dropDuplicates(["doc_id"])
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")

    def sized(x: Column, y: Column) -> Column:
        return 100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"])

    def possible(x: Column, y: Column) -> Column:
        """What the sizes, the shingles shared with any other document and the sketches leave possible."""
        both = x["size"] + y["size"]
        apart = F.lit(0)
        for k in range(SKETCH_WORDS):
            apart = apart + F.bit_count(x["sketch"][k].bitwiseXOR(y["sketch"][k]))
        return sized(x, y) & ((100 + percent) * F.least(x["shared"], y["shared"]) >= percent * both) & ((100 + percent) * apart <= (100 - percent) * both)

    def refined(ids: DataFrame) -> tuple[DataFrame, Near]:
        ids = ids.withColumnRenamed("id", "doc_id")
        return rare_shingles(stored(shingle_sets(with_ids(docs, ids, "doc_id"), words).dropDuplicates(["doc_id"])), percent), possible

    groups = alone(lambda: linked_groups(members, verified, sized, refined))
    labels = twins.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "set_a", "set_b").join(labels, ["set_a", "set_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


#: The contract of four words and 80 percent as SQL over the view `documents`, by plain counting of shared shingles.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
 n AS (SELECT doc_id, len(g) AS n FROM s),
 u AS (SELECT doc_id, unnest(g) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""
