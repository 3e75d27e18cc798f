"""Target-distribution importance resampling (operator 12).

Hashed word runs of the corpus and of a target set are counted in a fixed
number of buckets; a bucket's gain says how much likelier the target is to use
it. The gains are one array of that fixed size, with which tasks score whole
texts. Scores get Gumbel noise of the id, so that the highest ones are a draw
without replacement, and are put in order by a distributed radix sort: the
composite key (score down, id up) is cut into digits, and each pass, from the
lowest digit on, counts digits by part, turns the counts into global offsets
and sends every row to its place. A pass is stable, so after the last one a
row's place is its rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.tables import discard, id_and_text, stored
from rippleframe.llm.twins import crc32_sql
from rippleframe.llm.wordbytes import LOWER, byte_table, pieces, word_ranges

BUCKETS, SEED, PERCENT, MIN_WORDS, RUN = 10_000, 2024, 10, 20, 1
#: Bytes that end a word: all of ASCII but digits and lower-case letters.
GAPS = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Most bits of a digit: a part holds two to that power of counters.
DIGIT_BITS = 12
#: Rows of a part, beyond which there are more parts than shuffle partitions.
PART_ROWS = 2_000_000
#: Words of up to so many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 48
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """Remainders of single bytes by the reflected polynomial of crc32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc_on(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 values carried on over bytes starts..ends of data, one range for each value."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    by_size, at, state = size[order], starts[order], crc[order] ^ _ONES
    long = int(np.searchsorted(-by_size, -SIDE_BY_SIDE, side="left"))  # they come first
    for i in range(long):
        k = order[i]
        state[i] = np.uint32(zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(crc[k]))) ^ _ONES
    for j in range(int(by_size[long]) if long < len(order) else 0):
        n = int(np.searchsorted(-by_size, -j, side="left"))  # those longer than j
        s = state[long:n]
        state[long:n] = _CRC[(s ^ data[at[long:n] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ _ONES
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every run of 1 to `longest` words, and the number of words of each document."""
    low = LOWER[data]
    starts, ends, doc = word_ranges(low, offsets, GAPS)
    docs, found = [doc], [crc_on(np.zeros(len(starts), np.uint32), low, starts, ends)]
    space = np.frombuffer(b" ", np.uint8)
    for extra in range(1, longest):
        fits = np.flatnonzero(doc[: len(doc) - extra] == doc[extra:]) if len(doc) > extra else np.zeros(0, np.int64)
        before = np.flatnonzero(doc[: len(doc) - extra + 1] == doc[extra - 1 :]) if len(doc) >= extra else fits
        run = found[-1][np.isin(before, fits)]
        run = crc_on(run, space, np.zeros(len(run), np.int64), np.ones(len(run), np.int64))
        found.append(crc_on(run, low, starts[fits + extra], ends[fits + extra]))
        docs.append(doc[fits])
    return np.concatenate(docs), np.concatenate(found).astype(np.int64) % buckets, np.bincount(doc, minlength=len(offsets) - 1)


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(1)):
                counts += np.bincount(features(data, offsets, longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts (doc_id, text): a task adds up its own, so at most `buckets` rows of each task are shuffled."""
    return texts.mapInArrow(_counted(longest, buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The array of gains, floor(1000 ln(target share / corpus share)) with one count added everywhere, from two tables of at most `buckets` rows."""
    sides = []
    for counts in (corpus, target):
        own = np.zeros(buckets, np.int64)
        for bucket, n in counts.collect():
            own[bucket] = n
        sides.append(own)
    (s, t), (big_s, big_t) = sides, (int(x.sum()) for x in sides)
    return np.array([math.floor(1000 * math.log((int(b) + 1) * float(big_s + buckets) / ((int(a) + 1) * float(big_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for first, end, data, offsets in pieces(batch.column(1)):
                doc, bucket, words = features(data, offsets, longest, len(gain))
                n = np.bincount(doc, minlength=end - first)
                parts.append((n, np.bincount(doc, weights=gain[bucket], minlength=end - first).astype(np.int64), words))
            columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_features", "weight", "n_words"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times Gumbel noise) of an id: the same in every run; a null id counts as the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


# ---- the distributed radix sort


def _digits(keys: list[str], low: list[int], high: list[int], most_bits: int) -> list[tuple[Column, int]]:
    """(digit, its bits) of each pass over ascending keys, the lowest digit first; a key of one value needs none."""
    out = []
    for key, a, b in reversed(list(zip(keys, low, high, strict=True))):
        bits = (b - a).bit_length()
        value, shift = (F.col(key) - a, F.shiftright) if bits < 63 else (F.col(key).bitwiseXOR(F.lit(-(1 << 63))), F.shiftrightunsigned)
        bits = bits if bits < 63 else 64
        passes = -(-bits // most_bits)
        width = -(-bits // passes) if passes else 0
        out += [(shift(value, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")), width) for k in range(passes)]
    return out or [(F.lit(0).cast("long"), 0)]


def _to_places(names: list[str], bits: int):
    """Rows of a part in order, its offsets ahead of them: every row gets its place in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = None, np.zeros(1 << bits, np.int64)
        for batch in batches:
            own = {n: batch.column(n) for n in batch.schema.names}
            parts, digit, at = (np.asarray(own[n]) for n in ("_part", "_digit", "_at"))
            is_row = np.asarray(own["_is_row"])
            place = np.zeros(len(digit), np.int64)
            edges = np.flatnonzero(np.diff(parts)) + 1
            for a, b in zip([0, *edges], [*edges, len(parts)], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    part, offset = parts[a], np.zeros(1 << bits, np.int64)
                m = a + int(np.searchsorted(is_row[a:b], 1))
                offset[digit[a:m]] = at[a:m]
                d = digit[m:b]
                order = np.argsort(d, kind="stable")
                sorted_d = d[order]
                first = np.searchsorted(sorted_d, sorted_d)  # where the run of this digit begins
                place[m:b][order] = offset[sorted_d] + np.arange(len(d)) - first
                offset += np.bincount(d, minlength=len(offset))
            rows = pa.array(np.flatnonzero(is_row))
            yield pa.RecordBatch.from_arrays([*[own[n].take(rows) for n in names], pa.array(place).take(rows)], [*names, "_at"])

    return run


def radix_sorted(df: DataFrame, keys: list[str], digit_bits: int = DIGIT_BITS, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """(df with _at, the place 0, 1, 2, ... of each row by ascending keys; the number of rows).

    Keys are integers without nulls, the most significant first. Rows equal in
    all keys come in an order that is fixed when df is first written. Each pass is one
    write in the shared folder. Its counters are a row for each part and digit;
    they are added up on Spark, a digit at a time, and reach only their own part.
    """
    spark, names = df.sparkSession, df.columns
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()))
    bounds = rows.agg(F.count("*"), *[f(k) for k in keys for f in (F.min, F.max)]).first()
    n = bounds[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // part_rows))
    size = max(1, -(-n // parts))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    part = F.pmod(F.xxhash64("_at"), F.lit(parts))
    for digit, bits in _digits(keys, [x or 0 for x in bounds[1::2]], [x or 0 for x in bounds[2::2]], digit_bits):
        dealt = rows.withColumn("_part", part).withColumn("_digit", digit)
        counts = dealt.groupBy("_part", "_digit").agg(F.count("*").alias("_n"))
        so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.groupBy("_digit").agg(F.sum("_n").alias("_all")).select("_digit", so_far("_all", Window.orderBy("_digit")).alias("_start"))  # at most a row for each digit
        offsets = counts.join(F.broadcast(starts), "_digit").select("_part", "_digit", (F.col("_start") + so_far("_n", Window.partitionBy("_digit").orderBy("_part"))).alias("_at"))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        both = offsets.select(*blank, "_at", "_part", "_digit", F.lit(0).alias("_is_row")).unionByName(dealt.withColumn("_is_row", F.lit(1)))
        dealt_out = both.repartitionById(parts, F.col("_part").cast("int")).sortWithinPartitions("_part", "_is_row", "_at")
        moved = stored(dealt_out.mapInArrow(_to_places(names, bits), f"{kinds}, _at bigint"))
        discard(rows)
        rows, part = moved, F.floor(F.col("_at") / size)
    return rows, n


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; of those with min_words, percent in a hundred with the highest scores are drawn and ranked from 1.

    Equal scores go by the smaller id, null ids after all others; rows equal in
    both (repeated rows) have ranks of their own, in any order. A
    null or empty text has no features and weight 0. Without a target, or
    without documents, every count is zero and the formula still holds. Ids are
    integers; other columns are ignored.
    """
    docs = id_and_text(df, id_col, text_col)
    wanted = target.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(f"`{target_col}`"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(wanted, longest, buckets), buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.mapInArrow(_weighed(gain, longest), f"doc_id {kind}, n_features bigint, weight bigint, n_words bigint")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = scored.filter(F.col("n_words") >= min_words)
    keyed = fit.select("*", (-F.col("score")).alias("_down"), F.col("doc_id").isNull().cast("long").alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"))
    ranked, n = radix_sorted(keyed, ["_down", "_none", "_id"])
    rank = F.when(F.col("_at") < percent * n // 100, F.col("_at") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(scored.filter(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The twin of the query's parameters: words, crc32 of each different word, gains by bucket, noise, rank.
ORACLE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), b AS (SELECT {_WORDS} AS words FROM benchmark),
w AS (SELECT doc_id, unnest(words) AS word FROM d), v AS (SELECT unnest(words) AS word FROM b),
k AS (SELECT word, {crc32_sql('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM v))),
sc AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (word) GROUP BY 1), tc AS (SELECT bucket, count(*) AS t FROM v JOIN k USING (word) GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM w) AS big_s, (SELECT count(*) FROM v) AS big_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000)))) AS BIGINT) AS gain FROM sc LEFT JOIN tc USING (bucket), z),
f AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r LEFT JOIN o USING (doc_id)"""
