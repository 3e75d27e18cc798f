"""Suffix-array dedup (operator 5): bucket-pointer refinement of repeated byte strings.

Suffixes need to be told apart only to a depth of 50 bytes. They start in
buckets by their first 20 bytes, the only ones that are read as bytes. From then
on a bucket's number is made of two numbers that are known already: that of the
suffix itself and that of the suffix at a later offset (20 and 20 later give 40
bytes, 40 and 10 later give 50, two of 50 a longer stretch). Numbers are updated
once a length and reused for the next; suffixes are sorted by them.

0. Of the q-grams of a 50-byte window the one with the smallest hash stands for
   the window, so one suffix in about fifteen is placed. Its windows start 0 to
   30 bytes before it.
1. Open buckets, those of several documents, are refined by the number of the
   whole stretch that the suffix's windows cover. A stretch that a smaller
   document has is repeated as a whole; only its first document's goes on.
2. What is left is refined by the numbers at the offsets that all windows
   starting 0 to 15, or 16 to 30, bytes before the suffix share.
3. What is still open is refined to the full depth, window by window.

In every round each piece of the corpus names its buckets once, with the
smallest document that it has there; the names are sorted by ranges of their
numbers, and each piece gets back a bit for each of its buckets. So a bucket
that a third of all documents share costs a row for each piece. A piece makes
its numbers anew in each round, as eight bytes for each byte of text would cost
more than the corpus to keep. Numbers have 64 bits; with n of them in the
stretch and window rounds two different strings of a corpus fall together with a
probability of about n * n / 2**65 (n = 10**7: 3e-6).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.tables import id_and_text, stored, tidy
from rippleframe.llm.wordbytes import Prefix, flat, mix, pieces

LENGTH, Q = 50, 20
#: Bytes of text in a row of pieces, of those that are numbered together, and of those whose q-grams are ranked together.
PIECE_TEXT, HASHED, RANKED = 1 << 20, 1 << 18, 1 << 17
#: Bytes of a piece up to which its numbers are kept for all steps of a round, 24 bytes each; longer texts make them again.
KEPT = 2 << 20
#: Pieces whose buckets of one round make up one range of identifiers on average: about 8 MB of them.
PIECES_A_SLOT = 16
GRAM, STRETCH, HALF, WINDOW = range(4)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    done = 1
    while done * 2 <= w:
        v = np.minimum(v[: len(v) - done], v[done:])
        done *= 2
    if done < w:
        v = np.minimum(v[: len(v) - (w - done)], v[w - done :])
    return v


def anchors(data: np.ndarray, offsets: np.ndarray, live: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place, first window, windows, document) of each sampled suffix of the live documents.

    Of the q-grams in a window the one with the smallest hash (the first of
    equals) stands for the window; runs of windows with the same one become one
    row. Equal windows always choose equal q-grams.
    """
    found = []
    for base in range(0, max(len(data) - length + 1, 0), RANKED):
        part = data[base : base + RANKED + length - 1]
        prefix = Prefix(part)
        v = prefix.sums[q:] - prefix.sums[:-q]
        v *= prefix.down[: len(v)]
        v ^= v >> np.uint64(29)
        v *= _STEP
        # the upper 40 bits of the hash, then the place: of equals the first
        v &= ~_PLACE
        v |= np.arange(len(v), dtype=np.uint64)
        best = sliding_min(v, length - q + 1)
        # windows that leave their document, or lie in one that takes no part
        d = np.arange(np.searchsorted(offsets, base, "right") - 1, np.searchsorted(offsets, base + len(best), "left"))
        bad_from = np.clip(np.where(live[d], np.maximum(offsets[d], offsets[d + 1] - length + 1), offsets[d]) - base, 0, len(best))
        bad_to = np.clip(offsets[d + 1] - base, 0, len(best))
        good = np.cumsum(np.bincount(bad_from, minlength=len(best) + 1) - np.bincount(bad_to, minlength=len(best) + 1))[:-1] == 0
        new = np.empty(len(best), bool)
        new[0] = True
        np.not_equal(best[1:], best[:-1], out=new[1:])
        new[np.clip(offsets[d] - base, 0, len(best) - 1)] = True
        low = np.flatnonzero(new & good)
        # a run ends where the next one, or a window that does not count, begins
        stops = np.flatnonzero(np.append(new | ~good, True))
        n = stops[np.searchsorted(stops, low, "right")] - low
        at = (best[low] & _PLACE).astype(np.int64)
        found.append((prefix.of(at, at + q), at + base, low + base, n, np.searchsorted(offsets, low + base, "right") - 1))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Numbers:
    """Bucket numbers of every suffix of a run of bytes, at q bytes, twice and twice again, and at the full depth."""

    def __init__(self, data: np.ndarray, length: int, q: int):
        prefix = Prefix(data)
        grams = prefix.sums[q:] - prefix.sums[:-q] if len(data) >= q else np.zeros(0, np.uint64)
        size, now = q, mix(grams * prefix.down[: len(grams)])
        self.levels = {q: now}
        while size < length:
            later = min(size, length - size)
            now = self._refined(now[: max(len(now) - later, 0)], now[later:], size + later)
            size += later
            self.levels[size] = now

    @staticmethod
    def _refined(own: np.ndarray, later: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Numbers at a larger depth, from the own one and that of the suffix at a later offset."""
        return mix(own * np.uint64(3) + later + np.asarray(size).astype(np.uint64))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of ranges of q to twice the full depth bytes: those of the deepest level that fits, at both ends."""
        sizes, depths = ends - starts, np.array(list(self.levels))
        out = np.zeros(len(starts), np.uint64)
        fits = depths[np.searchsorted(depths, sizes, "right") - 1]
        for depth in np.unique(fits):
            rows = np.flatnonzero(fits == depth)
            now, s, n = self.levels[int(depth)], starts[rows], sizes[rows]
            out[rows] = np.where(n == depth, now[s], self._refined(now[s], now[s + n - depth], n))
        return out


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, q: int, made: dict[int, Numbers] | None = None) -> np.ndarray:
    """Bucket numbers of byte ranges, made for HASHED bytes of text at a time; made keeps them for the next call."""
    out = np.zeros(len(starts), np.uint64)
    for base in range(0, len(data), HASHED):
        mine = slice(None) if len(data) <= HASHED else np.flatnonzero((starts >= base) & (starts < base + HASHED))
        if len(starts[mine]):
            own = (made or {}).get(base) or Numbers(data[base : base + HASHED + 2 * length], length, q)
            if made is not None:
                made[base] = own
            out[mine] = own.of(starts[mine] - base, ends[mine] - base)
    return out


class Buckets:
    """The different identifiers of a piece in order, with the smallest document and whether there are several."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray):
        order = np.argsort(keys, kind="stable")
        k, d = keys[order], docs[order]
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        at = np.flatnonzero(new)
        self.keys = k[at]
        self.first = np.minimum.reduceat(d, at) if len(at) else d
        self.several = (np.maximum.reduceat(d, at) if len(at) else d) > self.first
        self.of = np.empty(len(k), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def bounds(self, slots: int) -> np.ndarray:
        """Where each slot, an even range of identifiers, begins; the end is added."""
        edges = np.array([(j << 64) // slots for j in range(1, slots)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])


class Piece:
    """One row of pieces and what the rounds so far have answered."""

    def __init__(self, ids: pa.Array, texts: pa.Array, answers: list | None, slots: int, length: int, q: int):
        self.data, self.offsets = flat(texts)
        self.ids, self.live = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        self.slots, self.length, self.q = slots, length, q
        self.made: dict[int, Numbers] | None = {} if len(self.data) <= KEPT else None
        self.answers: dict[int, dict[int, bytes]] = {}
        for a in answers or ():
            self.answers.setdefault(a["level"], {})[a["slot"]] = a["bits"]

    def answered(self, level: int, buckets: Buckets) -> np.ndarray:
        bounds, out = buckets.bounds(self.slots), np.zeros(len(buckets.keys), bool)
        for slot, bits in self.answers.get(level, {}).items():
            a, b = bounds[slot], bounds[slot + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a]
        return out

    def _windows(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) for all windows low..high bytes before the places."""
        n = high - low + 1
        row = np.repeat(np.arange(len(at)), n)
        return row, at[row] - low[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))

    def refine(self, rounds: int) -> tuple[Buckets | None, np.ndarray, np.ndarray]:
        """(buckets of a round, starts, ends of what is repeated): the buckets before the last answer, the ranges after it."""
        length, reach = self.length, self.length - self.q
        none = np.zeros(0, np.int64)
        h, at, low, n, doc = anchors(self.data, self.offsets, self.live, length, self.q)
        grams = Buckets(h, self.ids[doc])
        if rounds == GRAM:
            return grams, none, none
        go = np.flatnonzero(self.answered(GRAM, grams)[grams.of])
        at, low, n, doc = at[go], low[go], n[go], doc[go]
        stretches = Buckets(numbers(self.data, low, low + n - 1 + length, length, self.q, self.made), self.ids[doc])
        if rounds == STRETCH:
            return stretches, none, none
        whole = self.answered(STRETCH, stretches)[stretches.of] | (self.ids[doc] > stretches.first[stretches.of])
        # the windows start near..far bytes before their suffix, in two halves
        far, half = at - low, (reach + 2) // 2
        near = far - n + 1
        rows, lows, highs, keys = [], [], [], []
        for k in (0, half):
            top = min(k + half - 1, reach)
            row = np.flatnonzero((near <= top) & (far >= k) & ~whole)
            rows.append(row)
            lows.append(np.maximum(near[row], k))
            highs.append(np.minimum(far[row], top))
            keys.append(mix(numbers(self.data, at[row] - k, at[row] - top + length, length, self.q, self.made) + np.uint64(k)))
        row, lows, highs = np.concatenate(rows), np.concatenate(lows), np.concatenate(highs)
        halves = Buckets(np.concatenate(keys), self.ids[doc[row]])
        if rounds == HALF:
            return halves, none, none
        go = np.flatnonzero(self.answered(HALF, halves)[halves.of])
        some, start = self._windows(at[row[go]], lows[go], highs[go])
        owner = self.ids[doc[row[go][some]]]
        windows = Buckets(numbers(self.data, start, start + length, length, self.q, self.made), owner)
        if rounds == WINDOW:
            return windows, none, none
        single = self.answered(WINDOW, windows)[windows.of] | (owner > windows.first[windows.of])
        starts = np.concatenate([low[whole], start[single]])
        return None, starts, np.concatenate([(low + n - 1)[whole], start[single]]) + length


def _pieces(docs: DataFrame) -> DataFrame:
    """(piece, ids, texts): rows (doc_id, text) in runs of about PIECE_TEXT bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [b for _, b, _, _ in pieces(batch.column(1), PIECE_TEXT, batch.num_rows)]
            bounds = pa.array(np.array([0, *ends], np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, c) for c in batch.columns], ["ids", "texts"])

    return docs.mapInArrow(run, "ids array<bigint>, texts array<string>").select(F.monotonically_increasing_id().alias("piece"), "ids", "texts")


def _each(batches: Iterator[pa.RecordBatch], slots: int, length: int, q: int) -> Iterator[tuple[int, Piece]]:
    for batch in batches:
        for k in range(batch.num_rows):
            answers = batch.column(3)[k].as_py() if batch.num_columns > 3 else None
            yield batch.column(0)[k].as_py(), Piece(batch.column(1)[k].values, batch.column(2)[k].values, answers, slots, length, q)


def _named(rows: DataFrame, rounds: int, slots: int, length: int, q: int) -> DataFrame:
    """(slot, piece, keys, firsts): the buckets of each piece in a round. The last bit of a key says whether
    several documents of the piece are in the bucket; where order counts, firsts has the smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, piece in _each(batches, slots, length, q):
            buckets = piece.refine(rounds)[0]
            bounds = buckets.bounds(slots)
            used = np.flatnonzero(np.diff(bounds))
            ends = pa.array(np.append(bounds[used], bounds[-1]).astype(np.int32))
            keys = buckets.keys & ~np.uint64(1) | buckets.several.astype(np.uint64)
            firsts = pa.ListArray.from_arrays(ends, pa.array(buckets.first)) if rounds in (STRETCH, WINDOW) else pa.nulls(len(used), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), name)), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))), firsts], ["slot", "piece", "keys", "firsts"])

    return rows.mapInArrow(run, "slot int, piece bigint, keys array<bigint>, firsts array<bigint>")


def _sorted_buckets(table: pa.Table) -> pa.Table:
    """A bit for each bucket that each piece named in one slot: whether another document, or a smaller one where order counts, has it."""
    column = table["keys"].combine_chunks()
    sizes = column.value_lengths().to_numpy()
    keys = column.flatten().to_numpy().view(np.uint64)
    order = np.argsort(keys >> np.uint64(1), kind="stable")
    k = keys[order] >> np.uint64(1)
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    n = np.diff(np.append(at, len(k)))
    if table["firsts"].null_count:
        yes = np.repeat((n > 1) | (np.bitwise_or.reduceat(keys[order], at) & np.uint64(1)).astype(bool), n)
    else:
        firsts = table["firsts"].combine_chunks().flatten().to_numpy()[order]
        yes = firsts > np.repeat(np.minimum.reduceat(firsts, at), n)
    bits = np.empty(len(k), bool)
    bits[order] = yes
    packed = [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(sizes)[:-1])]
    return pa.table({"piece": table["piece"], "slot": table["slot"], "bits": pa.array(packed, pa.binary())})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, with_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes.

    Every byte goes that lies in a string of `length` bytes which also starts in
    a document with a smaller id; strings never cross documents, overlaps count,
    and all is judged on the input. Ids are integers. Texts are their UTF-8
    bytes. Null and empty texts, and texts shorter than length, lose nothing.
    Rows with the same id are no smaller than each other, so repeated rows come
    back alike. Rows with a null id take no part and keep all. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = id_and_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are integers here, not {kind}")
    parts = stored(_pieces(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))))
    slots = -(-max(parts.count(), 1) // PIECES_A_SLOT)
    answers, rows = None, parts
    for rounds in (GRAM, STRETCH, HALF, WINDOW):
        named = _named(rows, rounds, slots, length, q)
        judged = stored(named.groupBy("slot").applyInArrow(_sorted_buckets, "piece bigint, slot int, bits binary")).withColumn("level", F.lit(rounds))
        answers = judged if answers is None else answers.unionByName(judged)
        rows = parts.join(answers.groupBy("piece").agg(F.collect_list(F.struct("level", "slot", "bits")).alias("answers")), "piece", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values
                piece = Piece(ids, batch.column(2)[k].values, batch.column(3)[k].as_py(), slots, length, q)
                _, starts, ends = piece.refine(WINDOW + 1)
                size = len(piece.data)
                gone = np.cumsum(np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1))[:-1] > 0
                edge = gone & ~np.append(False, gone[:-1])[:size]
                edge[piece.offsets[:-1][piece.offsets[:-1] < size]] |= gone[piece.offsets[:-1][piece.offsets[:-1] < size]]
                total, spans = (np.concatenate([[0], np.cumsum(v)]) for v in (gone, edge))
                left, cut = piece.data[~gone].tobytes(), piece.offsets - total[piece.offsets]
                bodies = [left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                counts = [np.diff(piece.offsets), np.diff(total[piece.offsets]), np.diff(spans[piece.offsets])]
                out = [ids, *(pa.array(c.astype(np.int64)) for c in counts), pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_bytes:
                    out.append(pa.array(bodies, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(out, names)

    tidy(df.sparkSession)
    judged = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes)
    return judged.withColumn("doc_id", F.col("doc_id").cast(kind))
