"""Line dedup (operator 7): segment-partition edit join.

The threshold grows with the length of the shorter line. Of threshold-plus-one
segments of the shorter line, half are counted from its left end and half from
its right end. Lines within the threshold share at least one segment unchanged,
moved by no more places from that end than there are segments before it: else
every segment would cost an edit. Segments have one length within a class of
line lengths, so a probe needs no guess of the other line's length. Candidates
are verified by a banded bit-parallel edit distance. Lengths, positions and
edits count code points.

Segments and probes travel packed, one row for each run of lines and range of
keys; only those of buckets that hold several lines, one of them by a segment,
become rows. The pairs of a bucket are compared by sketches within a task (an
exact filter), and only who hangs together by them comes out of it: at most one
row a member. The lines that hang together over all buckets are a family; each
sends its text once to where its family is verified, and again what comes out is
one row a line at most. Buckets and families of many lines are cut into parts,
and each two parts meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.linking import components
from rippleframe.llm.tables import BROADCAST_IDS, alone, discard, map_arrow, map_groups, stored, with_ids
from rippleframe.llm.wordbytes import SPACES, Prefix, flat, mix, pieces, signed

#: One edit for so many code points of the shorter line, up to so many.
PER_EDIT, MOST_EDITS = 12, 8
#: Keys are sorted in so many slices of the segments, one after the other, to bound what lies on disk at a time.
SLICES = 4
#: Bytes of text whose lines or keys go into one row a slot; different lines, and keys, of a slot on average.
RUN_BYTES, LINES_A_SLOT, KEYS_A_SLOT = 2 << 20, 50_000, 1_000_000
#: Members of buckets, and lines of families, that meet in one task, on average.
MEMBERS_A_SLOT, TEXTS_A_SLOT = 250_000, 6_000
#: Pairs, and code points of one side, that are verified together; so few that are left are verified one by one.
PAIRS, CELLS, FEW = 4096, 1 << 21, 24
#: Longs of a line's sketch; lines of a family beyond which it is cut into parts, and by how much a bucket may be larger; possible pairs kept at a time.
SKETCH, CROWD, BUCKET, HELD = 4, 2048, 8, 1 << 19
#: Possible pairs that a line has at least if its letters are compared, too.
DENSE = 16
#: Parts of a line between which it is halved to bound edits by letters on both sides.
PARTS = 8


def line_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, number) of the newline-separated lines of each document; an empty text has one."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty(len(starts), np.int64)
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = offsets[1:][doc[last]]
    ends[~last] = starts[1:][~last[:-1]] - 1
    number = np.arange(len(starts)) - np.searchsorted(doc, doc)
    return starts, ends, doc, number


def length_classes(longest: int, edits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(smallest length, threshold) of each class of line lengths; a class is wider than its threshold."""
    low = [(PER_EDIT * t, t) for t in range(1, MOST_EDITS)] if edits is None else []
    top, most = (PER_EDIT * MOST_EDITS, MOST_EDITS) if edits is None else (edits + 1, edits)
    while not low or top <= longest:
        low.append((top, most))
        top += max(top // 4, most + 1)
    return np.array([x for x, _ in low]), np.array([t for _, t in low])


def probes(tau: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, whether from the right, move) of the substrings that stand for tau edits, those of one of about even parts."""
    segments = sorted(((i, side) for side, n in ((0, tau // 2 + 1), (1, tau - tau // 2)) for i in range(n)), reverse=True)
    load = [0] * parts
    own = []
    for i, side in segments:
        to = load.index(min(load))
        load[to] += 2 * i + 1
        own += [(i, side, move) for move in range(-i, i + 1) if to == part]
    return tuple(np.array([x[c] for x in own], np.int64) for c in range(3))


def segment_keys(data: np.ndarray, offsets: np.ndarray, edits: int | None, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, keys, indexed): bucket keys of the substrings each line probes with; indexed are those of its own segments."""
    prefix = Prefix(data)
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of each code point
    starts = np.searchsorted(place, offsets)
    length = np.diff(starts)
    base, tau = length_classes(int(length.max(initial=0)), edits)
    own = np.searchsorted(base, length, "right") - 1
    # the shorter line of a pair may be of the class below
    below = np.flatnonzero((own > 0) & (length < base[own] + tau[own - 1]))
    line = np.concatenate([np.flatnonzero(own >= 0), below])
    k = np.concatenate([own[own >= 0], own[below] - 1])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))]
    for t in np.unique(tau[k]):
        rows = np.flatnonzero(tau[k] == t)
        i, right, move = probes(int(t), part, parts)
        size = (base[k[rows]] // (t + 1))[:, None]
        at = np.where(right, length[line[rows]][:, None] - (i + 1) * size, i * size) + move
        fits = (at >= 0) & (at + size <= length[line[rows]][:, None])
        kind = mix((k[rows][:, None] * 64 + i * 2 + right).astype(np.uint64))
        s = (starts[line[rows]][:, None] + at)[fits]
        keys = mix(prefix.sum(place[s], place[s + np.broadcast_to(size, at.shape)[fits]]) ^ kind[fits])
        indexed = (own[line[rows]] == k[rows])[:, None] & (move == 0)
        found.append((np.broadcast_to(line[rows][:, None], at.shape)[fits], keys, indexed[fits]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def within(a: Sequence, b: Sequence, edits: int) -> bool:
    """Whether the edit distance is at most `edits`.

    Bit o of a level says that i = j + o - edits code points of a can stand against j
    of b with so many edits: a band of 2 * edits + 1 diagonals.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n, m = 0, min(len(a), len(b))
    while n < m and a[n] == b[n]:
        n += 1
    e = 0
    while e < m - n and a[len(a) - 1 - e] == b[len(b) - 1 - e]:
        e += 1
    a, b = a[n : len(a) - e], b[n : len(b) - e]
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << (2 * edits + 1)) - 1
    level = [(1 << (edits + e + 1)) - (1 << edits) for e in range(edits + 1)]
    for j, c in enumerate(b):
        same = places.get(c, 0)
        same = (same >> (j - edits) if j >= edits else same << (edits - j)) & full
        now = [level[0] & same]
        for e in range(1, edits + 1):
            now.append((level[e] & same | level[e - 1] | level[e - 1] >> 1 | now[e - 1] << 1) & full)
        if not any(now):
            return False
        level = now
    return bool(level[edits] >> (len(a) - len(b) + edits) & 1)


def all_within(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], edits: np.ndarray) -> np.ndarray:
    """within() of many pairs at a time: a and b hold (code points, offsets) of the lines, edits the most edits of each pair."""
    band = int(edits.max(initial=0))
    n_a, n_b = np.diff(a[1]), np.diff(b[1])
    out = np.zeros(len(edits), bool)
    order = np.flatnonzero(np.abs(n_a - n_b) <= edits)
    order = order[np.argsort(n_b[order], kind="stable")]
    while len(order):
        n = min(len(order), PAIRS)
        while n > 1 and n * n_b[order[n - 1]] > CELLS:
            n //= 2
        rows, order = order[:n], order[n:]
        columns = int(n_b[rows].max())
        grids = []
        for (points, offsets), size, shift, blank in ((a, n_a, band, 0xFFFFFFFF), (b, n_b, 0, 0xFFFFFFFE)):
            grid = np.full((columns + 2 * band + 1, n), blank, np.uint32)
            own = np.repeat(np.arange(n), size[rows])
            place = np.arange(len(own)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
            grid[place + shift, own] = points[offsets[rows][own] + place]
            grids.append(grid)
        x, y = grids
        full, places = np.uint32((1 << (2 * band + 1)) - 1), np.float32(2) ** np.arange(2 * band + 1, dtype=np.float32)
        level = np.array([[(1 << (band + e + 1)) - (1 << band)] for e in range(band + 1)], np.uint32).repeat(n, axis=1)
        ends, pair = n_b[rows], rows
        for j in range(columns + 1):
            done = np.searchsorted(ends, j, "right")
            if done:  # the shortest come first
                p = pair[:done]
                out[p] = level[edits[p], np.arange(done)] >> (n_a[p] - n_b[p] + band).astype(np.uint32) & 1
                x, y, level, ends, pair = x[:, done:], y[:, done:], level[:, done:], ends[done:], pair[done:]
            if j % 32 == 31:  # those beyond their edits leave the grid
                keep = np.flatnonzero(level[band])
                if len(keep) < 0.8 * len(pair):
                    x, y, level, ends, pair = x[:, keep], y[:, keep], level[:, keep], ends[keep], pair[keep]
            if len(pair) <= FEW:
                for p in pair:
                    out[p] = within(*(tuple(v[o[p] : o[p + 1]].tolist()) for v, o in (a, b)), int(edits[p]))
                break
            same = (places @ (x[j : j + 2 * band + 1] == y[j]).astype(np.float32)).astype(np.uint32)
            now = level & same
            now[1:] |= level[:-1]
            now[1:] |= level[:-1] >> np.uint32(1)
            for e in range(1, band + 1):
                now[e] |= now[e - 1] << np.uint32(1)
            level = now & full
    return out


def _slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots in use, where each begins among the sorted hashes h; the end is added): even ranges of hashes."""
    edges = np.array([(j << 64) // slots for j in range(1, slots)], np.uint64)
    bounds = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
    used = np.flatnonzero(np.diff(bounds))
    return used, np.append(bounds[used], len(h)).astype(np.int32)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, id) of the lines with a word of rows (doc_id, th, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                starts, ends, doc, number = line_ranges(data, offsets)
                inked = np.concatenate([[0], np.cumsum(~SPACES[data])])
                use = np.flatnonzero(inked[ends] > inked[starts])
                ids = Prefix(data).of(starts[use], ends[use])
                rows = pa.array(a + doc[use])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[use].astype(np.int32)), signed(ids)], ["doc_id", "th", "line", "id"])

    return map_arrow(docs.select("doc_id", "th", "text"), run, f"doc_id {kind}, th bigint, line int, id bigint")


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values, one binary for each range of bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def line_texts(docs: DataFrame, slots: int) -> DataFrame:
    """(id, n, body) of the different lines with a word of rows (doc_id, th, text); n of them are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(2), RUN_BYTES):
                starts, ends, _, _ = line_ranges(data, offsets)
                inked = np.concatenate([[0], np.cumsum(~SPACES[data])])
                use = np.flatnonzero(inked[ends] > inked[starts])
                found, first, n = np.unique(Prefix(data).of(starts[use], ends[use]), return_index=True, return_counts=True)
                starts, ends = starts[use[first]], ends[use[first]]
                used, bounds = _slots(found, slots)
                places = np.concatenate([[0], np.cumsum(ends - starts)])
                bodies = data[np.repeat(starts - places[:-1], ends - starts) + np.arange(places[-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), *(_packed(v, bounds) for v in (found, n.astype(np.int32), (ends - starts).astype(np.int32))), _packed(bodies, places[bounds])],
                    ["slot", "ids", "ns", "sizes", "bodies"],
                )

    def once(table: pa.Table) -> pa.Table:
        ids, first, own = np.unique(_unpacked(table["ids"], np.int64), return_index=True, return_inverse=True)
        n = np.bincount(own, _unpacked(table["ns"], np.int32), len(ids)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(_unpacked(table["sizes"], np.int32), dtype=np.int64)])
        bodies = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(table["bodies"].to_pylist()))])
        return pa.table({"id": ids, "n": n, "body": bodies.take(pa.array(first)).cast(pa.binary())})

    rows = map_arrow(docs.select("doc_id", "th", "text"), run, "slot int, ids binary, ns binary, sizes binary, bodies binary")
    return map_groups(rows.groupBy("slot"), once, "id bigint, n bigint, body binary")


def bucket_members(texts: DataFrame, edits: int | None, slots: int, part: int, parts: int, crowd: int) -> DataFrame:
    """(key, no) of lines (no, body) in the buckets of one slice that hold several lines, one of them by its own segment.

    A bucket of more than `crowd` lines is cut: any two of its parts make a bucket. Lines with
    neighbouring numbers should come one after the other: then a key takes six bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for a, b, data, offsets in pieces(batch.column(1), RUN_BYTES, rows=batch.num_rows):
                line, keys, indexed = segment_keys(data, offsets, edits, part, parts)
                slot = (keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
                low = (keys & np.uint64(0xFFFFFFFE) | indexed.astype(np.uint64)).astype(np.uint32)  # the last bit tells segments from probes
                place = numbers[a:b] - numbers[a]
                for high in np.unique(place >> 16):
                    use = np.flatnonzero((place >> 16)[line] == high)
                    use = use[np.argsort(slot[use].astype(np.uint16 if slots < 1 << 16 else np.uint64), kind="stable")]
                    bounds = np.flatnonzero(np.append(True, slot[use][1:] != slot[use][:-1])) if len(use) else np.zeros(0, np.int64)
                    ends = np.append(bounds, len(use))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot[use[bounds]].astype(np.int32)), pa.array(np.full(len(bounds), numbers[a] + (high << 16))), _packed(low[use], ends), _packed((place[line[use]] & 0xFFFF).astype(np.uint16), ends)],
                        ["slot", "first", "keys", "places"],
                    )

    def shared(slot: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = _unpacked(table["keys"], np.uint32)
        n = pc.binary_length(table["keys"]).to_numpy() // 4
        no = np.repeat(table["first"].to_numpy(), n) + _unpacked(table["places"], np.uint16)
        order = np.argsort(keys)
        k = keys[order] >> np.uint32(1)
        same = k[1:] == k[:-1]
        order = order[np.append(False, same) | np.append(same, False)]
        k, no, anchor = keys[order] >> np.uint32(1), no[order], (keys[order] & 1).astype(bool)
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
        if len(at):
            kept = np.repeat((np.minimum.reduceat(no, at) < np.maximum.reduceat(no, at)) & np.logical_or.reduceat(anchor, at), np.diff(np.append(at, len(k))))
            k, no = k[kept], no[kept]
            order = np.lexsort((no, k))
            k, no = k[order], no[order]
            new = np.append(True, (k[1:] != k[:-1]) | (no[1:] != no[:-1]))[: len(k)]
            k, no = k[new], no[new]
        key = mix(np.uint64(slot[0].as_py()) << np.uint64(31) | k.astype(np.uint64))
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
        lines = np.diff(np.append(at, len(k)))
        large = np.flatnonzero(lines > crowd)
        out = [(key, no)] if not len(large) else [(key[x], no[x]) for x in [np.repeat(lines <= crowd, lines)]]
        for x in large:
            own = no[at[x] : at[x] + lines[x]]
            cut = np.array_split(own, -(-2 * len(own) // max(crowd, 2)))
            for i in range(len(cut)):
                for j in range(i):
                    both = np.concatenate([cut[i], cut[j]])
                    out.append((np.full(len(both), mix(key[at[x] : at[x] + 1] ^ np.uint64(i << 32 | j + 1))[0]), both))
        key, no = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"key": signed(key), "no": no})

    rows = map_arrow(texts.select("no", "body"), run, "slot int, first bigint, keys binary, places binary")
    return map_groups(rows.groupBy("slot"), shared, "key bigint, no bigint")


def pairs_of_buckets(members: DataFrame, edits: int | None, slots: int) -> DataFrame:
    """(a, b), a < b, of members (key, id, traits) that share a bucket, where their traits leave it possible that they are within the threshold.

    All pairs of a bucket are compared, so buckets are to be small.
    """
    columns = ["size", *(f"s{k}" for k in range(SKETCH))]

    def run(table: pa.Table) -> pa.Table:
        key, ids, size, *sketch = (table[c].to_numpy() for c in ("key", "id", *columns))
        sketch = [s.view(np.uint64) for s in sketch]  # bits of negative numbers would be counted of their size
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        lines = np.diff(np.append(starts, len(key)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in np.unique(lines[lines > 1]):
            i, j = np.triu_indices(n, 1)
            first, step = starts[lines == n], max(1, CELLS // len(i))
            for k in range(0, len(first), step):
                x, y = (order[first[k : k + step, None] + side].ravel() for side in (i, j))
                most = np.minimum(np.minimum(size[x], size[y]) // PER_EDIT, MOST_EDITS) if edits is None else edits
                apart = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in sketch)
                keep = (np.abs(size[x] - size[y]) <= most) & (apart <= 4 * most)
                found.append((ids[x[keep]], ids[y[keep]]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}).group_by(["a", "b"]).aggregate([])

    rows = members.select(F.pmod("key", F.lit(slots)).alias("slot"), "key", "id", "traits.*")
    return map_groups(rows.groupBy("slot"), run, "a bigint, b bigint").distinct()


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, line of each) of a run of lines."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    return points, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))


def line_sketches(points: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bits) of a run of lines: each bit is the parity of the pairs of neighbours that fall to it. An edit
    changes at most four pairs."""
    pairs = np.flatnonzero(line[1:] == line[:-1])
    bit = (mix(points[pairs].astype(np.uint64) << np.uint64(32) | points[pairs + 1]) >> np.uint64(32)) % np.uint64(64 * SKETCH)
    flips = np.bincount(line[pairs] * (64 * SKETCH) + bit.astype(np.int64), minlength=lines * 64 * SKETCH) % 2
    return np.bincount(line, minlength=lines), np.packbits(flips.astype(np.uint8).reshape(lines, -1), axis=1).view(np.uint64)


def line_traits(texts: DataFrame) -> DataFrame:
    """(no, id, size, s0, s1, ...) of lines (no, id, body): their line_sketches()."""
    columns = ["size", *(f"s{k}" for k in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                size, sketch = line_sketches(*_code_points(data, offsets), b - a)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(size), *(signed(sketch[:, k].copy()) for k in range(SKETCH))], ["no", "id", *columns])

    return map_arrow(texts.select("no", "id", "body"), run, "no bigint, id bigint, " + ", ".join(f"{c} bigint" for c in columns))


def _allowed(shorter: np.ndarray, edits: int | None) -> np.ndarray:
    return np.minimum(shorter // PER_EDIT, MOST_EDITS) if edits is None else np.full(shorter.shape, edits)


def _possible(size: tuple[np.ndarray, np.ndarray], sketch: tuple[np.ndarray, np.ndarray], edits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(whether length and sketch leave two lines possible, bits that differ) of the lines on both sides, which may be crossed."""
    most = _allowed(np.minimum(*size), edits)
    apart = sum(np.bitwise_count(sketch[0][..., k] ^ sketch[1][..., k]).astype(np.int16) for k in range(SKETCH))
    return (np.abs(size[0] - size[1]) <= most) & (apart <= 4 * most), apart


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the own number of one of its group) after the links a, b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_]))
        while (label != label[label]).any():
            label = label[label]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return at, np.diff(np.append(at, len(values)))


def _pairs_of_runs(starts: np.ndarray, lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of the same run, so many at a time that memory is bounded."""
    for n in np.unique(lines[lines > 1]):
        own, rows = starts[lines == n], max(1, HELD // int(n))
        for r in range(0, int(n), rows):
            i = np.arange(r, min(int(n), r + rows))
            i, j = (c.ravel() for c in np.broadcast_arrays(i[:, None], np.arange(n)))
            i, j = i[i < j], j[i < j]
            step = max(1, HELD // max(1, len(i)))
            for k in range(0, len(own), step):
                yield (own[k : k + step, None] + i).ravel(), (own[k : k + step, None] + j).ravel()


def _spanning(ids: np.ndarray, label: np.ndarray) -> pa.Table:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": ids[label[moved]], "b": ids[moved]})


#: Lines of a bucket beyond which those that hang together are looked for one after the other.
WIDE = 128


def families(members: DataFrame, edits: int | None, slots: int) -> DataFrame:
    """Links (a, b) by which all members (key, id, size, s0, ...) hang together that share a bucket and are possible pairs
    by length and sketch, directly or in chains: at most one for each line and slot, however many pairs there are."""

    def run(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        starts, lines = _runs(key[order])
        size, sketch = table["size"].to_numpy()[order].astype(np.int32), np.stack([table[f"s{k}"].to_numpy()[order].view(np.uint64) for k in range(SKETCH)], 1)
        ids, own = np.unique(table["id"].to_numpy()[order], return_inverse=True)
        label = np.arange(len(ids))
        few = lines <= WIDE
        for x, y in _pairs_of_runs(starts[few], lines[few]):
            near = _possible((size[x], size[y]), (sketch[x], sketch[y]), edits)[0]
            label = _merged(label, own[x[near]], own[y[near]])
        for start, n in zip(starts[~few], lines[~few], strict=True):
            rest = np.arange(start, start + n)
            while len(rest) > 1:
                front, rest, links = rest[:1], rest[1:], []
                while len(front) and len(rest):
                    now = max(1, HELD // len(rest))
                    now, front = front[:now], front[now:]
                    near = _possible((size[now][:, None], size[rest]), (sketch[now][:, None], sketch[rest]), edits)[0]
                    met = near.any(0)
                    links.append((now[near[:, met].argmax(0)], rest[met]))
                    front, rest = np.concatenate([front, rest[met]]), rest[~met]
                if links:
                    x, y = (np.concatenate(c) for c in zip(*links, strict=True))
                    label = _merged(label, own[x], own[y])
        return _spanning(ids, label)

    rows = members.select(F.pmod("key", F.lit(slots)).alias("slot"), "key", "id", "size", *(f"s{k}" for k in range(SKETCH)))
    return map_groups(rows.groupBy("slot"), run, "a bigint, b bigint")


def verified(lines: DataFrame, edits: int | None, slots: int) -> DataFrame:
    """Links (a, b) by which all lines (tile, side, id, body) hang together that share a tile and are within the threshold:
    at most one for each line and slot. Sides tell lines that do not meet here with those of their own; -1 meets all."""

    def run(table: pa.Table) -> pa.Table:
        tile = table["tile"].to_numpy()
        order = np.argsort(tile, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        side, (ids, own) = table["side"].to_numpy(), np.unique(table["id"].to_numpy(), return_inverse=True)
        parts = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((0, SKETCH), np.uint64))]
        for body in table["body"].chunks:
            for a, b, data, offsets in pieces(body):
                points, line = _code_points(data, offsets)
                parts.append((points, *line_sketches(points, line, b - a)))
        points, size, sketch = (np.concatenate(c) for c in zip(*parts, strict=True))
        offsets = np.concatenate([[0], np.cumsum(size)])

        def picked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ends = np.concatenate([[0], np.cumsum(size[rows])])
            return points[np.repeat(offsets[rows] - ends[:-1], size[rows]) + np.arange(ends[-1])], ends

        def compared(label: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> np.ndarray:
            x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
            most = _allowed(np.minimum(size[x], size[y]), edits)
            pairs = np.bincount(np.concatenate([x, y]), minlength=len(size))
            dense = np.flatnonzero((pairs[x] > DENSE) & (pairs[y] > DENSE))
            if len(dense):
                rows, at = np.unique(np.concatenate([x[dense], y[dense]]), return_inverse=True)
                letters = [letter_sketches(p, np.repeat(np.arange(len(e) - 1), np.diff(e)), len(e) - 1, edits) for p, e in (picked(rows[k : k + PAIRS // 4]) for k in range(0, len(rows), PAIRS // 4))]
                base, bits = (np.concatenate(c) for c in zip(*letters, strict=True))
                bits = bits.view(np.uint64)  # bits of negative numbers would be counted of their size
                i, j = at[: len(dense)], at[len(dense) :]
                far = np.zeros(len(dense), bool)
                for k in range(0, bits.shape[1], 2 * SKETCH):
                    far |= sum(np.bitwise_count(bits[i, z] ^ bits[j, z]).astype(np.int16) for z in range(k, k + 2 * SKETCH)) > 2 * most[dense]
                keep = np.ones(len(x), bool)
                keep[dense[far & (base[i] == base[j])]] = False
                x, y, apart, most = x[keep], y[keep], apart[keep], most[keep]
            order = np.argsort(apart, kind="stable")  # the likeliest links come first: what they connect needs no more
            for k in range(0, len(order), PAIRS):
                p = order[k : k + PAIRS]
                p = p[label[own[x[p]]] != label[own[y[p]]]]
                p = p[all_within(picked(x[p]), picked(y[p]), most[p])]
                label = _merged(label, own[x[p]], own[y[p]])
            return label

        label, found, held = np.arange(len(ids)), [], 0
        for x, y in _pairs_of_runs(*_runs(tile[order])):
            meet = (side[x] != side[y]) | (side[x] < 0)
            x, y = x[meet], y[meet]
            near, apart = _possible((size[x], size[y]), (sketch[x], sketch[y]), edits)
            found.append((x[near], y[near], apart[near]))
            held += int(near.sum())
            if held > HELD:
                label, found, held = compared(label, found), [], 0
        return _spanning(ids, compared(label, found) if held else label)

    rows = lines.select(F.pmod("tile", F.lit(slots)).alias("slot"), "tile", "side", "id", "body")
    return map_groups(rows.groupBy("slot"), run, "a bigint, b bigint")


def tiles(labels: DataFrame, crowd: int) -> DataFrame:
    """(id, tile, side) of lines (id, label): a label is a tile; those of more than `crowd` lines are cut into parts, any two of which, and each alone, make one."""
    large = labels.groupBy("label").count().filter(F.col("count") > crowd).select("label", F.ceil(2 * F.col("count") / max(crowd, 2)).cast("int").alias("parts"))
    cut = labels.join(F.broadcast(large), "label", "left").select("id", "label", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("own"))
    each = cut.select("id", "label", "own", F.explode(F.expr("if(parts is null, array(-1), sequence(0, parts - 1))")).alias("other"))
    alone_ = (F.col("other") < 0) | (F.col("other") == F.col("own"))
    return each.select("id", F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), F.when(alone_, -1).otherwise(F.col("own")).alias("side"))


def letter_sketches(points: np.ndarray, line: np.ndarray, lines: int, edits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(base, sketches) of a run of lines: the smallest length of their class, and for each of PARTS - 1 places k below
    it the parities of the first k code points and of the last base - k.

    A code point counts with the number of equal ones before it (behind it, from the right), so two sketches differ in
    at most as many bits as the counts of letters of those k code points differ. If a prefix of k is aligned with one
    of k + d, the d letters more or less make up for as many that differ at most on one side, so its edits are half of
    that at least, and so are those of the suffix; both do not overlap, and their edits add up.
    """
    size = np.bincount(line, minlength=lines)
    low, _ = length_classes(int(size.max(initial=0)), edits)
    own = np.searchsorted(low, size, "right") - 1
    base = np.where(own >= 0, low[own], 0)
    first = np.cumsum(size) - size
    place = np.arange(len(points)) - first[line]
    order = np.lexsort((place, points, line))
    new = np.append(True, (points[order][1:] != points[order][:-1]) | (line[order][1:] != line[order][:-1]))[: len(points)]
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(points)))
    before = np.empty(len(points), np.int64)
    before[order] = np.arange(len(points)) - np.repeat(starts, count)
    behind = np.empty(len(points), np.int64)
    behind[order] = np.repeat(count, count) - 1 - before[order]
    bits, out = 64 * SKETCH, []
    for part in range(1, PARTS):
        k = base * part // PARTS
        for number, at, most in ((before, place, k), (behind, size[line] - 1 - place, base - k)):
            use = np.flatnonzero(at < most[line])
            bit = (mix(points[use].astype(np.uint64) << np.uint64(32) | number[use].astype(np.uint64)) >> np.uint64(32)) % np.uint64(bits)
            flips = np.bincount(line[use] * bits + bit.astype(np.int64), minlength=lines * bits) % 2
            out.append(np.packbits(flips.astype(np.uint8).reshape(lines, bits), axis=1).view(np.int64).reshape(lines, SKETCH))
    return base, np.concatenate(out, axis=1)


def paired_lines(texts: DataFrame, pairs: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Lines (id, body) that stand in the stored pairs (a, b): up to `most` ids are sent to the tasks, so that no other line is shuffled."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return texts.join(F.broadcast(ends) if 2 * pairs.count() <= most else ends, "id", "left_semi")


def line_classes(texts: DataFrame, edits: int | None, crowd: int = CROWD) -> DataFrame:
    """(id, label) of the stored lines (no, id, body; numbered here if no is absent) that have another one within the threshold, by links or chains of links. The lines are deleted."""
    if "no" not in texts.columns:
        texts, given = stored(texts.select(F.monotonically_increasing_id().alias("no"), "id", "body")), texts
        discard(given)
    slots = -(-max(texts.count(), 1) * 45 // (SLICES * KEYS_A_SLOT))  # about 45 keys a line
    members = None
    for part in range(SLICES):
        mine = stored(bucket_members(texts, edits, slots, part, SLICES, BUCKET * crowd))
        members = mine if members is None else members.unionByName(mine)
    near = stored(with_ids(texts, stored(members.select("no").distinct()), "no"))
    discard(texts)
    met = families(members.join(line_traits(near), "no"), edits, -(-max(members.count(), 1) // MEMBERS_A_SLOT))
    lines = stored(tiles(components(met), crowd))
    links = verified(near.join(lines, "id"), edits, -(-max(lines.count(), 1) // TEXTS_A_SLOT))
    return components(links)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (without the removed lines) and the columns named in keep.

    Lines with a word fall into classes: equal lines, and lines linked by at most
    `edits` edits (only lines longer than that link); by default by one edit for every
    PER_EDIT code points of the shorter line, up to MOST_EDITS, so lines under PER_EDIT
    code points have only equal ones. Of a class the
    line with the smallest (doc_id, line number) stays and all others are
    removed; lines without a word stay.
    A null or empty text has one empty line and loses nothing, the null comes
    back as empty. Repeated equal rows count as one document and come back
    alike; rows with a null id take no part and keep their text. Other columns
    are ignored; an empty table gives an empty result. Lines are told apart by
    64-bit hashes.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)]
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), *kept)
    known = docs.select("doc_id", "text", "th").filter("doc_id is not null")
    lines = stored(occurrences(known))
    texts = stored(line_texts(known, -(-max(lines.count(), 1) // LINES_A_SLOT)).withColumn("no", F.monotonically_increasing_id()))
    repeated = stored(texts.filter("n > 1").select("id"))
    groups = alone(lambda: line_classes(texts, edits))

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_IDS // 4 else rows

    labels = stored(repeated.join(groups, "id", "full").select("id", F.coalesce("label", "id").alias("label")))
    for done in (groups, repeated):
        discard(done)
    own = lines.join(sent(labels), "id").select("label", F.struct("doc_id", "th", "line").alias("at"))
    first = stored(own.groupBy("label").agg(F.min("at").alias("stays")))
    gone = own.join(sent(first), "label").filter(F.col("at") != F.col("stays"))
    gone = gone.groupBy("at.doc_id", "at.th").agg(F.sort_array(F.collect_set("at.line")).alias("gone"))
    joined = docs.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "gone", *[f"kept_{k}" for k in range(len(keep))])
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [(c, df.schema[c].dataType.simpleString()) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_removed, texts = [], [], []
            for text, out in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n_lines.append(text.count("\n") + 1)
                n_removed.append(len(out or ()))
                if out:
                    drop = set(out)
                    text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in drop])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string()), *batch.columns[3:]], ["doc_id", "n_lines", "n_removed", "text", *keep])

    return map_arrow(joined, run, f"doc_id {kind}, n_lines bigint, n_removed bigint, text string" + "".join(f", `{c}` {k}" for c, k in more))
