"""Benchmark decontamination (operator 2): template canonicalisation and slot consistency.

Words become a template: numbers, units after a number and names inside a
sentence turn into typed placeholders, other words lose case and outer
punctuation. Hashes of template windows of five words join documents with
benchmark items; a window of placeholders alone says nothing, so it counts by
its values. An item counts as leaked into a document if at least 80 % of its
distinct windows occur there and the slots behind the placeholders map one to
one between the two texts, over the whole document or in any one place that has
so many of the windows: a question that only got other numbers or names is still
caught, a text that merely shares a form is not.

Of n windows a leak lacks at most a fifth, so it has one of any fifth of them and
one more. Those that the fewest items have are joined with the windows of all
documents; the pairs that meet are then verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.tables import id_and_text, map_arrow, stored
from rippleframe.llm.wordbytes import LOWERCASE, UPPER, Prefix, byte_table, chained, flat, lowered, mix, pieces, signed, word_ranges

WORDS, PERCENT = 5, 80
#: Hashes of item windows that the tasks may carry (8 MB); more are joined by shuffle.
CARRIED = 1_000_000
#: Share of the slots that may break the mapping, in percent.
SLOT_SLACK = 10
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "hour", "days", "day", "years", "year", "minutes", "seconds", "meters", "metres", "miles", "mile", "feet", "inches", "pounds", "dollars", "euros", "percent", "degrees", "mph", "kph", "hz", "kw", "w", "v", "j", "n")
_DIGIT = byte_table(b"0123456789")
_NUMERIC = byte_table(b"0123456789.,:/%+-$()" + "€£".encode())
_NEWLINE = byte_table(b"\n")
_END = byte_table(b".!?")
_OUTER = byte_table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
NUMBER, UNIT, NAME = (np.uint64(k) for k in (0xA11CE0001, 0xA11CE0002, 0xA11CE0003))


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    data, offsets = flat(pa.array(words, pa.string()))
    return np.sort(Prefix(data).of(offsets[:-1], offsets[1:]))


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, value hash, placeholder, document) of every word; placeholder 0 is none."""
    starts, ends, doc = word_ranges(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, none, doc
    total = lambda table: np.concatenate([[0], np.cumsum(table[data])])
    digits, numeric, newlines = total(_DIGIT), total(_NUMERIC), total(_NEWLINE)
    has_digit = digits[ends] > digits[starts]
    number = has_digit & (numeric[ends] - numeric[starts] == ends - starts)
    inner_start, inner_end = starts.copy(), ends.copy()
    for _ in range(3):  # outer punctuation, up to three characters a side
        inner_start += (inner_start < inner_end) & _OUTER[data[np.minimum(inner_start, len(data) - 1)]]
        inner_end -= (inner_end > inner_start) & _OUTER[data[inner_end - 1]]
    value = Prefix(lowered(data)).of(inner_start, inner_end)
    first = np.ones(len(starts), bool)
    first[1:] = (doc[1:] != doc[:-1]) | _END[data[ends[:-1] - 1]] | (newlines[starts[1:]] > newlines[starts[:-1]])
    last = len(data) - 1
    name = ~first & ~has_digit & (inner_end > inner_start + 1) & UPPER[data[np.minimum(inner_start, last)]] & LOWERCASE[data[np.minimum(inner_start + 1, last)]]
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = after_number & np.isin(value, _hash_of(UNITS)) & ~number
    kind = np.zeros(len(starts), np.uint64)
    kind[name], kind[unit], kind[number] = NAME, UNIT, NUMBER
    return np.where(kind > 0, mix(kind), value), value, kind, doc


def windows(form: np.ndarray, value: np.ndarray, kind: np.ndarray, doc: np.ndarray, docs: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of template windows; a text of fewer words has one, of all its words."""
    count = np.bincount(doc, minlength=docs)
    found = []
    for k in range(1, words + 1):
        if k < words and not (count == k).any():
            continue
        at, h = chained(form, doc, k)
        literal = np.concatenate([[0], np.cumsum(kind == 0)])
        plain = np.flatnonzero(literal[at + k] == literal[at])
        h[plain] = mix(chained(value, doc, k)[1][plain] + np.uint64(words))
        if k < words:
            short = count[doc[at]] == k
            at, h = at[short], mix(h[short] + np.uint64(k))
        found.append((at, h))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Text:
    """Template, windows and slots of one text."""

    def __init__(self, text: str, words: int):
        data, offsets = flat(pa.array([text], pa.string()))
        form, self.value, self.kind, doc = templates(data, offsets)
        self.at, self.hash = windows(form, self.value, self.kind, doc, 1, words)
        self.order = np.argsort(self.hash, kind="stable")
        self.sorted = self.hash[self.order]
        self.words = min(words, len(self.kind))


def _slots(doc: Text, item: Text, here: np.ndarray, pos: np.ndarray, centre: int | None = None) -> tuple[int, int, int]:
    """(slots, slots against the mapping, slots with another value) under agreeing windows.

    Each slot of the item is read where the document has it next to the
    diagonal centre, without one where it has it first.
    """
    a = (here[:, None] + np.arange(item.words)).ravel()
    b = (pos[:, None] + np.arange(item.words)).ravel()
    same = (doc.kind[a] > 0) & (doc.kind[a] == item.kind[b])
    a, b = a[same], b[same]
    if not len(a):
        return 0, 0, 0
    order = np.lexsort((a if centre is None else np.abs(a - b - centre), b))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    theirs, ours = item.value[b[first]], doc.value[a[first]]
    broken = 0
    for x, y in ((theirs, ours), (ours, theirs)):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        starts = np.append(True, x[1:] != x[:-1])
        broken = max(broken, int((starts | np.append(True, y[1:] != y[:-1])).sum() - starts.sum()))
    return len(first), broken, int((theirs != ours).sum())


def leak(doc: Text, item: Text, percent: int, slack: int) -> tuple[int, int, int, int] | None:
    """(windows found, windows, slots, changed slots) if the item leaked into the document."""
    distinct, first = np.unique(item.hash, return_index=True)
    low, high = np.searchsorted(doc.sorted, distinct, "left"), np.searchsorted(doc.sorted, distinct, "right")
    found = int((high > low).sum())
    if not found or 100 * found < percent * len(distinct):
        return None
    # every window of the item where the document has it first
    place = np.searchsorted(doc.sorted, item.hash, "left")
    has = np.flatnonzero(np.append(doc.sorted, 0)[place] == item.hash)
    has = has[place[has] < len(doc.sorted)]
    n_slots, broken, changed = _slots(doc, item, doc.at[doc.order[place[has]]], item.at[has])
    if 100 * broken <= slack * n_slots:
        return found, len(distinct), n_slots, changed
    # every place of each different window, as diagonals (document word minus item word)
    n = high - low
    here = doc.at[doc.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]]
    pos, key = np.repeat(item.at[first], n), np.repeat(distinct, n)
    order = np.argsort(here - pos, kind="stable")
    here, pos, key = here[order], pos[order], key[order]
    centres, size = np.unique(here - pos, return_counts=True)
    reach = max(item.words, len(item.kind) // 4)
    low, high = np.searchsorted(here - pos, centres - reach, "left"), np.searchsorted(here - pos, centres + reach, "right")
    for k in np.argsort(-size, kind="stable"):
        needed = percent * len(distinct)
        if 100 * (high[k] - low[k]) < needed or 100 * len(np.unique(key[low[k] : high[k]])) < needed:
            continue
        # all windows of the item against that stretch of the document
        near = np.flatnonzero((doc.at >= centres[k] - reach) & (doc.at <= centres[k] + reach + len(item.kind)))
        near = near[np.argsort(doc.hash[near], kind="stable")]
        a, b = np.searchsorted(doc.hash[near], item.hash, "left"), np.searchsorted(doc.hash[near], item.hash, "right")
        m = b - a
        i, j = doc.at[near[np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum())]], np.repeat(item.at, m)
        band = np.abs(i - j - centres[k]) <= reach
        n_slots, broken, changed = _slots(doc, item, i[band], j[band], int(centres[k]))
        if 100 * broken <= slack * n_slots:
            return found, len(distinct), n_slots, changed
    return None


def _item_windows(items: DataFrame, words: int) -> DataFrame:
    """(item, h) of the distinct windows of rows (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                form, value, kind, item = templates(data, offsets)
                at, h = windows(form, value, kind, item, b - a, words)
                first = np.unique(mix(h ^ mix(item[at].astype(np.uint64))), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(item[at[first]])), signed(h[first])], ["item", "h"])

    return map_arrow(items.select("item", "text"), run, "item bigint, h bigint")


def _hits(docs: DataFrame, wanted: DataFrame, words: int, carried: int) -> DataFrame:
    """(th, h) of the windows of rows (th, text) that are among the stored wanted (h); repeats within a text are left in."""
    known = np.sort(np.array([r[0] for r in wanted.collect()], np.int64).view(np.uint64)) if wanted.count() <= carried else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                form, value, kind, doc = templates(data, offsets)
                at, h = windows(form, value, kind, doc, b - a, words)
                if known is not None:
                    place = np.searchsorted(known, h)
                    mine = np.flatnonzero(np.append(known, 0)[place] == h)
                    mine = mine[place[mine] < len(known)]
                    at, h = at[mine], h[mine]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc[at])), signed(h)], ["th", "h"])

    hits = map_arrow(docs.select("th", "text"), run, "th bigint, h bigint")
    return hits if known is not None else hits.join(wanted, "h", "left_semi")


LEAKS = "n_found int, n_windows int, n_slots int, n_changed int"


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, percent: int = PERCENT, slack: int = SLOT_SLACK, carried: int = CARRIED) -> DataFrame:
    """One row (doc_id, item_id, n_found, n_windows, n_slots, n_changed) for each item that leaked into a document.

    Null and empty documents and items without words leak nothing; an item of
    fewer words than a window leaked into a document of just that template. A
    repeated document row gives its rows again, an item id given twice counts as
    two items. Null ids stay null, other columns are ignored, empty tables give
    an empty result. Texts are told apart by 64-bit hashes.
    """
    docs = id_and_text(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    items = id_and_text(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id").filter(F.trim("text") != "")
    items = stored(items.withColumn("item", F.monotonically_increasing_id()))
    every = stored(_item_windows(items, words))
    often = every.groupBy("h").agg(F.count("*").alias("items"))
    own = Window.partitionBy("item")
    ranked = every.join(often, "h").select("item", "h", F.row_number().over(own.orderBy("items", "h")).alias("k"), F.count("*").over(own).alias("n"))
    few = stored(ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).select("item", "h"))
    hits = _hits(docs, stored(few.select("h").distinct()), words, carried)
    pairs = stored(hits.distinct().join(few, "h").select("th", "item").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc = None, None  # rows of one text come together
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["th"] != last:
                    last, doc = row["th"], Text(row["text"], words)
                got = leak(doc, Text(row["item_text"], words), percent, slack)
                if got:
                    out.append((row["th"], row["item"], *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64() if c < 2 else pa.int32()) for c in range(6)], ["th", "item", "n_found", "n_windows", "n_slots", "n_changed"])

    texts = docs.join(pairs.select("th").distinct(), "th", "left_semi").select("th", "text").dropDuplicates(["th"])
    both = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").join(texts, "th").select("th", "item", "text", "item_text")
    found = stored(map_arrow(both, run, f"th bigint, item bigint, {LEAKS}"))
    named = found.join(items.select("item", "item_id"), "item")
    return docs.select("doc_id", "th").join(named, "th").select("doc_id", "item_id", "n_found", "n_windows", "n_slots", "n_changed")


def contamination(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_items, items (sorted ids of leaked items), contaminated; cases as in leaks()."""
    found = leaks(df, benchmark, **options).groupBy(F.col("doc_id").alias("d")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.countDistinct(F.coalesce(F.col("item_id").cast("string"), F.lit("-"))).alias("n"))
    docs = df.select(F.col(f"`{options.get('id_col', 'doc_id')}`").alias("doc_id"))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("doc_id", n.cast("bigint").alias("n_items"), "items", (n > 0).alias("contaminated"))
