"""Quality rules (operator 3): line-first cleaning.

Each line of a text is judged by itself: lines that are mostly symbols or
exclamation, shouted, long without any punctuation, navigation lists or
boilerplate phrases fail and are removed. A document that loses too large a part of its
words is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rippleframe.llm.tables import id_and_text
from rippleframe.llm.wordbytes import LOWERCASE, SPACES, UPPER, Prefix, byte_table, chained, mix, pieces, word_ranges

SYMBOLS = byte_table(b"#*$%&|<>")
LOUD = byte_table(b"!?")
SEPARATORS = byte_table(b"|>")
#: A line of RUN_ON words or more needs one of these.
POINTS = byte_table(b".,;:!?")
RUN_ON = 30
#: Lower-case phrases that mark a line of up to BOILERPLATE_WORDS words as boilerplate.
BOILERPLATE = (
    b"all rights reserved", b"terms of use", b"terms of service", b"privacy policy", b"use of cookies",
    b"accept cookies", b"click here", b"read more", b"sign in", b"sign up", b"log in", b"subscribe to",
    b"share this", b"skip to content", b"enable javascript", b"powered by", b"copyright", b"lorem ipsum",
)
BOILERPLATE_WORDS = 12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40
_BOILERPLATE = re.compile(b"|".join(map(re.escape, BOILERPLATE)))


def _sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def line_failures(data: np.ndarray, line_bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, failed) of each line; line_bounds are line starts with the end added, starts are word starts."""
    first = np.searchsorted(starts, line_bounds)
    words = first[1:] - first[:-1]
    count = lambda table: _sums(table[data], line_bounds)
    symbols, upper, lower, loud, bars, points = map(count, (SYMBOLS, UPPER, LOWERCASE, LOUD, SEPARATORS, POINTS))
    some = words > 0
    failed = some & (symbols * 2 > words)  # symbols on more than half of the words
    failed |= (words >= 4) & (loud * 2 > words)  # exclamation all through
    failed |= (words >= 4) & (upper > 4 * lower) & (upper > 2 * words)  # shouted
    failed |= (words >= 4) & (bars * 3 >= words)  # a navigation list
    failed |= (words >= RUN_ON) & (points == 0)  # no sentence, no clause, no list
    if len(data):
        text = np.where(UPPER[data], data + np.uint8(32), data).astype(np.uint8).tobytes()
        for m in _BOILERPLATE.finditer(text):
            k = int(np.searchsorted(line_bounds, m.start(), side="right")) - 1
            if words[k] <= BOILERPLATE_WORDS and m.end() <= line_bounds[k + 1]:
                failed[k] = True
    return words, failed


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a flat byte array."""
    docs = len(offsets) - 1
    starts, ends, doc = word_ranges(data, offsets)
    n_words = np.bincount(doc, minlength=docs)
    gap = SPACES[data]
    word_chars = _sums(~gap & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _sums(SYMBOLS[data], offsets)
    prefix = Prefix(data)

    at, h = chained(prefix.of(starts, ends), doc, 3)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        own = mix(h ^ mix(doc[at].astype(np.uint64)))  # windows of different documents never compare equal
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for k in range(3):
            covered[at[twice] + k] = 1
    n_repeat = np.bincount(doc, weights=covered[:-1], minlength=docs).astype(np.int64)

    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    bounds = np.append(line_starts, len(data))
    words, failed = line_failures(data, bounds, starts)
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = bounds[1:] - (data[bounds[1:] - 1] == 10) if len(line_starts) else line_starts
    live = words > 0
    of = line_doc[live]
    key = mix(prefix.of(line_starts[live], line_ends[live]) ^ mix(of.astype(np.uint64)))
    n_dup = np.bincount(of, minlength=docs) - np.bincount(of[np.unique(key, return_index=True)[1]], minlength=docs)
    lost = np.bincount(line_doc, weights=words * failed, minlength=docs).astype(np.int64)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "n_lost_words": lost, "base_failed": base_failed, "kept": ~base_failed & (100 * lost <= MAX_LOST_PERCENT * n_words),
        "_bounds": bounds, "_failed": failed, "_line_doc": line_doc,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: the counts, base_failed, kept and, if asked, the text without its failed lines.

    n_repeat_words are words covered by windows of three words that the text has
    twice or more. kept is false if base_failed, or if the lines that fail hold
    over MAX_LOST_PERCENT of the words. Null and empty texts have no words and
    fail the base rules. Repeated rows are judged one by one, null ids kept,
    other columns ignored; an empty table gives an empty result. Lines and
    windows are compared by 64-bit hashes within a document.
    """
    docs = id_and_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", base_failed boolean, kept boolean" + ", cleaned string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                m = measures(data, offsets)
                out = [batch.column(0).slice(a, b - a), *(pa.array(m[c].astype(np.int64)) for c in _COUNTS), pa.array(m["base_failed"]), pa.array(m["kept"])]
                names = ["doc_id", *_COUNTS, "base_failed", "kept"]
                if with_text:
                    good = np.repeat(~m["_failed"], np.diff(m["_bounds"]))
                    total = np.zeros(len(data) + 1, np.int64)
                    np.cumsum(good, out=total[1:])
                    left, ends = data[good].tobytes(), total[offsets]
                    out.append(pa.array([left[x:y].decode() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                    names.append("cleaned")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.mapInArrow(run, schema)


_CLASS = r"[^\x20\x09-\x0D]+"
#: The same judgement as SQL over the view `documents`.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '{_CLASS}') AS w FROM d),
 a AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM w),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (SELECT unnest(range(3)) AS k) GROUP BY 1),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
 m AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_CLASS}')) AS n, len(regexp_extract_all(line, '[#*$%&|<>]')) AS s, len(regexp_extract_all(line, '[A-Z]')) AS u, len(regexp_extract_all(line, '[a-z]')) AS o,
   len(regexp_extract_all(line, '[!?]')) AS e, len(regexp_extract_all(line, '[|>]')) AS b, len(regexp_extract_all(line, '[.,;:!?]')) AS q, regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(p.decode() for p in BOILERPLATE)}') AS p FROM l),
 f AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN 2 * s > n OR (n >= 4 AND (2 * e > n OR (u > 4 * o AND u > 2 * n) OR 3 * b >= n)) OR (n >= {RUN_ON} AND q = 0) OR (p AND n <= {BOILERPLATE_WORDS}) THEN n ELSE 0 END) AS lost FROM m WHERE n > 0 GROUP BY 1),
 z AS (SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words FROM a LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
 NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words AS kept FROM z
"""
