"""Token counts by the whole-token shortcut (operator 11).

Offline, on the driver, every vocabulary string is tried: those that the
splitting pattern leaves in one piece and that the library turns into exactly
one token form the table of whole tokens, which is bounded by the vocabulary.
A task splits texts with that pattern, counts a piece of the table as one token
without touching the library, and hands only the distinct other pieces to it.

The splitting pattern runs in the `regex` module, whose Unicode tables may be
newer than the library's. Each code point is therefore tried once a task in
both; texts with one that the two read differently are split by the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.bpe import CUT_CHARS, safe_parts, vocabulary_path
from rippleframe.llm.tables import id_and_text

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Pieces whose counts a task keeps, and the longest that it keeps.
CACHE_PIECES, CACHE_CHARS = 200_000, 64


class Splitter:
    """The library's tokenizer of one vocabulary file, its special strings and its splitting pattern."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content for t in added.values()}
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.alike: set[str] = set()
        self.unlike: set[str] = set()

    def tried(self, chars: set[str]) -> None:
        """Files code points by whether pattern and library split around them alike."""
        for c in chars:
            text = f"a{c}1{c}!"
            same = [m.span() for m in self.pattern.finditer(text)] == [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]
            (self.alike if same else self.unlike).add(c)

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        chars = set(text)
        if not chars <= self.alike:
            self.tried(chars - self.alike - self.unlike)
            if not chars.isdisjoint(self.unlike):
                return [text[a:b] for a, b in (span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text))]
        return self.pattern.findall(text)

    def merged(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece, by the library."""
        return [len(e.ids) for e in self.library.encode_batch(pieces, add_special_tokens=False)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    """One for each Python worker."""
    return Splitter(path)


def _byte_of_char() -> dict[str, int]:
    """The inverse of the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one piece and encode alone as one token; at most as many as the vocabulary has."""
    own, byte = Splitter(path), _byte_of_char()
    texts = {}
    for token, number in own.library.get_vocab(with_added_tokens=False).items():
        try:
            texts[bytes(byte[c] for c in token).decode()] = number
        except (KeyError, UnicodeDecodeError):  # no text of its own
            continue
    alone = [t for t in texts if t and own.split(t) == [t]]
    codes = own.library.encode_batch(alone, add_special_tokens=False)
    return frozenset(t for t, e in zip(alone, codes, strict=True) if e.ids == [texts[t]])


def _counter(path: str, whole: frozenset[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(path)
        costs: dict[str, int] = {}
        for batch in batches:
            counts = []
            for value in batch.column(1):
                n_tokens = n_pieces = n_whole = 0
                for part in safe_parts(value.as_py() or "", limit):
                    for text in own.special.split(part) if own.special else (part,):
                        if text in own.added:
                            n_tokens += 1
                            continue
                        pieces = own.split(text)
                        rest = [p for p in pieces if p not in whole]
                        fresh = [p for p in set(rest) if p not in costs]
                        if fresh:
                            costs.update(zip(fresh, own.merged(fresh), strict=True))
                        n_pieces += len(pieces)
                        n_whole += len(pieces) - len(rest)
                        n_tokens += len(pieces) - len(rest) + sum([costs[p] for p in rest])
                        if any(len(p) > CACHE_CHARS for p in fresh) or len(costs) > CACHE_PIECES:
                            costs = {} if len(costs) > CACHE_PIECES else {p: n for p, n in costs.items() if len(p) <= CACHE_CHARS}
                counts.append((n_tokens, n_pieces, n_whole))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "n_bytes", "n_tokens", "n_pieces", "n_whole"])

    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most: int = LIMIT, cut_chars: int = CUT_CHARS) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than `most` tokens), n_pieces of the pattern and how many of them were whole tokens.

    Special strings inside a text count as one token, as the library has it by
    default; none are added and nothing is truncated. A null or empty text has
    no tokens. Repeated rows, null ids and ties come back as they are; other
    columns are ignored; an empty table gives an empty result. Texts longer
    than cut_chars are split at places where the pattern splits too, so memory
    follows cut_chars and not the text, save for texts without such a place.
    """
    path = path or vocabulary_path(VOCABULARY)
    docs = id_and_text(df, id_col, text_col).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = whole_tokens(path)
    out = docs.mapInArrow(_counter(path, whole, cut_chars), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_pieces bigint, n_whole bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"), "n_pieces", "n_whole")
