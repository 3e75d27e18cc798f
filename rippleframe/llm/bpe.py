"""Byte-level BPE encoding and decoding (operator 4).

The tiktoken library with a local rank file. Long texts are cut before they
reach it, only where the splitting pattern is bound to cut as well: before a
single space that stands between two characters that are not white space. The
piece to the left ends in a character that no match can carry over the space,
and the match to the right begins with the space, so that both sides give the
tokens of the whole text. Ids are decoded from raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rippleframe.llm.tables import id_and_text, map_arrow

VOCABULARY = "byte_bpe_50k.tiktoken"
CUT_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def codec(rank_path: str):
    """(encoding, decimal text by id, bytes by id) of a rank file; one per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = max(ranks.values()) + 1
    decimal = [b"%d" % i for i in range(size)]
    raw: list[bytes] = [b""] * size
    for token, rank in ranks.items():
        raw[rank] = token
    return encoding, decimal, raw


def safe_parts(text: str, limit: int = CUT_CHARS) -> Iterator[str]:
    """Parts of a text, of about `limit` characters, that encode one by one as the whole does."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit - 1)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(text: str, rank_path: str, limit: int = CUT_CHARS) -> list[int]:
    encoding = codec(rank_path)[0]
    ids: list[int] = []
    for part in safe_parts(text, limit):
        ids.extend(encoding.encode_ordinary(part))
    return ids


def _digests(rank_path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, decimal, raw = codec(rank_path)
        for batch in batches:
            n_tokens, ids_sha, decoded_sha = [], [], []
            for value in batch.column(1):
                n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                for part in safe_parts(value.as_py() or "", limit):
                    ids = encoding.encode_ordinary(part)
                    if ids:
                        ids_hash.update((b" " if n else b"") + b" ".join([decimal[i] for i in ids]))
                        bytes_hash.update(b"".join([raw[i] for i in ids]))
                        n += len(ids)
                n_tokens.append(n)
                ids_sha.append(ids_hash.hexdigest())
                decoded_sha.append(bytes_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, cut_chars: int = CUT_CHARS) -> DataFrame:
    """One row per input row: id, token count, sha256 of the ids and of the bytes they decode to.

    A null or empty text has no tokens and the digests of nothing. Repeated rows
    and null ids come back as they are; other columns are ignored; an empty
    table gives an empty result. A long text is encoded part by part, so memory
    follows cut_chars and not the text, save for texts without a safe place.
    """
    path = rank_path or vocabulary_path()
    docs = id_and_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, _digests(path, cut_chars), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, cut_chars: int = CUT_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of each row; null and empty texts give an empty array."""
    path = rank_path or vocabulary_path()
    docs = id_and_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = pa.array([encode_text(batch.column(1)[row].as_py() or "", path, cut_chars)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), ids], ["doc_id", "ids"])

    return map_arrow(docs, run, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_path: str | None = None) -> DataFrame:
    """(doc_id, raw binary) of each row of ids; null ids give empty bytes, an unknown id an error."""
    path = rank_path or vocabulary_path()
    rows = df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        raw = codec(path)[2]
        for batch in batches:
            out = [b"".join([raw[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "raw"])

    return map_arrow(rows, run, f"doc_id {kind}, raw binary")
