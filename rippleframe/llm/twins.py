"""Pieces of DuckDB SQL for the twins of this subpackage."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes: bit by bit, with the reflected polynomial."""
    one = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    byte = f"(16 * {digit('2 * i + 1')} + {digit('2 * i + 2')})::BIGINT"
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    return f"xor(list_reduce({data}, lambda s, b: list_reduce(range(8), lambda c, k: {one}, xor(s, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
