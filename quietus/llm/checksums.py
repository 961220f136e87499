"""crc32 in DuckDB SQL, for the SQL that queries are held against."""

from __future__ import annotations

#: A table ``t`` of one list, the 256 steps of crc32, for a WITH clause.
CRC_TABLE = """t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(256) r(i))"""


def crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of the UTF-8 bytes of a text of code points below 2048; CRC_TABLE must be in scope."""
    points = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END)"
    return f"xor(list_reduce(flatten({points}), lambda c, b: xor(t[(xor(c, b::BIGINT) & 255) + 1], c >> 8), 4294967295), 4294967295)"
