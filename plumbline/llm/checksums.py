"""What operators on plain words share with their SQL: lower-casing of A to Z alone, and crc32 in DuckDB."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table `ct` with the checksum's 256 entries as the list `tab`, made from their rule.
CRC_TABLE_SQL = "ct AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM (SELECT unnest(range(256)) AS n)))"


def crc_sql(value: str) -> str:
    """crc32 of the UTF-8 bytes of a value, beside `tab`."""
    one = f"CAST(('0x' || substr(hex(encode({value})), 2 * i + 1, 2)) AS BIGINT)"
    return f"xor(list_reduce(list_transform(range(octet_length(encode({value}))), lambda i: {one}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
