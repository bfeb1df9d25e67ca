"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

#: One row: the 256 remainders of CRC-32.
CRC_TABLE = "crc_table as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)))"


def crc32(text: str) -> str:
    """crc32 of the UTF-8 of ``text`` (code points below 2048), beside ``crc_table``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x))"
    octets = f"flatten(list_transform({codes}, lambda x: case when x < 128 then [x] else [192 + (x >> 6), 128 + (x & 63)] end))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform({octets}, lambda x: cast(x as bigint))), lambda c, b: xor(c >> 8, t[cast(xor(c, b) & 255 as bigint) + 1])))"
