"""Pieces of oracle SQL that several operators share."""

from __future__ import annotations

#: A table of one row for ``WITH``: crc32's 256 remainders, from its polynomial.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders)"""


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``; ``crc_table`` must be in FROM."""
    digit = "(strpos('0123456789ABCDEF', substr(hex({t}), {at}, 1)) - 1)"
    high, low = digit.format(t=text, at="2 * k + 1"), digit.format(t=text, at="2 * k + 2")
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: 16 * {high} + {low})"
    step = "xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"
