"""Functions on text records: lengths and positions are counted in UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def byte_find(text: Column, what: str, start: int = 0) -> Column:
    """Byte offset of the first occurrence at or after a byte offset, -1 if there is none.

    ISO 8859-1 turns bytes into characters one by one, so that positions in characters are positions in bytes.
    """
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.locate(what.encode().decode("latin-1"), as_bytes(text), start + 1) - 1


def code_point_at(text: Column, position: int) -> Column:
    """Code point whose first byte is at a byte position; -1 outside the text or inside a character."""
    raw = F.encode(text, "UTF-8")
    # The bytes before, taken as text, must be whole characters for the position to begin one.
    n = F.length(F.substring(raw, 1, position).cast("string"))
    fits = (F.octet_length(text) > position) & (F.octet_length(F.substring(text, F.lit(1), n)) == position)
    return F.when(fits, F.ascii(F.substring(text, n + 1, F.lit(1)))).otherwise(-1)


def java_hash31(text: Column) -> Column:
    """h = 31 * h + signed byte, wrapped to 32 bits, 0 for an empty text."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)
    wrapped = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(at, F.lit(0).cast("long"), lambda h, i: wrapped(h * 31 + signed(byte(i)))).cast("int")


def append(*texts: Column) -> Column:
    return F.concat(*[F.coalesce(t, F.lit("")) for t in texts])


def valid_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw)
