"""Editor positions: a 0-based line and an offset in UTF-16 units, from and to byte offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_column(source: Column, line_start: Column, offset: Column) -> Column:
    """UTF-16 units between the start of a line and a byte of it."""
    piece = F.substring(source.cast("binary"), line_start + 1, offset - line_start).cast("string")
    return (F.octet_length(F.encode(piece, "UTF-16BE")) / 2).cast("int")


def byte_offset(line: str, units: int) -> int:
    """Bytes before a place given in UTF-16 units, at most the whole line."""
    data = line.encode("utf-16-le", "surrogatepass")[: 2 * units]
    return len(data.decode("utf-16-le", "ignore").encode("utf-8", "surrogatepass"))
