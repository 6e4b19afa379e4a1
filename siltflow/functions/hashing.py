"""Integer hashes of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_mod(col: Column, p: int) -> Column:
    """The text's UTF-8 bytes, read as one big-endian integer, modulo p: a Horner fold, so no big integers arise."""
    digits = F.hex(F.encode(col, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    byte = F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(byte, F.lit(0).cast("long"), lambda h, b: (h * 256 + b) % F.lit(p))
    return F.when(F.length(col) == 0, F.lit(0).cast("long")).otherwise(folded)


def trailing_zeros(col: Column) -> Column:
    """Zero bits at the end of a non-negative integer's binary form; that of 0 is '0', so it has one."""
    return F.when(col == 0, F.lit(1)).otherwise(F.bit_count(col.bitwiseAND(-col) - 1)).cast("int")
