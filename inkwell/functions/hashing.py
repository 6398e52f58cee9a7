"""Perceptual hashes as 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(vector: Column) -> Column:
    """The signs of up to 64 components as the bits of a long, the first one highest; positive is 1."""
    bit = F.transform(vector, lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def from_hex(text: Column) -> Column:
    """16 hexadecimal digits as a signed long."""
    return F.conv(text, 16, -10).cast("long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """Bits of a picture of ``width`` x ``height`` grey values: each pixel against its right neighbour."""
    places = [y * width + x + 1 for y in range(height) for x in range(width - 1)]
    bits = F.transform(F.array(*map(F.lit, places)), lambda i: (F.element_at(pixels, i) > F.element_at(pixels, i + 1)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
