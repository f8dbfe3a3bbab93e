"""32-bit hashes held in bigint, masked after each step: ANSI mode never overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
PARTITIONS = 64


def _signed(x: Column) -> Column:
    """The low 32 bits as a signed number."""
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def _times(x: Column, factor: int) -> Column:
    """Low 32 bits of a product, by 16-bit halves so that no product passes 2^63."""
    low, high = x.bitwiseAND(0xFFFF), F.shiftrightunsigned(x, 16).bitwiseAND(0xFFFF)
    return (low * factor + F.shiftleft((high * factor).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def hash_int32(key: Column) -> Column:
    """A 32-bit finalising mix whose shifts keep the sign; result in [0, 2^32)."""
    x = key.cast("bigint").bitwiseAND(MASK)
    # Shifts and factors of the mix.
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        x = x.bitwiseXOR(F.shiftright(_signed(x), shift)).bitwiseAND(MASK)
        x = x if factor is None else _times(x, factor)
    return x


def combine_hashes(first: Column, second: Column) -> Column:
    """Folds the second hash into the first, modulo 2^32."""
    # The golden-ratio constant and the shifts.
    mixed = second + F.lit(0x9E3779B9) + F.shiftleft(first, 6) + F.shiftright(first, 2)
    return first.bitwiseXOR(mixed.bitwiseAND(MASK)).bitwiseAND(MASK)


def partition_of(hashed: Column, partitions: int = PARTITIONS) -> Column:
    """The low bits: which of the 64 partitions a hash belongs to."""
    return hashed.bitwiseAND(partitions - 1)


def slot_of(hashed: Column, mask: Column | int) -> Column:
    """The slot inside a partition: the bits above the partition's six."""
    return F.shiftright(hashed, 6).bitwiseAND(mask)
