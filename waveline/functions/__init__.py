"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards positive infinity (SQL ``round`` goes away from zero)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def path_index(key: Column, level: Column, levels: int) -> Column:
    """Index of the coefficient above ``key`` at ``level`` (1 = finest); level 0 is the overall average."""
    z = key - 1
    inner = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(levels) - level).cast("int")) + F.call_function("shiftright", z, level.cast("int")) + 1
    return F.when(level == 0, F.lit(1).cast("long")).otherwise(inner)


def path_sign(key: Column, level: Column) -> Column:
    """+1.0 in the right half of the coefficient's support and for level 0, -1.0 in the left half."""
    bit = F.call_function("shiftright", key - 1, F.greatest(level - 1, F.lit(0)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return F.when((level == 0) | (bit == 1), F.lit(1.0)).otherwise(F.lit(-1.0))


def support_size(level: Column, levels: int) -> Column:
    """Keys under a coefficient: 2**level, all of the domain for level 0."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(level == 0, F.lit(levels)).otherwise(level).cast("int")).cast("double")


def coin(seed: int, *parts: str) -> Column:
    """A reproducible uniform number in [0, 1) for a combination of columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bits(x: Column) -> Column:
    """floor(log2(x)) of a positive integer."""
    return F.length(F.bin(x)) - 1
