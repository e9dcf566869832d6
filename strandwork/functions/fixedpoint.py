"""Fixed-point arithmetic as column expressions over BIGINT, exact under ANSI rules.

Samples are 24- or 32-bit integers that wrap by contract. They are kept as BIGINT; words are numbers in [0, 2^32).
Column helpers take columns or Python ints.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = (1 << 32) - 1


def big(x: Column | int) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def word(x: Column) -> Column:
    """The low 32 bits, as an unsigned number."""
    return big(x).bitwiseAND(big(WORD))


def wrap32(x: Column) -> Column:
    """The signed 32-bit number with the low 32 bits of x."""
    return (big(x) + (1 << 31)).bitwiseAND(big(WORD)) - big(1 << 31)


def shr(x: Column, n: int | Column) -> Column:
    """Arithmetic shift to the right."""
    return F.shiftright(big(x), n) if isinstance(n, int) else F.call_function("shiftright", big(x), n.cast("int"))


def hi32(a: Column | int, b: Column | int) -> Column:
    """High word of the product of two signed words."""
    return shr(big(a) * big(b), 32)


def times32(a: Column | int, b: Column | int) -> Column:
    """a * b modulo 2^32 of two unsigned words, in 16-bit limbs so that nothing exceeds BIGINT."""
    x, y = big(a), big(b)
    low, high = y.bitwiseAND(big(65535)), shr(y, 16)
    return word(x * low + (x * high).bitwiseAND(big(65535)) * 65536)


def clamp24(x: Column) -> Column:
    return F.least(F.greatest(big(x), big(-8388608)), big(8388607))


def bit_at(x: Column, n: int) -> Column:
    """Bit n of x, 0 or 1."""
    return shr(x, n).bitwiseAND(big(1))
