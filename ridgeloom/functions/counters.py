"""Random numbers by counter, as columns of unsigned 64-bit arithmetic: the k-th number of a seed and a stream is a function
of the three, so any row can be drawn on its own and again.

Longs hold the 64 bits. Products and sums are made of 16-bit parts, as a long that overflows is an error in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The step of the state, the multiplier of the stream, a mask, and the multipliers of the two mixes.
STEP, STREAM, MASK, MIXES = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x123456789ABCDEF1, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
_PART = 0xFFFF


def signed(value: int) -> int:
    """The long with the same 64 bits."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often ``f`` uses it: expressions have no names, but lambdas do."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _parts(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(_PART).cast("long")) for k in range(4)]


def _joined(sums: list[Column]) -> Column:
    """The long of four sums of 16-bit parts, carries taken on; what lies beyond 64 bits is dropped."""
    out, carry = None, F.lit(0).cast("long")
    for k, part in enumerate(sums):
        part = part + carry
        carry = F.shiftright(part, 16)
        digit = F.shiftleft(part.bitwiseAND(F.lit(_PART).cast("long")), 16 * k)
        out = digit if out is None else out.bitwiseOR(digit)
    return out


def _shift_xor(x: Column, bits: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64."""
    b = [(factor >> 16 * k) & _PART for k in range(4)]

    def product(v: Column) -> Column:
        a = _parts(v)
        return _joined([sum((a[i] * b[k - i] for i in range(1, k + 1)), a[0] * b[k]) for k in range(4)])

    return _let(x, product)


def plus(x: Column, y: Column) -> Column:
    """x + y modulo 2**64."""
    return _let(F.struct(x.alias("x"), y.alias("y")), lambda v: _joined([p + q for p, q in zip(_parts(v["x"]), _parts(v["y"]), strict=True)]))


def drawn(seed: Column, stream: Column, counter: Column) -> Column:
    """The 64 bits of the number ``counter`` (from 1) of a seed and a stream, all longs."""
    start = times(seed, STEP).bitwiseXOR(times(stream, STREAM)).bitwiseXOR(F.lit(MASK).cast("long"))
    z = plus(start, times(counter, STEP))
    for shift, factor in MIXES:
        z = times(_shift_xor(z, shift), factor)
    return _shift_xor(z, 31)


def unit(bits: Column) -> Column:
    """A double in [0, 1) of the upper 53 bits."""
    return F.shiftrightunsigned(bits, 11).cast("double") / float(1 << 53)


def below(bits: Column, n: int) -> Column:
    """The unsigned value modulo n (at most 2**31)."""
    return _let(bits, lambda v: (F.shiftrightunsigned(v, 1) % n * 2 + v.bitwiseAND(F.lit(1).cast("long"))) % n)
