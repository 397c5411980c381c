"""Reading and writing whole numbers, floats and text in BINARY columns, in native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body has it."""
    return F.transform(F.array(value), body)[0]


def part(b: Column, at, n=None) -> Column:
    """n bytes from offset ``at`` (0 is the first), or all that follow."""
    if n is None:
        return F.substring(b, col(at) + 1, F.length(b))
    return F.substring(b, col(at) + 1, col(n))


def starts(b: Column, what: bytes, at: int = 0) -> Column:
    return part(b, at, len(what)) == F.lit(bytearray(what))


def be(b: Column, at, n: int) -> Column:
    """Unsigned big-endian number of n bytes (at most 7), null where the value ends early."""
    x = part(b, at, n)
    return F.when(F.length(x) == n, F.conv(F.hex(x), 16, 10).cast("long"))


def le(b: Column, at, n: int) -> Column:
    """Unsigned little-endian number of n bytes (at most 7)."""
    x = part(b, at, n)
    return F.when(F.length(x) == n, F.conv(F.concat(*[F.hex(F.substring(x, k, 1)) for k in range(n, 0, -1)]), 16, 10).cast("long"))


def be_any(b: Column) -> Column:
    """Unsigned big-endian number of the whole value (7 bytes at most)."""
    return F.conv(F.hex(b), 16, 10).cast("long")


def le64(b: Column, at) -> Column:
    return le(b, at, 4) + le(b, col(at) + 4, 2) * F.lit(1 << 32) + le(b, col(at) + 6, 1) * F.lit(1 << 48)


def bits(x: Column, shift: int, n: int) -> Column:
    return F.shiftright(x, shift).bitwiseAND((1 << n) - 1)


def float_be(b: Column) -> Column:
    """IEEE number of 4 or 8 bytes."""
    hi, lo = be(b, 0, 4), F.coalesce(be(b, 4, 4), F.lit(0))
    double = F.when(bits(hi, 31, 1) == 1, -1.0).otherwise(1.0) * (1 + (bits(hi, 0, 20) * F.lit(4294967296.0) + lo) / F.lit(2.0**52)) * F.pow(F.lit(2.0), bits(hi, 20, 11) - 1023)
    single = F.when(bits(hi, 31, 1) == 1, -1.0).otherwise(1.0) * (1 + bits(hi, 0, 23) / F.lit(2.0**23)) * F.pow(F.lit(2.0), bits(hi, 23, 8) - 127)
    return F.when((hi.bitwiseAND(0x7FFFFFFF) == 0) & (lo == 0), 0.0).when(F.length(b) == 8, double).when(F.length(b) == 4, single)


def syncsafe(b: Column, at, n: int = 4) -> Column:
    """Big-endian number of 7-bit bytes; null if a byte has its high bit set."""
    xs = [be(b, col(at) + k, 1) for k in range(n)]
    ok = reduce(lambda a, c: a & c, [x < 128 for x in xs])
    return F.when(ok, reduce(lambda a, x: a * 128 + x, xs))


def text(b: Column, charset: str = "ISO-8859-1") -> Column:
    """Text up to the first NUL."""
    return F.substring_index(F.decode(b, charset), "\0", 1)


def utf8_or_latin1(b: Column) -> Column:
    return F.when(F.call_function("is_valid_utf8", b.cast("string")), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def lv(x, n: int = 4, order=None) -> Column:
    """Bytes behind their length (high byte first, unless another order is given)."""
    return let(x if isinstance(x, Column) else raw(x), lambda b: F.concat((order or to_be)(F.length(b), n), b))


# --------------------------------------------------------------------------- writers
def to_be(x, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(col(x).cast("long")), 2 * n, "0"))


def to_le(x, n: int) -> Column:
    h = F.lpad(F.hex(col(x).cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * k - 1, 2) for k in range(n, 0, -1)]))


def to_syncsafe(x, n: int = 4) -> Column:
    x = col(x).cast("long")
    return F.concat(*[to_be(F.shiftright(x, 7 * k).bitwiseAND(127), 1) for k in range(n - 1, -1, -1)])


def raw(x) -> Column:
    """bytes, str or a string column as BINARY (UTF-8)."""
    return F.lit(bytearray(x)) if isinstance(x, bytes) else F.encode(col(x), "UTF-8")


def join(*xs) -> Column:
    """Bytes one after another; texts count as UTF-8."""
    return F.concat(*[x.cast("binary") if isinstance(x, Column) else raw(x) for x in xs])


def zeros(n: int) -> Column:
    return F.lit(bytearray(n))
