"""Code lengths and bit patterns as Column functions; all stay in the JVM.

Bit patterns are strings of 0 and 1, first bit first, so that they can be joined, measured and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the offset classes: limit, bits of the pattern before the offset's low bits, number of low bits.
OFFSET_CLASSES = [(128, "0", 0), (256, "100", 0), (512, "101", 1), (1024, "1100", 2), (2048, "1101", 3), (4096, "11100", 4), (8192, "11101", 5), (16384, "111100", 6), (32768, "111101", 7), (65536, "111110", 8), (131072, "111111", 9)]
NARROW_OFFSET_CLASSES = [(128, "0", 0), (256, "100", 0), (512, "101", 1), (1024, "1100", 2), (2048, "1101", 3), (4096, "11100", 4), (8192, "11101", 5), (16384, "11110", 6), (32768, "11111", 7)]
#: Fixed values of the bucketed format: first value and number of bits of each class.
BUCKET_OFFSETS = [(1, 5), (33, 8), (289, 11), (2337, 14)]
BUCKET_LENGTHS = [(2, 1), (4, 3), (12, 5), (44, 7)]


def floor_log2(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def padded_bits(n: Column, width: int) -> Column:
    """The last `width` bits."""
    return F.right(F.concat(F.repeat(F.lit("0"), F.lit(64)), F.bin(n)), F.lit(width))


def _by_class(o: Column, classes, value) -> Column:
    out = None
    for limit, pattern, low in classes:
        one = value(pattern, low)
        out = F.when(o < limit, one) if out is None else out.when(o < limit, one)
    return out


def offset_bits(o: Column, classes=OFFSET_CLASSES) -> Column:
    """Bits of an offset: its class pattern, seven bits of the byte aside, and its low bits; 0 costs none."""
    return F.when(o == 0, 0).otherwise(_by_class(o, classes, lambda pattern, low: F.lit(7 + len(pattern) + low)))


def offset_code(o: Column, classes=OFFSET_CLASSES) -> Column:
    """Struct of the pattern (the bit after the first belongs to the byte part) and the byte aside."""
    def one(pattern: str, low: int) -> Column:
        # for offsets below 128 the pattern's only bit is the byte's top bit
        bits = F.lit("") if pattern == "0" else F.concat(F.lit(pattern[1:]), padded_bits(o, low))
        return F.struct(bits.alias("bits"), F.shiftright(o, low).bitwiseAND(255).cast("int").alias("byte"))

    return _by_class(o, classes, one)


def length_bits(n: Column, max_match: int) -> Column:
    """Bits of an interleaved Elias-gamma length; the top class has no end bit."""
    top = max_match.bit_length() - 1
    return (2 * floor_log2(n) + 1 - F.when(floor_log2(n) >= top, 1).otherwise(0)).cast("int")


def length_code(n: Column, max_match: int) -> Column:
    """A one before each bit below the first, and a zero at the end unless in the top class."""
    top = max_match.bit_length() - 1
    below = F.substring(F.bin(n), 2, 64)
    return F.concat(F.regexp_replace(below, "(.)", "1$1"), F.when(floor_log2(n) >= top, "").otherwise("0"))


def rice_code(v: Column, k: int) -> Column:
    return F.concat(F.repeat(F.lit("1"), F.shiftright(v, k).cast("int")), F.lit("0"), padded_bits(v, k))


def golomb_code(v: Column, m: int) -> Column:
    """Quotient in unary, remainder in truncated binary."""
    b = m.bit_length() - 1
    r, spare = v % m, (1 << (b + 1)) - m
    return F.concat(F.repeat(F.lit("1"), F.floor(v / m).cast("int")), F.lit("0"), F.when(r < spare, padded_bits(r, b)).otherwise(padded_bits(r + spare, b + 1)))


def least_shift(base: Column, m: int) -> Column:
    """The least k >= 1 with base * 2**k >= m."""
    return F.length(F.bin(F.floor((F.lit(m) - 1) / base)))


def bucket_class(v: Column, classes) -> Column:
    out = F.lit(0)
    for k, (first, _) in enumerate(classes[1:], 1):
        out = F.when(v >= first, k).otherwise(out)
    return out


def bucket_code(v: Column, classes) -> Column:
    """The value less its class's first, in the class's bits."""
    out = padded_bits(v - classes[0][0], classes[0][1])
    for first, bits in classes[1:]:
        out = F.when(v >= first, padded_bits(v - first, bits)).otherwise(out)
    return out


def simple_token_bytes(offset: Column, length: Column) -> Column:
    """Bytes of a token of the byte-aligned format."""
    return F.when((offset <= 32) & (length <= 3), 1).when(length <= 17, 2).otherwise(3)


def delta_varint(d: Column) -> Column:
    """Hex of an even delta, halved, in 7-bit groups from the top; all but the last have the high bit."""
    v = F.shiftright(d, 1)
    group = lambda k, more: F.lpad(F.hex(F.shiftright(v, 7 * k).bitwiseAND(127) + 128 * more), 2, "0")
    out = group(0, 0)
    for k in range(1, 4):
        out = F.when(v >= 1 << (7 * k), F.concat(*(group(j, 1) for j in range(k, 0, -1)), group(0, 0))).otherwise(out)
    return out


def table_offset_symbol(o: Column, min_offset: int) -> Column:
    """0 below min_offset, else the class of the offset, counted from it."""
    return F.when(o < min_offset, 0).otherwise(floor_log2(o) - (min_offset.bit_length() - 1) + 1)


def big_endian(v: Column, n: int) -> Column:
    return F.unhex(F.right(F.concat(F.repeat(F.lit("0"), F.lit(16)), F.hex(v)), F.lit(2 * n)))


def from_big_endian(data: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("bigint")


def token_kind(offset: Column, length: Column) -> Column:
    return F.when((offset == 0) & (length == 1), "literal").when(offset == 0, "repeat_match").when(length == 1, "repeat_literal").otherwise("match")
