"""Small integer and packing helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    """One bits of a long."""
    return F.bit_count(x).cast("int")


def popcount_before(x: Column, n: Column) -> Column:
    """One bits among the n lowest bits of a long, n from 0 to 64."""
    below = F.when(n >= 64, F.lit(-1).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int"))))
    return F.bit_count(x.bitwiseAND(below)).cast("int")


def ceil_log2(x: Column) -> Column:
    """The least b with 2**b >= x, for x of 1 or more; exact for every long. Null below 1."""
    return F.when(x == 1, F.lit(0)).when(x > 1, F.length(F.bin(x - 1)))


def integer_power(base: Column, exponent: Column) -> Column:
    """base ** exponent as a long, by repeated multiplication; a result that doesn't fit is an error."""
    product = F.aggregate(F.sequence(F.lit(0), exponent), F.lit(1).cast("long"), lambda s, i: F.when(i == 0, s).otherwise(s * base.cast("long")))
    return F.when(exponent >= 0, product)


def pack_nibbles(symbols: Column) -> Column:
    """Bytes below 16, two in each byte of the result, the first one high; an odd number ends with 0. A larger byte is an error."""
    digits = F.hex(symbols)
    low = F.regexp_replace(digits, "0(.)", "$1")
    packed = F.unhex(F.rpad(low, (F.floor((F.length(low) + 1) / 2) * 2).cast("int"), F.lit("0")))
    return F.when(F.length(low) * 2 == F.length(digits), packed).when(symbols.isNotNull(), F.raise_error(F.lit("a symbol needs more than four bits")).cast("binary"))


def unpack_nibbles(packed: Column, n: Column) -> Column:
    """The first n symbols of pack_nibbles."""
    return F.unhex(F.regexp_replace(F.substring(F.hex(packed), F.lit(1), n.cast("int")), "(.)", "0$1"))


def nibble_at(packed: Column, i: Column) -> Column:
    return F.conv(F.substring(F.hex(packed), (i + 1).cast("int"), F.lit(1)), 16, 10).cast("int")


def zero_places(symbols: Column) -> Column:
    """Places of the bytes that are 0."""
    digits = F.split(F.regexp_replace(F.hex(symbols), "(..)", "$1 "), " ")
    return F.filter(F.transform(digits, lambda x, i: F.when(x == "00", i)), lambda i: i.isNotNull())
