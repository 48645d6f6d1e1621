"""Fingerprints and stable keys as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public FNV-1a (64 bit) definition, as two 32-bit halves.
FNV_BASIS_HIGH = 0xCBF29CE4
FNV_BASIS_LOW = 0x84222325
FNV_PRIME_LOW = 0x1B3
MASK32 = 0xFFFFFFFF


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def path_key(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 16 hex digits.

    The prime is 2**40 + 435, so a product modulo 2**64 is taken on two halves that
    never leave the range of BIGINT.
    """
    digits = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    octets = F.transform(digits, lambda d: F.conv(d, 16, 10).cast("long"))
    start = F.struct(
        F.lit(FNV_BASIS_HIGH).cast("long").alias("high"),
        F.lit(FNV_BASIS_LOW).cast("long").alias("low"),
    )

    def step(state: Column, octet: Column) -> Column:
        mixed = state["low"].bitwiseXOR(octet)
        product = mixed * FNV_PRIME_LOW
        high = state["high"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(
            high.bitwiseAND(F.lit(MASK32)).alias("high"),
            product.bitwiseAND(F.lit(MASK32)).alias("low"),
        )

    def text(state: Column) -> Column:
        return F.lower(
            F.concat(F.lpad(F.hex(state["high"]), 8, "0"), F.lpad(F.hex(state["low"]), 8, "0"))
        )

    return F.aggregate(octets, start, step, text)


def normalize_peer_id(c: Column) -> Column:
    """16 hex digits in lower case, or a hashed 36-character UUID form; null if neither."""
    return F.when(c.rlike("^[0-9A-Fa-f]{16}$"), F.lower(c)).when(
        (F.octet_length(c) == 36) & c.rlike("(?s)^.{8}-.{4}-.{4}-.{4}-.{12}$"),
        path_key(F.lower(c)),
    )


def text_differs(a: Column, b: Column) -> Column:
    """True when two texts differ by more than CRLF against LF line ends."""
    lf = lambda c: F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return lf(a) != lf(b)
