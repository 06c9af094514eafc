"""Keys in shuffles: exact, reversible packing of hex identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Not "$": it also matches before a line end that ends the key.
_HEX = r"^[0-9a-f]{64}\z"


def _binary(byte: int) -> Column:
    return F.lit(bytearray([byte]))


def packed(key: Column) -> Column:
    """The key as binary: 33 octets for a 64-digit lower-case hex key, else a
    zero octet and the key's own octets.  Distinct keys stay distinct, null
    stays null.  Hex digits do not shrink under the shuffle's compression, so
    this halves what a join or grouping by identity moves."""
    return F.when(key.rlike(_HEX), F.concat(_binary(1), F.unhex(key))).otherwise(
        F.concat(_binary(0), key.cast("binary"))
    )


def unpacked(key: Column) -> Column:
    """Inverse of ``packed``."""
    rest = F.substring(key, 2, 2_147_483_647)
    return F.when(F.substring(key, 1, 1) == _binary(1), F.lower(F.hex(rest))).otherwise(
        rest.cast("string")
    )


def stated(key: Column) -> Column:
    """True where a key is neither null nor empty."""
    return key.isNotNull() & (key != "")


def utc_month(seconds: Column, absent: str = "untimed") -> Column:
    """``YYYY-MM`` of unix seconds in UTC, whatever the session's zone.

    Null is ``absent``; seconds outside the years 1 to 9999 are ``out of range``.
    """
    first, last = -62135596800, 253402300799
    inside = seconds.between(first, last)
    days = F.when(inside, F.floor(seconds / F.lit(86400)).cast("int"))
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")
    return (
        F.when(seconds.isNull(), F.lit(absent)).when(inside, month).otherwise(F.lit("out of range"))
    )
