"""Draws that depend on the key and the seed only.

``rand(seed)`` depends on how rows are partitioned and on task retries.  A draw hashed from the
row's own key gives the same value on every partitioning, after every retry, and in plain SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed: str | int, *keys: Column | str) -> Column:
    """md5 of ``key|key|seed`` as 32 hex digits."""
    parts = [as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hex_number(digest: Column, start: int, length: int) -> Column:
    """Hex digits ``start .. start+length-1`` (1-based) of a digest as a long."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def hash_int(seed: str | int, *keys: Column | str) -> Column:
    """Integer in [0, 2**32)."""
    return hex_number(hash_hex(seed, *keys), 1, 8)


def uniform(seed: str | int, *keys: Column | str) -> Column:
    """Double strictly inside (0, 1)."""
    return (hash_int(seed, *keys) + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed: str | int, *keys: Column | str) -> Column:
    """Standard normal draw (Box-Muller on two 32-bit parts of one digest)."""
    digest = hash_hex(seed, *keys)
    u1 = (hex_number(digest, 1, 8) + F.lit(0.5)) / F.lit(4294967296.0)
    u2 = (hex_number(digest, 9, 8) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
