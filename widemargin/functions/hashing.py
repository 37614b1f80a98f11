"""Seeded hashes that give the same value on every run and engine."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def hash32(seed, *columns) -> Column:
    """Integer in [0, 2**32) from the md5 of ``seed|col|col...``."""
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def seeded_number(seed, *parts) -> int:
    """The value of ``hash32`` for plain values."""
    return int(hashlib.md5("|".join(str(p) for p in (seed, *parts)).encode()).hexdigest()[:8], 16)
