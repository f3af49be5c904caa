"""Seeded hashes with the same value in every SQL engine (md5 over integer text)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hex(seed: int | str, *keys: str | Column) -> Column:
    """32 hex characters for ``seed|key|...``; keys should be integers or strings, never doubles.

    Each purpose needs its own seed text: silos and splits cut from the same hash would be correlated.
    """
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash32(seed: int | str, *keys: str | Column) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(seeded_hex(seed, *keys), 1, 8), 16, 10).cast("bigint")
