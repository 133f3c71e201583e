"""Seeded hashes and counter-based randomness as Column expressions.

Nothing here draws from a random stream: every random number is a hash of its
coordinates (seed, run, set, key), so results do not depend on partitioning,
survive task retries, and can be computed by any SQL engine with md5.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

BITS = 60
FULL = 1 << BITS
KINDS = ("portable", "fast", "identity")


def h60(*parts: Column | str | int | float) -> Column:
    """60 bits of md5 over the parts joined by colons; equal in other SQL engines."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 15), 16, 10).cast("long")


def h60_sql(*parts: str) -> str:
    """The same hash in DuckDB, of SQL expressions."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def h60_value(*parts: object) -> int:
    """The same hash in Python, for plan-time constants."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def hash_id(col: Column, seed: int, kind: str = "portable", modulus: int | None = None) -> Column:
    """A seeded hash of a key, which counts by its text, so 1 and '1' are the same key.

    portable: md5; fast: xxhash64; identity: the key itself (for tests).
    """
    if modulus is not None and not 0 < modulus <= 1 << 64:
        raise ValueError(f"a modulus is in 1 .. 2^64, not {modulus}")
    if kind == "portable":
        h = h60(seed, col)
    elif kind == "fast":
        h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), col.cast("string")), 64 - BITS)
    elif kind == "identity":
        h = col.cast("long")
    else:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    # hashes are below 2^60: a larger modulus changes nothing
    return h if modulus is None or modulus >= FULL else F.pmod(h, F.lit(modulus))


def fingerprint(col: Column, seed: int, kind: str = "portable") -> Column:
    """A seeded 32-bit fingerprint."""
    return hash_id(col, seed, kind, 1 << 32)


def unit(h: Column) -> Column:
    """A hash as a double strictly between 0 and 1."""
    return (h.cast("double") + 0.5) / float(FULL)


def uniform(*parts: Column | str | int | float) -> Column:
    """The uniform random number at these coordinates."""
    return unit(h60(*parts))


def fan_out(seed: int, num_hashes: int, axes: int = 1) -> list[list[int]]:
    """Independent seeds for each hash function and axis."""
    return [[h60_value("fan", seed, k, a) % (1 << 31) for a in range(axes)] for k in range(num_hashes)]
