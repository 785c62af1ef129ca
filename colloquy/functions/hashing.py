"""Salted hashes that give the same order and buckets in every run and engine."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hex(value: Column, salt: str) -> Column:
    """First 16 hex digits of SHA-256 of ``salt|value``; sorts like the number they spell."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), value.cast("string")), 256), 1, 16)


def stable_int(value: Column, salt: str) -> Column:
    return F.conv(stable_hex(value, salt), 16, 10).cast("decimal(20,0)")


def bucket(value: Column, salt: str, modulus: int) -> Column:
    """stable_int modulo modulus (below 2^31), from its halves: the same number without decimals."""
    digits = stable_hex(value, salt)
    high, low = (F.conv(F.substring(digits, at, 8), 16, 10).cast("long") % modulus for at in (1, 9))
    return ((high * ((1 << 32) % modulus) + low) % modulus).cast("int")


def drawn(prefix: bytes, salt: str, modulus: int, low: int = 0) -> Callable[[bytes], int]:
    """``bucket`` of values that begin with prefix, outside of columns, plus low: of the rest of a value."""
    head = salt.encode() + b"|" + prefix

    def draw(rest: bytes) -> int:
        return int.from_bytes(sha256(head + rest).digest()[:8]) % modulus + low

    return draw


def fingerprint(ids: Column) -> Column:
    """Aggregate: SHA-256 of the sorted distinct ids, one a line. The whole set is one row, as the definition asks; ``set_digest`` has no such row."""
    return F.sha2(F.array_join(F.sort_array(F.collect_set(ids.cast("string"))), "\n"), 256)


#: Lanes of a set's digest and hex digits of each: sums of 2^39 ids fit a long.
LANES, DIGITS = 10, 6


def set_digest(ids: Column) -> Column:
    """Aggregate over different ids: the sums, modulo 2^24, of the first ten groups of six hex digits of their SHA-256.

    Sums are made map-side and don't depend on the order, and digests of disjoint sets add up (``merged_digest``).
    It tells sets apart that differ by accident, not sets that somebody made to collide.
    """
    return _added(F.sha2(ids.cast("string"), 256))


def merged_digest(digests: Column) -> Column:
    """Aggregate: the digest of the union of disjoint sets, of their digests."""
    return _added(digests)


def _added(hex_digits: Column) -> Column:
    lanes = [F.sum(F.conv(F.substring(hex_digits, 1 + DIGITS * i, DIGITS), 16, 10).cast("long")) for i in range(LANES)]
    return F.concat(*(F.lower(F.lpad(F.hex(F.pmod(F.coalesce(n, F.lit(0)), F.lit(1 << 4 * DIGITS))), DIGITS, "0")) for n in lanes))
