"""Bucket numbers of integer keys. All arithmetic is in bigint and never negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(key: Column) -> Column:
    return key.cast("long")


def hash_mod(key: Column, n: int) -> Column:
    return F.pmod(_long(key), F.lit(n))


def hash_offset(key: Column, n: int, offset: int) -> Column:
    return F.pmod(hash_mod(key, n) + F.lit(offset), F.lit(n))


def hash_universal(key: Column, a: int, b: int, p: int, n: int) -> Column:
    """((a * key + b) mod p) mod n. The key is reduced mod p first, so the product stays in bigint for p < 2**31."""
    return F.pmod(F.pmod(F.lit(a) * F.pmod(_long(key), F.lit(p)) + F.lit(b), F.lit(p)), F.lit(n))


def _mul32(a: Column, b: int) -> Column:
    """a * b mod 2**32 for 0 <= a < 2**32, by halves, so that no product leaves bigint."""
    return ((((a * F.lit(b >> 16)) % F.lit(1 << 16)) * F.lit(1 << 16)) + a * F.lit(b & 0xFFFF)) % F.lit(1 << 32)


def _rotl32(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftright(a, 32 - n))


def murmur3(key: Column, seed: int = 42) -> Column:
    """Murmur3_x86_32 of the key's eight bytes, least first, as an unsigned number. With Spark's own seed its built-in
    hash gives it."""
    if seed == 42:
        return F.pmod(F.hash(_long(key)).cast("long"), F.lit(1 << 32))
    h = F.lit(seed % (1 << 32)).cast("long")
    low = _long(key).bitwiseAND(F.lit(0xFFFFFFFF))
    for word in (low, F.shiftrightunsigned(_long(key), 32)):
        k = _mul32(_rotl32(_mul32(word, 0xCC9E2D51), 15), 0x1B873593)
        h = (_mul32(_rotl32(h.bitwiseXOR(k), 13), 5) + F.lit(0xE6546B64)) % F.lit(1 << 32)
    h = h.bitwiseXOR(F.lit(8))
    h = _mul32(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = _mul32(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


def hash_murmur(key: Column, n: int, seed: int = 42) -> Column:
    return F.pmod(murmur3(key, seed), F.lit(n))


def hash_polynomial(key: Column, n: int, p: int, digits: int = 10) -> Column:
    """Sum over the lowest decimal digits d_i of a key that is not negative of d_i * p**(i+1), mod n."""
    total = F.lit(0).cast("long")
    for i in range(digits):
        digit = F.pmod(F.call_function("div", _long(key), F.lit(10**i)), F.lit(10))
        total = total + digit * F.lit(pow(p, i + 1, n))
    return F.pmod(total, F.lit(n))


#: Utilisation in percent -> load factor of 32-slot nodes; any other utilisation counts as 1.
LOAD_FACTORS = {20: 0.2, 30: 0.3, 40: 0.4, 50: 0.55, 60: 0.625, 70: 0.875, 80: 1.875}


def slab_buckets(n: int, utilisation: int = 60) -> int:
    """Number of buckets for n keys in chains of 32-slot nodes."""
    return int(n / (32 * LOAD_FACTORS.get(utilisation, 1.0)))


def slab_buckets_of(n: Column, utilisation: int = 60) -> Column:
    """slab_buckets of a column."""
    return F.floor(n / F.lit(32 * LOAD_FACTORS.get(utilisation, 1.0))).cast("long")
