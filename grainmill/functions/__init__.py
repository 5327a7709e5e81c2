"""Scalar functions over columns."""

from grainmill.functions.hashing import hash_mod, hash_murmur, hash_offset, hash_polynomial, hash_universal, murmur3, slab_buckets, slab_buckets_of

__all__ = ["hash_mod", "hash_murmur", "hash_offset", "hash_polynomial", "hash_universal", "murmur3", "slab_buckets", "slab_buckets_of"]
