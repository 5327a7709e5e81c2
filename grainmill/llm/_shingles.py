"""Five-word shingle sets as sorted 64-bit hashes, computed over whole batches of texts."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for key, base in (("up", _P), ("down", _P_INV)):
            full = np.full(max(n, 1 << 20), base, np.uint64)
            full[0] = 1
            _POWERS[key] = np.cumprod(full)
    return _POWERS["up"], _POWERS["down"]


def shingle_sets(texts: list[bytes | None], width: int = WORDS) -> list[np.ndarray]:
    """For each text (UTF-8) its sorted distinct shingle hashes; shorter texts have their whole sequence as one."""
    low = [(t or b"").lower() for t in texts]  # bytes.lower() touches A-Z only
    raw = np.frombuffer(b"\n".join(low) + b"\n", np.uint8)
    at = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in low], out=at[1:])
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, at)
    n = len(h)
    if n >= width:
        full = h[: n - width + 1].copy()
        for k in range(1, width):
            full = mix(full) + h[k : n - width + 1 + k]
        full = mix(full ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x) + h[k : k + 1]
            out.append(mix(x ^ np.uint64(0x5A5A5A5A5A5A5A5A)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each set two signed 64-bit numbers that equal sets share, together 120 bits of hash; the low byte of the first
    is the set's size class. Both are 0 for the empty set."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    out = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if len(full):
        flat, at = np.concatenate([sets[k] for k in full]), np.cumsum(size[full]) - size[full]
        for which, seed in enumerate((0x1234567890ABCDEF, 0x0FEDCBA987654321)):
            out[which][full] = mix(np.add.reduceat(mix(flat ^ np.uint64(seed)), at) + size[full].astype(np.uint64))
        out[0][full] = (out[0][full] & ~np.uint64(0xFF)) | size_class(size[full]).astype(np.uint64)
    return out[0].view(np.int64), out[1].view(np.int64)


def size_class(size: np.ndarray) -> np.ndarray:
    """Two classes for each factor of 1.25, so that sizes that can link are at most 3 classes apart (2, and one for rounding)."""
    return np.minimum(255, np.floor(np.log(np.maximum(size, 1)) * (2 / np.log(1.25)))).astype(np.int64)


PLAIN = 32  # smaller sets give single shingles as keys, larger ones whole segments


def _plan(n: int) -> list[tuple[int, int, int]]:
    """(scheme, segments, keys to give) of a set's schemes; see keys_of."""
    if n < PLAIN:
        return [(0, 0, n - (4 * n + 4) // 5 + 1)]
    s = n.bit_length() - PLAIN.bit_length() + 1  # sizes PLAIN * 2**(s - 1) and up to twice that
    low, high = PLAIN << (s - 1), PLAIN << s
    out = [(s, (5 * ((high - 1) // 4) + 3) // 4 + 1, (n + 5 * n // 4) // 9 + 1)]
    if 4 * n <= 5 * (low - 1):  # a partner may be of the scheme below
        most = (low - 1) // 4
        out.append((s - 1, (5 * most + 3) // 4 + 1, (n + low - 1) // 9 + 1) if s > 1 else (0, 0, n - (4 * n + 4) // 5 + 1))
    return out


def keys_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its set): any two sets with a Jaccard similarity of 0.8 or more share a key.

    Sets a and b that link differ in at most d = (a + b) / 9 tokens. A scheme, chosen by the smaller size, cuts the
    token space into m > d segments; a set's part in each is one item, and at least m - d items of both are equal.
    By the prefix principle the first d + 1 items of either, in any order that depends on the items alone, hold a
    common one; items of many tokens come first, so sets that share only a passage seldom meet. Below PLAIN tokens
    the items are the tokens themselves. Keys are even.
    """
    jobs = [(k, *p) for k, s in enumerate(sets) if len(s) for p in _plan(len(s))]
    found, owner = [], []
    for k, _, m, take in jobs:
        if not m:
            found.append(mix(sets[k][:take] ^ np.uint64(0x6A09E667F3BCC909)))
            owner.append(np.full(take, k))
    jobs = [j for j in jobs if j[2]]
    if jobs:
        own, scheme, m, take = np.array(jobs, np.int64).T
        tokens = np.concatenate([sets[k] for k in own])
        job = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own])
        part = ((tokens >> np.uint64(32)) * m[job].astype(np.uint64)) >> np.uint64(32)  # ascending within a set
        new = np.ones(len(tokens), bool)
        new[1:] = (job[1:] != job[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        count = np.diff(at, append=len(tokens))
        run, part = job[at], part[at]
        item = mix(np.add.reduceat(mix(tokens ^ np.uint64(0x3C6EF372FE94F82B)), at) + count.astype(np.uint64))
        item = _item(item, part, scheme[run])
        order = ((255 - np.minimum(count, 255)).astype(np.uint64) << np.uint64(56)) | (item >> np.uint64(8))
        by = np.lexsort((order, run))
        first = np.searchsorted(run, np.arange(len(own)))
        chosen = by[np.arange(len(by)) - first[run[by]] < take[run[by]]]
        found.append(item[chosen])
        owner.append(own[run[chosen]])
        held = np.bincount(run, minlength=len(own))
        for j in np.flatnonzero(held < take):  # then empty segments are items too
            empty = np.setdiff1d(np.arange(m[j]), part[run == j].astype(np.int64)).astype(np.uint64)
            more = np.sort(_item(np.zeros(len(empty), np.uint64), empty, np.full(len(empty), scheme[j])) >> np.uint64(8))[: take[j] - held[j]]
            found.append(more << np.uint64(8))
            owner.append(np.full(len(more), own[j]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found) & ~np.uint64(1), np.concatenate(owner)


def _item(content: np.ndarray, part: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    return mix(content ^ mix(part * np.uint64(0x9E3779B97F4A7C15) + scheme.astype(np.uint64)))
