"""A cuckoo filter over numpy: batched insert, lookup and delete (Fan et al., 2014).

One filter serves one shard of line keys.  A key is two unsigned 64-bit
halves of its digest: the first chooses the bucket, the second gives the
16-bit tag.  A tag may sit in its bucket or in the alternate one, which
depends only on the bucket and the tag, so tags can be moved and removed
without the key.  Lookups have no false negative."""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8  # share of slots filled before a shard opens another table
MAX_ROUNDS = 400


def _tag(k2: np.ndarray) -> np.ndarray:
    tag = (k2 >> np.uint64(48)).astype(np.uint16)
    return np.where(tag == 0, np.uint16(1), tag)


def _other(bucket: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    step = (tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (bucket ^ step.astype(np.int64)) & (n - 1)


def empty_table(keys: int) -> np.ndarray:
    """An empty table with room for ``keys`` keys (a power of two of buckets)."""
    need = max(1, int(np.ceil(keys / (SLOTS * LOAD))))
    return np.zeros((1 << (need - 1).bit_length(), SLOTS), dtype=np.uint16)


def _homes(table, k1, k2):
    tag = _tag(k2)
    home = (k1 & np.uint64(len(table) - 1)).astype(np.int64)
    return home, _other(home, tag, len(table)), tag


def contains(table: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    a, b, tag = _homes(table, k1, k2)
    return (table[a] == tag[:, None]).any(axis=1) | (table[b] == tag[:, None]).any(axis=1)


def insert(table: np.ndarray, k1: np.ndarray, k2: np.ndarray, seed: int = 0) -> bool:
    """Insert distinct keys in place.  False when they do not all fit (the table
    is then unusable and must be rebuilt larger)."""
    rng = np.random.default_rng(seed)
    bucket, _, tag = _homes(table, k1, k2)
    for _ in range(MAX_ROUNDS):
        if not len(bucket):
            return True
        order = np.argsort(bucket, kind="stable")
        bucket, tag = bucket[order], tag[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        taken = table[bucket] != 0
        free = SLOTS - taken.sum(axis=1)
        fits = rank < free
        slots = np.argsort(taken[fits], axis=1, kind="stable")  # free slots first
        table[bucket[fits], slots[np.arange(len(slots)), rank[fits]]] = tag[fits]
        push = ~fits & (rank == free)  # one tag per full bucket puts another out
        slot = rng.integers(0, SLOTS, size=int(push.sum()))
        out = table[bucket[push], slot]
        table[bucket[push], slot] = tag[push]
        tag = tag.copy()
        tag[push] = out
        left = ~fits
        bucket, tag = _other(bucket[left], tag[left], len(table)), tag[left]
    return not len(bucket)


def delete(table: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> None:
    """Remove distinct keys that were inserted, in place."""
    a, b, tag = _homes(table, k1, k2)
    while len(tag):
        places = np.concatenate([table[a] == tag[:, None], table[b] == tag[:, None]], axis=1)
        found = places.any(axis=1)
        a, b, tag, places = a[found], b[found], tag[found], places[found]
        at = places.argmax(axis=1)
        cell = np.where(at < SLOTS, a, b) * SLOTS + at % SLOTS
        _, one = np.unique(cell, return_index=True)  # two keys may point at one tag: one takes it now
        table.reshape(-1)[cell[one]] = 0
        rest = np.ones(len(tag), dtype=bool)
        rest[one] = False
        a, b, tag = a[rest], b[rest], tag[rest]
