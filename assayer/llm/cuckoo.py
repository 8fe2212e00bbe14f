"""Cuckoo filters as numpy arrays: batches of keys are looked up, inserted and removed at once.

A filter is a chain of tables, the first for most keys and a further one, twice as large, whenever the last
is full. A table has a power of two of buckets with four 16-bit fingerprints each, 0 if empty.
"""

from __future__ import annotations

import numpy as np

SLOTS, LEAST_BUCKETS, LOAD, ROUNDS, MIX = 4, 16, 0.85, 60, np.uint64(0x9E3779B97F4A7C15)


def prints(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key's fingerprint and the number of which its first bucket is the remainder, from its 128 bits."""
    fp = (b.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
    return np.where(fp == 0, np.uint16(1), fp), a.view(np.uint64) >> np.uint64(16)


def other(bucket: np.ndarray, fp: np.ndarray, buckets: int) -> np.ndarray:
    """The second bucket of a fingerprint, from either."""
    return bucket ^ ((fp.astype(np.uint64) * MIX) >> np.uint64(24)) & np.uint64(buckets - 1)


def new_table(keys: int) -> np.ndarray:
    n = max(LEAST_BUCKETS, int(keys / (SLOTS * LOAD)) + 1)
    return np.zeros((1 << (n - 1).bit_length(), SLOTS), np.uint16)


def contains(chain: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """If a key may be there; false only if it isn't."""
    fp, at = prints(a, b)
    found = np.zeros(len(a), bool)
    for table in chain:
        one = at & np.uint64(len(table) - 1)
        two = other(one, fp, len(table))
        found |= (table[one] == fp[:, None]).any(axis=1) | (table[two] == fp[:, None]).any(axis=1)
    return found


def settle(table: np.ndarray, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Puts fingerprints in free slots of their buckets; which ones found none."""
    order = np.argsort(bucket, kind="stable")
    sorted_buckets = bucket[order]
    first = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    free = table[sorted_buckets] == 0
    slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
    fits = rank < free.sum(axis=1)
    table[sorted_buckets[fits], slot[fits]] = fp[order[fits]]
    return np.sort(order[~fits])


def filled(table: np.ndarray, fp: np.ndarray, at: np.ndarray) -> np.ndarray | None:
    """The table with all these fingerprints, or nothing if some find no place."""
    table, held = table.copy(), fp.copy()
    left, where = np.arange(len(held)), at & np.uint64(len(table) - 1)
    for turn in range(ROUNDS):
        rest = settle(table, held[left], where)
        left, where = left[rest], where[rest]
        if not len(left):
            return table
        if turn:  # both buckets are full: one fingerprint of a bucket makes room and goes to its other one
            _, one = np.unique(where, return_index=True)
            slot = np.full(len(one), turn % SLOTS)
            out = table[where[one], slot]
            table[where[one], slot] = held[left[one]]
            held[left[one]] = out
        where = other(where, held[left], len(table))
    return None


def insert(chain: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The chain with these keys, a fingerprint each; keys that the last table can't hold go to a new one."""
    if not len(a):
        return chain
    chain = [*chain] or [new_table(len(a))]
    fp, at = prints(a, b)
    while (table := filled(chain[-1], fp, at)) is None:
        larger = np.zeros((max(2 * len(chain[-1]), len(new_table(len(a)))), SLOTS), np.uint16)
        chain = [*chain, larger] if chain[-1].any() else [*chain[:-1], larger]
    return [*chain[:-1], table]


def remove(chain: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The chain without one fingerprint for each of these keys, which must have been inserted."""
    chain = [table.copy() for table in chain]
    fp, at = prints(a, b)
    places = []
    for table in chain:
        one = at & np.uint64(len(table) - 1)
        places.append((one, other(one, fp, len(table))))
    for k, f in enumerate(fp):
        spots = ((table, buckets[k]) for table, both in zip(chain, places, strict=True) for buckets in both)
        found = next(((table, bucket) for table, bucket in spots if (table[bucket] == f).any()), None)
        if found is None:
            raise ValueError("a key was removed that isn't there")
        table, bucket = found
        table[bucket, np.argmax(table[bucket] == f)] = 0
    return [table for table in chain if table.any()]
