"""Byte-pair merging with a segment tree over the ranks of adjacent pairs.

A leaf holds rank * width + position of the pair that starts at a symbol, an inner node the least of its
two children; so the root names the leftmost pair of the lowest rank. A merge changes three leaves and
their ancestors. Words of up to VECTOR_SYMBOLS symbols are merged side by side in numpy, one tree a row;
longer ones one at a time.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

VECTOR_SYMBOLS = 64
NONE = np.int32(2**31 - 1)

#: The byte-level alphabet's printable bytes; the others are the characters from 256 on.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]

def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    rest = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class PairTable:
    """(left id, right id) -> rank by open addressing, for arrays of pairs of ids below size."""

    def __init__(self, left: np.ndarray, right: np.ndarray, size: int):
        self.size, self.bits = size, max(4, (8 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo, rank = left.astype(np.int64) * size + right, np.arange(len(left), dtype=np.int32)
        slot = self.slot(todo)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.ranks[slot[put]] = todo[put], rank[put]
            left_over = np.setdiff1d(np.arange(len(todo)), put)
            todo, rank, slot = todo[left_over], rank[left_over], (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        slot = self.slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found


class Merger:
    """The vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_alphabet()
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int32).T
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs, self.rank_of = PairTable(left, right, self.size), None
        if len(pairs) >= 2**31 // VECTOR_SYMBOLS:
            raise ValueError("ranks and positions of so many merges don't fit 32 bits")
        self.sides = left, right
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, none of them empty, one after the other; and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts, done, low = np.zeros(len(words), np.int64), [], 0
        for width in (2, 4, 8, 16, 32, VECTOR_SYMBOLS):
            at = np.flatnonzero((lengths > low) & (lengths <= width))
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                ids, counts[part] = self._side_by_side([words[i] for i in part], lengths[part], width)
                done.append((part, ids))
            low = width
        for i in np.flatnonzero(lengths > low):
            ids = self._alone(words[i])
            counts[i] = len(ids)
            done.append((np.array([i]), ids))
        flat, start = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for part, ids in done:
            n = counts[part]
            flat[np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def _side_by_side(self, words: list[bytes], length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, bits = len(words), width.bit_length() - 1
        raw = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), length)
        start = np.cumsum(length) - length
        column = np.arange(len(raw)) - start[row]
        ids = np.zeros((n, width + 1), np.int32)  # the last column takes what is written past the end
        ids[row, column] = self.first[raw]
        ids[np.arange(n), length - 1] = self.last[raw[start + length - 1]]
        alive = np.zeros((n, width + 1), bool)
        alive[row, column] = True
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
        before = after - 2  # -1: the same column that takes what is past the end
        after[np.arange(n), length - 1] = width
        tree = np.full((n, 2 * width), NONE, np.int32)
        if width > 1:
            rank = self.pairs.find(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, -1)
            pair = (np.arange(width - 1) < (length - 1)[:, None]) & (rank < NONE)
            tree[:, width : 2 * width - 1] = np.where(pair, (rank << bits) | np.arange(width - 1, dtype=np.int32), NONE)
        for k in range(bits - 1, -1, -1):
            level = tree[:, 2 << k : 4 << k]
            tree[:, 1 << k : 2 << k] = np.minimum(level[:, ::2], level[:, 1::2])
        open_ = np.flatnonzero(tree[:, 1] < NONE)
        while len(open_):
            root = tree[open_, 1]
            at = root & (width - 1)
            made = self.made[root >> bits]
            gone = after[open_, at]
            right, left = after[open_, gone], before[open_, at]
            ids[open_, at], alive[open_, gone] = made, False
            after[open_, at], before[open_, right] = right, at
            r = self.pairs.find(made, ids[open_, right])
            key_at = np.where((right < width) & (r < NONE), (np.where(r < NONE, r, 0) << bits) | at, NONE)
            r = self.pairs.find(ids[open_, left], made)
            key_left = np.where((left >= 0) & (r < NONE), (np.where(r < NONE, r, 0) << bits) | left, NONE)
            tree[open_, width + gone], tree[open_, width + at] = NONE, key_at
            has = left >= 0
            tree[open_[has], width + left[has]] = key_left[has]
            for rows, leaf in ((open_, gone), (open_, at), (open_[has], left[has])):
                node = (width + leaf) >> 1
                for _ in range(bits):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            open_ = open_[tree[open_, 1] < NONE]
        alive = alive[:, :width]
        return ids[:, :width][alive], alive.sum(axis=1)

    def _alone(self, word: bytes) -> np.ndarray:
        if self.rank_of is None:
            self.rank_of = {(a, b): r for r, (a, b) in enumerate(zip(*(x.tolist() for x in self.sides), strict=True))}
        raw = np.frombuffer(word, np.uint8)
        ids = array("i", np.append(self.first[raw[:-1]], self.last[raw[-1]]).astype(np.int32).tobytes())  # arrays: a word may be a whole text
        n, width = len(ids), 1 << (len(ids) - 1).bit_length()
        after, before, none, rank_of, made = array("i", range(1, n + 1)), array("i", range(-1, n - 1)), 1 << 62, self.rank_of, self.made
        key = lambda i, j: (none if (r := rank_of.get((ids[i], ids[j]))) is None else r * width + i)
        tree = array("q", [none]) * width
        tree.extend(key(i, i + 1) for i in range(n - 1))
        tree.extend(array("q", [none]) * (width - n + 1))
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = width + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while (root := tree[1]) < none:
            rank, at = divmod(root, width)
            gone = after[at]
            ids[at], ids[gone], after[at] = int(made[rank]), -1, after[gone]
            put(gone, none)
            if after[at] < n:
                before[after[at]] = at
                put(at, key(at, after[at]))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], key(before[at], at))
        ids = np.frombuffer(ids, np.int32)
        return ids[ids >= 0]


_LOADED: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One for each worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = Merger(path)
    return _LOADED[path]
