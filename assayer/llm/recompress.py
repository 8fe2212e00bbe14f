"""Recompression of word sequences in numpy: what a task does of a round that names runs and pairs.

A step replaces runs of one symbol, or adjacent pairs chosen by a coin that is a hash of the symbol, by a
name that is a hash of what it stands for; so names agree in all tasks. A symbol also carries the words
that its presence depends on: wherever those words recur, so does the symbol. Between the rounds Spark
groups the names of all documents (substring_dedup.py); symbols that only one document has are dropped
with all that could depend on them, and leave gaps that no later symbol spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .wordhash import K, mixed

#: Of each round: steps of pair naming, and the words that a pair may span at most.
ROUNDS = ((5, 12), (3, 24), (3, 40))
#: Words that a symbol must span to tell texts apart.
LEAST = 4

_K2 = np.uint64(0xD6E8FEB86659FD93)
#: Names are of 48 bits, which move a quarter less; two that clash only let more windows through.
_NAME = np.uint64(16)


def named(x: np.ndarray) -> np.ndarray:
    return mixed(x) >> _NAME


@dataclass
class Symbols:
    """Symbols in order: each spans words[start:end] and depends on words[low:high]; fresh: named in this round."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    fresh: np.ndarray

    def __getitem__(self, which) -> Symbols:
        return Symbols(self.name[which], self.start[which], self.end[which], self.low[which], self.high[which], self.fresh[which])

    def telling(self, window: int) -> np.ndarray:
        """Fresh symbols that every window holding what they depend on shares with its copies."""
        return self.fresh & (self.end - self.start >= LEAST) & (self.high - self.low <= window)


def runs(words: np.ndarray, first: np.ndarray) -> Symbols:
    """Runs of one word. words holds several documents, first marks where each starts; no symbol spans two."""
    begin = first.copy()
    begin[1:] |= words[1:] != words[:-1]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(words))
    length = end - start
    name = words[start]
    name = np.where(length > 1, named(name * K + length.astype(np.uint64)), name >> _NAME)
    # a run depends on the word before and the word after it, or on there being none
    return Symbols(name, start, end, start - 1, end + 1, np.ones(len(start), bool))


def pairs(s: Symbols, starts: np.ndarray, ends: np.ndarray, turn: int) -> Symbols:
    """The steps of one round. starts, ends: for each word, and one more, if a document starts or has ended there.

    A symbol whose pairing a gap leaves open is dropped. What depends on where its document ends depends on
    the word beyond.
    """
    steps, cap = ROUNDS[turn]
    done = sum(n for n, _ in ROUNDS[:turn])
    s.fresh[:] = turn == 0
    for r in range(done, done + steps):
        salt = mixed(np.full(1, r + 1, np.uint64) * K)[0]
        left = (mixed(s.name ^ salt) & np.uint64(1)) == 0
        size = s.end - s.start
        at_start, at_end = starts[s.start], ends[s.end]
        next_to = np.append((s.end[:-1] == s.start[1:]) & ~at_start[1:], False)  # the next symbol follows at once
        after, before = next_to, np.append(False, next_to[:-1])
        one = np.append(left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= cap), False) & after
        two = np.append(False, one[:-1])
        # one that stays alone depends on the neighbour that it could have joined, if it had room for any
        alone = ~one & ~two & (size < cap)
        to_right, to_left = alone & left, alone & ~left
        next_high, last_low = np.append(s.high[1:], 0), np.append(0, s.low[:-1])
        high = np.where(one | to_right & after, np.maximum(next_high, s.high), np.where(to_right, np.maximum(s.high, s.end + 1), s.high))
        low = np.where(to_left & before, np.minimum(last_low, s.low), np.where(to_left, np.minimum(s.low, s.start - 1), s.low))
        low = np.where(one, np.minimum(low, np.append(s.low[1:], 0)) if len(low) else low, low)
        lost = to_right & ~after & ~at_end | to_left & ~before & ~at_start
        end = np.where(one, np.append(s.end[1:], 0), s.end)
        name = np.where(one, named(s.name * K + np.append(s.name[1:], np.uint64(0)) * _K2), s.name)
        s = Symbols(name, s.start, end, low, high, s.fresh | one)[~two & ~lost]
    return s


def parse(words: np.ndarray, first: np.ndarray) -> Symbols:
    """Runs and the first round of pairs."""
    starts = np.append(first, False)
    return pairs(runs(words, first), starts, np.append(first, True), 0)


def covered(low: np.ndarray, high: np.ndarray, n: int, window: int) -> np.ndarray:
    """How many of the symbols each of n windows of words, by its start, holds with all they depend on."""
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, np.clip(high - window, 0, n), 1)
    np.add.at(change, np.clip(low + 1, 0, n + 1), -1)
    return np.cumsum(change)[:n]


def held(symbols: Symbols, alive: np.ndarray, window: int) -> np.ndarray:
    """The symbols that some window still alive, by its start, holds with all they depend on."""
    upto = np.append(0, np.cumsum(alive))
    a, b = np.clip(symbols.high - window, 0, len(alive)), np.clip(symbols.low + 1, 0, len(alive))
    return upto[np.maximum(a, b)] > upto[a]
