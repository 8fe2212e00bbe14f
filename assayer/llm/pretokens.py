"""Whole texts to ids in numpy: pre-tokens by character classes, a memo of the pre-tokens merged before.

A batch's texts are cut at special strings, which have ids of their own, and into parts of bounded size
where no pre-token is. Parts are arrays of code points. Where classes change, pre-tokens start, by the rules
of the vocabulary file's pattern. Each pre-token's 64-bit hash looks up its ids; what isn't known goes
through the segment tree (bpe.py) once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

from . import bpe

#: Pre-tokens that a Python worker remembers (about 40 bytes each); beyond that the memo starts anew.
MEMO_WORDS = 1 << 20
#: Characters that are looked at together, about 80 bytes each; longer texts are cut where no pre-token is. Only
#: a run of one class, white space say, or of letters, is a pre-token of any length.
CHUNK_CHARS = 400_000

#: White space as the tokenizers library takes it.
SPACE = r"\t-\r \x85\xa0  -     　"
OTHER, LETTER, NUMBER, WHITE = range(4)
#: Before white space, and where a letter or a digit is followed by another class: what follows an apostrophe stays with it.
SAFE_CUT = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=\p{{L}})(?=[^\p{{L}}{SPACE}])|(?<=\p{{N}})(?=[^\p{{N}}{SPACE}])")

_TABLES: list[np.ndarray] = []
_LOADED: dict[str, Encoder] = {}


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _TABLES:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        found = np.zeros(0x110000, np.uint8)
        for kind, chars in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, f"[{SPACE}]")):
            found[[ord(c) for c in regex.findall(chars, every)]] = kind
        _TABLES.append(found)
    return _TABLES[0]


def starts(cp: np.ndarray, first: np.ndarray, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start in cp, and for each if it is one (else white space that is dropped).

    first marks each text's first character. words_only: the pattern without white space and with single
    digits (word_bpe); else the one that ties a space to what follows (byte_bpe).
    """
    kind = classes()[cp]
    n = len(cp)
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last = np.ones(n, bool)  # of its run of one class
    last[:-1] = new[1:]
    ends_text = np.ones(n, bool)
    ends_text[:-1] = first[1:]
    if words_only:
        new |= kind == NUMBER
        led = np.zeros(n, bool)
    else:
        # The last of a run of white space stands alone, or is tied to what follows if it is a space.
        final = white & last & ~ends_text
        led = np.zeros(n, bool)
        led[1:] = final[:-1] & (cp[:-1] == 32)
        new[final] = True
        new[led] = False
    # 's 't 'm 'd 're 've 'll, where a run of other characters is that apostrophe alone and no space leads it
    at = np.flatnonzero((cp == 39) & new & last & ~ends_text & ~led)
    if len(at):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        same_text = np.ones(len(at), bool)
        inside = at + 2 < n
        same_text[inside] = ~first[(at + 2)[inside]]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = same_text & inside & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for taken, length in ((at[short], 2), (at[long], 3)):
            new[taken + 1] = False
            after = (taken + length)[taken + length < n]
            new[after] = True
    begin = np.flatnonzero(new)
    return begin, ~white[begin] if words_only else np.ones(len(begin), bool)


class Encoder:
    """Ids or counts of texts for one vocabulary file."""

    def __init__(self, path: str):
        self.path, self.merger = path, bpe.merger(path)
        #: How ids are kept: 16 bits each if all fit.
        self.kind = np.dtype("<u2" if self.merger.size <= 1 << 16 else "<u4")
        self.words_only = self.merger.last[0] != self.merger.first[0]
        self.special = regex.compile("|".join(map(regex.escape, self.merger.special)) or r"(?!)")
        self.marked = all("<" in x for x in self.merger.special)
        self.bits = MEMO_WORDS.bit_length() + 1
        self.powers = self._powers(64)
        self.clear()

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        steps = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.offset, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, self.kind)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Entries of the keys, -1 for unknown ones."""
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        found = np.where(there == key, self.entry[slot], -1)
        open_ = np.flatnonzero((there != key) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            found[open_[hit]] = self.entry[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return found

    def insert(self, key: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct unknown keys."""
        m, mask = len(key), (1 << self.bits) - 1
        for name, more in (("offset", self.n + m), ("length", self.n + m), ("pool", self.used + len(ids))):
            if len(old := getattr(self, name)) < more:
                new = np.zeros(2 * more, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.pool[self.used : self.used + len(ids)] = ids
        self.offset[self.n : self.n + m] = self.used + np.cumsum(counts) - counts
        self.length[self.n : self.n + m] = counts
        todo, slot = np.arange(m), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot[todo]] == 0)
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free[one]]
            self.keys[slot[put]], self.entry[slot[put]] = key[put], self.n + put
            rest = np.ones(m, bool)
            rest[put] = False
            todo = todo[rest[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        self.n, self.used = self.n + m, self.used + len(ids)

    def entries(self, text: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of the joined texts start and their entries."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, is_token = starts(cp, first, self.words_only)
        if not len(begin):
            return begin, begin
        length = np.diff(begin, append=len(cp))
        if (most := int(length.max())) > len(self.powers):
            self.powers = self._powers(1 << most.bit_length())
        place = np.arange(len(cp)) - np.repeat(begin, length)
        key = cp.astype(np.uint64) + np.uint64(0x51ED270B)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        key *= self.powers[place]
        key = np.add.reduceat(key, begin)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key |= np.uint64(1)
        begin, length, key = begin[is_token], length[is_token], key[is_token]
        found = self.find(key)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            if self.n + len(unknown) > MEMO_WORDS:
                self.clear()
                unknown = np.arange(len(key))
            new, one = np.unique(key[unknown], return_index=True)
            at = unknown[one]
            words = [text[b : b + n].encode("utf-8", "surrogatepass") for b, n in zip(begin[at].tolist(), length[at].tolist(), strict=True)]
            self.insert(new, *self.merger.merge(words))
            found[unknown] = self.find(key[unknown])
        return begin, found

    def _plain(self, text: str) -> str:
        """The normalised text; each letter is lower-cased by itself, a capital sigma too."""
        if not self.words_only:
            return text
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, str, int | None]]:
        """(number, normalised text, id) in order: the stretches of each text, and the id of the special string that follows."""
        for i, text in enumerate(texts):
            at = 0
            if "<" in text or not self.marked:
                for m in self.special.finditer(text):
                    yield i, self._plain(text[at : m.start()]), self.merger.special[m.group()]
                    at = m.end()
            yield i, self._plain(text[at:]), None

    def _groups(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """Parts of texts, cut where no pre-token is, in groups of about CHUNK_CHARS characters."""
        group, size = [], 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = min(len(text), at + CHUNK_CHARS - size)
                if end < len(text):
                    cut = SAFE_CUT.search(text, end)
                    end = cut.start() if cut else len(text)
                group.append((i, text[at:end]))
                size += end - at
                at = end
                if size >= CHUNK_CHARS:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def encode(self, texts: list[str], counts_only: bool = False) -> tuple[list[bytes] | None, np.ndarray]:
        """Each text's ids as little-endian numbers of self.kind (None if not asked for), and how many they are."""
        total, parts = np.zeros(len(texts), np.int64), [[] for _ in texts]
        stretches = list(self._parts(texts))
        found: list[list[bytes]] = [[] for _ in stretches]
        for group in self._groups([x for _, x, _ in stretches]):
            sizes = np.array([len(x) for _, x in group])
            at = np.cumsum(sizes) - sizes
            first = np.zeros(int(sizes.sum()), bool)
            first[at] = True
            begin, entry = self.entries("".join(x for _, x in group), first)
            n = self.length[entry].astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(n)])
            bounds = sums[np.searchsorted(begin, np.append(at, len(first)))]
            np.add.at(total, [stretches[i][0] for i, _ in group], np.diff(bounds))
            if counts_only:
                continue
            ids = self.pool[np.repeat(self.offset[entry] - sums[:-1], n) + np.arange(sums[-1])].tobytes()
            size = self.kind.itemsize
            for (i, _), a, b in zip(group, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found[i].append(ids[size * a : size * b])
        for (i, _, special), ids in zip(stretches, found, strict=True):
            parts[i] += ids
            if special is not None:
                total[i] += 1
                parts[i].append(np.array([special], self.kind).tobytes())
        return None if counts_only else [b"".join(x) for x in parts], total


def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
