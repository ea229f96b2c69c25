"""Words of whole texts as ragged numpy arrays, and values remembered per distinct word.

A byte-level or word-level BPE vocabulary first splits a text by a fixed pattern;
merges never cross its words. ``split`` applies those patterns to a batch of texts
at once: character classes come from a table, word starts from class changes.
Plain words are what stands between white space, in lower case. Every word gets a 64-bit hash of its characters, so a batch's distinct words are
found by sorting numbers, and what was worked out for a word is kept in a ``Memo``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

LETTER, DIGIT, OTHER, BLANK = 0, 1, 2, 3
#: Unicode's White_Space characters, as the inside of a character class.
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
GAP = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
#: Characters of a text that are worked on at once; a longer text is cut before white space.
PART = 1 << 20
#: Distinct words remembered per Python worker.
MEMO_WORDS = 1_500_000
BASE = 0x9E3779B97F4A7C15


@cache
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, f"[{WHITE}]+")):
        for m in regex.finditer(pattern, chars):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


@cache
def _mixed() -> np.ndarray:
    x = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n at least."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(n, b, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


class Words:
    """start, end (in characters of ``joined``), hash and text number of each word."""

    def __init__(self, texts: list[str], byte_level: bool = False, plain: bool = False):
        if plain:
            texts = [t.lower() for t in texts]
        elif not byte_level:
            texts = [_plain(t) for t in texts]
        self.joined = "".join(texts)
        cp = np.frombuffer(self.joined.encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n_texts = len(texts)
        if not len(cp):
            self.start = self.end = self.text = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        cls = _classes()[cp]
        if plain:
            cls = np.where(cls == BLANK, BLANK, OTHER)
        opens = np.zeros(len(cp) + 3, bool)  # a text begins here; three beyond the end
        ends = np.cumsum(size)
        opens[ends - size] = True
        opens[len(cp) :] = True
        st = opens.copy()
        st[1 : len(cp)] |= cls[1:] != cls[:-1]
        if byte_level:  # the last blank before a word goes with it, if it is a space; otherwise it stands alone
            at = np.flatnonzero((cls[1:] != BLANK) & (cls[:-1] == BLANK) & ~opens[1 : len(cp)]) + 1
            st[at - 1] = True
            st[at] = cp[at - 1] != 32
        elif not plain:
            st[: len(cp)] |= cls == DIGIT
        if not plain:
            self._contractions(cp, st, opens)
        at = np.flatnonzero(st[: len(cp)])
        end = np.append(at[1:], len(cp))
        if not byte_level:
            solid = cls[at] != BLANK
            at, end = at[solid], end[solid]
        up, down = powers(len(cp) + 1)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_mixed()[cp] * up[: len(cp)], out=total[1:])
        self.hash = (total[end] - total[at]) * down[at] + (end - at).astype(np.uint64)
        self.start, self.end = at, end
        self.text = np.searchsorted(ends, at, side="right")

    @staticmethod
    def _contractions(cp: np.ndarray, st: np.ndarray, opens: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll: an apostrophe that begins a word takes these letters along."""
        q = np.flatnonzero(cp == 39)
        q = q[st[q] & st[q + 1] & ~opens[q + 1]] if len(q) else q
        if not len(q):
            return
        c = np.concatenate((cp, np.zeros(3, cp.dtype)))
        one, two = c[q + 1], np.where(opens[q + 2], 0, c[q + 2])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, k in ((short, 2), (long, 3)):
            st[q[hit] + 1] = False
            st[q[hit] + k] = True

    def strings(self, which: np.ndarray) -> list[str]:
        s = self.joined
        return [s[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


def _plain(text: str) -> str:
    """NFC and lower case of each character by itself."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Memo:
    """Sorted word hashes with one ragged array of values per word."""

    def __init__(self, dtype):
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, dtype)

    def look_up(self, words: Words, make) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each word's values in ``flat``; ``make(strings)`` gives (numbers, values) of new words."""
        found, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, found), max(len(self.hash) - 1, 0))
        known = self.hash[at] == found if len(self.hash) else np.zeros(len(found), bool)
        if not known.all():
            if len(self.hash) + len(found) > MEMO_WORDS:
                self.__init__(self.flat.dtype)
                known[:] = False
            new = ~known
            n, values = make(words.strings(first[new]))
            keys = np.concatenate((self.hash, found[new]))
            place = np.concatenate((self.at, len(self.flat) + np.cumsum(n) - n))
            number = np.concatenate((self.n, n))
            order = np.argsort(keys, kind="stable")
            self.hash, self.at, self.n = keys[order], place[order], number[order]
            self.flat = np.concatenate((self.flat, values.astype(self.flat.dtype)))
            at = np.searchsorted(self.hash, found)
        return self.at[at][back], self.n[at][back]


def parts(texts: list[str], special: list[str]) -> tuple[list[str], list[int], list[tuple[int, int, str]]]:
    """Stretches to split on their own, the text each belongs to, and (text, stretches before it, string) of each special string."""
    pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    out, owner, marks = [], [], []
    for k, t in enumerate(texts):
        bits = pattern.split(t) if pattern and any(s in t for s in special) else [t]
        for j, bit in enumerate(bits):
            if j % 2:
                marks.append((k, len(out), bit))
                continue
            while len(bit) > PART and (m := GAP.search(bit, PART)):
                out.append(bit[: m.start()])
                owner.append(k)
                bit = bit[m.start() :]
            out.append(bit)
            owner.append(k)
    return out, owner, marks
