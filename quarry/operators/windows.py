"""Chunks by running sums over a text's characters: fixed windows over units, and parts split at ever finer separators.

A batch of texts is one array of characters. Their classes give the units, and running
sums of weights, as whole twentieths of a token, give every window's end by search.
The reference weight of a window is a sum of doubles from the left; it is
added up that way only where the exact sum meets the size, as nowhere else
the two can fall to different sides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.functions.text import CJK, SPACE

OTHER, LETTER, DIGIT, BLANK, WIDE = range(5)
#: Characters of texts that are worked on at once (a longer text alone).
PART = 1 << 20


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((BLANK, f"[{SPACE}]"), (WIDE, f"[{CJK}]"), (LETTER, "[A-Za-z]"), (DIGIT, "[0-9]")):
        table[[c for c in range(0x10000) if re.match(pattern, chr(c))]] = kind
    return table


@cache
def _twentieths() -> np.ndarray:
    table = np.full(0x110000, 5, np.int64)
    table[_classes() == WIDE] = 20
    table[[ord(c) for c in " \n\t"]] = 4
    return table


class Units:
    """One text: the places where units begin (and its end), their weights, and running sums in twentieths by unit and by character."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _classes()[code]
        n = len(code)
        begins = np.ones(n, bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == OTHER) | (kind[1:] == WIDE)
        dots = np.flatnonzero((code[1:-1] == 46) & (kind[:-2] == DIGIT) & (kind[2:] == DIGIT)) + 1
        if len(dots):
            run = np.cumsum(begins)
            chained = np.zeros(len(dots), bool)  # the digits before are those after the last dot
            chained[1:] = run[dots[1:] - 1] == run[dots[:-1] + 1]
            place = np.arange(len(dots)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(dots))))
            taken = dots[place % 2 == 0]
            begins[taken] = begins[taken + 1] = False
        self.at = np.append(np.flatnonzero(begins), n)
        size, first = np.diff(self.at), kind[self.at[:-1]]
        self.sums = np.concatenate(([0], np.cumsum(_twentieths()[code])))
        self.unit_sums = self.sums[self.at]
        # a number weighs a quarter a character, with its dot
        weight = np.where((first == LETTER) | (first == DIGIT), 0.25 * size, np.where(first == WIDE, 1.0, 0.25))
        blank = np.flatnonzero(first == BLANK)
        weight[blank] = np.where(_twentieths()[code[self.at[blank]]] == 4, 0.2, 0.25)
        for u in blank[size[blank] > 1].tolist():
            weight[u] = np.cumsum(np.where(_twentieths()[code[self.at[u] : self.at[u + 1]]] == 4, 0.2, 0.25))[-1]
        self.weight, self.kind, self.code = weight, kind, code

    def reach(self, lo: int, after: int, goal: float) -> int:
        """The first unit from ``after`` on with which the units from ``lo`` on weigh ``goal``; their number if none does."""
        s, n = self.unit_sums, len(self.weight)
        # whole numbers: a double would have the sums copied as doubles for every window
        u = max(after, int(np.searchsorted(s, math.ceil(int(s[lo]) + 20 * goal - 1e-6))) - 1)
        while u < n and abs(s[u + 1] - s[lo] - 20 * goal) < 1e-3 and np.cumsum(self.weight[lo : u + 1])[-1] < goal:
            u += 1
        return min(u, n)

    def back(self, lo: int, end: int, goal: float) -> int:
        """How many units before ``end`` (and after ``lo``) it takes to weigh ``goal``, all if they don't; one at least."""
        s, most = self.unit_sums, end - lo - 1
        n = max(0, end - int(np.searchsorted(s, math.floor(int(s[end]) - 20 * goal + 1e-6), side="right")) + 1)
        while 0 < n <= most and abs(s[end] - s[end - n] - 20 * goal) < 1e-3 and np.cumsum(self.weight[end - n : end][::-1])[-1] < goal:
            n += 1
        return max(1, min(n, most))

    def tokens(self, lo: int, hi: int) -> int:
        """Estimated tokens of characters lo to hi: halves up, of a sum of doubles from the left."""
        q = int(self.sums[hi] - self.sums[lo])
        if q % 20 != 10:
            return (q + 10) // 20
        each = _twentieths()[self.code[lo:hi]]
        return int(np.floor(np.cumsum(np.where(each == 20, 1.0, np.where(each == 4, 0.2, 0.25)))[-1] + 0.5))

    def trimmed(self, lo: int, hi: int) -> tuple[int, int]:
        solid = np.flatnonzero(self.kind[lo:hi] != BLANK)
        return (lo + int(solid[0]), lo + int(solid[-1]) + 1) if len(solid) else (lo, lo)


def streamed(pieces: Iterable[str], size: float, overlap: float) -> Iterator[tuple[str, int, int, int]]:
    """Text, begin, end and tokens of each chunk of a text that comes in ``pieces``: windows that reach ``size``, without blanks at
    their ends; each begins with units worth ``overlap`` of the one before. Of the text a stretch is held at a time.
    """
    pieces, held, base, ahead, room = iter(pieces), "", 0, 0, PART
    while True:
        while len(held) <= room and (piece := next(pieces, None)) is not None:
            held += piece
        # a stretch from a window's begin on; its last units may go on behind it, so no window there is taken
        whole, u = len(held) <= room, Units(held[:room])
        n, lo, after = len(u.weight), 0, ahead
        while lo < n and after <= n:
            last = u.reach(lo, after, size)
            if last >= n - 4 and not whole:
                break
            a, b = u.trimmed(int(u.at[lo]), int(u.at[min(last + 1, n)]))
            if b > a:
                yield held[a:b], base + a, base + b, u.tokens(a, b)
            if last >= n:
                break
            after = last + 1
            lo = after if overlap <= 0 else after - u.back(lo, after, overlap)
        if whole:
            return
        room = PART if lo else 2 * room
        base, held, ahead = base + int(u.at[lo]), held[int(u.at[lo]) :], after - lo


def spans(text: str, size: float, overlap: float) -> list[tuple[int, int, int]]:
    """Begin, end and tokens of each chunk of ``text``, as ``streamed`` gives them."""
    return [x[1:] for x in streamed((text[k : k + PART] for k in range(0, len(text), PART)), size, overlap)]


def parts(u: Units, text: str, size: float, separators: list[str]) -> list[tuple[int, int]]:
    """Begin and end of the stretches of ``text`` that splitting at ever finer separators leaves, wherever one has more than ``size`` tokens."""
    found = [(0, len(text))]
    for sep in separators:
        finer = []
        for lo, hi in found:
            if u.tokens(lo, hi) <= size:
                finer.append((lo, hi))
                continue
            at = lo
            for piece in text[lo:hi].split(sep):
                if piece:
                    finer.append((at, at + len(piece)))
                at += len(piece) + len(sep)
        found = finer
    return found


def tail(text: str, n: float) -> str:
    """The last units of a text that are worth ``n``."""
    u = Units(text)
    end = len(u.weight)
    return text[slice(*u.trimmed(int(u.at[end - u.back(-1, end, n)]), len(text)))] if end else ""


def recursive(text: str, size: float, overlap: float, separators: list[str]) -> list[str]:
    """Parts of ``text`` joined from the left while they stay within ``size`` tokens, with a line end between two that have
    none there; each begins with units worth ``overlap`` of the one before.
    """
    u, blocks, held, weight = Units(text), [], "", 0
    some = parts(u, text, size, separators)
    for k, (lo, hi) in enumerate(some):
        own = int(u.sums[hi] - u.sums[lo])
        glue = "" if text[lo] == "\n" or k and text[some[k - 1][1] - 1] == "\n" else "\n"
        q = weight + own + 4 * len(glue)
        # at a half token rounding follows the sum of doubles over the whole text
        n = (q + 10) // 20 if q % 20 != 10 else Units(held + glue + text[lo:hi]).tokens(0, len(held) + len(glue) + hi - lo)
        if k and n <= size:
            held, weight = held + glue + text[lo:hi], q
            continue
        if k:
            blocks.append(held)
        held, weight = text[lo:hi], own
    blocks = [stripped(b) for b in [*blocks, held]] if some else []
    if blocks and not blocks[-1]:
        blocks.pop()
    if overlap <= 0:
        return blocks
    heads = ["", *(tail(b, overlap) for b in blocks[:-1])]
    return [stripped(f"{h}\n{b}") if h else b for h, b in zip(heads, blocks)]


BLANKS = "".join(chr(c) for c in range(0x10000) if re.match(f"[{SPACE}]", chr(c)))


def stripped(text: str) -> str:
    return text.strip(BLANKS)


def _by_text(docs: DataFrame, keep: list[str], name: str, made, kind: pa.DataType, sql: str) -> DataFrame:
    """``keep`` of ``docs`` and ``name``: what ``made`` gives of each row's text; a bounded part of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column("text").to_pylist(), 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and chars < PART:
                    chars += len(texts[hi])
                    hi += 1
                found = pa.array([made(t) for t in texts[lo:hi]], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), found], [*keep, name])
                lo = hi

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{own}, {name} {sql}")


def windows(docs: DataFrame, size: float, overlap: float, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with ``windows``: an array of text, begin, end (in characters), tokens of each row's fixed windows."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())]))
    made = lambda t: [{"text": t[a:b], "begin": a, "end": b, "tokens": k} for a, b, k in spans(t, size, overlap)]
    return _by_text(docs, keep, "windows", made, kind, "array<struct<text:string,begin:long,end:long,tokens:long>>")


def recursive_blocks(docs: DataFrame, size: float, overlap: float, separators: list[str], keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with ``blocks``: the chunks of each row's text by the recursive strategy."""
    return _by_text(docs, keep, "blocks", lambda t: recursive(t, size, overlap, separators), pa.list_(pa.string()), "array<string>")
