"""Operator 1, token counts: rank-synchronous merging of ragged symbol arrays.

Words are split in numpy (words.py). A batch's distinct words that are not known yet
are laid out as one flat array of symbols with an array of start offsets. Every round finds the lowest merge rank of each
sequence (one segmented minimum), applies that pair at all of its places in all
sequences at once, and closes the gaps. What is left of a sequence when no pair
has a rank is its token count. Counts of short words are remembered per worker.

A word of very many characters takes rounds that grow with its length.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated
results; other columns are ignored. No shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices, texts
from quarry.llm.words import Memo, Words, parts

NONE = np.iinfo(np.int32).max


def byte_symbols() -> dict[int, str]:
    """byte -> printable character, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeTable:
    """Merge ranks of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        self.symbol = np.zeros(256, np.int64)
        for byte, char in byte_symbols().items():
            self.symbol[byte] = vocab[char]
        self.special = [t["content"] for t in spec["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) word after all merges."""
        size = np.array([len(w) for w in words], np.int64)
        left_over = size.copy()
        sym = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        who = np.arange(len(words))
        rank = self._pair_ranks(sym, size)
        while len(who):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            live = least < NONE
            if not live.all():  # sequences without a ranked pair are done
                keep = np.repeat(live, size)
                left_over[who[~live]] = size[~live]
                who, size, least, sym, rank = who[live], size[live], least[live], sym[keep], rank[keep]
                if not len(who):
                    break
                start = np.cumsum(size) - size
            hit = rank == np.repeat(least, size)
            at = np.arange(len(hit))
            first = hit & ~np.concatenate(([False], hit[:-1]))
            run = np.maximum.accumulate(np.where(first, at, 0))
            take = np.flatnonzero(hit & ((at - run) % 2 == 0))  # a run of one pair (aaa) merges from the left
            sym[take] = self.made[rank[take]]
            stay = np.ones(len(sym), bool)
            stay[take + 1] = False
            size = np.add.reduceat(stay.astype(np.int64), start)
            place = np.cumsum(stay) - 1
            sym, rank = sym[stay], rank[stay]
            now = place[take]
            last = np.zeros(len(sym), bool)
            last[np.cumsum(size) - 1] = True
            touched = np.unique(np.concatenate((now, now[now > 0] - 1)))
            inner = touched[~last[touched]]
            rank[touched] = NONE
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        return left_over

    def _pair_ranks(self, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NONE
        return rank


class Counter:
    """Token counts of whole texts by a merge table."""

    def __init__(self, path: str):
        self.table, self.memo = MergeTable(path), Memo(np.int32)

    def _count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(words), np.int64), self.table.count([w.encode() for w in words])

    def texts(self, batch: list[str]) -> np.ndarray:
        some, owner, marks = parts(batch, self.table.special)
        words = Words(some, byte_level=True)
        at, _ = self.memo.look_up(words, self._count)
        out = np.zeros(len(batch), np.int64)
        np.add.at(out, np.array(owner, np.int64)[words.text], self.memo.flat[at])
        np.add.at(out, [m[0] for m in marks], 1)  # a special token's string is one token, as the library has it
        return out


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    ``tokenizer``: a byte-level BPE file of the tokenizers library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = Counter(tokenizer)
        for b in slices(batches):
            n = _counters[tokenizer].texts(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
        .mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
