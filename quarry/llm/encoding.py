"""Token ids of whole texts by the tokenizers library, which encodes each distinct word once per worker memo."""

from __future__ import annotations

import json
import os

import numpy as np

from quarry.llm.words import Memo, Words, parts


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = spec["normalizer"] is None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = Memo(self.dtype)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return n, np.fromiter((i for x in ids for i in x), self.dtype, int(n.sum()))

    def texts(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids, one text after the other."""
        some, owner, marks = parts(batch, list(self.special))
        words = Words(some, self.byte_level)
        at, n = self.memo.look_up(words, self._encode)
        total = int(n.sum())
        ids = self.memo.flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)]
        per_part = np.zeros(len(some), np.int64)
        np.add.at(per_part, words.text, n)
        per_text = np.zeros(len(batch), np.int64)
        np.add.at(per_text, np.array(owner, np.int64), per_part)
        if marks:
            before = np.concatenate(([0], np.cumsum(per_part)))
            ids = np.insert(ids, before[[m[1] for m in marks]], [self.special[m[2]] for m in marks])
            np.add.at(per_text, [m[0] for m in marks], 1)
        return per_text, ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
