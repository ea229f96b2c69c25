"""Deltas of answers that arrive in pieces: keyed state holds what is unfinished between batches.

A run's answer is a byte stream of lines; ``data:`` lines hold a JSON object whose delta is
the next part of the answer, ``[DONE]`` ends it, other lines (heartbeats, dirt) count for nothing. Pieces may be cut
anywhere, inside a line or a character, and may come late: the state of a run is its unfinished line, the number of
the next piece and the pieces that wait for it. So batches and restarts leave no trace in the events.

A line without its end is not an event. Pieces that come again are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "next long, events long, done boolean, rest binary, waiting string"


def delta(line: bytes) -> str | None:
    """The delta of one line, None without one; the end of the answer is an empty text."""
    text = line.decode("utf-8", "replace").strip()
    if not text.startswith("data:"):
        return None
    payload = text[5:].strip()
    if payload == "[DONE]":
        return ""
    try:
        content = json.loads(payload)["choices"][0]["delta"]["content"]
    except (ValueError, LookupError, TypeError):
        return None
    return content if isinstance(content, str) and content else None


def parse(pieces: DataFrame) -> DataFrame:
    """run_id, seq, delta of each event, from a stream of pieces (run_id long, seq from 0, piece binary)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, events, done, rest, waiting = state.get if state.exists else (0, 0, False, b"", "{}")
        rest, waiting = bytes(rest), {int(k): base64.b64decode(v) for k, v in json.loads(waiting).items()}
        for frame in frames:
            waiting.update((int(s), bytes(p)) for s, p in zip(frame["seq"], frame["piece"]) if s >= at)
        found = [rest]
        while at in waiting:
            found.append(waiting.pop(at))
            at += 1
        *lines, rest = b"".join(found).split(b"\n")
        out = []
        for line in lines:
            part = None if done else delta(line)
            done = done or part == ""
            if part:
                out.append((key[0], events + len(out), part))
        left = "{}" if done else json.dumps({k: base64.b64encode(v).decode() for k, v in waiting.items()})
        state.update((at, events + len(out), done, b"" if done else rest, left))
        yield pd.DataFrame(out, columns=["run_id", "seq", "delta"])

    return pieces.groupBy("run_id").applyInPandasWithState(run, "run_id long, seq long, delta string", _STATE, "append", GroupStateTimeout.NoTimeout)
