"""The chunk strategies over one text at a time, weighed character by character: what the array expressions are held against."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from quarry.operators.chunking import ChunkConfig

_CJK = "\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af\uf900-\ufaff"
_WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_UNIT = re.compile(f"[{_CJK}]|[A-Za-z]+|[0-9]+(?:\\.[0-9]+)?|[{_WHITE}]+|[^{_WHITE}]")
_SENTENCE = re.compile("[^。！？!?；;\n]+[。！？!?；;]?[\"'”’）)]*|\n+")
_IS_CJK = re.compile(f"[{_CJK}]")
_HEADING = re.compile(f"^#{{1,6}}[{_WHITE}]+")
#: The separators of the recursive strategy, coarse to fine.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "；", "，", " "]


def _strip(t: str) -> str:
    return t.strip(_WHITE)


def weigh(t: str) -> float:
    total = 0.0
    for ch in t:
        total += 1 if _IS_CJK.match(ch) else 0.2 if ch in " \n\t" else 0.25
    return total


def tokens(t: str) -> int:
    return math.floor(weigh(t) + 0.5)


def slide(text: str, size: float, overlap: float) -> list[str]:
    """Windows over units that reach ``size``; each starts with units worth ``overlap`` of the one before."""
    out, held, total = [], [], 0.0
    for unit in _UNIT.findall(text):
        held.append((unit, weigh(unit)))
        total += held[-1][1]
        if total < size:
            continue
        out.append("".join(u for u, _ in held))
        carry, back = 0, 0.0
        if overlap > 0:
            while carry < len(held) - 1 and back < overlap:
                carry += 1
                back += held[-carry][1]
            held = held[-max(1, carry) :]
        else:
            held = []
        total = 0.0
        for _, w in held:
            total += w
    if held:
        out.append("".join(u for u, _ in held))
    return [s for s in map(_strip, out) if s]


def tail(text: str, n: float) -> str:
    """Last units of a text worth ``n``."""
    kept, total = [], 0.0
    for unit in reversed(_UNIT.findall(text) if n > 0 else []):
        if total >= n:
            break
        kept.append(unit)
        total += weigh(unit)
    return _strip("".join(reversed(kept)))


def with_overlap(chunks: list[str], n: float) -> list[str]:
    if n <= 0:
        return chunks
    heads = ["", *(tail(c, n) for c in chunks[:-1])]
    return [_strip(f"{h}\n{c}") if h else c for h, c in zip(heads, chunks)]


def greedy(parts: list[str], limit: float, join: Callable[[str, str], str]) -> list[str]:
    """Parts joined from the left while they stay within ``limit``."""
    out, held = [], ""
    for part in parts:
        longer = join(held, part) if held else part
        if held and tokens(longer) > limit:
            out.append(_strip(held))
            held = part
        else:
            held = longer
    return [*out, _strip(held)] if _strip(held) else out


def split_sentences(text: str) -> list[str]:
    found = (_strip(s) for s in _SENTENCE.findall(re.sub("\r\n?", "\n", text)))
    return [s for s in found if s]


def split_paragraphs(text: str) -> list[str]:
    flat = re.sub("\r\n?", "\n", text)
    parts = re.split(f"\n[{_WHITE}]*\n", flat)
    return [p for p in map(_strip, parts if len(parts) > 1 else flat.split("\n")) if p]


def recursive(text: str, cfg: ChunkConfig) -> list[str]:
    parts = [text]
    for sep in SEPARATORS:
        parts = [q for p in parts for q in ([x for x in p.split(sep) if x] if tokens(p) > cfg.size else [p])]
        if all(tokens(p) <= cfg.size for p in parts):
            break
    glue = lambda a, b: a + ("" if a.endswith("\n") or b.startswith("\n") else "\n") + b
    return with_overlap(greedy(parts, cfg.size, glue), cfg.overlap)


def by_paragraph(text: str, cfg: ChunkConfig) -> list[str]:
    blocks = greedy(split_paragraphs(text), cfg.paragraph_max, lambda a, b: f"{a}\n\n{b}")
    if cfg.merge_small and len(blocks) > 1 and tokens(blocks[-1]) < 60:
        blocks[-2:] = [f"{blocks[-2]}\n\n{blocks[-1]}"]
    if cfg.overlap_paragraphs <= 0:
        return blocks
    heads = ["", *("\n\n".join(split_paragraphs(b)[-cfg.overlap_paragraphs :]) for b in blocks[:-1])]
    return [_strip(f"{h}\n\n{b}") if h else b for h, b in zip(heads, blocks)]


def by_sentence(text: str, cfg: ChunkConfig) -> list[str]:
    """What the semantic strategy falls back on without vectors."""
    blocks = greedy(split_sentences(text), cfg.semantic_max, lambda a, b: a + b)
    if len(blocks) > 1 and tokens(blocks[-1]) < cfg.semantic_min:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    return blocks


def semantic(text: str, cfg: ChunkConfig, embed: Callable[[list[str]], list[list[float]]]) -> list[str]:
    """Sentences grouped until neighbours differ or a group is full; small groups are merged."""
    sentences = split_sentences(text)
    if len(sentences) < 2:
        return by_sentence(text, cfg)
    vectors = embed(sentences)
    sims = [cosine(a, b) for a, b in zip(vectors, vectors[1:])]
    limit = cfg.threshold
    if cfg.threshold_mode == "percentile":
        limit = sorted(sims)[math.floor((len(sims) - 1) * min(100, max(0, cfg.percentile)) / 100)]
    most = max(128, cfg.semantic_max - cfg.overlap)
    groups, total = [sentences[0]], tokens(sentences[0])
    for sim, s in zip(sims, sentences[1:]):
        n = tokens(s)
        if sim < limit or total + n > most:
            groups.append(s)
            total = n
        else:
            groups[-1] += s
            total += n
    merged: list[str] = []
    for g in groups:
        if merged and min(tokens(g), tokens(merged[-1])) < cfg.semantic_min and tokens(g) + tokens(merged[-1]) <= most:
            merged[-1] += g
        else:
            merged.append(g)
    return with_overlap([t for t in map(_strip, merged) if t], cfg.overlap)


def cosine(a: list[float], b: list[float]) -> float:
    if not a or not b or len(a) != len(b):
        return 0.0
    dot, na, nb = (math.fsum(x * y for x, y in zip(p, q)) for p, q in ((a, b), (a, a), (b, b)))
    return dot / math.sqrt(na * nb) if na and nb else 0.0


def move_headings(chunks: list[str]) -> list[str]:
    """A heading that ends a chunk goes to the head of the next."""
    chunks = list(chunks)
    for i in range(len(chunks) - 1):
        lines = chunks[i].split("\n")
        last = _strip(lines[-1])
        if len(lines) > 1 and _HEADING.match(last):
            chunks[i] = _strip("\n".join(lines[:-1]))
            chunks[i + 1] = _strip(f"{last}\n{chunks[i + 1]}")
    return [c for c in chunks if c]


def cut(text: str | None, cfg: ChunkConfig, embed: Callable | None = None) -> list[str]:
    """Chunks of one text."""
    if not text or not _strip(text):
        return []
    if cfg.strategy == "recursive":
        found = recursive(text, cfg)
    elif cfg.strategy == "paragraph":
        found = by_paragraph(text, cfg)
    elif cfg.strategy == "semantic":
        found = semantic(text, cfg, embed) if embed else by_sentence(text, cfg)
    else:
        found = slide(text, cfg.size, cfg.overlap)
    return [c for c in map(_strip, move_headings(found) if cfg.markdown else found) if c]
