"""Hashed words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)
_IS_WORD = None
_SPACE = re.compile(r"\s")


def is_word() -> np.ndarray:
    """Whether each code point belongs to words: letters, digits and underscores."""
    global _IS_WORD
    if _IS_WORD is None:
        _IS_WORD = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
    return _IS_WORD


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    return h ^ (h >> np.uint64(32))


def cut(text: str, most: int) -> Iterator[str]:
    """Pieces of a text that begin at white space, of at least ``most`` characters but for the last."""
    begin = 0
    while len(text) - begin > most and (edge := _SPACE.search(text, begin + most)):
        yield text[begin : edge.start()]
        begin = edge.start()
    yield text[begin:] if begin else text


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [f"{t.lower()} " if t else " " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = is_word()[chars]
    before = np.append(False, inside[:-1])
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    last = np.flatnonzero(inside & ~np.append(inside[1:], False))
    length = last - first + 1
    at = np.flatnonzero(inside)
    of = np.repeat(np.cumsum(length) - length, length)
    odd = (2 * (np.arange(len(at)) - of) + 1).astype(np.uint64)
    parts = finish((chars[at].astype(np.uint64) + _MIX) * odd * _MIX + odd)
    words = finish(np.add.reduceat(parts, np.cumsum(length) - length))
    ends = np.cumsum(sizes)
    n = np.searchsorted(first, ends, "left")
    return words, np.diff(np.append(0, n))


def word_hashes(texts: list[str | None], slice_chars: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text.

    Texts are taken in slices, long ones cut at white space, so what is held beside the hashes is bounded."""
    words, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    part: list[str | None] = []
    own: list[int] = []
    size = 0

    def done() -> None:
        got, n = _hashes(part)
        words.append(got)
        np.add.at(counts, own, n)
        part.clear(), own.clear()

    for i, text in enumerate(texts):
        for piece in cut(text, slice_chars) if text else ():
            if part and size + len(piece) > slice_chars:
                done()
                size = 0
            part.append(piece)
            own.append(i)
            size += len(piece)
    if part:
        done()
    return np.concatenate(words), counts


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted set of hashed shingles of each text. A text of fewer words has one shingle of all its words, one without words none."""
    words, counts = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _MIX + words[i : i + n]
    h = finish(h)
    out, at = [], 0
    for k in counts.tolist():
        if k >= width:
            out.append(np.unique(h[at : at + k - width + 1]))
        else:
            short = np.zeros(min(k, 1), np.uint64)
            for w in words[at : at + k]:
                short = short * _MIX + w + np.uint64(k)
            out.append(finish(short))
        at += k
    return out
