"""Lossless WebP images of bytes: an encoder and a decoder in numpy.

The decoder reads the whole lossless format: prefix codes (simple and normal), groups of them chosen by an entropy
image, back-references with the two-dimensional distance map, the colour cache, and the inverse predictor,
cross-colour, subtract-green and palette transforms. Images with one group of codes are decoded in vectorised passes,
many at a time where they share their codes: what a symbol would be at every bit position is looked up, only the chain
of symbols is followed one by one, and back-references and cache codes become pointers to earlier pixels, which are
resolved by pointer jumping.

``store`` writes a document's bytes as pixels, and chooses for each image by its content alone, so equal texts are
equal images: back-references wherever they are shorter than literals; the colour cache if it makes the image smaller;
codes of its own if it has at least ``OWN_PIXELS`` pixels, else codes that are the same for all. An image in which
half of the pixels equal their left or upper neighbour is also encoded under the transform (palette, subtract-green,
predictor or cross-colour) after which its pixels have the least entropy, and stays so if that is smaller.

Cases: null and empty texts are one row of blanks; texts over ``TILE_ROWS`` rows of 64 pixels become several images,
one after the other; rows that repeat each get their own result; broken images raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tributary.llm.common import arrow_map, slices, starts, utf8

ROW_PIXELS = 64
UNIT = 3 * ROW_PIXELS
TILE_ROWS = 4096
OWN_PIXELS = 8192

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
_MOST = 15
_CACHE_BITS, _LEAST_COPY, _MOST_COPY = 6, 3, 4096


# Prefix codes


def code_lengths(weights: list[int], most: int = _MOST) -> list[int]:
    """Huffman code lengths; weights are flattened until no length is over ``most``."""
    weights = list(weights)
    used = [i for i, w in enumerate(weights) if w > 0]
    out = [0] * len(weights)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    while True:
        heap = [(weights[i], i, (i,)) for i in used]
        heapq.heapify(heap)
        for i in used:
            out[i] = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                out[i] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(out) <= most:
            return out
        weights = [(w + 1) // 2 if w else 0 for w in weights]


def canonical(lengths: list[int]) -> list[int]:
    """Codes of the lengths, bit-reversed, as the stream has them: first bit lowest."""
    code, size, out = 0, 0, [0] * len(lengths)
    for n, i in sorted((n, i) for i, n in enumerate(lengths) if n):
        code <<= n - size
        size = n
        out[i] = int(format(code, f"0{n}b")[::-1], 2)
        code += 1
    return out


@dataclass
class PrefixCode:
    """symbol[w], length[w] for each window w of 15 bits."""

    symbol: np.ndarray
    length: np.ndarray
    single: bool

    @classmethod
    def of(cls, lengths: list[int]) -> PrefixCode:
        used = [i for i, n in enumerate(lengths) if n]
        symbol, length = np.zeros(1 << _MOST, np.uint16), np.zeros(1 << _MOST, np.uint8)
        if len(used) <= 1:
            symbol[:] = used[0] if used else 0
            return cls(symbol, length, True)
        if sum(1 << (_MOST - lengths[i]) for i in used) != 1 << _MOST:
            raise ValueError("a prefix code that is not complete")
        codes = canonical(lengths)
        for i in used:
            symbol[codes[i] :: 1 << lengths[i]] = i
            length[codes[i] :: 1 << lengths[i]] = lengths[i]
        return cls(symbol, length, False)


class _Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0
        self.end = 8 * len(data)

    def get(self, bits: int) -> int:
        value = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << bits) - 1)
        self.at += bits
        if self.at > self.end:
            raise ValueError("the image ends early")
        return value

    def symbol(self, code: PrefixCode) -> int:
        w = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7) & 0x7FFF
        self.at += int(code.length[w])
        if self.at > self.end:
            raise ValueError("the image ends early")
        return int(code.symbol[w])


def _write_code(out: _Writer, lengths: list[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 1 and all(i < 256 for i in used):
        first = used[0] if used else 0
        out.put(1, 1), out.put(0, 1), out.put(int(first > 1), 1), out.put(first, 8 if first > 1 else 1)
        return
    out.put(0, 1)
    tokens: list[tuple[int, int, int]] = []
    i, before = 0, 8
    while i < len(lengths):
        n = lengths[i]
        run = next((j for j in range(i, len(lengths)) if lengths[j] != n), len(lengths)) - i
        if n == 0 and run >= 3:
            take = min(run, 138)
            tokens.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
        elif n and n == before and run >= 3:
            take = min(run, 6)
            tokens.append((16, take - 3, 2))
        else:
            take, before = 1, n or before
            tokens.append((n, 0, 0))
        i += take
    weights = [0] * 19
    for t, _, _ in tokens:
        weights[t] += 1
    if sum(w > 0 for w in weights) < 2:
        weights[next(k for k in (0, 1) if not weights[k])] = 1
    own = code_lengths(weights, 7)
    codes = canonical(own)
    count = max(4, max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]) + 1)
    out.put(count - 4, 4)
    for s in CODE_LENGTH_ORDER[:count]:
        out.put(own[s], 3)
    out.put(0, 1)
    for t, extra, bits in tokens:
        out.put(codes[t], own[t])
        out.put(extra, bits)


def _read_code(src: _Reader, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if src.get(1):
        two, wide = src.get(1), src.get(1)
        symbols = [src.get(8 if wide else 1)] + ([src.get(8)] if two else [])
        for s in symbols:
            if s >= alphabet:
                raise ValueError("a symbol outside its alphabet")
            lengths[s] = 1
        return PrefixCode.of(lengths)
    own = [0] * 19
    for s in CODE_LENGTH_ORDER[: 4 + src.get(4)]:
        own[s] = src.get(3)
    code = PrefixCode.of(own)
    left = 2 + src.get(2 + 2 * src.get(3)) if src.get(1) else alphabet
    i, before = 0, 8
    while i < alphabet and left:
        left -= 1
        t = src.symbol(code)
        if t < 16:
            lengths[i] = t
            before, i = t or before, i + 1
            continue
        value, run = (before, 3 + src.get(2)) if t == 16 else (0, 3 + src.get(3)) if t == 17 else (0, 11 + src.get(7))
        if i + run > alphabet:
            raise ValueError("too many code lengths")
        lengths[i : i + run] = [value] * run
        i += run
    return PrefixCode.of(lengths)


# Entropy-coded images; pixels are uint32 ARGB


def _prefix_value(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    half = v >> extra & 1
    return 2 * extra + 2 + half, v - ((2 + half) << extra), extra


def _from_prefix(prefix: int, src: _Reader) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + src.get(extra) + 1


def _tokens(pixels: np.ndarray, cache_bits: int, back_references: bool) -> list[tuple]:
    """("lit", argb), ("cache", index) and ("copy", length, distance code) of a plain image."""
    values = pixels.reshape(-1).tolist()
    cache = [None] * (1 << cache_bits) if cache_bits else None
    seen: dict[tuple, int] = {}
    out: list[tuple] = []
    i = 0

    def add(j: int) -> None:
        if cache is not None:
            cache[(CACHE_FACTOR * values[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[j]
        if back_references:
            seen[tuple(values[j : j + 3])] = j

    while i < len(values):
        j = seen.get(tuple(values[i : i + 3])) if back_references and i + 3 <= len(values) else None
        if j is not None:
            n = 3
            while i + n < len(values) and n < 4096 and values[j + n] == values[i + n]:
                n += 1
            out.append(("copy", n, i - j + 120))
            for k in range(i, i + n):
                add(k)
            i += n
            continue
        at = (CACHE_FACTOR * values[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache is not None else 0
        out.append(("cache", at) if cache is not None and cache[at] == values[i] else ("lit", values[i]))
        add(i)
        i += 1
    return out


def _write_image(out: _Writer, pixels: np.ndarray, *, main: bool, cache_bits: int = 0, back_references: bool = False) -> None:
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    tokens = _tokens(pixels, cache_bits, back_references)
    weights = [[0] * (280 + ((1 << cache_bits) if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    coded: list[list[tuple[int, int, int, int]]] = []
    for t in tokens:
        if t[0] == "lit":
            a, r, g, b = t[1] >> 24, t[1] >> 16 & 255, t[1] >> 8 & 255, t[1] & 255
            row = [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        elif t[0] == "cache":
            row = [(0, 280 + t[1], 0, 0)]
        else:
            p, x, n = _prefix_value(t[1])
            q, y, m = _prefix_value(t[2])
            row = [(0, 256 + p, x, n), (4, q, y, m)]
        for c, s, _, _ in row:
            weights[c][s] += 1
        coded.append(row)
    lengths = [code_lengths(w) for w in weights]
    for n in lengths:
        _write_code(out, n)
    codes = [canonical(n) for n in lengths]
    single = [sum(x > 0 for x in n) <= 1 for n in lengths]
    for row in coded:
        for c, s, x, n in row:
            if not single[c]:
                out.put(codes[c][s], lengths[c][s])
            out.put(x, n)


@dataclass
class _Group:
    green: PrefixCode
    red: PrefixCode
    blue: PrefixCode
    alpha: PrefixCode
    distance: PrefixCode


def _read_image(src: _Reader, width: int, height: int, *, main: bool) -> np.ndarray:
    cache_bits = src.get(4) if src.get(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of over 11 bits")
    meta, meta_bits, groups_n = None, 0, 1
    if main and src.get(1):
        meta_bits = src.get(3) + 2
        meta = _read_image(src, -(-width >> meta_bits), -(-height >> meta_bits), main=False)
        meta = (meta >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        groups_n = int(meta.max()) + 1
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [_Group(*[_read_code(src, n) for n in sizes]) for _ in range(groups_n)]
    if meta is None:
        g = groups[0]
        first = src.at >> 3
        pixels, ends = _pixels(np.frombuffer(src.data, np.uint8)[first : (src.end + 7) >> 3], g, cache_bits, width, [src.at - 8 * first], [width * height])
        src.at = 8 * first + ends[0]
        if src.at > src.end:
            raise ValueError("the image ends early")
        return pixels.reshape(height, width)
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    i = 0
    while i < total:
        g = groups[int(meta[(i // width) >> meta_bits, (i % width) >> meta_bits])] if meta is not None else groups[0]
        s = src.symbol(g.green)
        if s < 256:
            red, blue, alpha = src.symbol(g.red), src.symbol(g.blue), src.symbol(g.alpha)
            fresh = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n = _from_prefix(s - 256, src)
            d = _from_prefix(src.symbol(g.distance), src)
            if d > 120:
                d -= 120
            else:
                x, y = DISTANCE_MAP[d - 1]
                d = max(1, x + y * width)
            if d > i or i + n > total:
                raise ValueError("a reference outside the image")
            fresh = out[i - d : min(i, i - d + n)]
            fresh = (fresh * (-(-n // len(fresh))))[:n]
        else:
            if cache is None:
                raise ValueError("a cache code without a cache")
            fresh = [cache[s - 280]]
        out[i : i + len(fresh)] = fresh
        i += len(fresh)
        if cache is not None:
            for v in fresh:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
    return np.array(out, np.uint32).reshape(height, width)


def _windows(data: np.ndarray) -> np.ndarray:
    """The 15 bits from each bit position of data (which has two spare bytes)."""
    w = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
    return ((w[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).astype(np.uint16).reshape(-1)


def _extra_bits(prefix: np.ndarray) -> np.ndarray:
    return np.where(prefix < 4, 0, (prefix - 2) >> 1)


def _values(data: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths or distances from their prefixes and the extra bits at some bit positions."""
    n = _extra_bits(prefix)
    byte = at >> 3
    word = sum(data[np.minimum(byte + i, len(data) - 1)].astype(np.int64) << (8 * i) for i in range(4))
    extra = word >> (at & 7) & ((1 << n) - 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + extra + 1)


def _distances(codes: np.ndarray, width: int) -> np.ndarray:
    near = np.array([0] + [max(1, x + y * width) for x, y in DISTANCE_MAP])
    return np.where(codes > 120, codes - 120, near[np.minimum(codes, 120)])


def _pixels(data: np.ndarray, g: _Group, cache_bits: int, width: int, begin: list[int], pixels: list[int]) -> tuple[np.ndarray, list[int]]:
    """ARGB values of images that follow each other in data and share their codes, and the bit after each image."""
    data = np.concatenate([data, np.zeros(12, np.uint8)])
    window = _windows(data)
    size = np.int32(len(window) - 1)
    place = np.arange(len(window), dtype=np.int32)
    green = g.green.symbol[window]
    after_green = np.minimum(place + g.green.length[window], size)
    step = after_green
    for code in (g.red, g.blue, g.alpha):
        if not code.single:
            step = np.minimum(step + code.length[window[step]], size)
    grow = np.ones(len(window), np.int32)
    odd = np.flatnonzero(green >= 256)
    if len(odd):
        step = step.copy() if step is after_green else step
        step[odd] = after_green[odd]  # cache codes are the green symbol alone
        odd = odd[green[odd] < 280]
        prefix = green[odd].astype(np.int64) - 256
        grow[odd] = _values(data, after_green[odd].astype(np.int64), prefix)
        at = np.minimum(after_green[odd] + _extra_bits(prefix), size)
        distance = g.distance.symbol[window[at]].astype(np.int64)
        step[odd] = np.minimum(at + g.distance.length[window[at]] + _extra_bits(distance), size)
    # the chain of symbols
    steps, grows, marks, ends = memoryview(step), memoryview(grow), array("i"), []
    add = marks.append
    for p, n in zip(begin, pixels, strict=True):
        while n > 0:
            add(p)
            n -= grows[p]
            p = steps[p]
        if n:
            raise ValueError("a reference beyond the image")
        ends.append(p)
    at = np.frombuffer(marks, np.int32).astype(np.int64)
    symbol, length = green[at].astype(np.int64), grow[at].astype(np.int64)
    total = int(sum(pixels))
    first = np.cumsum(length) - length  # pixel of each symbol
    image = np.repeat(np.array([sum(pixels[:0])] + pixels[:-1]).cumsum(), pixels) if len(pixels) > 1 else np.zeros(total, np.int64)
    value = np.zeros(total + 1, np.uint32)  # the last one is an empty place of the cache
    source = np.arange(total + 1)
    literal = np.flatnonzero(symbol < 256)
    p, parts = after_green[at[literal]], []
    for code in (g.red, g.blue, g.alpha):
        parts.append(code.symbol[window[p]].astype(np.uint32))
        if not code.single:
            p = np.minimum(p + code.length[window[p]], size)
    red, blue, alpha = parts
    value[first[literal]] = alpha << np.uint32(24) | red << np.uint32(16) | symbol[literal].astype(np.uint32) << np.uint32(8) | blue
    copies = np.flatnonzero((symbol >= 256) & (symbol < 280))
    if len(copies):
        start = after_green[at[copies]].astype(np.int64) + _extra_bits(symbol[copies] - 256)
        prefix = g.distance.symbol[window[np.minimum(start, size)]].astype(np.int64)
        back = _distances(_values(data, start + g.distance.length[window[np.minimum(start, size)]], prefix), width)
        n = length[copies]
        copied = np.repeat(first[copies] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        source[copied] = copied - np.repeat(back, n)
        if (source[copied] < image[copied]).any():
            raise ValueError("a reference outside the image")
        _resolve(source, copied)
    cached = np.flatnonzero(symbol >= 280)
    if len(cached):
        if not cache_bits:
            raise ValueError("a cache code without a cache")
        key = (value[:-1] * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int64)
        at_cache = first[cached]
        key[at_cache] = symbol[cached] - 280
        key = key[source[:-1]]
        before = _previous(image << 11 | key)
        source[at_cache] = np.where(before[at_cache] < 0, total, before[at_cache])
        _resolve(source, np.flatnonzero(source[:-1] != np.arange(total)))
    return value[source[:-1]], ends


def _resolve(source: np.ndarray, at: np.ndarray) -> None:
    """Let the pointers of some pixels point to where their chains of pointers end."""
    while len(at):
        further = source[source[at]]
        moved = further != source[at]
        source[at] = further
        at = at[moved]


def _previous(keys: np.ndarray) -> np.ndarray:
    """For each element the place of the one before it with an equal key, -1 without one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


# Transforms; images as (height, width, 4) int arrays in the order A, R, G, B


def _split(pixels: np.ndarray) -> np.ndarray:
    return np.stack([(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def _join(parts: np.ndarray) -> np.ndarray:
    p = (parts & 255).astype(np.uint32)
    return p[..., 0] << np.uint32(24) | p[..., 1] << np.uint32(16) | p[..., 2] << np.uint32(8) | p[..., 3]


def _predict(mode: int, left, top, top_right, top_left) -> list[int]:
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return avg(avg(left, top_right), top)
    if mode < 10:
        return avg(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return avg(avg(left, top_left), avg(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))  # how far left is from left + top - top_left
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    mean = avg(left, top)
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, top_left, strict=True)]


def _unpredict(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from what is left after prediction, one after the other."""
    source = _split(pixels).reshape(-1, 4).tolist()
    height, width = pixels.shape
    done: list = []
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if i == 0:
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = done[-1]
            elif x == 0:
                guess = done[i - width]
            else:
                guess = _predict(int(modes[y >> bits, x >> bits]), done[-1], done[i - width], done[i - width + 1], done[i - width - 1])
            done.append([(v + g) & 255 for v, g in zip(source[i], guess, strict=True)])
    return _join(np.array(done, np.int32).reshape(height, width, 4))


def _cross_color(pixels: np.ndarray, table: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    height, width = pixels.shape
    p, t = _split(pixels), _split(table)
    t = t[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: (v & 255).astype(np.int8).astype(np.int32)
    delta = lambda a, b: signed(a) * signed(b) >> 5
    sign = 1 if inverse else -1
    red, green, blue = p[..., 1], p[..., 2], p[..., 3]
    new_red = red + sign * delta(t[..., 3], green)
    of_red = new_red if inverse else red
    new_blue = blue + sign * (delta(t[..., 2], green) + delta(t[..., 1], of_red))
    return _join(np.stack([p[..., 0], new_red, green, new_blue], axis=-1))


def _subtract_green(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    p = _split(pixels)
    sign = 1 if inverse else -1
    return _join(np.stack([p[..., 0], p[..., 1] + sign * p[..., 2], p[..., 2], p[..., 3] + sign * p[..., 2]], axis=-1))


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _expand_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(palette))
    index = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if bits:
        x = np.arange(width)
        depth = 8 >> bits
        index = index[:, x >> bits] >> (depth * (x & ((1 << bits) - 1))) & ((1 << depth) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


# Whole images


def _guesses(pixels: np.ndarray) -> list[np.ndarray]:
    """What each of the 14 predictors gives at each pixel, but for the first row and column, where the format fixes it."""
    p = _split(pixels)
    top, left, corner = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    top[1:], left[:, 1:], corner[1:, 1:] = p[:-1], p[:, :-1], p[:-1, :-1]
    right = np.zeros_like(p)  # after the last column the row goes on with the pixel below its first one
    right[1:, :-1], right[1:, -1] = p[:-1, 1:], p[1:, 0]
    avg = lambda a, b: (a + b) >> 1
    to_left, to_top = np.abs(top - corner).sum(axis=-1, keepdims=True), np.abs(left - corner).sum(axis=-1, keepdims=True)
    mean = avg(left, top)
    black = np.zeros_like(p)
    black[..., 0] = 255
    out = [black, left, top, right, corner, avg(avg(left, right), top), avg(left, corner), mean, avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right))]
    out += [np.where(to_left < to_top, left, top), np.clip(left + top - corner, 0, 255), np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)]
    for guess in out:
        guess[0], guess[1:, 0] = left[0], top[1:, 0]
        guess[0, 0] = (255, 0, 0, 0)
    return out


def _modes(pixels: np.ndarray, bits: int, blocks: tuple[int, int]) -> np.ndarray:
    """For each block the predictor with the least sum of absolute differences."""
    p, out = _split(pixels), []
    for guess in _guesses(pixels):
        error = (p - guess) & 255
        error = np.minimum(error, 256 - error)[..., 1:].sum(axis=-1)
        rows = np.add.reduceat(error, np.arange(blocks[0]) << bits, axis=0)
        out.append(np.add.reduceat(rows, np.arange(blocks[1]) << bits, axis=1))
    return np.argmin(np.stack(out), axis=0)


def _residuals(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels less what the predictors of their blocks give."""
    mode = modes[np.arange(pixels.shape[0])[:, None] >> bits, np.arange(pixels.shape[1])[None, :] >> bits]
    guess = np.choose(mode[..., None], _guesses(pixels))
    return _join(_split(pixels) - guess)


def _multipliers(pixels: np.ndarray, bits: int, blocks: tuple[int, int]) -> np.ndarray:
    """For each block the least-squares share of green in red and in blue, of red in blue none."""
    p = ((_split(pixels) + 128) & 255) - 128
    total = lambda v: np.add.reduceat(np.add.reduceat(v, np.arange(blocks[0]) << bits, axis=0), np.arange(blocks[1]) << bits, axis=1)
    red, green, blue = p[..., 1], p[..., 2], p[..., 3]
    share = lambda v: np.clip(np.rint(32 * total(v * green) / np.maximum(1, total(green * green))), -128, 127).astype(np.int32)
    return _join(np.stack([np.full(blocks, 255), np.zeros(blocks, np.int32), share(blue), share(red)], axis=-1))


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), *, cache_bits: int = 0, back_references: bool = False, block_bits: int = 3, modes: np.ndarray | None = None, multipliers: np.ndarray | None = None) -> bytes:
    """An image of (height, width) ARGB values. Transforms are applied in the order given; a palette needs at most 256 colours."""
    height, width = pixels.shape
    out = _Writer()
    _head(out, width, height)
    for kind in transforms:
        out.put(1, 1), out.put(kind, 2)
        blocks = (-(-pixels.shape[0] >> block_bits), -(-pixels.shape[1] >> block_bits))
        if kind == PREDICTOR:
            chosen = _modes(pixels, block_bits, blocks) if modes is None else modes
            out.put(block_bits - 2, 3)
            _write_image(out, 0xFF000000 + (chosen.astype(np.uint32) << np.uint32(8)), main=False)
            pixels = _residuals(pixels, chosen, block_bits)
        elif kind == CROSS_COLOR:
            table = _multipliers(pixels, block_bits, blocks) if multipliers is None else multipliers
            out.put(block_bits - 2, 3)
            _write_image(out, table, main=False)
            pixels = _cross_color(pixels, table, block_bits, False)
        elif kind == SUBTRACT_GREEN:
            pixels = _subtract_green(pixels, False)
        else:
            palette, index = np.unique(pixels, return_inverse=True)
            index = index.reshape(pixels.shape)
            out.put(len(palette) - 1, 8)
            deltas = _split(palette)
            deltas[1:] -= deltas[:-1].copy()
            _write_image(out, _join(deltas)[None, :], main=False)
            bits = _bundle_bits(len(palette))
            packed = np.zeros((pixels.shape[0], -(-pixels.shape[1] >> bits)), np.uint32)
            for x in range(pixels.shape[1]):
                packed[:, x >> bits] |= index[:, x].astype(np.uint32) << np.uint32((8 >> bits) * (x & ((1 << bits) - 1)))
            pixels = packed << np.uint32(8)
    out.put(0, 1)
    _write_image(out, pixels, main=True, cache_bits=cache_bits, back_references=back_references)
    return _riff(out.bytes())


def _head(out: _Writer, width: int, height: int) -> None:
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(0, 1), out.put(0, 3)


def _riff(data: bytes) -> bytes:
    padded = data + bytes(len(data) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + padded


def _unriff(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The stream of the image at a place, and the place after it."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP image")
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    size = int.from_bytes(data[at + 16 : at + 20], "little")
    if end > len(data) or at + 20 + size > end:
        raise ValueError("the image ends early")
    return data[at + 20 : at + 20 + size], end


def decode(data: bytes) -> np.ndarray:
    """ARGB values of one image."""
    src = _Reader(_unriff(data)[0])
    if src.get(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = src.get(14) + 1, src.get(14) + 1
    src.get(1)
    if src.get(3):
        raise ValueError("an unknown version")
    steps, now = [], width
    while src.get(1):
        kind = src.get(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            bits = src.get(3) + 2
            table = _read_image(src, -(-now >> bits), -(-height >> bits), main=False)
            steps.append((kind, bits, table, now))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, 0, None, now))
        else:
            size = src.get(8) + 1
            palette = _split(_read_image(src, size, 1, main=False)[0])
            steps.append((kind, 0, _join(np.cumsum(palette, axis=0)), now))
            now = -(-now >> _bundle_bits(size))
    pixels = _read_image(src, now, height, main=True)
    for kind, bits, table, wide in reversed(steps):
        if kind == PREDICTOR:
            pixels = _unpredict(pixels, table >> np.uint32(8) & np.uint32(15), bits)
        elif kind == CROSS_COLOR:
            pixels = _cross_color(pixels, table, bits, True)
        elif kind == SUBTRACT_GREEN:
            pixels = _subtract_green(pixels, True)
        else:
            pixels = _expand_palette(pixels, table, wide)
    return pixels


# Byte payloads


def _byte_weights() -> list[int]:
    """Weights of bytes by a rule: letters of European prose by rank, then other printable characters, then the rest."""
    weights = [1] * 256
    for b in range(32, 127):
        weights[b] = 24
    for b in (0xC3, *range(0xA0, 0xC0)):
        weights[b] = 60
    for rank, ch in enumerate(" entirshaodlucgmbfpvwyzkqxj.,\n"):
        weights[ord(ch)] = 20_000 // (rank + 3)
    return weights


@dataclass
class Coding:
    """Lengths of the five codes (green, red, blue, alpha, distance) of an image without transforms, and its bits after the size."""

    cache_bits: int
    lengths: list[list[int]]
    shared: bool = True

    def __post_init__(self):
        out = _Writer()
        out.put(0, 1), out.put(0, 3), out.put(0, 1)  # no alpha, version, no transform
        out.put(int(self.cache_bits > 0), 1)
        if self.cache_bits:
            out.put(self.cache_bits, 4)
        out.put(0, 1)  # one group
        for n in self.lengths:
            _write_code(out, n)
        self.head, self.head_bits = out.value, out.size
        self.used = [np.array(n if sum(x > 0 for x in n) > 1 else [0] * len(n), np.int64) for n in self.lengths]
        self.codes = [np.array(canonical(n), np.uint64) for n in self.lengths]
        self._group: _Group | None = None

    @property
    def group(self) -> _Group:
        if self._group is None:
            self._group = _Group(*[PrefixCode.of(n) for n in self.lengths])
        return self._group


_SHARED: list[Coding] = []


def shared_codings() -> list[Coding]:
    """Without and with a cache: codes from weights by rule, the shorter lengths and the farther distances likelier."""
    if not _SHARED:
        plain = code_lengths(_byte_weights())
        for bits in (0, _CACHE_BITS):
            extra = [4000 // (i + 2) for i in range(24)] + [1200] * ((1 << bits) if bits else 0)
            lengths = [code_lengths(_byte_weights() + extra), plain, plain, [0] * 255 + [1], code_lengths([1 + i * i for i in range(40)])]
            _SHARED.append(Coding(bits, lengths))
    return _SHARED


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


@dataclass
class _Tokens:
    """Symbols of some images: the pixel at which each begins, its image, kind (0 literal, 1 copy), length and distance; and for all pixels the previous one with the same place in a cache."""

    at: np.ndarray
    image: np.ndarray
    copy: np.ndarray
    length: np.ndarray
    distance: np.ndarray
    hit: np.ndarray
    key: np.ndarray


def _tokens_of(pixels: np.ndarray, image: np.ndarray, image_end: np.ndarray) -> _Tokens:
    """Back-references to the nearest equal three pixels, as long as the distance stays the same."""
    n = len(pixels)
    wide = np.append(pixels, np.zeros(2, np.uint32)).astype(np.uint64)
    h = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15) + wide[1:-1] * np.uint64(0xD6E8FEB86659FD93) + wide[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + image.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    before = _previous((h ^ h >> np.uint64(32)).view(np.int64))
    place = np.arange(n)
    ok = np.flatnonzero((before >= 0) & (place + 2 < image_end))
    j = before[ok]
    ok = ok[(image[j] == image[ok]) & (pixels[j] == pixels[ok]) & (pixels[j + 1] == pixels[ok + 1]) & (pixels[np.minimum(j + 2, n - 1)] == pixels[ok + 2])]
    back = np.zeros(n + 1, np.int64)
    back[ok] = ok - before[ok]
    new = np.flatnonzero(back[1:] != back[:-1]) + 1
    edges = np.concatenate([[0], new, [n]]) if n else np.zeros(1, np.int64)
    begin, size = edges[:-1], np.diff(edges)
    on = back[begin] > 0
    begin, end = begin[on], (begin + size)[on] + _LEAST_COPY - 1
    begin = np.maximum(begin, np.append(0, end[:-1])) if len(begin) else begin
    on = end - begin >= _LEAST_COPY
    begin, end = begin[on], end[on]
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, begin, 1), np.add.at(inside, end, -1)
    literal = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    pieces = -(-(end - begin) // _MOST_COPY)
    start = np.repeat(begin, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _MOST_COPY
    length = np.minimum(np.repeat(end, pieces) - start, _MOST_COPY)
    distance = np.repeat(back[np.minimum(begin, n - 1)], pieces) if len(begin) else np.zeros(0, np.int64)
    at = np.concatenate([literal, start])
    order = np.argsort(at, kind="stable")
    kind = np.concatenate([np.zeros(len(literal), bool), np.ones(len(start), bool)])[order]
    at = at[order]
    key = (pixels * np.uint32(CACHE_FACTOR) >> np.uint32(32 - _CACHE_BITS)).astype(np.int64)
    last = _previous(image.astype(np.int64) << 11 | key)
    hit = (last >= 0) & (pixels[last] == pixels)
    return _Tokens(at, image[at], kind, np.concatenate([np.ones(len(literal), np.int64), length])[order], np.concatenate([np.zeros(len(literal), np.int64), distance])[order], hit[at] & ~kind, key[at])


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of lengths or distances from 1."""
    v = values - 1
    n = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2, 0)
    half = v >> n & 1
    small = v < 4
    return np.where(small, v, 2 * n + 2 + half), np.where(small, 0, v - ((2 + half) << n)), np.where(small, 0, n)


def _store_tiles(tiles: list[bytes]) -> list[bytes]:
    """Images of payloads, many at a time."""
    sizes = np.array([len(t) // 3 for t in tiles], np.int64)
    raw = np.frombuffer(b"".join(tiles), np.uint8).reshape(-1, 3).astype(np.uint32)
    pixels = np.uint32(0xFF000000) | raw[:, 0] << np.uint32(16) | raw[:, 1] << np.uint32(8) | raw[:, 2]
    image = np.repeat(np.arange(len(tiles)), sizes)
    t = _tokens_of(pixels, image, np.repeat(np.cumsum(sizes), sizes))
    lead = starts(np.bincount(t.image, minlength=len(tiles)))
    lp, lx, ln = _prefixes(t.length)
    dp, dx, dn = _prefixes(t.distance + 120)
    value = pixels[t.at]
    parts = [(value >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0)]
    codings = list(shared_codings())

    def bits(c: Coding, cache: np.ndarray | bool) -> np.ndarray:
        green, red, blue, _, far = c.used
        plain = green[parts[0]] + red[parts[1]] + blue[parts[2]]
        plain = np.where(t.hit & cache, green[np.minimum(280 + t.key, len(green) - 1)], plain) if c.cache_bits else plain
        return np.where(t.copy, green[256 + lp] + ln + far[dp] + dn, plain)

    sums = [np.add.reduceat(bits(c, True), lead) + c.head_bits for c in codings]
    coding = (sums[1] < sums[0]).astype(np.int64)  # of each image
    for i in np.flatnonzero(sizes >= OWN_PIXELS).tolist():
        own = slice(int(lead[i]), int(lead[i + 1]) if i + 1 < len(tiles) else len(t.at))
        cached, copy = t.hit[own] & bool(coding[i]), t.copy[own]
        green = np.where(copy, 256 + lp[own], np.where(cached, 280 + t.key[own], parts[0][own]))
        alone = ~copy & ~cached
        counts = [np.bincount(green, minlength=280 + ((1 << _CACHE_BITS) if coding[i] else 0)), np.bincount(parts[1][own][alone], minlength=256), np.bincount(parts[2][own][alone], minlength=256)]
        fitted = Coding(_CACHE_BITS if coding[i] else 0, [code_lengths(c.tolist()) for c in counts] + [[0] * 255 + [1], code_lengths(np.bincount(dp[own][copy], minlength=40).tolist())], False)
        coding[i] = len(codings)
        codings.append(fitted)
    wide = max(len(c.used[0]) for c in codings)
    table = lambda k, width, what: np.stack([np.pad(getattr(c, what)[k], (0, width - len(getattr(c, what)[k]))) for c in codings])
    size_of = [table(k, w, "used") for k, w in ((0, wide), (1, 256), (2, 256), (4, 40))]
    code_of = [table(k, w, "codes") for k, w in ((0, wide), (1, 256), (2, 256), (4, 40))]
    c = coding[t.image]
    cached = t.hit & np.array([x.cache_bits > 0 for x in codings])[c]
    green = np.where(t.copy, 256 + lp, np.where(cached, 280 + t.key, parts[0]))
    n_fields = np.where(t.copy, 4, np.where(cached, 1, 3))
    base = np.cumsum(n_fields) - n_fields
    n = np.zeros(int(n_fields.sum()), np.int64)
    code = np.zeros(len(n), np.uint64)
    n[base], code[base] = size_of[0][c, green], code_of[0][c, green]
    alone, copy = np.flatnonzero(~t.copy & ~cached), np.flatnonzero(t.copy)
    for k in (1, 2):
        n[base[alone] + k], code[base[alone] + k] = size_of[k][c[alone], parts[k][alone]], code_of[k][c[alone], parts[k][alone]]
    at = base[copy]
    n[at + 1], code[at + 1] = ln[copy], lx[copy].astype(np.uint64)
    n[at + 2], code[at + 2] = size_of[3][c[copy], dp[copy]], code_of[3][c[copy], dp[copy]]
    n[at + 3], code[at + 3] = dn[copy], dx[copy].astype(np.uint64)
    code = np.where(n > 0, code, np.uint64(0))
    total = np.cumsum(n)
    first = base[lead]
    head_bits = 36 + np.array([x.head_bits for x in codings])[coding]
    size_bytes = (head_bits + np.add.reduceat(n, first) + 7) // 8
    origin = 8 * starts(size_bytes)
    per_image = np.diff(np.append(first, len(n)))
    place = total - n + np.repeat(origin + head_bits - (total[first] - n[first]), per_image)
    word = place >> 5
    shifted = code << (place & 31).astype(np.uint64)
    change = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words = np.zeros(int(origin[-1] // 8 + size_bytes[-1]) // 4 + 3, np.uint64)
    words[word[change]] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), change)
    words[word[change] + 1] += np.add.reduceat(shifted >> np.uint64(32), change)
    stream = words.astype("<u4").tobytes()
    out = []
    for tile, b, s, own in zip(tiles, (origin // 8).tolist(), size_bytes.tolist(), coding.tolist(), strict=True):
        head = 0x2F | (ROW_PIXELS - 1) << 8 | (len(tile) // UNIT - 1) << 22 | codings[own].head << 36
        n_head = (36 + codings[own].head_bits + 7) // 8
        body = stream[b : b + s]
        joined = head | int.from_bytes(body[:n_head], "little")
        out.append(_riff(joined.to_bytes(n_head, "little") + body[n_head:]))
    # pixels that are like their neighbours are worth a transform
    alike = np.zeros(len(pixels), bool)
    alike[1:] |= pixels[1:] == pixels[:-1]
    alike[ROW_PIXELS:] |= pixels[ROW_PIXELS:] == pixels[:-ROW_PIXELS]
    begin = starts(sizes)
    share = np.add.reduceat(alike, begin, dtype=np.int64) / sizes
    for i in np.flatnonzero(share >= 0.5).tolist():
        out[i] = min(out[i], _transformed(pixels[begin[i] : begin[i] + sizes[i]].tobytes()), key=len)
    return out


@lru_cache(maxsize=512)
def _transformed(data: bytes) -> bytes:
    """An image under the transforms after which its pixels' entropy is least."""
    pixels = np.frombuffer(data, np.uint32).reshape(-1, ROW_PIXELS)

    def entropy(values: np.ndarray) -> float:
        n = np.unique(values, return_counts=True)[1]
        return float(-(n * np.log2(n / values.size)).sum())

    blocks = tuple(-(-n >> 3) for n in pixels.shape)
    parts = lambda p: sum(entropy(x) for x in (p >> np.uint32(16) & np.uint32(255), p >> np.uint32(8) & np.uint32(255), p & np.uint32(255)))
    costs = {(SUBTRACT_GREEN,): parts(_subtract_green(pixels, False)), (PREDICTOR,): parts(_residuals(pixels, _modes(pixels, 3, blocks), 3)), (CROSS_COLOR,): parts(_cross_color(pixels, _multipliers(pixels, 3, blocks), 3, False))}
    colours = len(np.unique(pixels))
    if colours <= 256:
        costs[(PALETTE,)] = entropy(pixels) + 24 * colours
    return encode(pixels, min(costs, key=costs.get), back_references=True)


def store(payloads: list[bytes]) -> list[bytes]:
    """Images of payloads, whose sizes are positive multiples of 192: 64 pixels a row, R, G and B the next three bytes."""
    out: list[list[bytes]] = [[] for _ in payloads]
    tiles = [(i, p[a : a + UNIT * TILE_ROWS]) for i, p in enumerate(payloads) for a in range(0, len(p), UNIT * TILE_ROWS)]
    for first, end in slices([len(t) for _, t in tiles], 200_000):
        part = tiles[first:end]
        for (i, _), image in zip(part, _store_tiles([t for _, t in part]), strict=True):
            out[i].append(image)
    return [b"".join(x) for x in out]


def load(media: list[bytes]) -> list[bytes]:
    """The payloads of stored images. Images that share their codes are decoded many at a time, others one by one."""
    out: list[list] = [[] for _ in media]
    codings = shared_codings()
    alike: list[list[tuple[int, int, bytes, int]]] = [[] for _ in codings]
    rgb = lambda pixels: pixels.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            begin = at
            stream, at = _unriff(data, at)
            for c, group in zip(codings, alike, strict=True):
                head = int.from_bytes(stream[: (36 + c.head_bits + 7) // 8], "little")
                if stream[0] == 0x2F and head >> 36 & ((1 << c.head_bits) - 1) == c.head:
                    width, height = (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1
                    out[i].append(None)
                    group.append((i, len(out[i]) - 1, stream, width, height))
                    break
            else:
                out[i].append(rgb(decode(data[begin:at]).reshape(-1)))
    for c, group in zip(codings, alike, strict=True):
        group.sort(key=lambda q: q[3])  # images of one width lie together, so that distances mean the same
        for width, same in itertools.groupby(group, key=lambda q: q[3]):
            same = list(same)
            for first, end in slices([len(q[2]) for q in same], 50_000):
                part = same[first:end]
                at = starts(np.array([len(q[2]) for q in part], np.int64)).tolist()
                pixels, ends = _pixels(np.frombuffer(b"".join(q[2] for q in part), np.uint8), c.group, c.cache_bits, width, [8 * a + 36 + c.head_bits for a in at], [width * q[4] for q in part])
                plain, k = rgb(pixels), 0
                for (i, j, stream, _, height), a, stop in zip(part, at, ends, strict=True):
                    if stop > 8 * (a + len(stream)):
                        raise ValueError("the image ends early")
                    out[i][j] = plain[3 * k : 3 * (k + width * height)]
                    k += width * height
    return [b"".join(x) for x in out]


def feature(payload: bytes) -> str:
    """Image size, then mean and deviation of each channel, in units of 1/1000, by integer arithmetic."""
    p = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(np.int64)
    total, squares = p.sum(axis=0), (p * p).sum(axis=0)
    mean = (1000 * total // len(p)).tolist()
    deviation = [int(np.sqrt(max(0.0, float(s) / len(p) - (float(t) / len(p)) ** 2)) * 1000 + 1e-6) for s, t in zip(squares, total, strict=True)]
    return f"{ROW_PIXELS}x{len(p) // ROW_PIXELS} mean {' '.join(map(str, mean))} dev {' '.join(map(str, deviation))}"


def to_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each row of documents."""

    def each(cols: dict[str, list]) -> dict[str, list]:
        raw = [utf8(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(x) for x in raw], "media": store([padded(x) for x in raw])}

    return arrow_map(documents.select("doc_id", "text"), each, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored images hold: sizes, digests and a feature of the pixels."""

    def each(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], **{k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}}
        for media, payload in zip(cols["media"], load(cols["media"]), strict=True):
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(feature(payload))
        return out

    return arrow_map(stored.select("doc_id", "n_bytes", "media"), each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
