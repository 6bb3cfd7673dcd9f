"""Byte-level BPE encoding and decoding in linear time.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over all vocabulary entries finds every entry
that occurs in a piece of text. An encoding is what BPE merging yields exactly if each pair of adjacent tokens is
compatible: merging the two tokens' bytes alone gives the same two tokens back. So a piece is encoded left to right
from the longest entry at each place; if it isn't compatible with its predecessor, or leads to a place already known
to be a dead end, the next shorter entry is tried, else the last token is taken back. Dead ends are marked, so each
place is left at most once. Compatibility of a pair is memoised, as is the pair of tokens that each entry is merged from.

Texts are first cut by the tokenizer's pattern; each match is encoded by itself, and a match that is an entry as a
whole is that entry, as in the tiktoken library. No special tokens are recognised.

Cases: null and empty texts have no ids; a piece of any length is encoded whole, in time linear in it; rows that
repeat each get their own result; surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from tributary.llm.common import with_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: The pattern on texts of these characters alone, where re's classes and the pattern's are the same; it is three times as fast.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_NOT_PLAIN = re.compile(rf"[^\t\n\r -~{_LATIN}]")
_PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_GENERAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairEncoder:
    """ranks: bytes -> rank; every single byte has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_pieces: int = 300_000):
        self.ranks, self.pattern, self.memo_pieces = ranks, regex.compile(pattern), memo_pieces
        self.plain = pattern == _GENERAL_PATTERN
        self.entry = {r: b for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), r))
        self.automaton.make_automaton()
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._pieces: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a byte."""
        if token not in self._parts:
            found = self.merge(self.entry[token], below=token)
            self._parts[token] = (found[0], found[1]) if len(found) == 2 else None
        return self._parts[token]

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Plain merging, lowest rank first, leftmost on ties; only used on single entries of the vocabulary."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks[j], i) for i in range(len(parts) - 1) if (j := parts[i] + parts[i + 1]) in self.ranks and (below is None or self.ranks[j] < below)), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of this one, -1 if there is none."""
        if token not in self._shorter:
            b = self.entry[token]
            self._shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return self._shorter[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left and right together leaves these two tokens.

        Merging would join the two sides if, at some time, the tokens then at the border had an entry of their own
        with a rank that comes before the next merge of either side. The merges of both sides are undone, latest
        first, and the pair at the border is looked up at each step.
        """
        known = self._fits.get((left, right))
        if known is None:
            a, b, limit = left, right, len(self.entry) + 1
            while True:
                if self.ranks.get(self.entry[a] + self.entry[b], limit) < limit:
                    known = False
                    break
                split_a, split_b = self.parts(a), self.parts(b)
                if split_a is None and split_b is None:
                    known = True
                    break
                if split_b is None or split_a is not None and a > b:
                    limit, a = a, split_a[1]  # a merge of equal rank further left came first
                else:
                    limit, b = b + 1, split_b[0]
            if len(self._fits) >= 1_000_000:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * size
        for end, (n, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = rank  # later ends are longer entries
        out: list[int] = []
        dead = bytearray(size + 1)
        place, token = 0, longest[0]
        while place < size:
            end = place + len(self.entry[token])
            if not dead[end] and (end - place == 1 or self.parts(token)) and (not out or self.fits(out[-1], token)):
                out.append(token)
                place = end
                token = longest[place] if place < size else -1
                continue
            token = self.shorter(token)
            if token < 0:  # nothing leads on from here
                dead[place] = 1
                token = out.pop()
                place -= len(self.entry[token])
        return out

    def _piece_bytes(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self._pieces) >= self.memo_pieces:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get = self._pieces.get
        pattern = _PLAIN_PATTERN if self.plain and not _NOT_PLAIN.search(text) else self.pattern
        return b"".join([get(p) or self._piece_bytes(p) for p in pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entry.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None = None) -> BytePairEncoder:
    """One encoder for each Python worker."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return BytePairEncoder.from_file(path, pattern)


def encode_documents(documents: DataFrame, path: str | None = None, *, keep: bool = False, names: tuple[str, str, str] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded (binary) for each row; with ``keep``, the columns of documents and these (columns of their names give way)."""
    path = path or vocabulary_path()

    def each(texts: list[str | None]) -> dict[str, list]:
        own = encoder(path)
        ids = [own.encode(t) for t in texts]
        lists = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        return dict(zip(names, ([len(x) for x in lists], lists, [own.decode(x) for x in ids]), strict=True))

    n_tokens, ids, decoded = names
    return _added(documents, each, f"`{n_tokens}` long, `{ids}` array<int>, `{decoded}` binary", keep)


def digests(documents: DataFrame, path: str | None = None, *, keep: bool = False, names: tuple[str, str, str] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_documents, hashed in the worker so that no ids leave it."""
    path = path or vocabulary_path()

    def each(texts: list[str | None]) -> dict[str, list]:
        own = encoder(path)
        out: dict[str, list] = {n: [] for n in names}
        for text in texts:
            ids = own.encode(text)
            values = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()
            for n, v in zip(names, values, strict=True):
                out[n].append(v)
        return out

    return _added(documents, each, ", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "string", "string"), strict=True)), keep)


def _added(documents: DataFrame, each, schema: str, keep: bool) -> DataFrame:
    return with_columns(documents, "text", each, schema) if keep else with_columns(documents.select("doc_id", "text"), "text", each, schema).drop("text")


__all__ = ["BytePairEncoder", "digests", "encode_documents", "encoder", "vocabulary_path"]
