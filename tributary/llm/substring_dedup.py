"""Removal of repeated byte strings by column-wise multi-document suffix sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same document or
another. Work is split so that equal strings meet in bounded groups, and each group is suffix-sorted exactly.

1. Anchors. Among the substrings of ``ANCHOR`` bytes in a string of ``LENGTH`` bytes, the one with the least hash is an
   anchor. It depends on the string's bytes alone, so equal strings have equal anchors at equal offsets. All strings
   that hold an anchor lie in its context, at most ``LENGTH - ANCHOR`` bytes before it and ``LENGTH`` from its start.
   Anchors whose hash occurs once are dropped: nothing around them repeats.
2. Contexts that are equal as a whole (by hash, map-side aggregated) are one context with its number of copies; all
   strings in one with several copies repeat.
3. Contexts with the same anchor are a collection that is aligned on it: equal strings start in the same column. The
   collection is sorted column-wise: in each round one symbol of every context, from right to left, is read from a
   sequential file and inserted; a stable counting sort by symbol turns the order of the suffixes of one column into
   that of the next. That order and the common prefixes of neighbours, updated by range minima, are appended to
   another file; the Burrows-Wheeler column, the symbols in the old order, is what the sort consumes and isn't kept, as
   suffixes of different columns never meet. A last sequential pass over the file marks the suffixes that share
   ``LENGTH`` bytes with a neighbour. Files lie in the shared folder under names of their own task attempt, which
   deletes them; the folder goes when the ranges are written.
4. Where an anchor has over ``GROUP`` different contexts, each context is cut into two halves of its strings, and the
   bytes that all strings of a half have in common are a longer anchor. Halves that differ there fall apart into
   groups of their own; this repeats until groups are small or the context is one string. So no task holds more than
   GROUP contexts of one anchor, and nothing is left out.

Cases: null and empty texts and texts of under LENGTH bytes keep all bytes; strings may overlap themselves; documents
of equal text repeat each other; rows that repeat doc_id and text do too; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import _arrow_schema, arrow_map, bounded_batches, drop_stage, row_key, sliced, slices, stage, stage_path, utf8
from tributary.llm.shingles import finish

LENGTH, ANCHOR, GROUP = 200, 88, 256
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.inverse = _powers(_INVERSE, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(_BASE, len(data) + 1)[: len(data)], out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return finish((self.prefix[end] - self.prefix[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def anchors(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Number of anchors of each text; then for all anchors: hash, place in the text, bytes from it to its context's end, and the context's hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    if len(data) < length:
        return np.zeros(len(texts), np.int64), *(np.zeros(0, np.int64) for _ in range(4))
    hashes = Hashes(data)
    n = len(data) - anchor + 1
    h = finish((hashes.prefix[anchor:] - hashes.prefix[:n]) * hashes.inverse[:n] + np.uint64(anchor))
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # least hash, then leftmost
    window, have = length - anchor + 1, 1
    while have < window:
        step = min(have, window - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    owner_start = np.repeat(begin, sizes)
    owner_end = np.repeat(begin + sizes, sizes)
    inside = np.arange(len(key)) + length <= owner_end[: len(key)]
    chosen = (key[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = chosen[np.append(True, chosen[1:] != chosen[:-1])] if len(chosen) else chosen
    low = np.maximum(at - (length - anchor), owner_start[at])
    high = np.minimum(at + length, owner_end[at])
    context = finish(hashes.of(low, high) + (at - low).astype(np.uint64))
    count = np.searchsorted(at, begin + sizes) - np.searchsorted(at, begin)
    return count, h[at].view(np.int64), at - owner_start[at], high - at, context.view(np.int64)


class Scratch:
    """Sequential files in a folder that all executors share."""

    def __init__(self, uri: str):
        self.uri = uri

    @contextmanager
    def files(self, n: int) -> Iterator[list[SequentialFile]]:
        """Some new files, deleted when the task attempt is done with them. Those of a lost executor go with the folder."""
        fs, folder = pafs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("/") else self.uri.replace(":", "://", 1))
        fs.create_dir(folder)
        made = [SequentialFile(fs, f"{folder}/{uuid.uuid4().hex}") for _ in range(n)]
        try:
            yield made
        finally:
            for f in made:
                f.delete()


class SequentialFile:
    """Written from begin to end, then read likewise."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.out, self.source = fs, path, None, None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.out = self.fs.open_output_stream(self.path, buffer_size=1 << 20)
        self.out.write(data)

    def read(self, size: int) -> bytes:
        if self.source is None:
            self.out.close()
            self.source = self.fs.open_input_stream(self.path, buffer_size=1 << 20)
        return self.source.read(size)

    def delete(self) -> None:
        for f in (self.out, self.source):
            if f is not None:
                f.close()
        if self.out is not None:
            self.fs.delete_file(self.path)


def column_sort(contexts: list[bytes], left: np.ndarray, before: int, scratch: Scratch, length: int = LENGTH) -> np.ndarray:
    """repeated[i, c]: whether the string of ``length`` bytes that starts in column c of context i starts there in another one.

    left[i]: the column of context i's first byte. Columns 0 .. before are starts of strings.
    """
    m, width = len(contexts), before + length
    symbols = np.zeros((width, m), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(m), size)
    symbols[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left, size), row] = flat
    right = left + size  # the column after the last byte
    with scratch.files(2) as (columns, rounds):
        columns.write(symbols[::-1].tobytes())
        del symbols
        order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int16)  # contexts by suffix; lcp[i]: with the one before
        written = []
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(m), np.uint8)
            stays = left[order] <= c
            if not stays.all():  # a context that has ended leaves; its neighbours share the least of both prefixes
                ends = np.flatnonzero(stays)
                lcp = np.minimum.reduceat(lcp[: ends[-1] + 1], np.append(0, ends[:-1] + 1)) if len(ends) else lcp[:0]
                order = order[ends]
            fresh = np.flatnonzero(right == c + 1)
            if len(fresh):  # suffixes of one symbol follow an empty one, which is less than all others
                order = np.concatenate([fresh, order])
                lcp = np.concatenate([np.zeros(len(fresh) + 1, np.int16), lcp[1:]])[: len(order)]
            s = symbol[order]
            new = np.argsort(s, kind="stable")
            order, lcp = order[new], _prefixes(lcp, new, s[new])
            if c <= before:
                rounds.write(order.astype(np.int32).tobytes() + lcp.tobytes())
                written.append((c, len(order)))
        repeated = np.zeros((m, before + 1), bool)
        for c, n in written:
            order = np.frombuffer(rounds.read(4 * n), np.int32)
            long = np.frombuffer(rounds.read(2 * n), np.int16) >= length
            repeated[order[long], c] = True
            repeated[order[:-1][long[1:]], c] = True
    return repeated


def _prefixes(lcp: np.ndarray, new: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Common prefixes after a symbol was put before each suffix: one more than the least between two of equal symbol."""
    out = np.zeros(len(new), np.int16)
    if len(new) < 2:
        return out
    at = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
    low, high = new[at - 1] + 1, new[at]
    span = high - low + 1
    levels, table = int(span.max()).bit_length() if len(at) else 0, [lcp]
    for k in range(1, levels):
        table.append(np.minimum(table[-1][: -(1 << (k - 1))], table[-1][1 << (k - 1) :]))
    level = np.frexp(span.astype(np.float64))[1] - 1
    for k in range(levels):
        on = level == k
        if on.any():
            out[at[on]] = np.minimum(table[k][low[on]], table[k][high[on] - (1 << k) + 1]) + 1
    return out


def _sorted_groups(items: DataFrame, scratch: Scratch, chunk: int = 8192) -> DataFrame:
    """d, k, a, b: byte ranges of repeated strings of contexts with one copy. Rows of a group follow each other; whole groups are taken together up to ``chunk`` contexts."""
    bounded_batches(items.sparkSession)
    schema = "d long, k long, a long, b long"
    target = _arrow_schema(items.sparkSession, schema)
    names = items.columns

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        col = {n: [r[i] for r in rows] for i, n in enumerate(names)}
        before = LENGTH - ANCHOR
        p, off = np.array(col["p"], np.int64), np.array(col["off"], np.int64)
        repeated = column_sort(col["ctx"], before - off, before, scratch)
        own = np.array(col["w"]) == 1
        starts_ = repeated & own[:, None]
        edge = np.diff(np.pad(starts_, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        a, b = p[i] + low - before, p[i] + high - 1 - before + LENGTH
        return pa.RecordBatch.from_arrays([pa.array(np.array(col["d"], np.int64)[i]), pa.array(np.array(col["k"], np.int64)[i]), pa.array(a), pa.array(b)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in sliced(batches):
            rows += zip(*[batch.column(x).to_pylist() for x in range(len(names))], strict=True)
            if len(rows) > chunk + GROUP:
                cut = len(rows) - 1
                while cut and rows[cut - 1][0] == rows[-1][0]:
                    cut -= 1
                if cut:
                    yield ranges(rows[:cut])
                    del rows[:cut]
        if rows:
            yield ranges(rows)

    return items.mapInArrow(run, schema)


def _halves(items: DataFrame) -> DataFrame:
    """Two items for each: the strings that start in the first and in the second half of lo .. hi, with the bytes those cover."""

    def each(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("d", "k", "p", "g", "x", "lo", "hi", "off", "ctx", "w")}
        for g, d, k, p, lo, hi, off, ctx, w in zip(*[cols[n] for n in ("g", "d", "k", "p", "lo", "hi", "off", "ctx", "w")], strict=True):
            mid = (lo + hi) // 2
            for low, high in ((lo, mid), (mid + 1, hi)):
                first, last = max(low, -off), min(high, len(ctx) - LENGTH - off)
                if first > last:
                    continue
                a, b = off + first, off + last + LENGTH
                new_off = -first
                core = ctx[off + high : off + low + LENGTH]
                digest = hashlib.blake2b(core, digest_size=8, key=f"{g}:{low}:{high}".encode()).digest()
                part = ctx[a:b]
                whole = hashlib.blake2b(part, digest_size=8, key=f"{first}:{last}".encode()).digest()
                for n, v in zip(out, (d, k, p, int.from_bytes(digest, "little", signed=True), int.from_bytes(whole, "little", signed=True), low, high, new_off, part, w), strict=True):
                    out[n].append(v)
        return out

    return arrow_map(items, each, "d long, k long, p long, g long, x long, lo int, hi int, off int, ctx binary, w long")


def repeats(documents: DataFrame) -> DataFrame:
    """d (doc_id), k (row key), spans: byte ranges of repeated strings of each document that has any; ranges may overlap."""
    spark = documents.sparkSession
    plain = documents.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), row_key().alias("k"), "text").where(F.octet_length("text") >= LENGTH)
    bounded_batches(spark)
    schema = "d long, k long, h array<long>, p array<int>, e array<int>, x array<long>"
    target = _arrow_schema(spark, schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [utf8(t) for t in batch.column(2).to_pylist()]
            for a, b in slices([len(t) for t in raw], 1_000_000):
                count, h, p, e, x = anchors(raw[a:b])
                offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(t))) for v, t in ((h, np.int64), (p, np.int32), (e, np.int32), (x, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *[v.cast(target.field(i + 2).type) for i, v in enumerate(lists)]], schema=target)

    marked = plain.mapInArrow(find, schema)
    often, often_at = stage(marked.select(F.explode("h").alias("g")).groupBy("g").count().where("count > 1").select("g"), "anchors")
    every = marked.select("d", "k", F.explode(F.arrays_zip("h", "p", "e", "x")).alias("i")).select(F.col("i.h").alias("g"), F.col("i.x").alias("x"), "d", "k", F.col("i.p").cast("long").alias("p"), F.col("i.e").alias("e"))
    found, found_at = stage(every.join(often, "g"), "contexts")
    drop_stage(spark, often_at)

    def grouped(items: DataFrame, *extra: str) -> tuple[DataFrame, str]:
        """Different contexts, with their copies and one of their places, and the number of contexts of their anchor."""
        firsts = [F.first(c).alias(c) for c in extra]
        return stage(items.groupBy("g", "x").agg(F.sum("w").alias("w"), F.min(F.struct("d", "k", "p", *(("e",) if "e" in items.columns else ()))).alias("at"), *firsts), "groups")

    first, first_at = grouped(found.withColumn("w", F.lit(1).cast("long")))
    copies = found.join(first.where("w > 1").select("g", "x"), ["g", "x"])
    full = copies.select("d", "k", F.greatest(F.col("p") - (LENGTH - ANCHOR), F.lit(0)).alias("a"), (F.col("p") + F.col("e")).alias("b")).where(F.col("b") - F.col("a") >= LENGTH)
    out, out_at = stage(full, "ranges")
    parts, used = [out], []

    sizes, sizes_at = stage(first.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    wanted, wanted_at = stage(first.join(sizes, "g").select("g", "w", "n", F.col("at.d").alias("d"), F.col("at.k").alias("k"), F.col("at.p").alias("p"), F.col("at.e").alias("e")), "wanted")
    drop_stage(spark, first_at, sizes_at, found_at)
    lists = wanted.groupBy("d", "k").agg(F.collect_list(F.struct("p", "e", "g", "w", "n")).alias("c"))

    def cut(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("g", "d", "k", "p", "lo", "hi", "off", "ctx", "w", "n")}
        before = LENGTH - ANCHOR
        seen = set()
        for d, k, text, contexts in zip(cols["d"], cols["k"], cols["text"], cols["c"], strict=True):
            raw = utf8(text)
            for c in contexts:
                if (d, k, c["p"], c["g"]) in seen:
                    continue  # a repeated row joined again
                a = max(0, c["p"] - before)
                for n, v in zip(out, (c["g"], d, k, c["p"], -before, 0, c["p"] - a, raw[a : c["p"] + c["e"]], c["w"], c["n"]), strict=True):
                    out[n].append(v)
        return out

    items, items_at = stage(arrow_map(plain.join(lists, ["d", "k"]), cut, "g long, d long, k long, p long, lo int, hi int, off int, ctx binary, w long, n long").dropDuplicates(["g", "d", "k", "p"]), "items")
    drop_stage(spark, wanted_at)
    scratch_at = stage_path(spark, "columns")
    while True:
        small = items.where(F.col("n") <= GROUP).drop("n")
        placed = small.select("g", "d", "k", "p", "off", "ctx", "w").repartition("g").sortWithinPartitions("g")
        ranges, ranges_at = stage(_sorted_groups(placed, Scratch(scratch_at)), "ranges")
        parts.append(ranges)
        hot = items.where(F.col("n") > GROUP)
        if hot.isEmpty():
            break
        halves, halves_at = stage(_halves(hot.drop("n")), "halves")
        drop_stage(spark, items_at)
        total, total_at = grouped(halves, "lo", "hi", "off", "ctx")
        same = halves.where("w = 1").join(total.where("w > 1").select("g", "x"), ["g", "x"])
        ranges, ranges_at = stage(same.select("d", "k", (F.col("p") - F.col("off")).alias("a"), (F.col("p") - F.col("off") + F.length("ctx")).alias("b")), "ranges")
        parts.append(ranges)
        sizes, sizes_at = stage(total.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        items, items_at = stage(total.join(sizes, "g").select("g", F.col("at.d").alias("d"), F.col("at.k").alias("k"), F.col("at.p").alias("p"), "lo", "hi", "off", "ctx", "w", "n"), "items")
        drop_stage(spark, halves_at, total_at, sizes_at)
    drop_stage(spark, items_at, scratch_at)
    all_ranges = parts[0]
    for part in parts[1:]:
        all_ranges = all_ranges.unionByName(part)
    return all_ranges.groupBy("d", "k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in some ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, in bytes), kept (binary) for each row of documents."""
    return _removed(documents, False)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: as remove, hashed in the worker."""
    return _removed(documents, True)


def _removed(documents: DataFrame, hashed: bool) -> DataFrame:
    marks = repeats(documents).withColumnsRenamed({"d": "__d", "k": "__k"})
    rows = documents.select("doc_id", row_key().alias("k"), "text")
    joined = rows.join(marks, (F.coalesce(rows["doc_id"], F.lit(-(2**63))) == marks["__d"]) & (rows["k"] == marks["__k"]), "left").select("doc_id", "text", "spans")

    def each(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], **{n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}}
        for text, spans in zip(cols["text"], cols["spans"], strict=True):
            raw = utf8(text)
            gone = union([(s["a"], s["b"]) for s in spans or ()])
            parts, at = [], 0
            for a, b in gone:
                parts.append(raw[at:a])
                at = b
            kept = b"".join(parts) + raw[at:]
            for n, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("spans", [{"begin": a, "end": b} for a, b in gone]), ("kept", kept)):
                out[n].append(v)
        return out

    return arrow_map(joined, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if hashed else "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
