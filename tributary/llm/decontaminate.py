"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: at its ones the words of a test item and of a document must be equal,
at its zeros they may differ. A document is contaminated by an item if any run along an alignment of the two has
``min_words`` words (all of the item's, if it has fewer) of which ``min_share`` agree, whatever surrounds the run.

1. Items with the same words are one text. Each text's seeds are a table of (hash, text, places).
2. One pass over the documents hashes their words under the same masks. A sieve, a bit table of all seeds whose size is
   bounded by ``sieve_bytes``, lets through those that may be seeds of an item; a document with none is done. More
   seeds than the sieve has room for let through more, and lose nothing. A hash goes on once for each document, with
   all its places.
3. Documents' and items' seeds are joined on the hash. A hot hash is one row for each document that has it.
4. Candidates are verified for each document, at most ``CELL`` texts at a time: the places of a common seed fix how
   an item lies along the document; of each such alignment the longest run of enough agreement is found by prefix sums
   in which words that agree and words that don't cancel at just the share. It is given without substituted words at
   its ends, as far as ``min_words`` allows. Alignments are marked in a table of places, not listed by pairs, and
   verified in slices, so that a word repeated over and over costs time but no memory.

With the default of 13 words and a share of 0.8, every run has a common seed: the three masks meet every way to
substitute a fifth of 13 to 30 words (tests count them). Where an item is shorter, or other limits are asked for, the
seeds are runs as long as the substitutions allowed must leave one.

Words are maximal runs of word characters in lower case, compared by 64-bit hashes. Cases: null and empty texts,
documents or items without words, have no hits; null item ids are left out; items with equal words each give their
rows, an item_id with several texts gives its best run; rows that repeat in documents each give their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import _arrow_schema, arrow_map, bounded_batches, drop_stage, row_key, sliced, stage, unused
from tributary.llm.shingles import word_hashes

MASKS = ("1111011", "1110100011", "101001000111")
#: Texts against which a document is verified at a time, and bytes of a part of the sieve.
CELL, BLOCK = 256, 1 << 16
_PLANES, _PLAIN = 8, (13, Fraction(4, 5))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(613).integers(1 << 62, 1 << 63, _PLANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def masks_for(n_words: int, min_words: int, min_share: Fraction) -> tuple[str, ...]:
    """Masks of which one at least fits any run of enough agreement with an item of n_words words."""
    need = min(min_words, n_words)
    if need >= _PLAIN[0] and min_share >= _PLAIN[1]:
        return MASKS
    # k substituted words leave a run of a k + 1st of the others
    lost = lambda n: int(n * (1 - min_share))
    return ("1" * max(1, min(-(-(n - lost(n)) // (lost(n) + 1)) for n in range(need, 20 * need + 1))),)


def seeds(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a mask fits within a text (texts follow each other in words), and the hash there."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2) + (len(mask) << 20), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h + words[i : i + n]) * _MIX
            h ^= h >> np.uint64(29)
    fits = np.zeros(len(words) + 1, np.int32)
    room = sizes >= len(mask)
    np.add.at(fits, starts[room], 1)
    np.add.at(fits, (starts + sizes - len(mask) + 1)[room], -1)
    at = np.flatnonzero(np.cumsum(fits)[:n] > 0)
    return at, h[at]


def _slots(h: np.ndarray, plane: int, bits: int) -> np.ndarray:
    return (h * _FACTORS[plane]) >> np.uint64(64 - bits)


class Sieve:
    """A table of 2 ** bits bytes; bit i of a byte tells whether any seed has it as its i-th slot."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits, self.table = bits, np.zeros(1 << bits, np.uint8) if table is None else table

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be seeds."""
        at = np.arange(len(h))
        for plane in range(_PLANES):
            at = at[self.table[_slots(h[at], plane, self.bits)] >> np.uint8(plane) & np.uint8(1) > 0]
        return at


def _sieve(table: DataFrame, sieve_bytes: int) -> Sieve:
    """Built in parts by tasks; the driver puts together at most sieve_bytes bytes."""
    most = max(16, sieve_bytes.bit_length() - 1)
    bits = min(most, max(16, (32 * table.count()).bit_length()))

    def slots(cols: dict[str, list]) -> dict[str, list]:
        h = np.array(cols["h"], np.int64).view(np.uint64)
        at = np.concatenate([_slots(h, plane, bits) for plane in range(_PLANES)]).astype(np.int64)
        return {"block": at // BLOCK, "at": at % BLOCK, "bit": np.repeat(1 << np.arange(_PLANES), len(h))}

    marks = arrow_map(table.select("h"), slots, "block int, at int, bit int").groupBy("block", "at").agg(F.bit_or("bit").alias("bits"))
    placed = marks.repartition("block").sortWithinPartitions("block")
    target = _arrow_schema(table.sparkSession, "block int, part binary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=target)
        for batch in sliced(batches):
            block, at, bit = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for b in np.unique(block).tolist():
                if b != now:
                    if now is not None:
                        yield done()
                    now, part = b, np.zeros(BLOCK, np.uint8)
                own = block == b
                part[at[own]] = bit[own]
        if now is not None:
            yield done()

    sieve = Sieve(bits)
    for row in placed.mapInArrow(blocks, "block int, part binary").toLocalIterator():
        sieve.table[row[0] * BLOCK : (row[0] + 1) * BLOCK] = np.frombuffer(row[1], np.uint8)
    return sieve


def longest_runs(doc: np.ndarray, items: list[np.ndarray], places: list[list[tuple]], min_words: int, min_share: Fraction, most: int = 500_000) -> list[tuple[int, int, int, int]]:
    """(item, words of the run, words that agree, word of doc at which it begins), the longest run for each item that has one.

    places[i]: (places in doc, places in item) of each seed that doc and item i share."""
    item, zero = [], []
    for i, pairs in enumerate(places):
        # where the item's first word would lie; marked, so a word that repeats in both makes no list of pairs
        size = len(items[i])
        mark = np.zeros(len(doc) + size, bool)
        for here, there in pairs:
            here, there = np.asarray(here, np.int64) + size, np.asarray(there, np.int64)
            few, many = (there, here) if len(there) <= len(here) else (here, there)
            for x in few.tolist():
                mark[many - x if few is there else x - many] = True
        z = np.flatnonzero(mark) - size
        item.append(np.full(len(z), i))
        zero.append(z)
    item, zero = np.concatenate(item), np.concatenate(zero)
    sizes = np.array([len(x) for x in items], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(items)
    best: dict[int, tuple[int, int, int]] = {}
    ends = np.cumsum(sizes[item])
    cuts = [0]
    while cuts[-1] < len(item):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + most, "right"))))
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i, run in _runs(doc, flat, starts, sizes, item[a:b], zero[a:b], min_words, min_share):
            if i not in best or (run[0], run[1], -run[2]) > (best[i][0], best[i][1], -best[i][2]):
                best[i] = run
    return [(i, *run) for i, run in sorted(best.items())]


def _runs(doc, flat, starts, sizes, item, zero, min_words: int, min_share: Fraction) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """The longest run of enough agreement along each alignment."""
    gain, loss = min_share.denominator - min_share.numerator, min_share.numerator
    low = np.maximum(0, -zero)
    n = np.minimum(sizes[item], len(doc) - zero) - low
    item, zero, low, n = item[n > 0], zero[n > 0], low[n > 0], n[n > 0]
    if not len(item):
        return
    heads = np.cumsum(n + 1) - (n + 1)  # one slot ahead of each alignment, then one for each word
    own = np.repeat(np.arange(len(n)), n + 1)
    j = np.arange(len(own)) - heads[own] + low[own] - 1
    lead = np.zeros(len(own), bool)
    lead[heads] = True
    same = (doc[np.maximum(zero[own] + j, 0)] == flat[starts[item][own] + np.maximum(j, 0)]) & ~lead
    total = np.cumsum(np.where(lead, 0, np.where(same, gain, -loss)))
    total -= total[heads][own]
    # a run has enough agreement if no sum before it exceeds the one at its end: the first such place, by running maxima
    key = own * (2 * max(gain, loss) * (int(n.max()) + 1)) - total
    before = np.searchsorted(np.maximum.accumulate(key), key, "left")
    length = np.arange(len(key)) - before
    need = np.minimum(min_words, sizes[item])
    for g in np.flatnonzero(np.maximum.reduceat(length, heads) >= need).tolist():
        last = int(heads[g] + length[heads[g] : heads[g] + n[g] + 1].argmax())
        first, least = int(before[last]) + 1, int(need[g])
        while last - first + 1 > least and not same[last]:
            last -= 1
        while last - first + 1 > least and not same[first]:
            first += 1
        yield int(item[g]), (last - first + 1, int(same[first : last + 1].sum()), int(zero[g] + j[first]))


def _words(column: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _texts(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """t, words, n of the different texts of the items; t, item_id; and the tables staged."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")

    def each(cols: dict[str, list]) -> dict[str, list]:
        words, counts = word_hashes(cols["text"])
        ends = np.cumsum(counts).tolist()
        return {"item_id": cols["item_id"], "words": [words[e - n : e].tobytes() for e, n in zip(ends, counts.tolist(), strict=True)], "n": counts}

    items, items_at = stage(arrow_map(rows, each, "item_id long, words binary, n int").where("n > 0").distinct(), "items")
    texts, texts_at = stage(items.select("words", "n").distinct().select(F.monotonically_increasing_id().alias("t"), "words", "n"), "item-texts")
    names, names_at = stage(items.join(texts, ["words", "n"]).select("t", "item_id"), "item-names")
    drop_stage(benchmark.sparkSession, items_at)
    return texts, names, [texts_at, names_at]


def _seed_table(texts: DataFrame, min_words: int, min_share: Fraction) -> DataFrame:
    """h, t, places: each different seed of each text."""

    def each(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"h": [], "t": [], "places": []}
        for t, words in zip(cols["t"], _words(cols["words"]), strict=True):
            for mask in masks_for(len(words), min_words, min_share):
                at, h = seeds(words, np.zeros(1, np.int64), np.array([len(words)]), mask)
                kinds, of = np.unique(h, return_inverse=True)
                parts = np.split(at[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(kinds)))[:-1]) if len(kinds) else []
                out["h"] += kinds.view(np.int64).tolist()
                out["t"] += [t] * len(kinds)
                out["places"] += [p.astype(np.int32) for p in parts]
        return out

    return arrow_map(texts.select("t", "words"), each, "h long, t long, places array<int>")


def _suspects(documents: DataFrame, sieve: Sieve, masks: list[str]) -> DataFrame:
    """d, k, words, hits (hash, places) of the documents that have any seed that passes the sieve."""
    shipped = documents.sparkSession.sparkContext.broadcast(sieve)  # of at most sieve_bytes bytes
    bounded_batches(documents.sparkSession)
    schema = "d long, k long, words binary, hits array<struct<h: long, places: array<int>>>"
    target = _arrow_schema(documents.sparkSession, schema)
    rows = documents.where("text <> ''").select(F.col("doc_id").cast("long").alias("d"), row_key().alias("k"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in sliced(batches):
            words, counts = word_hashes(batch.column(2).to_pylist())
            starts = np.cumsum(counts) - counts
            place, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for mask in masks:
                at, h = seeds(words, starts, counts, mask)
                on = own.passes(h)
                place.append(at[on])
                found.append(h[on])
            place, found = np.concatenate(place), np.concatenate(found)
            if not len(place):
                continue
            doc = np.searchsorted(starts, place, "right") - 1
            order = np.lexsort((place, found, doc))
            doc, found, place = doc[order], found[order], (place - starts[doc])[order]
            fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])))
            docs, first = np.unique(doc[fresh], return_index=True)
            places = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(place)).astype(np.int32)), pa.array(place.astype(np.int32)))
            hits = pa.StructArray.from_arrays([pa.array(found[fresh].view(np.int64)), places], names=["h", "places"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(fresh)).astype(np.int32)), hits)
            data = pa.array([words[starts[i] : starts[i] + counts[i]].tobytes() for i in docs.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), batch.column(1).take(pa.array(docs)), data, lists.cast(target.field(3).type)], schema=target)

    return rows.mapInArrow(run, schema)


def _found(documents: DataFrame, benchmark: DataFrame, min_words: int, min_share: float, sieve_bytes: int) -> tuple[DataFrame, str]:
    """u (row), d, k, item_id, n_words, n_agree, first_word; and where it is staged."""
    spark, share = documents.sparkSession, Fraction(str(min_share))
    texts, names, used = _texts(benchmark)
    table, table_at = stage(_seed_table(texts, min_words, share), "seeds")
    sizes = [r[0] for r in texts.select(F.least("n", F.lit(min_words)).alias("n")).distinct().collect()]  # min_words values at most
    masks = sorted({m for n in sizes for m in masks_for(n, min_words, share)})
    suspects, suspects_at = stage(_suspects(documents, _sieve(table, sieve_bytes), masks).select(F.monotonically_increasing_id().alias("u"), "d", "k", "words", "hits"), "suspects")
    hits = suspects.select("u", F.explode("hits").alias("x")).select("u", F.col("x.h").alias("h"), F.col("x.places").alias("here"))
    pairs = hits.join(table, "h").groupBy("u", "t").agg(F.collect_list(F.struct("here", F.col("places").alias("there"))).alias("places"))
    pairs, pairs_at = stage(pairs, "candidates")
    cells = pairs.groupBy("u").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    spread = pairs.join(cells, "u").join(texts, "t").select("u", F.pmod(F.xxhash64("t"), "cells").alias("cell"), F.struct("t", F.col("words").alias("item"), "places").alias("c"))
    full = spread.groupBy("u", "cell").agg(F.collect_list("c").alias("c")).join(suspects.select("u", "d", "k", "words"), "u")

    def verify(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("u", "d", "k", "t", "n_words", "n_agree", "first_word")}
        for u, d, k, words, cell in zip(cols["u"], cols["d"], cols["k"], _words(cols["words"]), cols["c"], strict=True):
            places = [[(p["here"], p["there"]) for p in c["places"]] for c in cell]
            for i, *run in longest_runs(words, _words([c["item"] for c in cell]), places, min_words, share):
                for n, v in zip(out, (u, d, k, cell[i]["t"], *run), strict=True):
                    out[n].append(v)
        return out

    runs = arrow_map(full, verify, "u long, d long, k long, t long, n_words int, n_agree int, first_word int")
    best = F.max(F.struct("n_words", "n_agree", (-F.col("first_word")).alias("later"))).alias("b")
    rows = runs.join(names, "t").groupBy("u", "d", "k", "item_id").agg(best)
    found, path = stage(rows.select("u", "d", "k", "item_id", F.col("b.n_words").alias("n_words"), F.col("b.n_agree").alias("n_agree"), (-F.col("b.later")).alias("first_word")), "contaminated")
    drop_stage(spark, *used, table_at, suspects_at, pairs_at)
    return found, path


def contaminated(documents: DataFrame, benchmark: DataFrame, *, min_words: int = 13, min_share: float = 0.8, sieve_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, item_id, n_words, n_agree, first_word for each document and test item that it overlaps."""
    found, _ = _found(documents, benchmark, min_words, min_share, sieve_bytes)
    return found.select(F.col("d").alias("doc_id"), "item_id", "n_words", "n_agree", "first_word")


def clean(documents: DataFrame, benchmark: DataFrame, *, min_words: int = 13, min_share: float = 0.8, sieve_bytes: int = 1 << 24) -> DataFrame:
    """The documents that overlap no test item, with all their columns. Keys of the others are broadcast if Spark finds them small, else joined."""
    found, _ = _found(documents, benchmark, min_words, min_share, sieve_bytes)
    d, k = unused(documents.columns, "d", "k")
    bad = found.select(F.col("d").alias(d), F.col("k").alias(k)).distinct()
    return documents.join(bad, (row_key() == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d)), "left_anti")
