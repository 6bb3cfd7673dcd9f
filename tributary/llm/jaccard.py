"""Join of documents on the Jaccard similarity of their shingle sets, with Bayesian pruning of candidates.

1. Each text becomes its set of hashed shingles of five words and ``BANDS * ROWS`` MinHash values, of which 16 bits are
   kept. Texts with equal sets form a class, which goes on as one row with its number of copies.
2. Classes that agree in all values of a band meet in that band's bucket. Buckets with the same members as an earlier
   one are dropped. A pair of similarity 0.8 meets in no bucket with a probability below 1e-6.
3. Buckets of over ``BLOCK`` classes are cut into blocks, and each pair of blocks is a cell of its own; so a task holds
   two blocks at most, whatever the size of a group. In a cell, the MinHash values of pairs are compared some at a
   time; after each, pairs are dropped whose posterior probability of a similarity of at least the threshold, given
   the agreements so far and a uniform prior, is below ``tolerance``. A pair is handled in the first band that it
   shares alone. This first pass carries MinHash values only.
4. Texts are joined for the classes that have a pair left in a cell, and these pairs are verified exactly on their
   shingle sets, by products of incidence matrices. A cell gives, for each class, its number of links there and one
   edge to the smallest class it is connected with, so a group of k similar texts makes on the order of k rows for
   each cell, not k * k.

Cases: null and empty texts and texts without words have no links and are classes of their own; texts of one to four
words have one shingle; equal sets are always linked; other columns are kept out; rows that repeat doc_id and text are
copies like any others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import _arrow_schema, arrow_map, bounded_batches, drop_stage, row_key, since, sliced, slices, stage, staged, unused
from tributary.llm.components import components
from tributary.llm.shingles import finish, shingle_sets

ROWS, BANDS, STEP = 4, 28, 16
BLOCK = 512
_VALUES = ROWS * BANDS


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of the MinHash values of each set; zeros for an empty one."""
    out = np.zeros((len(sets), _VALUES), np.uint16)
    rng = np.random.default_rng(20_240)
    factor = rng.integers(1 << 62, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 1 << 63, _VALUES, dtype=np.uint64)
    filled = [i for i, s in enumerate(sets) if len(s)]
    for a, b in slices([len(sets[i]) for i in filled], 16_384):
        part = filled[a:b]
        flat = np.concatenate([sets[i] for i in part])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in part])[:-1]])
        for j in range(_VALUES):
            least = np.minimum.reduceat((flat ^ mask[j]) * factor[j], at)
            out[part, j] = (finish(least) >> np.uint64(48)).astype(np.uint16)
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values: the agreements below which the posterior falls under the tolerance.

    The posterior of the similarity after m of n agreements is Beta(m + 1, n - m + 1); its mass above the threshold is
    the chance of at most m successes in n + 1 trials of the threshold's probability.
    """
    out = {}
    for n in range(STEP, _VALUES + 1, STEP):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _candidates(sig: np.ndarray, side: np.ndarray, cross: bool, band: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that are left after pruning and that share no earlier band."""
    keys = np.ascontiguousarray(sig).view(np.uint64)
    rows, columns = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(sig)),) * 2
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(rows) if len(columns) else 0, 64):
        some = rows[a : a + 64]
        agree = (sig[some, None, :STEP] == sig[None, columns, :STEP]).sum(axis=2)
        i, j = np.nonzero(agree >= least[STEP])
        m, i, j = agree[i, j], some[i], columns[j]
        if not cross:
            m, i, j = m[i < j], i[i < j], j[i < j]
        for n in range(2 * STEP, _VALUES + 1, STEP):
            m = m + (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1)
            on = m >= least[n]
            m, i, j = m[on], i[on], j[on]
        on = (keys[i, band] == keys[j, band]) & ~(keys[i, :band] == keys[j, :band]).any(axis=1)
        kept.append((i[on], j[on]))
    return np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets; the diagonal means nothing."""
    values, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(of, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    on = often[of]
    of, owner = number[of[on]], owner[on]
    order = np.argsort(of, kind="stable")
    of, owner = of[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(of, [low, low + 4096])
        part = np.zeros((len(sets), min(4096, int(often.sum()) - low)), np.float32)
        part[owner[a:b], of[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _pruned(cell: dict[str, list], least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(cell["sig"]), np.uint16).reshape(-1, _VALUES)
    side = (np.array(cell["own"]) != cell["i"][0]).astype(int)
    return _candidates(sig, side, cell["i"][0] != cell["j"][0], cell["band"][0], least)


def _links(cell: dict[str, list], threshold: float, least: dict[int, int], width: int) -> list[tuple[int, int, int]]:
    """(class, links, smallest connected class) of a cell's classes that have links there."""
    i, j = _pruned(cell, least)
    if not len(i):
        return []
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    sets = shingle_sets([cell["text"][k] for k in used.tolist()], width)
    both = _intersections(sets)[i, j]
    size = np.array([len(s) for s in sets])
    on = both >= threshold * (size[i] + size[j] - both) - 1e-9
    i, j = i[on], j[on]
    ids, copies = np.array(cell["c"], np.int64)[used], np.array(cell["size"], np.int64)[used]
    links = np.bincount(i, copies[j], len(used)) + np.bincount(j, copies[i], len(used))
    label = ids.copy()
    while True:  # a cell's classes are few, and most are linked directly
        fresh = label.copy()
        np.minimum.at(fresh, i, label[j])
        np.minimum.at(fresh, j, fresh[i])
        if (fresh == label).all():
            break
        label = fresh
    return [(int(ids[k]), int(links[k]), int(label[k])) for k in np.flatnonzero(links)]


def _left(cell: dict[str, list], least: dict[int, int]) -> list[tuple]:
    """The rows, without their values, of a cell's classes that have a pair left after pruning."""
    i, j = _pruned(cell, least)
    return [(cell["cell"][k], cell["i"][k], cell["j"][k], cell["band"][k], cell["own"][k], cell["c"][k]) for k in np.unique(np.concatenate([i, j])).tolist()]


def _by_cell(rows: DataFrame, each, schema: str) -> DataFrame:
    """each(columns of one cell) -> rows, for all cells of two or more rows. A cell's rows follow each other in a partition, so one cell at a time is held."""
    placed = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    bounded_batches(rows.sparkSession)
    target = _arrow_schema(rows.sparkSession, schema)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: dict[str, list] = {n: [] for n in names}
        key, found = None, []

        def out():
            done = pa.RecordBatch.from_arrays([pa.array([r[x] for r in found], f.type) for x, f in enumerate(target)], schema=target)
            found.clear()
            return done

        for batch in sliced(batches):
            for row in zip(*[batch.column(x).to_pylist() for x in range(len(names))], strict=True):
                if (now := row[:3]) != key:
                    if key is not None and len(cell["c"]) > 1:
                        found += each(cell)
                    key, cell = now, {n: [] for n in names}
                for n, v in zip(names, row, strict=True):
                    cell[n].append(v)
            if len(found) > 50_000:
                yield out()
        if key is not None and len(cell["c"]) > 1:
            found += each(cell)
        yield out()

    return placed.mapInArrow(run, schema)


def classes(documents: DataFrame, *, threshold: float = 0.8, tolerance: float = 1e-6, width: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, copy_of, n_links for each row of documents.

    class_id: the smallest doc_id of the documents that links connect with this one; copy_of: the smallest doc_id of
    the documents with the same shingle set; n_links: other documents at a similarity of at least the threshold.
    """
    return classify(documents, threshold=threshold, tolerance=tolerance, width=width, block=block).drop("k", "class_k")


def classify(documents: DataFrame, *, threshold: float = 0.8, tolerance: float = 1e-6, width: int = 5, block: int = BLOCK) -> DataFrame:
    """As classes, with k, the key of the row (see row_key), and class_k, the least key of the class's documents of that class_id."""
    spark = documents.sparkSession
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), "text")

    def each(cols: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(cols["text"], width)
        sums = [(int(finish(s).sum(dtype=np.uint64)), int(finish(s ^ np.uint64(0x5555)).sum(dtype=np.uint64))) for s in sets]
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return {"doc_id": cols["doc_id"], "k": cols["k"], "n": [len(s) for s in sets], "s1": [signed(a) for a, _ in sums], "s2": [signed(b) for _, b in sums], "sig": [x.tobytes() for x in signatures(sets)]}

    rows, rows_at = stage(arrow_map(plain, each, "doc_id long, k long, n int, s1 long, s2 long, sig binary"), "minhash")
    key = ["s1", "s2", "n"]
    grouped = rows.where("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("rep"), F.count("*").alias("size"), F.first("sig").alias("sig"))
    sets, sets_at = stage(grouped.select(F.monotonically_increasing_id().alias("c"), *key, F.col("rep.doc_id").alias("rep"), F.col("rep.k").alias("rep_k"), "size", "sig"), "classes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda x: F.struct(x.alias("band"), F.xxhash64(x, F.substring("sig", x * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("key")))
    met = sets.select("c", F.explode(bands).alias("b")).select("c", F.col("b.band").alias("band"), F.col("b.key").alias("key"))
    buckets = met.groupBy("band", "key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("c")).alias("who")).where("members > 1")
    first = buckets.groupBy("members", "who").agg(F.min(F.struct("band", "key")).alias("b"))
    buckets, buckets_at = stage(first.select(F.col("b.band").alias("band"), F.col("b.key").alias("key"), "members"), "buckets")
    members, members_at = stage(met.join(buckets, ["band", "key"]).select("band", "key", "c", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "members")

    own = F.pmod(F.xxhash64("c", "key"), F.col("blocks")).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select(F.xxhash64("band", "key").alias("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "c")
    least = least_matches(threshold, tolerance)
    values = sets.select("c", "sig")
    left, left_at = stage(_by_cell(cells.join(values, "c").select(*cells.columns, "sig"), lambda cell: _left(cell, least), "cell long, i int, j int, band int, own int, c long"), "candidates")

    needed = sets.join(left.select("c").distinct(), "c", "left_semi").select("c", F.col("rep").alias("doc_id"), F.col("rep_k").alias("k"), "size", "sig")
    texts = plain.join(needed, (plain.k == needed.k) & plain.doc_id.eqNullSafe(needed.doc_id)).select(needed.c, needed.size, needed.sig, plain.text).dropDuplicates(["c"])
    full = left.join(texts, "c").select(*left.columns, "size", "sig", "text")
    links, links_at = stage(_by_cell(full, lambda cell: _links(cell, threshold, least, width), "c long, links long, label long"), "links")
    drop_stage(spark, buckets_at, members_at, left_at)

    total = links.groupBy("c").agg(F.sum("links").alias("links"))
    mark = staged()
    labels = components(links, "c", "label").select(F.col("node").alias("c"), "label")
    labels_at = since(mark)
    known, known_at = stage(sets.select("c", *key, "rep", "rep_k", "size").join(total, "c", "left").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")), "known")
    firsts = known.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_k")).alias("first"))
    final, _ = stage(known.join(firsts, "label").select(*key, F.col("first.rep").alias("class_id"), F.col("first.rep_k").alias("class_k"), F.col("rep").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "class-ids")
    drop_stage(spark, sets_at, links_at, known_at, *labels_at)
    done = rows.select("doc_id", "k", *key).join(final, key, "left")
    alone = lambda c, other: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col(other)).alias(c)
    return done.select("doc_id", "k", alone("class_id", "doc_id"), alone("class_k", "k"), alone("copy_of", "doc_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """One row of each class: the document with the smallest doc_id, of several with that id the one with the least key, of rows that repeat both one."""
    d, k, n = unused(documents.columns, "d", "k", "n")
    first = F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("class_k") == F.col("k"))
    found = classify(documents, **options).where(first).groupBy("doc_id", "k").agg(F.count("*").alias(n)).withColumnsRenamed({"doc_id": d, "k": k})
    rows = documents.join(found, (row_key() == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d)))
    once, several = rows.where(F.col(n) == 1), rows.where(F.col(n) > 1).dropDuplicates([d, k])
    return once.unionByName(several).select(*[F.col(f"`{c}`") for c in documents.columns])
