"""Removal of repeated runs of lines, by a suffix array over line ids; DataFrame expressions only.

A document is its sequence of lines without blank ones, white space at their ends cut off; a place is a document and a
line's number in that sequence, a suffix begins at each place.

1. Ranks, by distributed prefix doubling. At level k, suffixes that begin with the same 2^k lines have one rank, and
   ranks are in the order of the suffix array: the pair of the ranks of a place and of the place 2^k lines on is the
   key of the next level, and keys that occur twice are sorted by range and numbered. A suffix that is alone with its
   key has no equal beyond and drops out, so each level has fewer rows; the loop ends when none are left. The ranks of
   a level are the intervals of the suffix array whose longest common prefix is at least 2^k lines.
2. Intervals of other lengths, by halving. A prefix of L lines, 2^k < L < 2^(k+1), has as key the ranks at level k of
   its first and of its last 2^k lines. A place that has an earlier equal at level k at most has a run of 2^k to
   2^(k+1) - 1 lines; and as a run of L lines leaves one of L - 1 or more to the next place, the bounds of a document's
   places draw each other together. A length is tried by keying all suffixes of the place's interval at that length; it
   stands if one of equal key begins earlier. First the upper bounds are tried, at places that do not follow from the
   one before, then all places that are open still are halved. What remains is the longest prefix that occurs at an
   earlier place: the depth of the innermost interval in which the suffix isn't the first, hence a later copy that is
   maximal to the right.
3. A later copy is deleted if it has at least ``min_lines`` lines, or is a line of at least ``min_chars`` characters.
   The first copy of each run stays.

Rank tables are small beside the text, are written to the shared folder at each level and joined, never collected; hot
lines are one row after map-side aggregation, and the joins that bring ranks back are ones that Spark can split.

Cases: null texts stay null and have no lines; an empty text has none; documents are ordered by doc_id, null first,
then by text hash; rows that repeat doc_id and text are one document, so each of them keeps the same lines; ids of
lines are two hashes (96 bits) with the length; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import drop_stage, row_key, stage, unused

_PLACE = ("d", "k", "p")
NAMES = ("n_lines", "n_removed", "longest_run")


def _document() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), row_key()]


def _numbered(lines):
    """The lines that aren't blank, trimmed, with their numbers among all."""
    cut = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("t")))
    return F.filter(cut, lambda x: x["t"] != "")


def _lines(documents: DataFrame) -> DataFrame:
    """d, k: document; p: number among its lines that aren't blank; h, g, size: the line's id."""
    d, k = _document()
    rows = documents.select(d.alias("d"), k.alias("k"), F.posexplode(F.transform(_numbered(F.split("text", "\n")), lambda x: x["t"])).alias("p", "t"))
    return rows.select(*_PLACE, F.xxhash64("t").alias("h"), F.hash("t").alias("g"), F.length("t").alias("size"))


def _ranked(rows: DataFrame, key: list[str]) -> tuple[DataFrame, str]:
    """r (rank, in the keys' order), first (place) and n of each key that more than one place has."""
    place = F.struct(*_PLACE)
    kinds = rows.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last")
    return stage(kinds.select(*key, "first", "n").repartitionByRange(*key).sortWithinPartitions(*key).select(*key, F.monotonically_increasing_id().alias("r"), "first", "n"), "line-ranks")


def ranks(documents: DataFrame) -> tuple[list[DataFrame], list[str]]:
    """By level: the places whose next 2^level lines occur elsewhere, with size of the first line, r, n, and whether an earlier one is equal."""
    spark = documents.sparkSession
    rows, rows_at = stage(_lines(documents), "lines")
    key, out, paths = ["h", "g", "size"], [], []
    while True:
        kinds, kinds_at = _ranked(rows, key)
        current = rows.join(kinds, key).select(*_PLACE, "size", "r", "n", (F.struct(*_PLACE) > F.col("first")).alias("later"))
        level, level_at = stage(current if out else current.dropDuplicates(list(_PLACE)), "line-level")
        drop_stage(spark, rows_at, kinds_at)
        out.append(level)
        paths.append(level_at)
        if level.isEmpty():
            return out, paths
        ahead = level.select("d", "k", (F.col("p") - (1 << len(out) - 1)).alias("p"), F.col("r").alias("r2"))
        rows, rows_at = stage(level.select(*_PLACE, "size", F.col("r").alias("r1")).join(ahead, list(_PLACE)), "line-pairs")
        key = ["r1", "r2"]


def _bounded(state: DataFrame, halve: bool) -> DataFrame:
    """state with its bounds drawn together within documents, ask (the length to try next, null for none) and whether its document is open.

    Where a run of L lines has an earlier copy, one of L - 1 from the next place has, too. So low falls by one at most from
    a place to the next, and high rises by one at most from a place to the one before; a place behind a gap binds none."""
    of_document = Window.partitionBy("d", "k")
    up, down = of_document.orderBy("p"), of_document.orderBy(F.desc("p"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    state = state.withColumn("high", F.min(F.col("high") + F.col("p")).over(down.rowsBetween(*so_far)) - F.col("p"))
    low = F.max(F.col("low") + F.col("p")).over(up.rowsBetween(*so_far)) - F.col("p")
    # what the place before has handed on is its run without the first line, of which no number of copies is known
    state = state.withColumns({"new": low, "copies": F.when(low == F.col("low"), F.col("copies"))}).withColumn("low", F.col("new")).drop("new")
    wide = F.col("low") < F.col("high")
    if halve:
        ask = F.when(wide, F.col("low") + F.expr("(high - low + 1) div 2").cast("int"))
    else:  # a place whose high is that of the place before less one is settled with it
        handed = (F.lag("p").over(up) == F.col("p") - 1) & (F.lag(wide).over(up)) & (F.lag("high").over(up) == F.col("high") + 1)
        ask = F.when(wide & ~F.coalesce(handed, F.lit(False)), F.col("high"))
    return state.withColumns({"ask": ask, "open": F.max(wide).over(of_document)})


def later_runs(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """d, k, p, size, lines, copies: for each place, the longest run from it that an earlier place begins too, its lines and how often it occurs.

    copies is null where the run is that from the place before without its first line; with the paths to drop after use."""
    spark = documents.sparkSession
    levels, paths = ranks(documents)
    every = None
    for i, level in enumerate(levels):
        level = level.withColumn("level", F.lit(i))
        every = level if every is None else every.unionByName(level)
    # the deepest level at which an earlier place is equal
    top = every.where("later").groupBy(*_PLACE).agg(F.max("level").alias("level"), F.max_by("r", "level").alias("r"), F.max_by("n", "level").alias("copies"), F.max("size").alias("size"))
    bounds = {"low": F.expr("shiftleft(1, level)"), "high": F.expr("shiftleft(2, level) - 1")}
    state, state_at = stage(_bounded(top.withColumns(bounds), halve=False), "line-runs")
    settled, settled_at = [state.where("not open")], [state_at]
    members, near_at = every.where("level > 0").select("level", *_PLACE, "r"), []
    while not (state := state.where("open")).isEmpty():
        if len(settled) > 1:  # intervals that are open, and what lies beside their places; no others open later
            of_open = members.join(state.select("level", "r").distinct(), ["level", "r"], "left_semi").select("level", "d", "k").distinct()
            members, at = stage(members.join(of_open, ["level", "d", "k"], "left_semi"), "line-near")
            drop_stage(spark, *near_at)
            near_at = [at]
        ahead = members.select("level", "d", "k", F.col("p").alias("at"), F.col("r").alias("r2"))
        off = F.col("ask") - F.expr("shiftleft(1, level)")
        asked = state.where("ask is not null").select("level", "r", off.alias("off")).distinct()
        keyed = members.join(asked, ["level", "r"]).withColumn("at", F.col("p") + F.col("off")).join(ahead, ["level", "d", "k", "at"])
        keyed, keyed_at = stage(keyed.select("level", "r", "off", "r2", *_PLACE), "line-keys")
        firsts = keyed.groupBy("level", "r", "off", "r2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1")
        longer = keyed.join(firsts, ["level", "r", "off", "r2"]).where(F.struct(*_PLACE) > F.col("first")).select("level", *_PLACE, "off", "n")
        joined = state.withColumn("off", off).join(longer, ["level", *_PLACE, "off"], "left")
        stands = F.col("n").isNotNull()
        tried = {"low": F.when(stands, F.col("ask")).otherwise(F.col("low")), "high": F.when(F.col("ask").isNotNull() & ~stands, F.col("ask") - 1).otherwise(F.col("high"))}
        fresh = joined.withColumns(tried | {"copies": F.coalesce("n", "copies")}).select(*state.columns).drop("ask", "open")
        state, state_at = stage(_bounded(fresh, halve=True), "line-runs")
        drop_stage(spark, keyed_at)
        settled.append(state.where("not open"))
        settled_at.append(state_at)
    drop_stage(spark, *paths, *near_at)
    runs = settled[0]
    for more in settled[1:]:
        runs = runs.unionByName(more)
    return runs.select(*_PLACE, "size", F.col("low").alias("lines"), "copies"), settled_at


def _earlier(documents_runs: DataFrame) -> DataFrame:
    """Runs with the line after the last of the runs that begin before them in the document, and the length of the run one line before."""
    of_document = Window.partitionBy("d", "k").orderBy("p")
    end = F.max(F.col("p") + F.col("lines")).over(of_document.rowsBetween(Window.unboundedPreceding, -1))
    left = F.when(F.lag("p").over(of_document) == F.col("p") - 1, F.lag("lines").over(of_document))
    return documents_runs.withColumns({"end": F.coalesce(end, F.lit(0)), "left": F.coalesce(left, F.lit(0))})


def maximal_runs(documents: DataFrame) -> DataFrame:
    """d, k, p, lines, copies of the later copies that no longer one holds: the run from the line before isn't this one with that line."""
    runs, _ = later_runs(documents)
    return _earlier(runs).where(F.col("left") != F.col("lines") + 1).select(*_PLACE, "lines", "copies")


def deletions(documents: DataFrame, min_chars: int = 40, min_lines: int = 2) -> DataFrame:
    """d, k, gone (places to delete, each once), longest (lines of the longest later copy)."""
    runs, _ = later_runs(documents)
    long = (F.col("lines") >= min_lines) | (F.col("size") >= min_chars)
    # a long line that begins a run too short for deletion goes alone
    some = _earlier(runs.where(long).withColumn("lines", F.when(F.col("lines") >= min_lines, F.col("lines")).otherwise(1)))
    first, last = F.greatest("p", "end"), F.col("p") + F.col("lines") - 1
    parts = some.select("d", "k", F.when(first <= last, F.sequence(first, last)).alias("part"), F.lit(0).alias("lines"))
    longest = runs.groupBy("d", "k").agg(F.max("lines").alias("lines")).select("d", "k", F.lit(None).cast("array<int>").alias("part"), "lines")
    return parts.unionByName(longest).groupBy("d", "k").agg(F.flatten(F.collect_list("part")).alias("gone"), F.max("lines").alias("longest"))


def _once(value, then):
    """then(value) with value computed once, however often then names it: lambda functions don't share what they compute."""
    return F.transform(F.array(value), then)[0]


def _cut(lines, gone):
    """n: how many lines aren't blank; text: the lines but those of them whose numbers are in gone, null if none goes."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())

    def kept(at):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda p: F.get(at, p)))
        text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
        return F.struct(F.size(at).alias("n"), F.when(F.size(gone) > 0, text).alias("text"))

    return _once(at, kept)


def deduplicate(documents: DataFrame, min_chars: int = 40, min_lines: int = 2, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The columns of documents, text without later copies, with the numbers of its lines, of those removed, and of the lines of its longest later copy.

    A column of documents that has one of these three names gives way to them; give other names to keep it."""
    d, k, gone_at, longest_at, cut_at = unused([*documents.columns, *names], "d", "k", "gone", "longest", "cut")
    marks = deletions(documents, min_chars, min_lines).withColumnsRenamed({"d": d, "k": k, "gone": gone_at, "longest": longest_at})
    own_d, own_k = _document()
    joined = documents.withColumns({d: own_d, k: own_k}).join(marks, [d, k], "left")
    gone = F.coalesce(F.col(gone_at), F.array().cast("array<int>"))
    joined = joined.withColumn(cut_at, _once(F.split("text", "\n"), lambda lines: _cut(lines, gone)))
    text = F.coalesce(F.col(cut_at)["text"], F.col("text"))
    counts = dict(zip(names, (F.coalesce(F.col(cut_at)["n"], F.lit(0)), F.size(gone), F.coalesce(F.col(longest_at), F.lit(0))), strict=True))
    rest = [c for c in documents.columns if c.lower() not in {n.lower() for n in names}]
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rest], *[v.alias(n) for n, v in counts.items()])
