"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: for each context of up to ``order`` bytes, the counts of the bytes that
followed it in training. The code length of a byte starts at the longest context that the language has seen; a byte
that never followed it costs an escape (method C: the number of distinct followers over that number plus the total)
and is coded at the next shorter context, bytes of the longer one excluded; below order 0 all 256 bytes that are still
possible are equally likely. Statistics are frozen after training, so a byte's exact code length depends only on the
order + 1 last bytes. It is tabulated for each such string seen in training and computed by the same function for
the rest. A text's language is the one with the shortest total code.

Training uses a bounded sample of every language: ``docs_per_lang`` whole documents of at most ``max_train_chars``
characters, and beginnings of that length where a language has few or no such documents. All languages share
``train_bytes``, but each has ``least_bytes`` if it has as many.

Cases: null text, empty text or text without letters gives ``und`` with score 0; ties go to the language that sorts
first; a table without any labelled row gives ``und`` everywhere; rows that repeat each get their own result; a null
doc_id is neither held out nor learned from. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import arrow_map, crc_mod, slices, starts, utf8

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ContextTrees:
    """Context trees of all languages over one set of strings. Level n has the strings of n bytes seen in training.

    langs: names in order. code: byte -> symbol, 0 if unseen. child[n][id of the first n bytes, symbol] -> id of the
    string of n + 1 bytes, 0 if unseen. neg_log[n][id, lang]: -log2 of the count of string id, inf if that language
    has not seen it. plain[n][context id, lang]: log2(total + distinct) of a context of n bytes. esc[n][...]: log2 of
    the distinct followers. after[n][...]: the same denominator one level down, once an escape from this context has
    excluded its followers; after_new: log2 of the followers that are then new (-inf: none). Where a language has not
    seen the context, seen is False and the value one level down is that of the suffix without exclusion.
    """

    order: int
    langs: list[str]
    code: np.ndarray
    child: list[np.ndarray]
    neg_log: list[np.ndarray]
    plain: list[np.ndarray]
    distinct: list[np.ndarray]
    seen: list[np.ndarray]
    excluded: list[np.ndarray]
    table: np.ndarray | None = None

    def ids(self, symbols: np.ndarray) -> list[np.ndarray]:
        """For n = 1 .. order + 1: the id of the string of n bytes that ends at each position."""
        out = [symbols.astype(np.int32)]
        for n in range(1, self.order + 1):
            before = np.zeros(len(symbols), np.int32)
            before[1:] = out[-1][:-1]
            out.append(self.child[n][before, symbols])
        return out

    def lengths(self, strings: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Code lengths in bits per language. strings[n]: ids of the n + 1 last bytes; contexts[n]: of the n bytes before the last."""
        rows, width = len(strings[0]), len(self.langs)
        bits, open_ = np.zeros((rows, width)), np.ones((rows, width), bool)
        above_total, above_distinct, escaped = np.zeros((rows, width)), np.zeros((rows, width)), np.zeros((rows, width), bool)
        for n in range(self.order, -1, -1):
            ctx = contexts[n]
            seen = self.seen[n][ctx]
            total = self.plain[n][ctx] - np.where(escaped, above_total, 0)
            fresh = self.distinct[n][ctx] - np.where(escaped, above_distinct, 0)
            den = np.log2(np.maximum(total + fresh, 1))
            cost = self.neg_log[n][strings[n]]
            hit = open_ & seen & np.isfinite(cost)
            bits += np.where(hit, cost + den, 0)
            miss = open_ & seen & ~hit
            bits += np.where(miss & (fresh > 0), den - np.log2(np.maximum(fresh, 1)), 0)
            open_ &= ~hit
            if n:
                above_total = np.where(miss, self.excluded[n][ctx], 0)
                above_distinct = np.where(miss, self.distinct[n][ctx], 0)
                escaped = miss
            else:
                left = np.where(miss, 256 - self.distinct[0][ctx], 256)
                bits += np.where(open_, np.log2(np.maximum(left, 1)), 0)
        return bits

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Total code length in bits of each text in each language."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        symbols = self.code[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        at = starts(sizes)
        symbols[at + sizes - 1] = 0  # a separator is in no context, so a text's first bytes meet only shorter ones
        ids = self.ids(symbols)
        bits = self.table[ids[self.order]]
        if len(rare := np.flatnonzero(ids[self.order] == 0)):
            bits[rare] = self.lengths([x[rare] for x in ids], _contexts(ids, rare))
        bits[at + sizes - 1] = 0
        return np.add.reduceat(bits, at, axis=0, dtype=np.float64)


def _contexts(ids: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """Ids of the 0 .. order bytes before each position: 0 is the empty context on level 0, an unseen one above."""
    before = [np.zeros(len(at), np.int32)]
    for x in ids[:-1]:
        y = x[at - 1].copy()
        y[at == 0] = 0
        before.append(y)
    return before


def fit(samples: dict[str, list[bytes]], order: int = 3) -> ContextTrees:
    """Count the context trees of each language's texts."""
    langs = sorted(samples)
    texts = [t for lang in langs for t in samples[lang]]
    owner = np.repeat(np.arange(len(langs)), [sum(len(t) + 1 for t in samples[lang]) for lang in langs])
    raw = np.frombuffer(b"\0".join(texts) + b"\0" if texts else b"", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1 if texts else np.zeros(0, np.int64)
    real = np.ones(len(raw), bool)
    real[ends] = False
    code = np.zeros(256, np.int32)
    present = np.unique(raw[real])
    code[present] = np.arange(1, len(present) + 1)
    symbols = code[raw]
    symbols[ends] = 0
    width, symbols_n = len(langs), len(present) + 1

    child: list[np.ndarray] = [np.arange(symbols_n, dtype=np.int32)[None, :]]
    ids, counts, parents, last = [symbols], [], [], []
    for n in range(order + 1):
        if n:
            before = np.zeros(len(raw), np.int64)
            before[1:] = ids[-1][:-1]
            key = np.where((before > 0) & (symbols > 0), before * symbols_n + symbols, 0)
            distinct, found = np.unique(np.append(0, key), return_inverse=True)
            ids.append(found[1:].astype(np.int32))
            child.append(np.zeros((len(counts[-1]), symbols_n), np.int32))
            child[n].reshape(-1)[distinct[1:]] = np.arange(1, len(distinct))
            parents.append((distinct // symbols_n).astype(np.int32))
            last.append((distinct % symbols_n).astype(np.int32))
        else:
            parents.append(np.zeros(symbols_n, np.int32))
            last.append(np.arange(symbols_n, dtype=np.int32))
        size = len(parents[n])
        table = np.bincount(ids[n].astype(np.int64) * width + owner, minlength=size * width).reshape(size, width).astype(np.float64) if len(raw) else np.zeros((size, width))
        table[0] = 0
        counts.append(table)

    plain, distinct_, seen, excluded, suffix = [], [], [], [], [np.zeros(symbols_n, np.int32)]
    for n in range(1, order + 1):  # the id of a string without its first byte
        suffix.append(child[n - 1][suffix[n - 1][parents[n]], last[n]] if n > 1 else last[1].copy())
    for n in range(order + 1):
        size = 1 if n == 0 else len(counts[n - 1])
        total, kinds, out = np.zeros((size, width)), np.zeros((size, width)), np.zeros((size, width))
        np.add.at(total, parents[n][1:], counts[n][1:])
        np.add.at(kinds, parents[n][1:], (counts[n][1:] > 0).astype(np.float64))
        if n:
            np.add.at(out, parents[n][1:], np.where(counts[n][1:] > 0, counts[n - 1][suffix[n][1:]], 0))
            total[0] = kinds[0] = out[0] = 0
        plain.append(total), distinct_.append(kinds), seen.append(kinds > 0), excluded.append(out)
    with np.errstate(divide="ignore"):
        neg_log = [-np.log2(c) for c in counts]
    trees = ContextTrees(order, langs, code, child, neg_log, plain, distinct_, seen, excluded)
    size = len(counts[order])
    strings, contexts = [np.arange(size, dtype=np.int32)], [parents[order].copy()]
    for n in range(order, 0, -1):
        strings.insert(0, suffix[n][strings[0]])
        contexts.insert(0, parents[n - 1][strings[0]])
    trees.table = trees.lengths(strings, contexts).astype(np.float32)
    return trees


@dataclass
class Forest:
    """Context trees of groups of languages, in order. A language's code lengths don't depend on the others, but tables are as wide as a group."""

    groups: list[ContextTrees]

    @property
    def langs(self) -> list[str]:
        return [x for g in self.groups for x in g.langs]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([g.score(texts) for g in self.groups], axis=1)


def train(documents: DataFrame, *, docs_per_lang: int = 300, max_train_chars: int = 20_000, order: int = 3, folds: int = 5, train_bytes: int = 8_000_000, least_bytes: int = 4_000, group: int = 8) -> Forest:
    """Fit on a bounded sample of the documents whose crc32 remainder is not 0; every language has its share."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", folds) != 0)).select("doc_id", "text", "lang")
    size = F.length("text")
    short = size <= max_train_chars
    found = known.where(size >= 1).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("n_short"), F.sum(F.least(size, F.lit(max_train_chars))).alias("chars"), F.coalesce(F.sum(F.when(short, size)), F.lit(0)).alias("chars_short")).collect()
    if not found:
        return Forest([])
    budget = max(least_bytes, train_bytes // len(found))
    plan = []
    for r in found:
        # beginnings of longer texts are taken where the short ones don't make up a language
        long = r.chars_short < min(budget, max_train_chars)
        n, chars = (r.n, r.chars) if long else (r.n_short, r.chars_short)
        plan.append((r.lang, long, min(1.0, 2.0 * docs_per_lang / n, max(2.0 * budget / chars, 16.0 / n))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000))
    wanted = F.broadcast(documents.sparkSession.createDataFrame(plan, "lang string, long boolean, share double"))
    rest = known.where(size >= 1).join(wanted, "lang").where(F.col("long") | short).select(drawn.alias("draw"), "doc_id", "lang", F.substring("text", 1, max_train_chars).alias("text"), "share")
    rows = rest.where(F.col("draw") < F.col("share") * 1_000_000).drop("share").collect()
    missed = sorted({r.lang for r in found} - {r.lang for r in rows})
    if missed:  # nothing was drawn of a language: its first document is
        one = F.min(F.struct("draw", "doc_id", "lang", "text")).alias("one")
        rows += [r.one for r in rest.join(F.broadcast(documents.sparkSession.createDataFrame([(x,) for x in missed], "lang string")), "lang").groupBy("lang").agg(one).collect()]
    samples: dict[str, list[bytes]] = {}
    used: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r.draw, r.doc_id, r.text)):
        if len(samples.setdefault(r.lang, [])) < docs_per_lang and used.get(r.lang, 0) < budget:
            samples[r.lang].append(utf8(r.text))
            used[r.lang] = used.get(r.lang, 0) + len(samples[r.lang][-1])
    langs = sorted(samples)
    return Forest([fit({x: samples[x] for x in langs[i : i + group]}, order) for i in range(0, len(langs), group)])


def predict(trees: ContextTrees | Forest, texts: list[str | None], slice_bytes: int = 4_000_000, evidence: int = 32) -> tuple[list[str], list[float]]:
    """Languages and scores: posterior probabilities, code lengths taken as those of at most ``evidence`` bytes."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    names = trees.langs
    at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if names else []
    raw = [utf8(texts[i]) for i in at]
    for a, b in slices([len(x) for x in raw], slice_bytes):
        bits = trees.score(raw[a:b])
        size = np.array([len(x) for x in raw[a:b]], np.float64)
        best = bits.argmin(axis=1)
        scaled = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, evidence / size)[:, None]
        score = 1 / np.exp2(-np.minimum(scaled, 500)).sum(axis=1)
        for i, lang, s in zip(at[a:b], best, score, strict=True):
            langs[i], scores[i] = names[lang], float(s)
    return langs, scores


def identify(documents: DataFrame, trees: ContextTrees | Forest | None = None, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents."""
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(trees or train(documents, folds=folds))  # bounded by the sample

    def each(cols: dict[str, list]) -> dict[str, list]:
        langs, scores = predict(shipped.value, cols["text"])
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": langs, "score": scores}

    rows = documents.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, each, "doc_id long, held_out boolean, lang_pred string, score double")
