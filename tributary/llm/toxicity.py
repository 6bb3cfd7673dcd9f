"""Toxicity scores from bags of subwords: hashed n-gram embeddings, averaged, under a linear softmax.

A text's subwords are the character n-grams (3 to 6) of its words with boundary marks, and the whole words. Its vector
is the mean of their embeddings, each weighted by how few training texts its bucket is in (a bucket of under
``least_texts`` has no weight); two logits are linear in it. Embeddings and the softmax layer are trained jointly in
numpy, by mini-batches with Adagrad. A misspelling that training never saw shares most n-grams with the word it comes
from. After training, the model is linear in a subword, so each hash bucket keeps a single number, its share of the
difference of the logits, and whole texts are scored in vectorised passes over their characters.

Training uses a bounded sample: at most ``max_positive`` and ``max_negative`` labelled texts, those whose ids have the
least hashes, of each at most the first ``max_train_chars`` characters and of all together at most ``train_chars``,
weighted to the shares that the labels have in the whole table.

Cases: null and empty texts, and texts without words, get the score of the bias alone (about the share of label 1);
rows that repeat each get the same score; documents with several labels count once for each; null labels are left
out; a null doc_id is neither held out nor learned from; without labels of both kinds all scores are the share of
label 1 (0 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import crc_mod, slices, with_columns
from tributary.llm.shingles import is_word

BUCKETS = 1 << 20
SHIFT = np.uint64(64 - 20)
GAIN = 10.0
_LOW, _HIGH = 3, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)
_EDGE = re.compile(r"\W")


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of all texts, and the text that each belongs to (in any order)."""
    lowered = [f" {t.lower()} " if t else "  " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = is_word()[chars]
    edge = ~inside
    beside = np.zeros(len(chars), bool)  # marks stand for the character before and after a word
    beside[:-1] |= inside[1:]
    beside[1:] |= inside[:-1]
    code = np.where(inside, chars, np.uint32(32)).astype(np.uint64)
    usable = inside | (edge & beside)
    breaks = np.cumsum(edge)
    found, of = [], []
    h = code.copy()
    for n in range(2, _HIGH + 1):
        h = h[:-1] * _STEP + code[n - 1 :]
        if n < _LOW:
            continue
        # an n-gram may hold a boundary at its ends alone: none strictly inside
        ok = usable[: len(h)] & usable[n - 1 :] & (breaks[n - 2 : n - 2 + len(h)] - breaks[: len(h)] == 0)
        at = np.flatnonzero(ok)
        found.append(((h[at] + np.uint64(n)) * _MIX) >> SHIFT)
        of.append(owner[at])
    first = np.flatnonzero(inside & np.append(True, edge[:-1]))
    if len(first):
        last = np.flatnonzero(inside & np.append(edge[1:], True))
        place = np.arange(len(chars)) - np.repeat(np.append(0, first), np.diff(np.append(np.append(0, first), len(chars))))
        odd = (2 * place + 1).astype(np.uint64)
        scaled = (code * _MIX ^ odd) * odd * _MIX  # a text ends outside any word, so last + 1 is a place
        whole = np.add.reduceat(scaled, np.stack([first, last + 1], axis=1).reshape(-1))[::2]
        found.append((whole * _MIX) >> SHIFT)
        of.append(owner[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


@dataclass
class ToxicityModel:
    """margin[b]: what bucket b adds to the logit difference; bias: the difference without words."""

    margin: np.ndarray
    bias: float

    def score(self, texts: list[str | None], slice_chars: int = 250_000) -> list[float]:
        """Scores of whole texts. Long ones are cut between words, where no subword crosses, so memory stays bounded; sums of pieces are added in order."""
        owner, pieces = [], []
        for i, text in enumerate(texts):
            for piece in cut(text.lower() if text else "", slice_chars):
                owner.append(i)
                pieces.append(piece)
        total, count = np.zeros(len(pieces)), np.zeros(len(pieces))
        for a, b in slices([len(p) for p in pieces], slice_chars):
            bucket, of = features(pieces[a:b])
            total[a:b] = np.bincount(of, self.margin[bucket], minlength=b - a)
            count[a:b] = np.bincount(of, minlength=b - a)
        z = self.bias + GAIN * np.bincount(owner, total, len(texts)) / np.maximum(1, np.bincount(owner, count, len(texts)))
        return (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()


def cut(text: str, most: int) -> Iterator[str]:
    """Pieces of a text that begin outside words, of at least ``most`` characters but for the last."""
    begin = 0
    while len(text) - begin > most and (edge := _EDGE.search(text, begin + most)):
        yield text[begin : edge.start()]
        begin = edge.start()
    yield text[begin:]


def _batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different buckets of each text, in the buckets' order; the text of each; its share of the text's subwords."""
    bucket, of = features(texts)
    pair, n = np.unique(bucket * len(texts) + of, return_counts=True)
    bucket, of = pair // len(texts), pair % len(texts)
    share = n / np.maximum(1, np.bincount(of, n, minlength=len(texts)))[of]
    return bucket.astype(np.int32), of.astype(np.uint8), share.astype(np.float32)


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None, *, dim: int = 8, epochs: int = 7, batch: int = 64, rate: float = 0.1, least_texts: int = 3, seed: int = 7) -> ToxicityModel:
    y = np.asarray(labels, np.float32)
    w = np.ones(len(y), np.float32) if weights is None else np.asarray(weights, np.float32)
    share = float((y * w).sum() / w.sum()) if len(y) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 700.0 if share else -700.0)
    w = w / w.mean()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    batches, found = [], np.zeros(BUCKETS, np.int32)
    for a in range(0, len(order), batch):
        rows = order[a : a + batch]
        batches.append((rows, *_batch([texts[i] for i in rows])))
        found += np.bincount(batches[-1][1], minlength=BUCKETS).astype(np.int32)
    rarity = np.where(found >= least_texts, np.log((len(texts) + 1) / (found + 1)), 0).astype(np.float32)
    for i, (rows, bucket, of, value) in enumerate(batches):
        on = rarity[bucket] > 0
        batches[i] = rows, bucket[on], of[on], value[on] * rarity[bucket[on]]
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.array([math.log(1 - share), math.log(share)], np.float32)
    seen = [np.full(BUCKETS, 1e-8, np.float32), np.full_like(layer, 1e-4), np.full_like(bias, 1e-4)]
    target = np.stack([1 - y, y], axis=1)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            rows, bucket, of, value = batches[k]
            shares = embed[bucket] * value[:, None]
            hidden = np.stack([np.bincount(of, shares[:, d], minlength=len(rows)) for d in range(dim)], axis=1).astype(np.float32) * np.float32(GAIN)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[rows]) * w[rows][:, None] / len(rows)
            to_hidden, to_layer, to_bias = (g @ layer.T) * np.float32(GAIN), hidden.T @ g, g.sum(axis=0)
            if len(bucket):
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                used = bucket[first]
                grad = np.add.reduceat(to_hidden[of] * value[:, None], first, axis=0)
                seen[0][used] += (grad * grad).mean(axis=1)
                embed[used] -= rate * grad / np.sqrt(seen[0][used])[:, None]
            for q, grad, s in ((layer, to_layer, seen[1]), (bias, to_bias, seen[2])):
                s += grad * grad
                q -= 0.5 * rate * grad / np.sqrt(s)
    return ToxicityModel((embed @ (layer[:, 1] - layer[:, 0]) * rarity).astype(np.float32), float(bias[1] - bias[0]))


def train(documents: DataFrame, labels: DataFrame, *, max_positive: int = 2000, max_negative: int = 3500, max_train_chars: int = 8_000, train_chars: int = 8_000_000, folds: int = 4, held_out: int = 2) -> ToxicityModel:
    """Fit on a bounded, deterministic sample of the labelled rows outside the held-out fold."""
    marked = labels.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", folds) != held_out)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    most = {1: max_positive, 0: max_negative}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000))
    drawn = [marked.where(F.col("toxic") == k).withColumn("draw", draw).orderBy("draw", "doc_id").limit(n) for k, n in most.items()]
    texts = documents.where("text <> ''").select("doc_id", F.substring("text", 1, max_train_chars).alias("text"))
    bound = sum(most.values())  # of the labels broadcast and of the texts collected, whatever ids repeat
    rows = texts.join(F.broadcast(drawn[0].unionAll(drawn[1])), "doc_id").orderBy("draw", "doc_id", "text").limit(bound).collect()
    kept: dict[int, list[str]] = {0: [], 1: []}
    left = {k: train_chars * n // bound for k, n in most.items()}
    for r in sorted(rows, key=lambda r: (r.draw, r.doc_id, r.text)):
        if len(kept[r.toxic]) < most[r.toxic] and left[r.toxic] > 0:
            kept[r.toxic].append(r.text)
            left[r.toxic] -= len(r.text)
    del rows
    if not (kept[0] and kept[1]):
        total = sum(counts.values())
        share = counts.get(1, 0) / total if total else 0.0
        z = math.log(share / (1 - share)) if 0 < share < 1 else (700.0 if share else -700.0)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), z)
    weights = [counts[0] / len(kept[0])] * len(kept[0]) + [counts[1] / len(kept[1])] * len(kept[1])
    return fit(kept[0] + kept[1], [0] * len(kept[0]) + [1] * len(kept[1]), weights)


def score(documents: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None, *, threshold: float = 0.3, folds: int = 4, held_out: int = 2, keep: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; with ``keep``, the columns of documents and the last two under ``names`` (columns of these names give way)."""
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(model or train(documents, labels, folds=folds, held_out=held_out))  # a fixed number of buckets

    def marks(texts: list[str | None]) -> dict[str, list]:
        scores = shipped.value.score(texts)
        return dict(zip(names, (scores, [int(s >= threshold) for s in scores]), strict=True))

    if keep:
        return with_columns(documents, "text", marks, f"`{names[0]}` double, `{names[1]}` int")
    rows = documents.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return with_columns(rows, "text", marks, f"`{names[0]}` double, `{names[1]}` int").drop("text")
