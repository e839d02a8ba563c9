"""Operator 1: toxicity from averaged subword embeddings under a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, per_batch, remainder, slices, words_of

#: Labelled rows taken for each class, and the longest text among them, in characters.
PER_CLASS, LONGEST = 3000, 8000
#: Hashed rows of the embedding, its width, the lengths of byte n-grams, and words to a window.
BUCKETS, WIDTH, GRAMS, WINDOW = 1 << 17, 16, (3, 4, 5, 6), 8
#: Words that are cut into subwords at once.
RUN = 20_000
#: The softmax sees averages times this, as one telling word among WINDOW must be enough.
SCALE = np.float32(WINDOW)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the hashed byte n-grams of each ``<word>`` and of each word itself."""
    text = lambda x: pa.scalar(x, pa.large_string())
    marked = pc.binary_join_element_wise(text("<"), words.cast(pa.large_string()), text(">"), text(""))
    raw = np.frombuffer(b"".join(marked.cast(pa.large_binary()).to_pylist()), np.uint8).astype(np.uint64)
    size = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(start + size, size) - np.arange(len(raw))
    rows, keys = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(1099511628211) + raw[at + j]
        rows.append(word[at])
        keys.append(h)
    power = np.cumprod(np.full(int(size.max(initial=0)), 1099511628211, np.uint64))
    if len(raw):
        total = np.add.reduceat(raw * power[np.arange(len(raw)) - np.repeat(start, size)], start)
        rows.append(np.arange(len(size)))
        keys.append(total)
    row, key = np.concatenate(rows), np.concatenate(keys)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return row, (key >> np.uint64(40)).astype(np.int64) % BUCKETS


def means(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bounds[:-1], axis=0) / np.diff(bounds)[:, None] if len(bounds) > 1 else np.zeros((0, x.shape[1]))


def windows(bounds: np.ndarray, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, row of each window): runs of ``n`` words that cover each row."""
    size = np.diff(bounds)
    count = -(-size // n)
    row = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    return bounds[:-1][row] + (np.arange(len(row)) - first[row]) * n, row


@dataclass
class Model:
    """Of the softmax only the difference of the two logits matters: ``weight`` by bucket and ``bias``."""

    weight: np.ndarray
    bias: float

    def window_logits(self, words: pa.Array, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest window decides; a window's logit is the mean over words of the mean over subwords."""
        if not len(codes):
            return np.zeros(0)
        by_word = np.zeros(len(words))
        for at in range(0, len(words), RUN):
            word, buckets = subwords(words[at : at + RUN])
            by_word[at : at + RUN] = np.bincount(word, self.weight[buckets]) / np.bincount(word)
        return self.pooled(by_word, codes, starts)

    def pooled(self, by_word: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.append(starts[1:], len(codes))
        return SCALE * np.add.reduceat(by_word[codes], starts) / (ends - starts) + self.bias


def train(texts: pa.Array, labels: np.ndarray, positive_share: float, seed: int = 7) -> Model:
    """Embedding and softmax fitted together by Adagrad.

    First every window takes its document's label. Then a toxic document is
    stood for by its most toxic window, and a clean one by that and another.
    At last the bias is moved from the sample's share of toxic labels to ``positive_share``.
    """
    rng = np.random.default_rng(seed)
    bounds, codes, words = words_of(texts, lower=pc.utf8_lower)
    starts, row = windows(bounds)
    if not len(codes) or len(set(labels.tolist())) < 2:
        share = float(np.clip(positive_share, 1e-6, 1 - 1e-6))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    ends = np.append(starts[1:], len(codes))
    ends = np.minimum(ends, bounds[1:][row])
    parts, counts = [], []
    for at in range(0, len(words), RUN):
        word, b = subwords(words[at : at + RUN])
        parts.append(b[np.argsort(word, kind="stable")].astype(np.int32))
        counts.append(np.bincount(word))
    buckets, sub_bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    del parts
    emb = rng.normal(0, 0.3 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    seen = [np.full(BUCKETS, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    out[:, 1] = rng.normal(0, 0.1, WIDTH)

    def step(pick: np.ndarray, weight: np.ndarray, rate: float) -> None:
        nonlocal out, bias
        size = (ends - starts)[pick]
        tokens = np.repeat(starts[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        used, local = np.unique(codes[tokens], return_inverse=True)
        n = np.diff(sub_bounds)[used]
        ids = buckets[np.repeat(sub_bounds[:-1][used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        by_word = means(emb[ids], np.concatenate([[0], np.cumsum(n)]))
        x = SCALE * means(by_word[local], np.concatenate([[0], np.cumsum(size)]))
        z = x @ out + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), labels[row[pick]]] -= 1
        g = p * (weight / weight.sum() * len(pick))[:, None]
        gx = SCALE * (g @ out.T) / size[:, None]
        g_word = np.zeros((len(used), WIDTH), np.float32)
        order = np.argsort(local, kind="stable")
        first = np.flatnonzero(np.diff(local[order], prepend=-1))
        g_word[:] = np.add.reduceat(np.repeat(gx, size, axis=0)[order], first, axis=0)
        g_ids = np.repeat(g_word / n[:, None], n, axis=0)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        at, g_emb = ids[order][first], np.add.reduceat(g_ids[order], first, axis=0)
        seen[0][at] += (g_emb**2).mean(1)
        emb[at] -= rate * g_emb / np.sqrt(seen[0][at])[:, None]
        for value, grad, total in ((out, x.T @ g / len(pick), seen[1]), (bias, g.mean(0), seen[2])):
            total += grad**2
            value -= rate * grad / np.sqrt(total)

    per_doc = np.bincount(row, minlength=len(labels))
    for part in np.array_split(rng.permutation(len(row)), max(1, len(row) // 512)):
        step(part, 1 / per_doc[row[part]], 0.1)

    def model() -> Model:
        return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

    docs = np.flatnonzero(per_doc)
    first = np.searchsorted(row, docs)
    for rate in (0.1, 0.1, 0.07, 0.05, 0.03, 0.02):
        now = model()
        by_word = np.concatenate([np.add.reduceat(now.weight[buckets[sub_bounds[a] : sub_bounds[b]]], sub_bounds[a:b] - sub_bounds[a]) for a, b in zip(range(0, len(words), RUN), [*range(RUN, len(words), RUN), len(words)], strict=True)])
        logits = now.pooled(by_word / np.diff(sub_bounds), codes, starts)
        best = np.lexsort([logits, row])[np.append(first[1:], len(row)) - 1]
        other = first + rng.integers(0, per_doc[docs])
        picked = np.concatenate([best, other[(labels[docs] == 0) & (other != best)]])
        for part in np.array_split(rng.permutation(picked), max(1, len(picked) // 256)):
            step(part, np.ones(len(part)), rate)
    fitted, sampled = model(), float(labels.mean())
    odds = lambda p: float(np.log(p / (1 - p)))
    return Model(fitted.weight, fitted.bias + odds(float(np.clip(positive_share, 1e-6, 1 - 1e-6))) - odds(sampled))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, split: int, held: int, per_class: int, longest: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled rows of each class outside the held-out part, by hash order.

    Null labels are skipped; of repeated rows of a document the largest label counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", split) != held)).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= longest))
    return texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")


def fitted(docs: DataFrame, labels: DataFrame, split: int, held: int, per_class: int, longest: int) -> Model:
    rows = training_rows(docs, labels, "toxic", split, held, per_class, longest).toArrow().combine_chunks().sort_by("doc_id")
    toxic, clean = labels.filter(remainder("doc_id", split) != held).agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    model = train(texts, rows.column("label").to_numpy().astype(np.int64), toxic / max(1, toxic + clean))
    del rows, texts
    give_back()
    return model


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    bounds, codes, words = words_of(texts, lower=pc.utf8_lower)
    starts, row = windows(bounds)
    logit = np.full(len(texts), -np.inf)
    if len(row):
        np.maximum.at(logit, row, model.window_logits(words, codes, starts))
    return 1 / (1 + np.exp(-logit))


def toxicity(docs: DataFrame, labels: DataFrame, split: int = 5, held: int = 0, per_class: int = PER_CLASS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    The model is fitted on a bounded sample: at most ``per_class`` rows of each
    class, none longer than ``longest`` characters. Whole texts are scored. A
    null or empty text, or one of white space, scores 0. Without labelled rows
    of both classes all other texts get the same score, the share of toxic
    labels. Repeated rows are scored each; other columns are ignored. A null
    doc_id has a null held_out.
    """
    model = fitted(docs, labels, split, held, per_class, longest)
    slim = docs.select("doc_id", "text")
    kind = T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(scores(model, batch.column("text")))], names=["doc_id", "score"])

    scored = slim.mapInArrow(per_batch(score), kind)
    return scored.select("doc_id", (remainder("doc_id", split) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, split: int = 5, held: int = 0, per_class: int = PER_CLASS, longest: int = LONGEST) -> DataFrame:
    """``docs`` without the rows that :func:`toxicity` predicts to be toxic; all columns stay. No row is shuffled."""
    model = fitted(docs, labels, split, held, per_class, longest)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [scores(model, b.column(0)) for b in slices(pa.record_batch([texts], names=["text"]))] if len(texts) else []
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(score("text") < 0.5)
