"""Operator 2: quality from histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_batch, remainder, rows_of, words_of

#: Labelled rows taken for each class.
PER_CLASS = 10_000
BINS, DEPTH, TREES, RATE, L2 = 64, 4, 80, 0.15, 1.0

#: Byte classes whose share of the text is a feature.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",", b"!?", b"#$%&*", b"|", b"<>{}[]()/\\=_;:@", bytes(range(128, 256))]
_IN_CLASS = np.array([[b in c for c in CLASSES] for b in range(256)], np.float64)
FEATURES = len(CLASSES) + 9


def _distinct(bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often its most common one occurs."""
    n = len(bounds) - 1
    key = np.sort(rows_of(bounds).astype(np.int64) << 32 | codes.astype(np.int64))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    row, often = key[first] >> 32, np.diff(np.append(first, len(key)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row, often)
    return np.bincount(row, minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES numbers for each text; all 0 for a null or empty one."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    raws = texts.cast(pa.large_binary()).to_pylist()
    counts = np.stack([np.bincount(np.frombuffer(r, np.uint8), minlength=256) for r in raws]) if n else np.zeros((0, 256))
    size = counts.sum(1).astype(np.float64)
    share = counts @ _IN_CLASS / np.maximum(size, 1)[:, None]
    bounds, codes, words = words_of(texts)
    n_words = np.diff(bounds).astype(np.float64)
    kinds, most = _distinct(bounds, codes)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64)[codes]
    row = rows_of(bounds)
    mean = np.bincount(row, lengths, n) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, lengths**2, n) / np.maximum(n_words, 1) - mean**2, 0))
    lists = pc.split_pattern(texts, "\n")
    line_bounds = lists.offsets.to_numpy().astype(np.int64)
    line_bounds -= line_bounds[0]
    lines = np.diff(line_bounds).astype(np.float64)
    line_kinds, line_most = _distinct(line_bounds, lists.flatten().dictionary_encode().indices.to_numpy())
    per = lambda a, b: a / np.maximum(b, 1)
    extra = [np.log1p(size), np.log1p(n_words), mean, spread, per(kinds, n_words), per(most, n_words), per(line_kinds, lines), per(line_most, lines), np.log1p(per(size, lines))]
    return np.column_stack([share, *extra]) * (size > 0)[:, None]


@dataclass
class Trees:
    """Complete trees of one depth in flat arrays: inner node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - (2**DEPTH - 1)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting of the logistic loss; splits are searched in histograms of at most BINS quantile bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    feature, threshold, leaf = [], [], []
    z = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (at - first) * BINS + binned[:, j]
                gs = np.bincount(key, g, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                hs = np.bincount(key, h, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better] = top[better]
                f[first : first + nodes][better] = j
                t[first : first + nodes][better] = c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        at -= inner
        value = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        z += value[at]
        feature.append(f)
        threshold.append(t)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def quality(docs: DataFrame, labels: DataFrame, split: int = 4, held: int = 2, per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Statistics of whole texts are the only inputs. The trees are fitted on at
    most ``per_class`` labelled rows of each class, whose statistics alone
    reach the driver; scores are then moved to the classes' shares among all
    labels. A null or empty text is scored from
    statistics of 0. Without labelled rows of both classes all texts get the
    same score. Null labels are skipped and of repeated ones the largest
    counts; repeated rows are scored each, and other columns are ignored. A
    null doc_id has a null held_out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder("doc_id", split) != held)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    slim = docs.select("doc_id", "text")
    fields = [T.StructField("x", T.ArrayType(T.DoubleType()))]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column("text"))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), pa.array(x.ravel()))
        return pa.record_batch([lists, batch.column("doc_id"), batch.column("label")], names=["x", "doc_id", "label"])

    sample = slim.join(F.broadcast(some), "doc_id").select("text", "doc_id", "label")
    got = sample.mapInArrow(per_batch(measure), T.StructType([*fields, slim.schema["doc_id"], sample.schema["label"]])).toArrow().sort_by("doc_id")
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
    y = got.column("label").to_numpy().astype(np.float64)
    model = fit_trees(x, y)
    good, bad = known.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if 0 < y.sum() < len(y):
        model.base += float(np.log(good / bad) - np.log(y.sum() / (len(y) - y.sum())))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-model.logits(statistics(batch.column("text"))))))], names=["doc_id", "score"])

    scored = slim.mapInArrow(per_batch(score), T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (remainder("doc_id", split) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
