"""Operator 3: language-model scores from a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, rows_of, slices, stored, sums_by_row, words_of

#: Common words are the most frequent ones, in classes of equal size by rank; the rest are in classes by their ending.
CLASSES, CLASS_WORDS, TAILS = 24, 32, 8
COMMON = CLASSES * CLASS_WORDS
#: Symbols of a context: none, each common word, and endings by hash. Rows of hashed pairs.
SYMBOLS, PAIRS = 2048, 1 << 13
#: Most frequent words whose counts every task holds; counts of the others are joined.
HELD_COUNTS = 1 << 18
#: Tokens to a gradient step, its rate, and the rounds of averaging by share of the training documents, in quarters.
BATCH, RATE, ROUNDS = 16_384, 0.15, ((0,), (1, 2, 3))
#: Rows of parameters that are summed together.
PART = 128
SMOOTH = 0.1
END = np.uint64(0xE17D)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, symbol by the last three bytes, class by the last two) of each word."""
    raw = words.cast(pa.large_binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
    last = np.frombuffer(b"".join([(b"\0\0\0" + r)[-3:] for r in raw]), np.uint8).reshape(-1, 3).astype(np.uint64)
    two = (last[:, 1] << np.uint64(8) | last[:, 2]) * np.uint64(0x9E3779B97F4A7C15)
    three = ((last[:, 0] << np.uint64(16)) + (last[:, 1] << np.uint64(8)) + last[:, 2] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return h, ((three >> np.uint64(33)) % np.uint64(SYMBOLS - COMMON - 1)).astype(np.int64) + COMMON + 1, (two >> np.uint64(40)).astype(np.int64) % TAILS


def counted(batches):
    """(h, tail, n) of the words of a partition, and of the ends of its texts."""
    parts, held = [], 0

    def merged():
        h, t, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return key, t[first], np.bincount(inverse, n, len(key))

    ends = 0
    for batch in batches:
        for part in slices(batch) if batch.num_rows else ():
            bounds, codes, words = words_of(part.column("text"))
            ends += part.num_rows
            if len(codes):
                h, _, tail = word_features(words)
                parts.append((h, tail, np.bincount(codes, minlength=len(h)).astype(np.float64)))
                held += len(h)
            if held > 2_000_000:
                parts = [merged()]
                held = len(parts[0][0])
                if held > 1_000_000:
                    yield _counts(*parts[0])
                    parts, held = [], 0
    if ends:
        parts.append((np.array([END]), np.zeros(1, np.int64), np.array([float(ends)])))
    if parts:
        yield _counts(*merged())


def _counts(h, tail, n) -> pa.RecordBatch:
    keep = n > 0
    return pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(tail[keep].astype(np.int32)), pa.array(n[keep].astype(np.int64))], names=["h", "tail", "n"])


@dataclass
class Vocabulary:
    """Sorted hashes with counts, and which of them are common words, by their rank."""

    hashes: np.ndarray
    counts: np.ndarray
    common: np.ndarray
    common_rank: np.ndarray

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """(hash, count or -1, rank or -1, symbol, tail class) of each word."""
        h, symbol, tail = word_features(words)
        count = np.full(len(h), -1, np.int64)
        rank = np.full(len(h), -1, np.int64)
        for keys, values, out in ((self.hashes, self.counts, count), (self.common, self.common_rank, rank)):
            if len(keys):
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h
                out[hit] = values[at[hit]]
        return h, count, rank, np.where(rank >= 0, rank + 1, symbol), tail


@dataclass
class Tokens:
    """Tokens of some texts, each with its end: class, word within a common class or -1, and context symbols."""

    bounds: np.ndarray
    codes: np.ndarray
    cls: np.ndarray
    word: np.ndarray
    before: list[np.ndarray]


def tokens_of(texts: pa.Array, vocabulary: Vocabulary) -> tuple[Tokens, tuple[np.ndarray, ...]]:
    """Codes refer to the words found, the last of which stands for the end."""
    bounds, codes, words = words_of(texts)
    h, count, rank, symbol, tail = vocabulary.look_up(words)
    end_count = vocabulary.counts[np.searchsorted(vocabulary.hashes, END)] if END in vocabulary.hashes else 0
    h, count, rank, symbol, tail = (np.append(x, y) for x, y in zip((h, count, rank, symbol, tail), (END, end_count, 0, 1, 0), strict=True))
    n = len(bounds) - 1
    at = np.arange(len(codes)) + rows_of(bounds)
    full = np.full(len(codes) + n, len(h) - 1, np.int64)
    full[at] = codes
    bounds = bounds + np.arange(n + 1)
    r, s = rank[full], symbol[full]
    cls = np.where(r >= 0, r // CLASS_WORDS, CLASSES + tail[full]).astype(np.int64)
    word = np.where(r >= 0, r % CLASS_WORDS, -1)
    place = np.arange(len(full)) - np.repeat(bounds[:-1], np.diff(bounds))
    before = []
    for d in (1, 2, 3):
        shifted = np.zeros(len(full), np.int64)
        shifted[d:] = s[: max(0, len(full) - d)]
        shifted[place < d] = 0
        before.append(shifted)
    return Tokens(bounds, full, cls, word, before), (h, count)


WIDTH = CLASSES + TAILS
#: Name, rows and columns of each table of weights.
TABLES = [("bias", 1, WIDTH), ("one", SYMBOLS, WIDTH), ("skip2", SYMBOLS, WIDTH), ("skip3", SYMBOLS, WIDTH), ("pair", PAIRS, WIDTH), ("own", CLASSES, CLASS_WORDS), ("own1", PAIRS, CLASS_WORDS), ("own2", PAIRS, CLASS_WORDS)]
assert WIDTH == CLASS_WORDS


class Model:
    """Weights of the class softmax and of the softmax of words within each common class."""

    def __init__(self, weights: np.ndarray):
        self.weights, at = weights, 0
        self.tables = {}
        for name, rows, _ in TABLES:
            self.tables[name] = (at, weights[at : at + rows])
            at += rows

    @classmethod
    def initial(cls, class_counts: np.ndarray, word_counts: np.ndarray) -> Model:
        """Biases that give the frequencies, and no influence of contexts."""
        w = np.zeros((sum(rows for _, rows, _ in TABLES), WIDTH), np.float32)
        model = cls(w)
        model.tables["bias"][1][0] = np.log(class_counts + SMOOTH)
        model.tables["own"][1][:] = np.log(word_counts + SMOOTH)
        return model

    def features(self, t: Tokens, sel: slice) -> list[tuple[str, np.ndarray]]:
        a, b, c = (x[sel] for x in t.before)
        return [("one", a), ("skip2", b), ("skip3", c), ("pair", (a * 2654435761 + b * 40503 + (a * b >> 3)) % PAIRS)]

    def word_features(self, t: Tokens, sel: np.ndarray) -> list[tuple[str, np.ndarray]]:
        a, b, k = t.before[0][sel], t.before[1][sel], t.cls[sel]
        return [("own", k), ("own1", (a * 31 + k * 7919) % PAIRS), ("own2", (b * 31 + k * 7919) % PAIRS)]

    def logits(self, features: list[tuple[str, np.ndarray]], bias: np.ndarray | None) -> np.ndarray:
        z = self.tables[features[0][0]][1][features[0][1]]
        for name, rows in features[1:]:
            z += self.tables[name][1][rows]
        if bias is not None:
            z += bias
        return z

    @staticmethod
    def normalise(z: np.ndarray) -> np.ndarray:
        """exp(z) with rows that sum to 1, in place."""
        top = z.max(1)
        z -= top[:, None]
        np.exp(z, out=z)
        total = z.sum(1)
        z /= total[:, None]
        return z

    def log_probabilities(self, t: Tokens) -> np.ndarray:
        """Natural logs of P(class | context) and, for common words, P(word | class, context), added."""
        out = np.zeros(len(t.cls))
        for at in range(0, len(out), BATCH):
            sel = slice(at, at + BATCH)
            p = self.normalise(self.logits(self.features(t, sel), self.tables["bias"][1][0]))
            out[sel] = np.log(p[np.arange(len(p)), t.cls[sel]])
            own = at + np.flatnonzero(t.word[sel] >= 0)
            if len(own):
                p = self.normalise(self.logits(self.word_features(t, own), None))
                out[own] += np.log(p[np.arange(len(own)), t.word[own]])
        return out

    def learn(self, t: Tokens, seen: np.ndarray, used: np.ndarray) -> None:
        """Gradient steps over the tokens, with a rate for each row from the gradients so far."""
        for at in range(0, len(t.cls), BATCH):
            sel = slice(at, at + BATCH)
            features = self.features(t, sel)
            g = self.normalise(self.logits(features, self.tables["bias"][1][0]))
            g[np.arange(len(g)), t.cls[sel]] -= 1
            self.apply(features, g, seen, used)
            self.step("bias", np.zeros(1, np.int64), g.sum(0, keepdims=True), np.array([len(g)]), seen, used)
            own = at + np.flatnonzero(t.word[sel] >= 0)
            if len(own):
                features = self.word_features(t, own)
                g = self.normalise(self.logits(features, None))
                g[np.arange(len(own)), t.word[own]] -= 1
                self.apply(features, g, seen, used)

    def apply(self, features, g, seen, used) -> None:
        for name, rows in features:
            order = np.argsort(rows.astype(np.uint16), kind="stable")
            ranked = rows[order]
            first = np.flatnonzero(np.diff(ranked, prepend=-1))
            self.step(name, ranked[first], np.add.reduceat(g[order], first, axis=0), np.diff(np.append(first, len(rows))), seen, used)

    def step(self, name, rows, total, n, seen, used) -> None:
        at = self.tables[name][0] + rows
        total /= np.sqrt(n)[:, None]  # a row's step grows with the root of its uses
        seen[at] += (total**2).mean(1)
        used[at] += n
        self.weights[at] -= (RATE / np.sqrt(seen[at]))[:, None] * total


def learn_partition(weights: np.ndarray, vocabulary: Vocabulary, batches):
    """(part, slot, sums): weights after the partition's texts, times the uses of each row, and the uses."""
    model = Model(weights.copy())
    seen, used = np.full(len(weights), 1.0, np.float32), np.zeros(len(weights), np.float32)
    for batch in batches:
        for part in slices(batch) if batch.num_rows else ():
            model.learn(tokens_of(part.column("text"), vocabulary)[0], seen, used)
    out = np.column_stack([model.weights * used[:, None], used]).astype("<f4")
    slot = TaskContext.get().partitionId() % 64
    for p in range(0, len(out), PART):
        rows = out[p : p + PART]
        if rows[:, -1].any():
            yield pa.record_batch([pa.array([p // PART], pa.int32()), pa.array([slot], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["part", "slot", "sums"])


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(s, "<f4") for s in rows.sums], axis=0, dtype=np.float64).astype("<f4")
    return pd.DataFrame({"part": rows.part.iloc[:1], "slot": rows.slot.iloc[:1], "sums": [total.tobytes()]})


def trained(train: DataFrame, start: Model, vocabulary: Vocabulary) -> Model:
    """Each round, tasks take gradient steps over their texts from common weights, which are then averaged by use."""
    weights = start.weights
    kind = "part int, slot int, sums binary"
    for quarters in ROUNDS:
        some = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)).isin(*quarters)).select("text")

        def run(batches, weights=weights):
            return learn_partition(weights, vocabulary, batches)

        sums = some.mapInArrow(run, kind).groupBy("part", "slot").applyInPandas(_added, kind).groupBy("part").applyInPandas(_added, kind)
        weights = weights.copy()
        for r in sums.collect():
            rows = np.frombuffer(r.sums, "<f4").reshape(-1, WIDTH + 1)
            at = r.part * PART + np.flatnonzero(rows[:, -1])
            rows = rows[rows[:, -1] > 0]
            weights[at] = rows[:, :-1] / rows[:, -1:]
    return Model(weights)


def lm_scores(docs: DataFrame, split: int = 10, held: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    Tokens are the words of the text in lower case (A-Z) between ASCII white
    space, then an end. base_score is their log10 probability by smoothed
    counts. score is that of a maximum-entropy model: the class of a token
    given the words one, two and three places before it and the pair before it,
    and a common word within its class given the words one and two places
    before. Other words have their smoothed share of their class, in which all
    words not seen in training are one. Both learn from every row outside the
    held-out part; a null doc_id is not learned from and has a null held_out.
    A null or empty text is one end. Repeated rows count and are scored each.
    Without training rows N and V are 0. Other columns are ignored.
    """
    slim = docs.select("doc_id", "text")
    train = slim.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", split) != held))
    counts = stored(train.select("text").mapInArrow(counted, "h bigint, tail int, n bigint").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "h").limit(HELD_COUNTS).toArrow().combine_chunks()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    common = np.concatenate([[END], h[h != END][: COMMON - 1]]).astype(np.uint64)
    rank_of = np.argsort(common)
    by_hash = np.argsort(h)
    vocabulary = Vocabulary(h[by_hash], n[by_hash], common[rank_of], rank_of)
    of_common = dict(zip(h.tolist(), n.tolist(), strict=True))
    word_counts = np.zeros(COMMON)
    word_counts[: len(common)] = [of_common.get(x, 0) for x in common.tolist()]
    is_common = F.col("h").isin(*[int(x) for x in common.view(np.int64)])
    tails = {r.tail: (r.n, r.v) for r in counts.filter(~is_common).groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tail_n, tail_v = (np.array([tails.get(t, (0, 0))[i] for t in range(TAILS)], float) for i in (0, 1))
    all_n = int(word_counts.sum() + tail_n.sum())
    all_v = int((word_counts > 0).sum() + tail_v.sum())
    # a common class that holds fewer words than it has places gives the others next to nothing
    start = Model.initial(np.concatenate([word_counts.reshape(CLASSES, -1).sum(1), tail_n]), word_counts.reshape(CLASSES, -1))
    start.tables["own"][1].ravel()[len(common) :] = -30
    model = trained(train, start, vocabulary) if all_n else start
    weights, log_tail, log_all = model.weights, np.log10(tail_n + SMOOTH * (tail_v + 1)), math.log10(all_n + SMOOTH * (all_v + 1))
    kind = T.StructType([slim.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("row_id", "n_tokens", "known")], *[T.StructField(c, T.DoubleType()) for c in ("base", "model")], T.StructField("rare_h", T.ArrayType(T.LongType())), T.StructField("rare_n", T.ArrayType(T.LongType()))])

    def score(batches):
        model, row_id = Model(weights), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                t, (h, count) = tokens_of(part.column("text"), vocabulary)
                c = count[t.codes]
                held_back = c < 0  # the count is not among those at hand
                seen = np.where(held_back, 0.0, np.log10(np.maximum(c, 0) + SMOOTH))
                tail = t.word < 0
                logs = model.log_probabilities(t) / math.log(10)
                logs[tail] += seen[tail] - log_tail[t.cls[tail] - CLASSES]
                m = part.num_rows
                key = (rows_of(t.bounds) * len(h) + t.codes)[held_back]
                key, often = np.unique(key, return_counts=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(key // len(h), minlength=m))]).astype(np.int32)
                size = np.diff(t.bounds)
                yield pa.record_batch(
                    [
                        part.column("doc_id"), pa.array(row_id + np.arange(m)), pa.array(size), pa.array(sums_by_row((c > 0).astype(np.int64), t.bounds)),
                        pa.array(sums_by_row(seen, t.bounds) - size * log_all), pa.array(sums_by_row(logs, t.bounds)),
                        pa.ListArray.from_arrays(ends, pa.array(h[key % len(h)].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(often)),
                    ],
                    names=[f.name for f in kind],
                )
                row_id += m

    scored = stored(slim.mapInArrow(score, kind))
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("r")).select("row_id", F.col("r.rare_h").alias("rh"), F.col("r.rare_n").alias("rn"))
    known = rare.join(counts.select("h", "n"), F.col("rh") == F.col("h"), "left")
    rest = known.groupBy(F.col("row_id").alias("rid")).agg(F.sum(F.col("rn") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("rn")).otherwise(0)).alias("more"))
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.drop("rare_h", "rare_n").join(rest, scored["row_id"] == rest["rid"], "left").select(
        "doc_id", (remainder("doc_id", split) == held).alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(all_n).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
