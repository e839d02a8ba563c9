"""Operator 7: language from interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_batch, remainder, rows_of, words_of

#: Sampled documents of each language and their longest text in characters; order of the models; absolute discount.
PER_LANGUAGE, LONGEST, ORDER, DISCOUNT = 1500, 8000, 5, 0.75
#: Assumed size of the alphabet, for characters that no model has seen.
ALPHABET = 2000
#: Words whose scores a worker remembers.
REMEMBERED = 300_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters_of(words: pa.Array) -> pa.Array:
    """The letters of each word, the rest removed."""
    return pc.replace_substring_regex(words, pattern=r"[^\p{L}]+", replacement="")


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of ``<word>`` one after the other, position of each in its word)."""
    text = "".join([f"\x02{w}\x03" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return code, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)


def grams(code: np.ndarray, place: np.ndarray, n: int, before: np.ndarray | None) -> np.ndarray:
    """Hash of the n symbols that end at each position, from those of n-1; positions with fewer repeat the shorter one's."""
    if before is None:
        return (code + np.uint64(1)) * _PRIME
    first = np.zeros_like(code)
    first[n - 1 :] = code[: len(code) - n + 1]
    h = before ^ ((first + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93))
    h = (h ^ (h >> np.uint64(32))) * _PRIME
    return np.where(place >= n - 1, h, before)


def count_model(words: list[str], counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each order: sorted hashes, discounted probability, and the weight of the lower order after that context.

    The highest order counts occurrences; a lower one counts the different
    symbols that precede the n-gram.
    """
    code, place = symbols(words)
    weight = np.repeat(counts.astype(np.float64), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    real = place >= 1
    hashes, h = [], None
    for n in range(1, ORDER + 1):
        h = grams(code, place, n, h)
        hashes.append(h)
    out, probability, context_weight = [], [], []
    for n in range(1, ORDER + 1):
        whole = real & (place >= n - 1)
        key, first, inverse = np.unique(hashes[n - 1][whole], return_index=True, return_inverse=True)
        if n == ORDER:
            count = np.bincount(inverse, weight[whole], len(key))
        else:  # left neighbours, or occurrences where the word begins
            longer = np.flatnonzero(whole & (place >= n))
            _, one = np.unique(hashes[n][longer], return_index=True)
            count = np.bincount(np.searchsorted(key, hashes[n - 1][longer[one]]), minlength=len(key)).astype(np.float64)
            opening = whole & (place == n - 1)
            count += np.bincount(np.searchsorted(key, hashes[n - 1][opening]), weight[opening], len(key))
        at = np.flatnonzero(whole)[first]
        context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        ctx, c_inv = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(c_inv, count, len(ctx)), np.bincount(c_inv, minlength=len(ctx))
        probability.append((key, np.maximum(count - DISCOUNT, 0) / total[c_inv]))
        context_weight.append((ctx, DISCOUNT * kinds / total))
    for n in range(1, ORDER + 1):
        key, p = probability[n - 1]
        keys = np.union1d(key, context_weight[n][0]) if n < ORDER else key
        value, back = np.zeros(len(keys)), np.ones(len(keys))
        value[np.searchsorted(keys, key)] = p
        if n < ORDER:
            back[np.searchsorted(keys, context_weight[n][0])] = context_weight[n][1]
        out.append((keys, value, back))
    return [*out, (np.zeros(1, np.uint64), np.zeros(1), context_weight[0][1][:1])]


@dataclass
class Models:
    """All languages' models over common keys: for each order, sorted hashes and a row of values for each."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    backs: list[np.ndarray] = field(default_factory=list)
    unigram_back: np.ndarray | None = None
    sharpness: float = 1.0
    floor: np.ndarray | None = None

    @classmethod
    def of(cls, languages: list[str], single: list[list[tuple[np.ndarray, ...]]]) -> Models:
        out, k = cls(languages), len(languages)
        for n in range(ORDER):
            keys = np.unique(np.concatenate([m[n][0] for m in single]))
            value, back = np.zeros((len(keys) + 1, k), np.float32), np.ones((len(keys) + 1, k), np.float32)
            for j, m in enumerate(single):
                at = np.searchsorted(keys, m[n][0])
                value[at, j], back[at, j] = m[n][1], m[n][2]
            out.keys.append(keys)
            out.values.append(value)
            out.backs.append(back)
        out.unigram_back = np.array([m[ORDER][2][0] for m in single], np.float32)
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural logs of each word's probability, one column for each language."""
        code, place = symbols(words)
        p = np.full((len(code), len(self.languages)), 1 / ALPHABET, np.float32)
        back, h = self.unigram_back[None, :], None
        for n in range(1, ORDER + 1):
            h = grams(code, place, n, h)
            keys = self.keys[n - 1]
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            at[(keys[at] != h) | (place < n - 1)] = len(keys)
            here = place >= n - 1
            p = np.where(here[:, None], self.values[n - 1][at] + back * p, p)
            shifted = np.ones_like(p)
            shifted[1:] = self.backs[n - 1][at[:-1]]
            back = shifted
        logs = np.log(np.maximum(p, 1e-12))
        logs[place == 0] = 0
        first = np.flatnonzero(place == 0)
        return np.add.reduceat(logs, first, axis=0) if len(first) else np.zeros((0, len(self.languages)))


class Scorer:
    """Cross-entropies of texts; scores of recent words are kept in two generations."""

    def __init__(self, models: Models):
        self.models, self.new, self.old = models, {}, {}

    def of_words(self, words: pa.Array) -> np.ndarray:
        """For each word its letters and their ends, then the log probabilities."""
        names = words.to_pylist()
        new, old = self.new, self.old
        missing = [i for i, w in enumerate(names) if w not in new]
        moved = [names[i] for i in missing if names[i] in old]
        new.update(zip(moved, map(old.__getitem__, moved), strict=True))
        if moved:
            missing = [i for i in missing if names[i] not in new]
        if missing:
            bare = letters_of(words.take(pa.array(missing))).to_pylist()
            full = [i for i, b in enumerate(bare) if b]
            table = np.zeros((len(bare), len(self.models.languages) + 1), np.float32)
            for at in range(0, len(full), 50_000):
                part = full[at : at + 50_000]
                table[part, 1:] = self.models.word_scores([bare[i] for i in part])
                table[part, 0] = [len(bare[i]) + 1 for i in part]
            raw, step = table.tobytes(), 4 * table.shape[1]
            new.update((names[i], raw[j * step : (j + 1) * step]) for j, i in enumerate(missing))
        found = np.frombuffer(b"".join(map(new.__getitem__, names)), np.float32).reshape(len(names), -1)
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        return found

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, nats for each symbol and language) of each text."""
        bounds, codes, words = words_of(texts, lower=pc.utf8_lower)
        table = self.of_words(words)
        row, n = rows_of(bounds), len(texts)
        sums = np.column_stack([np.bincount(row, table[:, j][codes], n) for j in range(table.shape[1])]) if n else np.zeros((0, 1 + len(self.models.languages)))
        return sums[:, 0], -sums[:, 1:] / np.maximum(sums[:, :1], 1)


def languages(docs: DataFrame, split: int = 5, held: int = 0, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row for each row of ``docs``.

    Models are fitted on at most ``per_language`` documents of each language,
    none longer than ``longest`` characters, taken by hash order outside the
    held-out part; only those of low hashes for their language are ranked. The language of the lowest cross-entropy for each character
    is predicted, with its share of the languages' softmax as the score; ties
    go to the name that sorts first. ``rejected`` marks texts that their own
    language explains worse than nearly all of its sample. A text without
    letters, null or empty, is `und` with score 0, as is every text when no
    language was learned. A null doc_id has a null held_out and is not learned
    from; repeated rows are predicted each; other columns are ignored. The
    models are dense tables of all n-grams by all languages, for up to some
    hundred languages.
    """
    slim = docs.select("doc_id", "text")
    usable = docs.select("doc_id", "lang", F.length("text").alias("n")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("n").between(1, longest) & (remainder("doc_id", split) != held))
    usable = usable.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 33).alias("draw"))
    # of a common language only the lowest draws, a few more than are wanted, are shuffled and ranked
    totals = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("total"))  # rows may repeat; within the few more
    drawn = usable.join(F.broadcast(totals), "lang").filter(F.col("draw") * F.col("total").cast("double") <= F.lit(2.0**31 * (per_language + per_language // 4 + 50))).select("doc_id", "lang", "draw").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = drawn.withColumn("k", rank).filter(F.col("k") <= per_language).select("doc_id", "lang", "k").dropDuplicates(["doc_id"])
    sample = slim.filter(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").select("lang", "text", "k")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        bounds, codes, words = words_of(pa.array(rows.text), lower=pc.utf8_lower)
        bare = np.array(letters_of(words).to_pylist(), object)[codes]
        learn = rows_of(bounds) % 10 != 0  # a tenth of the texts calibrates
        known = pd.Series(bare[learn]).value_counts().sort_index().drop("", errors="ignore")
        if not len(known):
            return pd.DataFrame(columns=["lang", "n", "h", "p", "b", "texts"])
        model = count_model(known.index.tolist(), known.to_numpy())
        kept = rows.text.iloc[::10].tolist()
        return pd.DataFrame([{"lang": rows.lang.iloc[0], "n": n, "h": h.tobytes(), "p": p.astype("<f8").tobytes(), "b": b.astype("<f8").tobytes(), "texts": kept if n == 0 else []} for n, (h, p, b) in enumerate(model)])

    rows = sample.groupBy("lang").applyInPandas(fit, "lang string, n int, h binary, p binary, b binary, texts array<string>").collect()
    names = sorted({r.lang for r in rows})
    parts = {(r.lang, r.n): (np.frombuffer(r.h, np.uint64), np.frombuffer(r.p), np.frombuffer(r.b)) for r in rows}
    models = Models.of(names, [[parts[name, n] for n in range(ORDER + 1)] for name in names]) if names else Models([])
    if names:
        calibrate(models, {r.lang: r.texts for r in rows if r.n == 0})
    kind = T.StructType([slim.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def predict(batches):
        scorer = Scorer(models)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not names:
                size, best, score, rejected = np.zeros(batch.num_rows), np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            else:
                size, h = scorer.entropies(batch.column("text"))
                best, score, rejected = decide(models, size, h)
            pred = np.where(size > 0, np.array([*names, "und"], object)[best], "und")
            return pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=[f.name for f in kind])

        yield from per_batch(one)(batches)

    found = slim.mapInArrow(predict, kind)
    return found.select("doc_id", (remainder("doc_id", split) == held).alias("held_out"), "lang_pred", "score", "rejected")


def decide(models: Models, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = h.argmin(1)
    z = -models.sharpness * h
    p = np.exp(z - z.max(1, keepdims=True))
    score = np.where(size > 0, (p / p.sum(1, keepdims=True))[np.arange(len(best)), best], 0.0)
    return best, score, (size == 0) | (h[np.arange(len(best)), best] > models.floor[best])


def calibrate(models: Models, texts: dict[str, list[str]]) -> None:
    """The sharpness of the softmax and each language's rejection bound, from texts that were kept out of the models."""
    scorer, hs, ys = Scorer(models), [], []
    for j, name in enumerate(models.languages):
        size, h = scorer.entropies(pa.array(texts.get(name) or [], pa.string()))
        hs.append(h[size > 0])
        ys.append(np.full(int((size > 0).sum()), j))
    models.floor = np.array([np.quantile(h[:, j], 0.995) * 1.25 if len(h) else np.inf for j, h in enumerate(hs)])
    h, y = np.concatenate(hs), np.concatenate(ys)
    if not len(y):
        return

    def loss(s: float) -> float:
        z = -s * h
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]))

    models.sharpness = min((1, 2, 4, 8, 16, 32, 64), key=loss)
