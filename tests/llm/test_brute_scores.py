"""Whole queries of the scoring operators against plain loops over bytes, words and characters."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, quality, toxicity
from millrace.llm.queries import QUERIES
from tests.oracle import DATA

D = f"{DATA}/sf0.001"
MASK = 2**64 - 1


def rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def bucket(h):
    h ^= h >> 29
    return (h * 0xBF58476D1CE4E5B9 & MASK) >> 40


def plain_subwords(word):
    """Buckets of the byte n-grams of the marked word and of all of it."""
    raw, prime, out = f"<{word}>".encode(), 1099511628211, []
    for n in toxicity.GRAMS:
        for i in range(len(raw) - n + 1):
            h = n
            for c in raw[i : i + n]:
                h = (h * prime + c) & MASK
            out.append(bucket(h) % toxicity.BUCKETS)
    whole = sum(c * pow(prime, i + 1, 2**64) for i, c in enumerate(raw)) & MASK
    return [*out, bucket(whole) % toxicity.BUCKETS]


def plain_toxicity(model, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    value = {}
    for w in words:
        if w not in value:
            of = plain_subwords(w)
            value[w] = sum(float(model.weight[b]) for b in of) / len(of)
    best = -math.inf
    for at in range(0, len(words), toxicity.WINDOW):
        some = words[at : at + toxicity.WINDOW]
        best = max(best, float(toxicity.SCALE) * sum(value[w] for w in some) / len(some) + model.bias)
    return 1 / (1 + math.exp(-best)) if words else 0.0


def test_toxicity_query_by_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels, 5, 0, toxicity.PER_CLASS, toxicity.LONGEST)
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, D).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        r, want = got[i], plain_toxicity(model, text)
        assert r.score == pytest.approx(want, abs=1e-5) and r.held_out == (rest(i, 5) == 0) and r.predicted == (r.score >= 0.5)


def test_toxicity_is_learned_from_its_part_alone(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fitted(docs.withColumn("lang", F.lit("x")), x, 5, 0, 3000, 8000) for x in (labels, turned))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias
    rows = toxicity.training_rows(docs, labels, "toxic", 5, 0, 3000, 8000).collect()
    known = {(r.doc_id, r.toxic) for r in labels.collect()}
    assert rows and all(rest(r.doc_id, 5) != 0 and (r.doc_id, r.label) in known for r in rows)


def plain_softmax_step(emb, out, bias, texts, labels):
    """Loss of the softmax over averages of averages, by loops."""
    total = 0.0
    for text, y in zip(texts, labels, strict=True):
        words = text.split()
        x = sum(np.mean([emb[b] for b in plain_subwords(w)], axis=0) for w in words) / len(words) * float(toxicity.SCALE)
        z = x @ out + bias
        total -= z[y] - math.log(sum(math.exp(v) for v in z))
    return total / len(texts)


def test_training_lowers_the_plain_loss():
    texts = [f"calm words number {'abcdef'[i % 6]}" for i in range(60)] + [f"you idiot number {'abcdef'[i % 6]}" for i in range(60)]
    labels = np.repeat([0, 1], 60)
    model = toxicity.train(pa.array(texts), labels, 0.5)
    chance = math.log(2)
    # the difference of the logits is all that the softmax sees
    emb, out = model.weight[:, None], np.array([[0.0, 1.0]])
    assert plain_softmax_step(emb, out, np.array([0.0, model.bias]), texts, labels) < 0.2 * chance


def plain_statistics(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * quality.FEATURES
    words = [w for w in re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))]
    lines = raw.split(b"\n")
    share = [sum(b in c for b in raw) / len(raw) for c in quality.CLASSES]
    size = [len(w.decode()) for w in words]
    mean = sum(size) / max(1, len(size))
    spread = math.sqrt(max(0.0, sum(s * s for s in size) / max(1, len(size)) - mean**2))
    often = lambda x: max(collections.Counter(x).values(), default=0)
    n = max(1, len(words))
    return [*share, math.log1p(len(raw)), math.log1p(len(words)), mean, spread, len(set(words)) / n, often(words) / n, len(set(lines)) / len(lines), often(lines) / len(lines), math.log1p(len(raw) / len(lines))]


def walk(trees, row):
    total = trees.base
    for f, cut, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        at = 0
        for _ in range(quality.DEPTH):
            at = 2 * at + (2 if row[f[at]] > cut[at] else 1)
        total += leaf[at - len(f)]
    return total


def test_quality_query_by_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if rest(r.doc_id, 4) != 2 and r.quality in (0, 1)}
    rows = sorted(i for i in known if i in texts)
    x, y = np.array([plain_statistics(texts[i]) for i in rows]), np.array([float(known[i]) for i in rows])
    assert np.allclose(x, quality.statistics(pa.array([texts[i] for i in rows])), rtol=1e-9)
    trees = quality.fit_trees(quality.statistics(pa.array([texts[i] for i in rows])), y)
    good = sum(known.values())
    trees.base += math.log(good / (len(known) - good)) - math.log(y.sum() / (len(y) - y.sum()))
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, D).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = 1 / (1 + math.exp(-walk(trees, quality.statistics(pa.array([text]))[0])))
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].held_out == (rest(i, 4) == 2) and got[i].predicted == (got[i].score >= 0.7)


class PlainKneserNey:
    def __init__(self, words):
        self.n, self.tables = language.ORDER, {}
        top, seen, opening = collections.defaultdict(collections.Counter), {k: set() for k in range(1, self.n)}, {k: collections.defaultdict(collections.Counter) for k in range(1, self.n)}
        for w, c in collections.Counter(words).items():
            s = f"\x02{w}\x03"
            for i in range(1, len(s)):
                if i >= self.n - 1:
                    top[s[i - self.n + 1 : i]][s[i]] += c
                for k in range(1, self.n):
                    if i >= k:
                        seen[k].add((s[i - k : i], s[i]))
                    elif i == k - 1:
                        opening[k][s[:i]][s[i]] += c
        self.tables[self.n] = top
        for k in range(1, self.n):
            t = opening[k]
            for context, c in seen[k]:
                t[context[1:]][c] += 1
            self.tables[k] = t

    def log(self, word):
        s, total = f"\x02{word}\x03", 0.0
        for i in range(1, len(s)):
            p = 1 / language.ALPHABET
            for k in range(1, self.n + 1):
                if i < k - 1:
                    break
                row = self.tables[k].get(s[i - k + 1 : i])
                if row:
                    n = sum(row.values())
                    p = max(row[s[i]] - language.DISCOUNT, 0) / n + language.DISCOUNT * len(row) / n * p
            total += math.log(max(p, 1e-12))
        return total


def letters(text):
    bare = ["".join(c for c in w if c.isalpha()) for w in re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())]
    return [w for w in bare if w]


def test_language_query_by_plain_loops(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id"), 33))
    rows = docs.collect()
    by = collections.defaultdict(list)
    for r in rows:
        if r.lang is not None and rest(r.doc_id, 5) != 0 and 1 <= len(r.text or "") <= language.LONGEST:
            by[r.lang].append(r)
    models = {}
    for lang, own in by.items():
        own.sort(key=lambda r: (r.draw, r.doc_id))
        models[lang] = PlainKneserNey([w for k, r in enumerate(own) if k % 10 for w in letters(r.text)])
    logs, close, wrong = {}, 0, []
    got = {r.doc_id: r for r in QUERIES["op7_language"](spark, D).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        words = letters(r.text)
        assert got[r.doc_id].held_out == (rest(r.doc_id, 5) == 0) and 0 <= got[r.doc_id].score <= 1
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        total = {}
        for lang, m in models.items():
            for w in set(words):
                if (lang, w) not in logs:
                    logs[lang, w] = m.log(w)
            total[lang] = -sum(logs[lang, w] for w in words) / sum(len(w) + 1 for w in words)
        ranked = sorted(total, key=lambda k: (total[k], k))
        if total[ranked[1]] - total[ranked[0]] < 1e-4:
            close += 1
        elif got[r.doc_id].lang_pred != ranked[0]:
            wrong.append(r.doc_id)
    assert not wrong and close < 0.05 * len(rows)
