"""Toxicity, quality, language and language-model scores: held-out accuracy, exact parts by brute force, odd rows."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, lm, quality, toxicity
from millrace.llm.common import words_of
from millrace.llm.queries import QUERIES
from tests.oracle import DATA

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "some text here"), (5, "x" * 50_000), (6, "é ß ñ 語 " * 3000), (7, "\x00\x1c|||")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en" if i % 2 else None, "src") for i, r in enumerate(ODD)], "doc_id bigint, text string, lang string, score string")


def held(doc_id, n, r):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n == r


def joined(spark, name, sf="sf0.01"):
    d = f"{DATA}/{sf}"
    got = QUERIES[name](spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    return got.merge(docs, on="doc_id").merge(labels, on="doc_id", how="left")


def auc(score, y):
    order = np.argsort(np.argsort(score))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_toxicity_on_held_out_rows(spark):
    m = joined(spark, "op1_toxicity", "sf0.1")
    assert (m.held_out == [held(i, 5, 0) for i in m.doc_id]).all()
    m = m[m.held_out & m.toxic.notna()]
    assert auc(m.score, m.toxic) > 0.93 and (m.predicted == m.toxic).mean() > 0.93


def test_misspellings_share_subwords():
    texts = pa.array([f"calm words number {i} here" for i in range(300)] + [f"you stupid idiot number {i} here" for i in range(300)])
    model = toxicity.train(texts, np.repeat([0, 1], 300), 0.5)
    s = toxicity.scores(model, pa.array(["what an idiott", "such calm words", None, ""]))
    assert s[0] > 0.5 > s[1] and s[2] == s[3] == 0


def test_toxicity_rows_and_filter(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD)
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns
    flagged = collections.Counter(r.doc_id for r in got if r.predicted)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r[0] for r in ODD) - flagged


def test_quality_on_held_out_rows(spark):
    m = joined(spark, "op2_quality")
    assert (m.held_out == [held(i, 4, 2) for i in m.doc_id]).all() and (m.predicted == (m.score >= 0.7)).all()
    m = m[m.held_out & m.quality.notna()]
    assert auc(m.score, m.quality) > 0.95 and (m.predicted == m.quality).mean() > 0.9


def test_trees_in_arrays_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.fit_trees(x, y)

    def walk(row):
        total = t.base
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + bool(row[f[at]] > cut[at])
            total += leaf[at - len(f)]
        return total

    assert np.allclose(t.logits(x), [walk(r) for r in x])
    assert ((t.logits(x) > 0) == y).mean() > 0.97


def test_quality_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, None)], "doc_id bigint, quality int, toxic int")
    got = quality.quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(odd.limit(0), labels).count() == 0
    assert quality.quality(odd, labels.limit(0)).count() == len(ODD)
    assert quality.statistics(pa.array([None, ""])).tolist() == np.zeros((2, quality.FEATURES)).tolist()


def test_language_on_held_out_rows(spark):
    m = joined(spark, "op7_language")
    assert (m.held_out == [held(i, 5, 0) for i in m.doc_id]).all()
    assert (m.lang_pred == m.lang)[m.held_out].mean() > 0.98 and m.score.between(0, 1).all()


def test_language_rows(spark, odd):
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language.languages(odd).collect()}
    assert {(i, "und", held(i, 5, 0)) for i in (1, 2, 3, 7)} <= got and (4, "en", held(4, 5, 0)) in got
    assert {r.lang_pred for r in language.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(odd.limit(0)).count() == 0


def test_kneser_ney_against_a_plain_one():
    words, counts = ["abab", "abc", "cab", "b", "bab"], np.array([3, 1, 2, 5, 1])
    models = language.Models.of(["x"], [language.count_model(words, counts)])
    n, d = language.ORDER, language.DISCOUNT
    grams = collections.defaultdict(collections.Counter)  # context -> next symbol -> count
    for w, c in zip(words, counts, strict=True):
        s = f"\x02{w}\x03"
        for i in range(1, len(s)):
            grams[s[max(0, i - n + 1) : i]][s[i]] += int(c)
    tables = {n: {k: v for k, v in grams.items() if len(k) == n - 1}}
    for k in range(n - 1, 0, -1):
        t = collections.defaultdict(collections.Counter)
        seen = set()
        for w, c in zip(words, counts, strict=True):
            s = f"\x02{w}\x03"
            for i in range(1, len(s)):
                if i >= k:
                    seen.add((s[i - k : i], s[i]))
                elif i == k - 1:
                    t[s[:i]][s[i]] += int(c)
        for context, c in seen:
            t[context[1:]][c] += 1
        tables[k] = t

    def p(context, c):
        out = 1 / language.ALPHABET
        for k in range(1, n + 1):
            if len(context) < k - 1:
                break
            row = tables[k].get(context[len(context) - k + 1 :])
            if row:
                total = sum(row.values())
                out = max(row[c] - d, 0) / total + d * len(row) / total * out
        return out

    for w in ["abab", "cc", "zb", "bbbab"]:
        s = f"\x02{w}\x03"
        want = sum(math.log(p(s[max(0, i - n + 1) : i], s[i])) for i in range(1, len(s)))
        assert models.word_scores([w])[0, 0] == pytest.approx(want, rel=1e-4)


def plain_tokens(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower)), None]


def check_lm(got, docs):
    counts = collections.Counter()
    for i, text in docs:
        if held(i, 10, 0) is False:
            counts.update(plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, text in docs:
        tokens = plain_tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want[i, held(i, 10, 0), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want


@pytest.mark.parametrize("held_counts", [50, lm.HELD_COUNTS])
def test_base_scores_by_brute_force(spark, monkeypatch, held_counts):
    monkeypatch.setattr(lm, "HELD_COUNTS", max(held_counts, 10))
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    got = lm.lm_scores(docs.repartition(3)).collect()
    check_lm(got, [tuple(r) for r in docs.collect()])


def test_lm_beats_counts_on_held_out_rows(spark):
    m = joined(spark, "op3_lm_scores")
    m = m[m.held_out]
    assert m.score.sum() > 0.97 * m.base_score.sum() and (m.score > m.base_score).mean() > 0.9


def test_lm_rows(spark, odd):
    check_lm(lm.lm_scores(odd).collect(), ODD)
    assert lm.lm_scores(odd.limit(0)).count() == 0
    alone = lm.lm_scores(odd.filter("doc_id IS NULL")).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)


def test_model_is_a_distribution():
    rng = np.random.default_rng(0)
    model = lm.Model(rng.normal(size=(sum(r for _, r, _ in lm.TABLES), lm.WIDTH)).astype(np.float32))
    before = [np.full(lm.WIDTH, x) for x in (5, 900, 0)]
    t = lm.Tokens(np.array([0, lm.WIDTH]), None, np.arange(lm.WIDTH), np.full(lm.WIDTH, -1), before)
    assert np.exp(model.log_probabilities(t)).sum() == pytest.approx(1, rel=1e-4)
    t = lm.Tokens(np.array([0, lm.WIDTH]), None, np.full(lm.WIDTH, 3), np.arange(lm.WIDTH), before)
    one = lm.Tokens(np.array([0, 1]), None, np.array([3]), np.array([-1]), [b[:1] for b in before])
    assert np.exp(model.log_probabilities(t)).sum() == pytest.approx(np.exp(model.log_probabilities(one))[0], rel=1e-4)


def test_words_split_at_ascii_white_space_alone():
    bounds, codes, words = words_of(pa.array([" A b\x0bC d ", None, "", "x\x1cy"]))
    assert [[words[c].as_py() for c in codes[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)] == [["a", "b", "c d"], [], [], ["x\x1cy"]]


def test_language_model_counts_by_brute_force_over_many_slices(spark):
    d = f"{DATA}/sf0.1"
    docs = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    counts = collections.Counter()
    for i, words in docs:
        if not held(i, 10, 0):
            counts.update(words)
            counts[None] += 1
    n = sum(counts.values())
    base = {w: math.log10((c + 0.1) / (n + 0.1 * (len(counts) + 1))) for w, c in counts.items()}
    unknown = math.log10(0.1 / (n + 0.1 * (len(counts) + 1)))
    got = {r.doc_id: r for r in QUERIES["op3_lm_scores"](spark, d).collect()}
    assert len(got) == len(docs)
    for i, words in docs:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(w in counts for w in words) + 1, n)
        assert abs(r.base_score - sum(base.get(w, unknown) for w in [*words, None])) < 1e-6 * len(words) + 1e-6
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_only_low_draws_of_a_language_are_ranked(spark):
    """The sample is the lowest draws of all usable rows, whatever the language's size."""
    d = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "the cat sat on the mat").otherwise("der hund und die katze").alias("text"), F.when(F.col("id") % 10 == 0, "en").otherwise("de").alias("lang"))
    d = d.unionByName(d.filter("doc_id = 7"))
    got = language.languages(d, per_language=60).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 400, "de": 3601}
