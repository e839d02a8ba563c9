"""Slices of a batch give what whole copies of their rows give, in every function that works on texts."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from millrace.llm import bpe, common, jaccard, language, lm, quality, toxicity
from millrace.llm.queries import BYTE_BPE, WORD_BPE


def texts(n=60):
    rnd = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "été", "ßs", "x1", "語", "don't", "\n", "Ünder\t", "end."]
    return [rnd.choice([None, "", " "]) if rnd.random() < 0.1 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 300, 4000])
def test_slices_give_what_copies_give(size):
    given = texts()
    batch = pa.record_batch([pa.array(range(len(given))), pa.array(given, pa.string())], names=["doc_id", "text"])
    parts = list(common.slices(batch, size=size))
    assert len(parts) > 1 and [x for p in parts for x in p.column("text").to_pylist()] == given
    for part in parts:
        cut, own = part.column("text"), pa.array(part.column("text").to_pylist(), pa.string())
        for lower in (pc.ascii_lower, pc.utf8_lower, None):
            (b, c, w), (b1, c1, w1) = common.words_of(cut, lower), common.words_of(own, lower)
            fold = {None: lambda t: t, pc.utf8_lower: str.lower}.get(lower, lambda t: t.encode().lower().decode())
            assert b.tolist() == b1.tolist() and w.take(pa.array(c)).to_pylist() == w1.take(pa.array(c1)).to_pylist() == [x for t in own.to_pylist() for x in fold(t or "").split()]
        for a, b in zip(jaccard.shingles(cut, 3), jaccard.shingles(own, 3), strict=True):
            assert a.tolist() == b.tolist()
        assert np.array_equal(quality.statistics(cut), quality.statistics(own))
        assert bpe.counts_of(BYTE_BPE, cut).tolist() == bpe.counts_of(BYTE_BPE, own).tolist()
        for a, b in zip(bpe.ids_of(WORD_BPE, cut), bpe.ids_of(WORD_BPE, own), strict=True):
            assert a.tolist() == b.tolist()
        model = toxicity.Model(np.arange(toxicity.BUCKETS, dtype=np.float32) / toxicity.BUCKETS, 0.0)
        assert np.array_equal(toxicity.scores(model, cut), toxicity.scores(model, own))
        models = language.Models.of(["x"], [language.count_model(["alpha", "beta"], np.array([1, 2]))])
        for a, b in zip(language.Scorer(models).entropies(cut), language.Scorer(models).entropies(own), strict=True):
            assert np.array_equal(a, b)


def test_counts_do_not_depend_on_slices():
    given = [t for t in texts(200) if t]
    batch = pa.record_batch([pa.array(given, pa.string())], names=["text"])
    whole = pa.Table.from_batches(lm.counted([batch])).to_pydict()
    apart = pa.Table.from_batches(lm.counted([batch.slice(i, 7) for i in range(0, len(given), 7)])).to_pydict()
    total = lambda d: sorted(zip(d["h"], d["n"], strict=True))
    assert total(whole) == total(apart) and sum(whole["n"]) == sum(len(t.split()) + 1 for t in given)
