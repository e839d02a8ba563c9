"""Token ids in wavelet matrices: round trips, and ranks and selects against plain lists; ids against the library's on whole texts."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, wavelet
from millrace.llm.queries import BYTE_BPE, QUERIES
from tests.oracle import DATA


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70), max_size=60), max_size=12), st.sampled_from([64, 256]), st.sampled_from([1, 900, 60_000_000]))
def test_shards_against_lists(docs, block_bits, step):
    docs = [[x * step for x in d] for d in docs]
    ids = np.array([x for d in docs for x in d], "<u4")
    keys, nulls = np.arange(len(docs)) * -3, np.arange(len(docs)) % 4 == 1
    raw = wavelet.encoded(ids, np.array([len(d) for d in docs], np.int64), keys, nulls, 7, 90, block_bits)
    shard = wavelet.Shard(raw + b"\n")
    assert (shard.part, shard.before, shard.n, shard.docs) == (7, 90, len(ids), len(docs))
    assert shard.ids().tolist() == ids.tolist() and shard.sizes.tolist() == [len(d) for d in docs]
    assert shard.null.tolist() == nulls.tolist() and shard.doc_ids[~nulls].tolist() == keys[~nulls].tolist()
    assert [shard.token(i) for i in range(len(ids))] == ids.tolist()
    places = collections.defaultdict(list)
    for i, x in enumerate(ids.tolist()):
        places[x].append(i)
    for x in [*places, 71 * step, 4_200_000_000]:
        assert shard.occurrences(x).tolist() == places[x] and shard.count(x) == len(places[x])
        for a, b in ((0, len(ids) // 2), (len(ids) // 3, len(ids))):
            inside = [i for i in places[x] if a <= i < b]
            assert shard.count(x, a, b) == len(inside) and shard.occurrences(x, a, b).tolist() == inside
        assert [shard.nth(x, k) for k in range(len(places[x]) + 1)] == [*places[x], -1]


def test_skewed_ids_are_compressed():
    rnd = np.random.default_rng(1)
    ids = np.minimum(rnd.zipf(1.5, 200_000), 50_000).astype("<u4")
    raw = wavelet.encoded(ids, np.array([len(ids)]), np.array([1]), np.array([False]))
    assert len(raw) < 0.6 * 2 * len(ids)


def odd_texts():
    rnd = random.Random(2)
    bits = ["word", " ", "  ", "\n", "\t", "é", "語", " ", " ", "\x1c", "x1y", "don't", "<|endoftext|>", "\U0001f600", "12345", "...", "\r\n", "Ġ", "é"]
    return [None, "", " ", "a", " a", "a ", "<|endoftext|>", " <|endoftext|> ", *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(1500))]


def test_ids_are_the_librarys():
    texts, library = odd_texts(), Tokenizer.from_file(BYTE_BPE)
    bounds, ids = bpe.byte_ids_of(BYTE_BPE, pa.array(texts, pa.string()))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_odd_ends_of_pieces():
    pieces = ["", "a", "a ", "a\n", "\x1c", "b\x1f", "\u00a0", "x\u3000", " y", "\u200b"]
    assert bpe.odd_ends(pieces).tolist() == [not p or p[-1].isspace() for p in pieces]
    assert bpe.odd_ends([]).tolist() == []


def plain(rows):
    """(doc_id, start, n_tokens, ids_crc32) by one pass over sorted rows."""
    library, at, out = Tokenizer.from_file(BYTE_BPE), 0, []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_the_library(spark):
    d = f"{DATA}/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op11_token_ids"](spark, d).collect())) == sorted(plain(rows))


@pytest.mark.parametrize("shard_tokens", [1, 200, 1 << 22])
def test_odd_rows_and_lookups(spark, tmp_path, shard_tokens):
    texts = odd_texts()[:150]
    rows = [(i - 40, t, 5, "x") for i, t in enumerate(texts)] + [(None, "last", 5, "y"), (None, None, 5, "z"), (8, "again", 1, "q")] + [(9, "many times the same", 1, "q")] * 60 + [(300, "long " * 40_000, 0, "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int, __text string").repartition(5)
    folder = wavelet.write_ids(docs, BYTE_BPE, str(tmp_path / "ids"), shard_tokens=shard_tokens)
    got = sorted(wavelet.with_starts(wavelet.documents(spark, folder, with_ids=True)).collect(), key=lambda r: r.start)
    # ids are in order, texts of one id in some order
    assert [r.doc_id for r in got] == [*sorted(r[0] for r in rows if r[0] is not None), None, None]
    want = plain([(r[0], r[1]) for r in rows])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((i, n, c) for i, _, n, c in want if i is not None)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    flat = [(r.doc_id, k, x) for r in got for k, x in enumerate(np.frombuffer(r.ids, "<u4").tolist())]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    wanted = [0, flat[3][2], 50256, 999_999]
    n = collections.Counter(x for _, _, x in flat)
    assert {r.token: r.n for r in wavelet.counts(spark, folder, wanted).collect()} == {x: n[x] for x in wanted}
    found = wavelet.occurrences(spark, folder, wanted).collect()
    key = lambda t: (t[0], t[1] is None, t[1] or 0, t[2])
    assert sorted(((r.token, r.doc_id, r.offset) for r in found), key=key) == sorted(((x, i, k) for i, k, x in flat if x in wanted), key=key)


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    folder = wavelet.write_ids(docs, BYTE_BPE, str(tmp_path / "none"))
    assert wavelet.with_starts(wavelet.documents(spark, folder)).count() == 0
