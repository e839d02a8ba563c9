"""Token counts and packing against the tokenizer library on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.packing import FirstFit, pack, pack_sizes
from millrace.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from millrace.llm.token_counts import token_counts
from tests.oracle import DATA

ODD = ["", " ", "a", "  a b ", "a\n\n b  c\t", "x  y 　z", "a\x1c b\x1d\x1d!", "<|endoftext|> a<|endoftext|>  b <|startoftext|>x", "é é ́a", "don't we'll  'S it's\n'", "ab\x0bcd!\x0b!", "12 3\x85 4\x85\x855", "ΑΣ Σ", "日本語 テキスト。 \n", "🙂🙃 👩‍👩‍👧", "İI ıi", "  x ​ y"]


def texts(n=600):
    rnd = random.Random(4)
    return ODD + ["".join(rnd.choice("ab é\n \t!'s1\x1c \x85\x0b.<|>ΣÁ") for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def plain(path, ts):
    return [e.ids for e in bpe.encode(path, ts)]


def test_counts_and_ids_equal_the_library():
    ts = texts()
    assert bpe.counts_of(BYTE_BPE, pa.array(ts)).tolist() == [len(x) for x in plain(BYTE_BPE, ts)]
    bounds, ids = bpe.ids_of(WORD_BPE, pa.array(ts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == plain(WORD_BPE, ts)


@pytest.mark.parametrize("chunk, overlap", [(7, 2), (40, 8), (1000, 16)])
def test_spliced_counts_equal_whole_ones(chunk, overlap):
    ts = [t for t in texts(150) if t] + ["a" * 500, "ab  c" * 200, ("word " * 300).strip(), "no" * 90 + " " + "yes" * 90]
    assert [bpe.spliced_count(BYTE_BPE, t, chunk, overlap) for t in ts] == [len(x) for x in plain(BYTE_BPE, ts)]


def test_token_count_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "Hello wörld", 7), (3, "Hello wörld", 7), (None, "x", 7), (4, "many words " * 3000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_counts(df, BYTE_BPE, huge=5000).collect()), key=repr)
    want = [(d, len((t or "").encode()), n := len(plain(BYTE_BPE, [t or ""])[0]), n > 512) for d, t, _ in rows]
    assert got == sorted(want, key=repr)
    assert token_counts(df.limit(0), BYTE_BPE).count() == 0


def test_token_count_query(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    got = QUERIES["op4_token_counts"](spark, f"{DATA}/sf0.001").toPandas().set_index("doc_id")
    assert got.n_tokens.loc[docs.doc_id].tolist() == [len(x) for x in plain(BYTE_BPE, docs.text.tolist())]


def test_first_fit_takes_the_leftmost_bin():
    rng = random.Random(2)
    tree, room = FirstFit(300, 100), [100] * 300
    for _ in range(300):
        size = rng.randint(1, 100)
        want = next(i for i, r in enumerate(room) if r >= size)
        room[want] -= size
        assert tree.put(size) == want


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_everything_without_padding(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 50, rng.randint(1, 64), 64]) for _ in range(rng.randint(0, 80))]
    bins = pack_sizes(sizes, 64)
    for b in bins:
        total = sum(n for _, _, n in b)
        assert 0 < total <= 64 and (total == 64 or total & (total - 1) == 0)
    spans = sorted(p for b in bins for p in b)
    for i, size in enumerate(sizes):
        own = [(s, n) for j, s, n in spans if j == i]
        assert sum(n for _, n in own) == size and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False)) and (not own or own[0][0] == 0)


def check_pieces(rows, docs, capacity=2048):
    ids = {d: [*x, 1] for (d, _), x in zip(docs, plain(WORD_BPE, [t or "" for _, t in docs]), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        assert sorted(i for r in own for i in range(r.start, r.start + r.length)) == list(range(len(ids[d])))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_packing_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(QUERIES["op10_packing"](spark, f"{DATA}/sf0.001").collect(), docs)


def test_packing_rows(spark):
    docs = [(1, None), (2, ""), (3, "one two three"), (None, "x y"), (4, "long text here " * 4000), *[(i, f"doc {i} " * (i % 40)) for i in range(5, 200)]]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, length int").repartition(3)
    got = pack(df, WORD_BPE, group_bytes=20_000).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(got, docs)
    assert pack(df.limit(0), WORD_BPE).count() == 0
    twice = pack(df.filter("doc_id = 3").unionByName(df.filter("doc_id = 3")), WORD_BPE).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_rows_that_repeat_are_dealt_to_many_groups(spark):
    from millrace.llm import packing

    df = spark.range(0, 40_000, 1, 2).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("").alias("text"))
    got = pack(df, WORD_BPE).groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in got) == 40_000 and len(got) == -(-40_000 // packing.GROUP_ROWS) and max(r.n for r in got) < 2 * packing.GROUP_ROWS
