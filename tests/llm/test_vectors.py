"""Vector codes and clusters against plain loops over whole integers."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import clusters as C
from millrace.llm import codes as K
from millrace.llm import vectors as V

BIG = 2**63 - 1


def integers(x, scale):
    return [max(-(2**63), min(BIG, int(np.floor(float(c) * scale)))) for c in x]


def kept(rows, scale):
    fine = [(i, x, l) for i, x, l in rows if x is not None and all(c is not None and abs(c) < float("inf") for c in x)]
    return [(i, integers(x, scale), l, x) for i, x, l in fine]


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows, strict=True)]


def last(i):
    return (i is None, i or 0)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    v = [r for r in kept(rows, 256) if len(r[1]) and len(r[1]) % parts == 0]
    v.sort(key=lambda r: (last(r[0]), r[3]))
    v = [r for r in v if len(r[1]) == len(v[0][1])]
    w = len(v[0][1]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in v[:entries]] for p in range(parts)]
    near = lambda x, book: min((away(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for r in v:
                held[near(cut(r[1], p), books[p])[1]].append(cut(r[1], p))
            books[p] = [mean(h) if h else c for h, c in zip(held, books[p], strict=True)]
    out, by_label = [], {}
    for i, x, label, _ in v:
        found = [near(cut(x, p), books[p]) for p in range(parts)]
        error = min(BIG, sum(d for d, _ in found))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, min(BIG, by_label[label]), sha) for i, c, e, label in out), key=repr)


def plain_clusters(rows, k=8, rounds=10, dimension=64):
    v = [r for r in kept(rows, 1024) if len(r[1]) == dimension]
    name = lambda r: "~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()
    centroids = [r[1] for r in sorted(v, key=lambda r: (name(r), r[3]))[:k]]
    near = lambda x: min((away(x, c), e) for e, c in enumerate(centroids))
    for _ in range(rounds):
        held = [[] for _ in centroids]
        for r in v:
            held[near(r[1])[1]].append(r[1])
        centroids = [mean(h) if h else c for h, c in zip(held, centroids, strict=True)]
    found = [(r[0], *near(r[1])) for r in v]
    cap = lambda x: min(BIG, x)
    total = {}
    for _, d, c in found:
        total[c] = total.get(c, 0) + cap(d)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, cap(d), cap(total[c]), cap(sum(total.values())), sha[c]) for i, d, c in found), key=repr)


def rows_of(dims, n, seed=1, scale=1.0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-1.3, -0.2, 0.0, 0.31, 0.9]) * scale if i % 3 else rnd.gauss(0, 0.3) * scale for _ in range(dims)], rnd.choice([1, 2, None])) for i in range(-5, n)]
    rows += [(n + 1, [0.25 * scale] * dims, 7)] * 30 + [(3, [0.5 * scale] * dims, None), (None, [0.1 * scale] * dims, 1), (None, None, 1), (n + 2, None, 1)]
    rows += [(n + 3, [None] + [1.0] * (dims - 1), 1), (n + 4, [float("nan")] * dims, 1), (-9, [float("-inf")] * dims, 1), (-8, [], 1), (-7, [1.0] * (dims - 1), 1), (n + 5, [1.0] * (2 * dims), 2)]
    return rows


SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, cluster int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("dims, n, chunk, scale", [(32, 150, 1 << 21, 1.0), (16, 90, 40 * 16, 1.0), (16, 20, 1 << 21, 1.0), (32, 60, 1 << 21, 1e9), (32, 40, 1 << 21, 1e30)])
def test_codes_against_loops(spark, dims, n, chunk, scale):
    rows = rows_of(dims, n, scale=scale)
    got = sorted(map(tuple, K.vector_codes(frame(spark, rows), chunk=chunk).collect()), key=repr)
    assert got == plain_codes(rows)


@pytest.mark.parametrize("n, chunk, scale", [(150, 1 << 21, 1.0), (70, 25 * 64, 1.0), (1, 1 << 21, 1.0), (40, 1 << 21, 1e30)])
def test_clusters_against_loops(spark, n, chunk, scale):
    rows = rows_of(64, n, 2, scale)
    got = sorted(map(tuple, C.clusters(frame(spark, rows), chunk=chunk).collect()), key=repr)
    assert got == plain_clusters(rows)


def test_few_and_no_vectors(spark):
    two = [(4, [0.5] * 64, 1), (2, [-0.5] * 64, None)]
    assert sorted(map(tuple, K.vector_codes(frame(spark, two)).collect()), key=repr) == plain_codes(two)
    assert sorted(map(tuple, C.clusters(frame(spark, two)).collect()), key=repr) == plain_clusters(two)
    for rows in ([], [(1, None, 1), (2, [1.0], 1)]):
        assert K.vector_codes(frame(spark, rows)).count() == C.clusters(frame(spark, rows)).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 4, 7, 80])
def test_shortlists_lose_no_nearest_entry(dims):
    rnd = np.random.default_rng(dims)
    v, e = rnd.integers(-200, 200, (1000 if dims > 4 else 20_000, dims)), rnd.integers(-200, 200, (64, dims))
    e[10] = e[3]
    blocks = K.Blocks.of(v)
    assert sorted(blocks.order.tolist()) == list(range(len(v)))
    d = ((blocks.v[:, None] - e[None]) ** 2).sum(2)
    near, least = blocks.nearest(e)
    assert near.tolist() == d.argmin(1).tolist() and least.tolist() == d.min(1).tolist()
    sums, n = blocks.totals(e)
    assert n.tolist() == np.bincount(near, minlength=64).tolist()
    assert all(sums[k].tolist() == blocks.v[near == k].sum(0).tolist() for k in range(64))
    if dims <= 4:  # the curve keeps blocks small enough to rule entries out
        assert blocks.shortlists(e).mean() < 0.6


def test_dictionaries_are_lossless():
    rnd = np.random.default_rng(3)
    v = np.concatenate([rnd.integers(-3, 3, (500, 20)), np.tile(rnd.integers(-900, 900, (10, 20)), (50, 1))])
    v = np.concatenate([v, rnd.integers(-(10**6), 10**6, (1000, 13))], axis=1)
    widths, sizes, code_widths, dictionaries, stored, itemsize = C.packed(v)
    assert sum(widths) == 33 and max(widths) > 1 and itemsize == 4
    blocks = C.blocks_of({"widths": widths, "sizes": sizes, "code_widths": code_widths, "dictionaries": dictionaries, "codes": stored, "itemsize": itemsize, "n": len(v)})
    assert np.concatenate([f[c] for _, f, c in blocks], axis=1).tolist() == v.tolist()
    centroids = rnd.integers(-900, 900, (5, 33))
    assert C.distances(blocks, centroids).tolist() == ((v[:, None] - centroids[None]) ** 2).sum(2).tolist()


def test_floors_at_the_ends():
    assert V.floors(np.array([0.5, -0.001, 1e40, -1e40, 2.0**62 / 256, 2.0**61 / 256]), 256).tolist() == [128, -1, BIG, -(2**63), 2**62, 2**61]
