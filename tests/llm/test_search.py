"""Top-k search and benchmark decontamination against brute force."""

import random

import pyarrow as pa
import pytest

from millrace.llm import decontamination as D
from millrace.llm import topk
from millrace.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    d = f"{DATA}/sf0.001"
    assert of_spark(QUERIES[name](spark, d)) == of_duckdb(ORACLES[name], d)


def brute(rows, k, every):
    v = [(i, [int(256 * x // 1) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and abs(x) < float("inf") for x in e)]
    queries = {}
    for i, q in v:
        if i % every == 0:
            queries[i] = min(q, queries.get(i, q))
    out = []
    for i, q in sorted(queries.items()):
        s = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in v if j != i and len(c) == len(q))
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_with_ties_and_odd_rows(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 12)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.5, -0.1, 0.0, 0.3, 1.0]) * scale for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(120, 160)]
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (210, [1.0, 2.0]), (211, [3.0, -1.0]), (220, []), (7, [0.0] * 4), (10, [9.0] * 4)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id bigint, embedding array<double>, score int").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, 5, 10).collect()))
    assert got == brute(rows, 5, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def distance_in(pattern, text):
    """Smallest edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        old, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != t))
    return min(row)


def test_bit_parallel_distance():
    rnd = random.Random(3)
    for _ in range(300):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60)))
        assert D.Pattern(p).best(t)[0] == distance_in(p, t)


def edited(rnd, text, n):
    for _ in range(n):
        k = rnd.randrange(len(text))
        text = text[:k] + rnd.choice(["", "q", text[k] + "z"]) + text[k + 1 :]
    return text


def test_decontamination_by_brute_force(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(rnd.choice([3, 8, 15, 30]))) for i in range(12)] + [(20, "ab"), (21, None), (22, "..."), (0, None)]
    docs = []
    for i in range(60):
        text = say(rnd.choice([1, 20, 60]))
        if rnd.random() < 0.6:
            text += ", " + edited(rnd, rnd.choice(items[:12])[1], rnd.choice([0, 0, 1, 2, 4, 8])).upper() + "! " + say(10)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "x AB x"), (103, "xabx"), (102, "x AB x"), (None, "ab")]
    di = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int").repartition(3)
    it = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    norm = lambda x: D.normalised(pa.array([x], pa.string()))[0].as_py()
    want = []
    for d, text in docs:
        for i, item in items:
            n = norm(item)
            short = len(n) - 2 < D.CHARS_PER_EDIT
            p = n if short else n.strip()
            if p.strip():
                k = 0 if short else len(p) // D.CHARS_PER_EDIT
                best = distance_in(p, norm(text))
                if best <= k:
                    want.append((d, i, best, k))
    got = sorted(((r.doc_id, r.item_id, r.distance, r.allowed) for r in D.contaminated(di, it).collect()), key=repr)
    assert got == sorted(want, key=repr) and len(want) > 20
    assert sorted(((r.doc_id, r.item_id, r.distance, r.allowed) for r in D.contaminated(di, it, block_chars=200).collect()), key=repr) == got
    hit = {w[0] for w in want if w[0] is not None}
    kept = D.drop_contaminated(di, it)
    assert kept.columns == di.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, _ in docs if d not in hit)
    assert D.contaminated(di.limit(0), it).count() == 0 and D.contaminated(di, it.limit(0)).count() == 0


def test_only_rows_that_hold_an_item_go(spark):
    item = "a passage of the benchmark that nobody should have seen before"
    docs = spark.createDataFrame([(1, f"well {item} indeed"), (1, "a clean text of the same id"), (2, "clean too"), (None, item)], "doc_id bigint, text string")
    kept = D.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a clean text of the same id"), (2, "clean too"), (None, item)], key=repr)
