"""Operator 9: n-gram Jaccard join with signature trees.

Spark deals documents out so that any two that link meet: the range of shingle
hashes is cut into more parts than the two sets can differ in, so several parts
at least are the same in both, and their hashes are keys that both have. Each set
leaves out its most frequent keys, as many as leave one in common: what is in many
documents brings none of them together. Documents
that share keys form clusters. Within a cluster a tree of OR-combined bitmaps
and size ranges is joined with itself, and pairs of nodes whose largest
possible overlap is too small, or whose sets are all connected, are left out
with all that lies below them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, give_back, per_batch, rows_of, sized, unused, words_of
from .graph import components

#: Shingles that one group of a cluster holds; documents that stand for a cluster in each of its groups.
GROUP_SHINGLES, PIVOTS = 1 << 20, 4
LEAF, FANOUT = 16, 8
#: Sets of which a task remembers that it has connected them.
REMEMBERED = 1 << 18

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when den * intersection >= num * union."""

    words: int
    num: int
    den: int

    def classes(self, largest: int) -> np.ndarray:
        """Largest sizes of the size classes; sets that link are in the same class or in neighbouring ones."""
        out, low = [], 1
        while low <= largest or not out:
            out.append(low * self.den // self.num)
            low = out[-1] + 1
        out.append(low * self.den // self.num)
        return np.array(out, np.int64)

    @property
    def band(self) -> float:
        """Logarithm of a band of sizes: sets that link are in the same band or in neighbouring ones, with room for rounding."""
        return float(np.log(1.0001 * self.den / self.num))

    def differing(self, total: np.ndarray) -> np.ndarray:
        """The most elements in which two linking sets of this total size differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def needed(self, total: np.ndarray) -> np.ndarray:
        """The least intersection of two linking sets of this total size."""
        return -(-total * self.num // (self.den + self.num))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, sorted distinct hashes of the k-word shingles of each text); of a shorter text its whole sequence."""
    bounds, codes, words = words_of(texts)
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    w = of_word[codes]
    size = np.diff(bounds)
    h = np.zeros(len(w), np.uint64)
    for j in range(k):
        h[: len(w) - j] = h[: len(w) - j] * np.uint64(0x9E3779B97F4A7C15) + w[j:]
    h = mixed(h + np.uint64(k))
    out = []
    for a, n in zip(bounds[:-1].tolist(), size.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(h[a : a + n - k + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for x in w[a : a + n]:
                short = mixed(short * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64), np.concatenate(out) if out else np.zeros(0, np.uint64)


def totals(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Wrapping sums of the runs of x."""
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def set_ids(bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One even 64-bit number for each set, the same for equal sets."""
    return mixed(totals(mixed(h + np.uint64(1)), bounds) ^ (np.diff(bounds).astype(np.uint64) << np.uint64(40))).view(np.int64) & ~1


def keys_and_spare(bounds: np.ndarray, h: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, step, spare): of each set, the hash of each part, for its size class (step 0) and the next one (step 1).

    There are a quarter more parts than the sets of a class can differ in. A set
    with so few parts that hold anything that all could differ also has keys of
    its empty parts; of two such sets that link, an empty part may be all that
    they have in common. Otherwise two sets that link have more keys in common
    than ``spare`` (by set and step): if each leaves out that many of its own, the first in an
    order that is the same for all, the last common one is left to both.
    """
    size = np.diff(bounds)
    limit = rule.classes(int(size.max(initial=1)))
    rows, keys, steps = [], [], []
    salted = mixed(h ^ np.uint64(0x94D049BB133111EB))
    high = h >> np.uint64(32)
    row = rows_of(bounds)
    spare = np.zeros((len(size), 2), np.int64)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), spare
    own = np.searchsorted(limit, size, "left")
    for step in (0, 1):
        cls = own + step
        most = rule.differing(2 * limit[cls])
        count = most + 2 + most // 4
        part = (high * count.astype(np.uint64)[row]) >> np.uint64(32)
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part.astype(np.int64), prepend=-1) != 0))
        total = totals(salted, np.append(start, len(h)))
        at = row[start]
        name = (cls.astype(np.uint64)[at] << np.uint64(32)) + part[start]
        rows.append(at)
        steps.append(np.full(len(at), step))
        keys.append(mixed(total ^ mixed(name + np.uint64(7))))
        filled = np.bincount(at, minlength=len(size))
        spare[:, step] = np.maximum(0, filled - most - 1)
        for i in np.flatnonzero((size > 0) & (filled <= most)):
            empty = np.setdiff1d(np.arange(count[i]), part[bounds[i] : bounds[i + 1]].astype(np.int64))
            rows.append(np.full(len(empty), i))
            steps.append(np.full(len(empty), step))
            keys.append(mixed(mixed((np.uint64(cls[i]) << np.uint64(32)) + empty.astype(np.uint64) + np.uint64(7)) ^ np.uint64(0xFEED)))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(steps), spare


def part_keys(bounds: np.ndarray, h: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, step), all keys of each set."""
    return keys_and_spare(bounds, h, rule)[:3]


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        b = (s % np.uint64(bits)).astype(np.int64)
        np.bitwise_or.at(out[i], b >> 3, (1 << (b & 7)).astype(np.uint8))
    return out.view(np.uint64)


class SignatureTree:
    """Levels of nodes, leaves last: each has the OR of its sets' bitmaps, their range of sizes, and how many more
    elements than bits a set below it has at most."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        bits = 1 << int(np.clip(np.ceil(np.log2(32 * max(1, self.size.max(initial=1)))), 9, 16))
        maps = bitmaps(sets, bits)
        over = self.size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, self.size, self.size, over)]
        width = LEAF
        while len(self.levels[0][0]) > 1:
            m, lo, hi, ov = self.levels[0]
            at = np.arange(0, len(m), width)
            self.levels.insert(0, (np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ov, at)))
            width = FANOUT

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
        """Whether sets below node i and node j can link."""
        m, lo, hi, ov = self.levels[level]
        sizes = (rule.den * hi[i] >= rule.num * lo[j]) & (rule.den * hi[j] >= rule.num * lo[i])
        i, j = i[sizes], j[sizes]
        overlap = np.bitwise_count(m[i] & m[j]).sum(1).astype(np.int64) + np.minimum(ov[i], ov[j])
        sizes[sizes] = np.minimum(overlap, np.minimum(hi[i], hi[j])) >= rule.needed(lo[i] + lo[j])
        return sizes

    def roots(self, label: np.ndarray) -> list[np.ndarray]:
        """By level, the label that all sets below a node have, or -1."""
        out, width = [label], LEAF
        for _ in self.levels[:-1]:
            at = np.arange(0, len(out[0]), width)
            low, high = np.minimum.reduceat(out[0], at), np.maximum.reduceat(out[0], at)
            out.insert(0, np.where(low == high, low, -1))
            width = FANOUT
        return out

    def pairs(self, rule: Rule, label: np.ndarray | None = None):
        """Arrays (i, j) of sets, i < j, that no bound rules out; node pairs are worked off in bounded runs.

        Pairs of nodes whose sets have one ``label`` are left out; the caller changes labels as it connects sets.
        """
        label = np.arange(len(self.size)) if label is None else label
        last = len(self.levels) - 1
        stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        root, age = self.roots(label), 1
        while stack:
            level, i, j = stack.pop()
            if len(i) > 4096:
                stack.append((level, i[4096:], j[4096:]))
                i, j = i[:4096], j[:4096]
            apart = (root[level][i] != root[level][j]) | (root[level][i] < 0)
            i, j = i[apart], j[apart]
            keep = self.possible(level, i, j, rule)
            i, j = i[keep], j[keep]
            if level == last:
                if (i < j).any():
                    yield i[i < j], j[i < j]
                    root, age = root if age % 16 else self.roots(label), age + 1
            elif len(i):
                n, width = len(self.levels[level + 1][0]), LEAF if level + 1 == last else FANOUT
                step = np.arange(width)
                ci, cj = (i[:, None] * width + step)[:, :, None], (j[:, None] * width + step)[:, None, :]
                ci, cj = np.broadcast_arrays(ci, cj)
                fine = (ci < n) & (cj < n) & (ci <= cj)
                stack.append((level + 1, ci[fine], cj[fine]))


def joined_sets(ids: np.ndarray, sets: list[np.ndarray], known: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """(smallest, other) of the ids that links connect; sets with the same ``known`` label are taken as connected."""
    order = np.lexsort([[int(s[0]) if len(s) else 0 for s in sets], [len(s) for s in sets]])
    sets, ids = [sets[i] for i in order], ids[order]
    _, label = np.unique(known[order], return_inverse=True)
    at = np.argsort(label, kind="stable")
    members = dict(enumerate(np.split(at, np.flatnonzero(np.diff(label[at])) + 1))) if len(at) else {}
    for i, j in SignatureTree(sets).pairs(rule, label) if len(sets) > 1 else ():
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = label[a], label[b]
            if x == y:
                continue
            s, t = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            place = np.searchsorted(t, s)
            place[place == len(t)] = 0
            if int((t[place] == s).sum()) >= rule.needed(len(s) + len(t)):
                if len(members[x]) < len(members[y]):
                    x, y = y, x
                moved = members.pop(y)
                label[moved] = x  # the fewer ones move, so each set moves seldom
                members[x] = np.concatenate([members[x], moved])
    order = np.lexsort([ids, label])
    start = np.flatnonzero(np.diff(label[order], prepend=-1))
    least = np.repeat(ids[order][start], np.diff(np.append(start, len(order))))
    return [(int(a), int(b)) for a, b in zip(least, ids[order], strict=True) if a != b]


def _runs(batches):
    """(a, b): of sorted keys, the first set of each key with each further one, unless the task has lately connected them."""
    key, pivot, parent = None, None, {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        k, s = batch.column("key").to_numpy(), batch.column("sid").to_numpy()
        if not len(k):
            continue
        new = np.diff(k, prepend=k[0]) != 0
        new[0] = key is None or k[0] != key
        first, owner = s[np.flatnonzero(new)], np.cumsum(new) - 1
        a = first[owner] if new[0] else np.append(first, pivot)[owner]
        out = []
        for x, y in zip(a[a != s].tolist(), s[a != s].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        key, pivot = k[-1], a[-1]
        if len(parent) > REMEMBERED:  # it only saves repeats
            parent.clear()


def _linked(rule: Rule, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("sid")
    found = joined_sets(rows.sid.to_numpy(), [np.frombuffer(s, np.uint64) for s in rows.shingles], rows.known.to_numpy(), rule)
    give_back()
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    A document's set holds the distinct shingles of ``words`` words of its text
    in lower case (A-Z), or its whole sequence if it has fewer words. Documents
    link when den * intersection >= num * union, and component_id is the
    smallest doc_id that links lead to. A null or empty text, or one of white
    space, has an empty set, links with nothing and is its own component.
    Copies and repeated rows share a set and so a component; a null doc_id is
    never the smallest, and takes part otherwise. Sets are told apart by 64-bit
    hashes. Other columns are ignored; an empty table gives no row.
    """
    return _labelled(docs, Rule(words, num, den), group_shingles, Scratch(docs.sparkSession)).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, rule: Rule, group_shingles: int, work: Scratch) -> DataFrame:
    """(doc_id, text_hash, n_shingles, label, component_id): ``label`` names the component, as one doc_id can be in two.

    Of what it writes in ``work``, only what this reads is left.
    """
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind, words = slim.schema["doc_id"], rule.words

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds, h = shingles(batch.column("text"), words)
        return pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(bounds)), pa.array(set_ids(bounds, h))], names=["doc_id", "text_hash", "n_shingles", "sid"])

    base = work.stored(slim.mapInArrow(per_batch(sets_of), T.StructType([kind, T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sid", T.LongType())])))
    # a row of each set to read it from again: of the smallest doc_id, or without one
    first_hash = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("first_hash")
    firsts = work.stored(base.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), first_hash, F.first("n_shingles").alias("n")))

    def keys_of(batches):
        seen: set[int] = set()

        def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
            sid = batch.column("sid").to_numpy()
            new = np.array([not (i in seen or seen.add(i)) for i in sid.tolist()], bool)  # rows that repeat give their keys once
            if len(seen) > REMEMBERED:
                seen.clear()
            bounds, h = shingles(batch.column("text").filter(pa.array(new)), words)
            sid = sid[new]
            row, keys, step, spare = keys_and_spare(bounds, h, rule)
            right = (set_ids(bounds, h) == sid)[row]
            row, keys, step = row[right], keys[right], step[right]
            # in its next size class a set goes by the odd number after its own
            return pa.record_batch([pa.array(keys), pa.array(sid[row] + step), pa.array(spare[row, step].astype(np.int32))], names=["key", "sid", "spare"])

        yield from per_batch(keyed)(batches)

    dealt = _texts_of(slim, firsts, ["sid"]).mapInArrow(keys_of, "key bigint, sid bigint, spare int").repartition("key")
    # of its keys that several sets have, a set leaves out the most frequent ones
    dealt = dealt.withColumn("n_sets", F.count("*").over(Window.partitionBy("key"))).filter("n_sets > 1")
    often = Window.partitionBy("sid").orderBy(F.desc("n_sets"), F.desc("key"))
    dealt = dealt.withColumn("place", F.row_number().over(often)).filter("place > spare").select("key", "sid").repartition("key").sortWithinPartitions("key", "sid")
    # a set's first sets, of which it has no more than keys, are linked to the smallest of them
    stars = dealt.mapInArrow(_runs, "a bigint, b bigint").groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("s"))
    near = stars.select(F.col("s")[0].alias("a"), F.explode(F.array_append(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("b"))).alias("b")).distinct()
    clusters = components(near, work=work)
    clusters = clusters.select(F.col("node").bitwiseAND(F.lit(-2)).alias("of"), F.col("label").alias("cluster"))
    members = work.stored(firsts.join(sized(clusters), clusters["of"] == firsts["sid"]).select("sid", "first_id", "first_hash", "n", "cluster"))
    large = members.groupBy("cluster").agg(F.sum("n").alias("total")).filter(F.col("total") > group_shingles).select(F.col("cluster").alias("big"))
    large = work.stored(large)
    # a split cluster is dealt by band of sizes, so that a block meets those of its own band and the neighbouring ones, and then by hash
    band = F.when(F.col("big").isNull(), 0).otherwise(F.floor(F.log("n") / F.lit(rule.band))).cast("int")
    banded = members.join(large, members["cluster"] == large["big"], "left").select("sid", "first_id", "first_hash", "n", "cluster", F.col("big").isNotNull().alias("split"), band.alias("band"))
    blocks = banded.filter("split").groupBy(F.col("cluster").alias("c"), F.col("band").alias("z")).agg(F.ceil(F.sum("n") / group_shingles).cast("int").alias("blocks"))
    blocks = work.stored(blocks)
    block = F.coalesce(F.pmod(F.xxhash64("sid"), "blocks"), F.lit(0)).cast("int").alias("block")
    placed = work.stored(banded.join(sized(blocks), (F.col("cluster") == F.col("c")) & (F.col("band") == F.col("z")), "left").select("sid", "first_id", "first_hash", "cluster", "split", "band", block))

    def texts_to_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds, h = shingles(batch.column("text"), words)
        right = set_ids(bounds, h) == batch.column("sid").to_numpy()
        raw = h.tobytes()
        out = pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sid", "cluster", "split", "band", "block")), out], names=["sid", "cluster", "split", "band", "block", "shingles"]).filter(pa.array(right))

    texts = _texts_of(slim, placed, ["sid", "cluster", "split", "band", "block"])
    loaded = texts.mapInArrow(per_batch(texts_to_sets), "sid bigint, cluster bigint, split boolean, band int, block int, shingles binary")
    split = large.limit(1).count() > 0
    if split:
        loaded = work.stored(loaded)
    link_kind = "a bigint, b bigint"
    meets = ["cluster", "band", "block"]
    groups = loaded.select(*meets, "sid", F.col("sid").alias("known"), "shingles")
    if split:  # a few sets of each band of a split cluster go to all blocks of that band and the neighbouring ones
        pivots = _pivots(loaded)
        groups = groups.unionByName(_beside(pivots, blocks).select("cluster", F.col("z").alias("band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "sid", F.col("sid").alias("known"), "shingles"))
    links = work.stored(groups.groupBy(*meets).applyInPandas(lambda rows: _linked(rule, rows), link_kind))
    if split:
        links = links.unionByName(_across(loaded, links, blocks, rule, group_shingles, link_kind, work))
    found = components(links, work=work)
    labelled = work.stored(firsts.join(sized(found), firsts["sid"] == found["node"]).select("sid", "first_id", "label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = labelled.select("sid", F.col("label").alias("l")).join(least, F.col("l") == F.col("label")).select(F.col("sid").alias("s1"), "label", "component_id")
    resolved = work.stored(firsts.join(ids, firsts["sid"] == ids["s1"], "left").select(F.col("sid").alias("s2"), F.coalesce("label", "sid").alias("label"), F.coalesce("component_id", "first_id").alias("component_id")))
    work.drop_all_but(base, resolved)
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return base.join(resolved, (base["sid"] == resolved["s2"]) & (base["n_shingles"] > 0), "left").select("doc_id", "text_hash", "n_shingles", "label", own)


def _texts_of(slim: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """(text, *fields): the wanted sets' rows, read again; a row that repeats comes each time."""
    wanted = wanted.select(F.col("first_id").alias("__id"), F.col("first_hash").alias("__hash"), *fields)
    texts = slim.join(sized(wanted.filter("__id IS NOT NULL")), (F.col("doc_id") == F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("text", *fields)
    nameless = wanted.filter("__id IS NULL")
    if nameless.limit(1).count():  # such rows repeat under no name of their own
        texts = texts.unionByName(slim.filter("doc_id IS NULL").dropDuplicates(["text_hash"]).join(sized(nameless), F.col("text_hash") == F.col("__hash")).select("text", *fields))
    return texts


def _pivots(loaded: DataFrame) -> DataFrame:
    """A few sets of each band of a split cluster: the smallest id of each of PIVOTS hash classes."""
    some = loaded.filter("split")
    chosen = some.groupBy("cluster", "band", F.pmod(F.xxhash64("sid"), F.lit(PIVOTS)).alias("of")).agg(F.min("sid").alias("chosen")).select("chosen")
    return some.join(sized(chosen), F.col("sid") == F.col("chosen"), "left_semi")


def _beside(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """The sets with each band of their cluster that can hold one that links, and the number of its blocks."""
    near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))
    return sets.withColumn("beside", near).join(sized(blocks), (F.col("cluster") == F.col("c")) & (F.col("beside") == F.col("z")))


def _across(loaded: DataFrame, links: DataFrame, blocks: DataFrame, rule: Rule, group_shingles: int, kind: str, work: Scratch) -> DataFrame:
    """Links between blocks of a cluster that are not connected yet.

    What lies outside a cluster's largest component so far, in chunks by band
    of sizes, meets the blocks of its own band and the neighbouring ones; pairs
    within one component are not compared.
    """
    some = loaded.filter("split")
    labels = components(links, work=work)
    known = some.join(labels, some["sid"] == labels["node"], "left").select("cluster", "band", "block", "sid", "shingles", F.coalesce("label", "sid").alias("known"))
    known = work.stored(known)
    counts = known.groupBy("cluster", "known").agg(F.count("*").alias("n"))
    largest = counts.groupBy(F.col("cluster").alias("big")).agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    outside = known.join(largest, (known["cluster"] == largest["big"]) & (known["known"] == largest["main"]), "left_anti")
    sizes = outside.groupBy(F.col("cluster").alias("c"), F.col("band").alias("z")).agg(F.ceil(F.sum(F.length("shingles")) / 8 / group_shingles).cast("int").alias("blocks"))
    sizes = work.stored(sizes)
    meets, fields = ["cluster", "z", "block", "of", "chunk"], ["sid", "known", "shingles"]
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    # an outside set is in one chunk of its band, and goes with it to all blocks beside it
    own = outside.drop("block").join(sized(sizes.withColumnRenamed("blocks", "chunks").withColumnsRenamed({"c": "oc", "z": "of"})), (F.col("cluster") == F.col("oc")) & (F.col("band") == F.col("of")))
    own = own.withColumn("chunk", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("chunks")).cast("int"))
    dealt = _beside(own, blocks).select("cluster", "z", numbers("blocks", "block"), "of", "chunk", *fields)
    # a set in a block meets all chunks beside it
    spread = _beside(known, sizes).select("cluster", F.col("band").alias("own"), "block", F.col("z").alias("of"), numbers("blocks", "chunk"), *fields).withColumnRenamed("own", "z")
    return work.stored(dealt.select(*meets, *fields).unionByName(spread.select(*meets, *fields)).groupBy(*meets).applyInPandas(lambda rows: _linked(rule, rows), kind))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all columns stay.

    Rows are told apart by doc_id and text: of different texts that share the
    smallest doc_id of a component one stays, of rows that repeat both one, and
    a text goes only if it is in the component itself. Documents without words,
    and rows with a null doc_id, stay.
    """
    work = Scratch(docs.sparkSession)
    found = work.stored(_labelled(docs, Rule(words, num, den), group_shingles, work).filter("n_shingles > 0 AND doc_id IS NOT NULL"))
    stays = found.filter("doc_id = component_id").groupBy(F.col("label").alias("l")).agg(F.min("text_hash").alias("keep"))
    gone = found.join(stays, found["label"] == stays["l"]).filter("doc_id <> component_id OR text_hash <> keep")
    key, row = unused(docs, "id", "hash")
    gone = work.stored(gone.select(F.col("doc_id").alias(key), F.col("text_hash").alias(row)).distinct())
    repeated = found.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(row)).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = work.stored(repeated.join(gone, [key, row], "left_anti").select(key, row))
    work.drop_all_but(gone, repeated)
    same = (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(row))
    single = docs.join(sized(gone), same, "left_anti")
    if not repeated.limit(1).count():
        return single
    once = docs.join(sized(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.join(sized(repeated), same, "left_anti").unionByName(once)
