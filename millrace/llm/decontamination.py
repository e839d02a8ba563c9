"""Operator 6: benchmark decontamination by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_batch, sized, stored, unused

#: One edit is allowed for so many characters of an item; characters of items that one automaton holds.
CHARS_PER_EDIT, BLOCK_CHARS = 16, 1 << 20


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case, with one space for each run of characters other than letters and digits, and at both ends."""
    folded = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\p{L}\p{N}]+", replacement=" ")
    return pc.binary_join_element_wise(" ", pc.utf8_trim(folded, " "), " ", "")


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces that make up the text: ``edits`` edits leave at least one of them whole."""
    cuts = [j * len(text) // (edits + 1) for j in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel matching: the distance of the pattern to the best substring that ends at each character."""

    def __init__(self, text: str):
        self.size, self.masks = len(text), {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(smallest distance, end of the first substring that has it)."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, distance, found = full, 0, self.size, (self.size, 0)
        for at, c in enumerate(text):
            eq = self.masks.get(c, 0)
            cross = eq | minus
            down = (((eq & plus) + plus) ^ plus) | eq
            up_plus = minus | ~(down | plus) & full
            up_minus = plus & down
            if up_plus & top:
                distance += 1
            elif up_minus & top:
                distance -= 1
            up_plus, up_minus = up_plus << 1 & full, up_minus << 1 & full
            plus = up_minus | ~(cross | up_plus) & full
            minus = up_plus & cross
            if distance < found[0]:
                found = (distance, at + 1)
        return found


class Matcher:
    """Finds items, given as normalised texts, inside normalised documents."""

    def __init__(self, items: list[tuple[object, str]], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick

        self.items = []
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            text = text if len(text) - 2 < chars_per_edit else text.strip(" ")  # without edits whole words must match
            if not text.strip(" "):
                continue
            edits = len(text) // chars_per_edit if not text.startswith(" ") else 0
            self.items.append((key, Pattern(text), edits))
            for at, piece in pieces(text, edits):
                by_piece.setdefault(piece, []).append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, allowed edits, end in the text) for each item within its budget."""
        if not len(self.automaton):
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, at in places:
                starts.setdefault(item, set()).add(end + 1 - size - at)
        out = []
        for item, found in sorted(starts.items()):
            key, pattern, edits = self.items[item]
            best, runs = None, []
            for s in sorted(found):  # starts no more than the budget apart share a window
                if runs and s - runs[-1][0] <= edits:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for first, last in runs:
                a = max(0, first - edits)
                distance, end = pattern.best(text[a : last + pattern.size + edits])
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, a + end)
                if best and best[0] == 0:
                    break
            if best:
                out.append((key, best[0], edits, best[1]))
        return out


_MATCHERS: dict[str, Matcher] = {}


def contaminated(docs: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, allowed, match_end): each benchmark item that a document holds within its edit budget.

    Texts are compared in lower case with runs of other characters than letters
    and digits as one space; an item of n such characters may have
    ``n // chars_per_edit`` edits anywhere. Shorter items must occur as whole
    words. Null or empty texts hold and match nothing. Rows of ``items`` that
    repeat count once, and repeated rows of ``docs`` each; an item is reported
    once for a document, at its best and then first place. Empty tables give no
    row. Other columns are ignored.

    Items go in blocks of bounded size, each with one pass over the documents.
    """
    wanted = items.select("item_id", F.col("text").alias("t")).filter(F.col("t").isNotNull()).distinct()
    total = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    slim = docs.select("doc_id", "text")
    kind = T.StructType([slim.schema["doc_id"], items.schema["item_id"], T.StructField("distance", T.IntegerType()), T.StructField("allowed", T.IntegerType()), T.StructField("match_end", T.LongType())])

    def search(rows: list[tuple[object, str]]) -> DataFrame:
        name = uuid.uuid4().hex

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            if name not in _MATCHERS:
                _MATCHERS.clear()
                _MATCHERS[name] = Matcher(rows, chars_per_edit)
            matcher = _MATCHERS[name]
            found = [(i, *hit) for i, text in enumerate(normalised(batch.column("text")).to_pylist()) for hit in matcher.find(text)]
            row, item, distance, allowed, end = zip(*found, strict=True) if found else ((), (), (), (), ())
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("item_id", item_type), ("distance", pa.int32()), ("allowed", pa.int32()), ("match_end", pa.int64())])
            return pa.record_batch([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, item_type), pa.array(distance, pa.int32()), pa.array(allowed, pa.int32()), pa.array(end, pa.int64())], schema=schema)

        return slim.mapInArrow(per_batch(one), kind)

    parts = []
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).toArrow().combine_chunks()
        item_type = rows.schema.field("item_id").type
        texts = normalised(rows.column("t").combine_chunks()).to_pylist() if rows.num_rows else []
        parts.append(search(sorted(zip(rows.column("item_id").to_pylist(), texts, strict=True), key=lambda r: (r[1], str(r[0])))))
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns stay, and rows with a null doc_id too.

    A row goes if its own text holds an item, whatever other rows of its doc_id hold.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    key, row = unused(docs, "hit", "hash")
    hits = stored(contaminated(rows, items, **options).select(F.col("doc_id.doc_id").alias(key), F.col("doc_id.text_hash").alias(row)).distinct())
    return docs.join(sized(hits), (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(row)), "left_anti")
