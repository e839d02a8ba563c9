"""Token ids and counts of many texts, through the tokenizer library, with each distinct piece of text encoded once.

Both vocabularies split text before they merge bytes, and no split piece spans
a change from a character that is not white space to ASCII white space. Pieces
between such changes can therefore be encoded alone with the same result.
"""

from __future__ import annotations

import os
import re
from functools import cache, partial
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import sums_by_row, words_of

#: Distinct pieces that a worker remembers, and those of which it remembers the ids of a vocabulary of bytes.
REMEMBERED, REMEMBERED_IDS = 250_000, 450_000
#: Pieces that are encoded at once.
RUN = 512


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path: str, texts: list[str]):
    return tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)


class Memory:
    """What was computed for each piece of text, in two generations: the older one is dropped when the newer is full."""

    def __init__(self, compute, most: int = REMEMBERED):
        self.compute, self.most, self.new, self.old = compute, most, {}, {}

    def of(self, pieces: list[str]) -> list:
        new, old = self.new, self.old
        missing = [p for p in pieces if p not in new]
        kept = [p for p in missing if p in old]
        new.update(zip(kept, map(old.__getitem__, kept), strict=True))
        missing = [p for p in missing if p not in new] if kept else missing
        for at in range(0, len(missing), RUN):
            part = missing[at : at + RUN]
            new.update(zip(part, self.compute(part), strict=True))
        found = list(map(new.__getitem__, pieces))
        if len(new) > self.most:
            self.old, self.new = new, {}
        return found


def runs_encoded(path: str, pieces: list[str], gap: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each piece, all their ids) from one encoding of the pieces joined by ``gap``."""
    whole = tokenizer(path).encode(gap.join(pieces), add_special_tokens=False)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(gap)
    at = np.fromiter((a for a, _ in whole.offsets), np.int64, len(whole.ids))
    return np.bincount(np.searchsorted(np.cumsum(size), at, "right"), minlength=len(pieces)), np.array(whole.ids, "<u4")


@cache
def word_ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return out


def _ids(path: str, words: list[str]) -> list[bytes]:
    """A word of ASCII letters has one id that ends a word, its last; other words are told apart by their places."""
    out: list[bytes] = [b""] * len(words)
    plain = [i for i, w in enumerate(words) if w.isalpha() and w.isascii()]
    other = [i for i, w in enumerate(words) if not (w.isalpha() and w.isascii())]
    if plain:
        ids = np.array(tokenizer(path).encode(" ".join([words[i] for i in plain]), add_special_tokens=False).ids, "<u4")
        _fill(out, plain, ids, np.flatnonzero(word_ends(path)[ids]) + 1)
    if other:
        n, ids = runs_encoded(path, [words[i] for i in other], " ")
        _fill(out, other, ids, np.cumsum(n))
    return out


def _fill(out: list[bytes], at: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
    raw, ends = ids.tobytes(), (4 * ends).tolist()
    for i, a, b in zip(at, [0, *ends[:-1]], ends, strict=True):
        out[i] = raw[a:b]


def _counts(path: str, units: list[str]) -> list[int]:
    """A unit that starts with ASCII white space and ends otherwise can follow any such unit.

    One that starts otherwise gets a line feed before it, which is one token of its own.
    """
    ends = [not u[-1:].isspace() and u != "" for u in units]
    lead = [u[:1] in (" ", "\t", "\n", "\r") and e for u, e in zip(units, ends, strict=True)]
    bare = [e and not u[:1].isspace() for u, e in zip(units, ends, strict=True)]
    out = np.zeros(len(units), np.int64)
    joined = [i for i, (a, b) in enumerate(zip(lead, bare, strict=True)) if a or b]
    if joined:
        n, _ = runs_encoded(path, ["\n" + units[i] if bare[i] else units[i] for i in joined], "")
        out[joined] = n - np.array([bare[i] for i in joined])
    alone = [i for i, (a, b) in enumerate(zip(lead, bare, strict=True)) if not (a or b)]
    out[alone] = [len(e) for e in encode(path, [units[i] for i in alone])] if alone else []
    return out.tolist()


@cache
def space_starts(path: str) -> np.ndarray:
    """Which ids begin with a space, in a vocabulary of bytes."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
    return out


def _byte_ids(path: str, units: list[str]) -> list[bytes]:
    """Units of one space and then no other have one id that begins with a space, their first, so they are encoded in one run."""
    out: list[bytes] = [b""] * len(units)
    run, alone = [], []
    for i, u in enumerate(units):
        (run if u.rfind(" ") == 0 and len(u) > 1 and not u[-1].isspace() else alone).append(i)
    if run:
        ids = np.array(encode(path, ["".join([units[i] for i in run])])[0].ids, "<u4")
        starts = np.flatnonzero(space_starts(path)[ids])
        if len(starts) == len(run):
            _fill(out, run, ids, np.append(starts[1:], len(ids)))
        else:
            alone += run
    if alone:
        for i, e in zip(alone, encode(path, [units[i] for i in alone]), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
    return out


_IDS: dict[str, Memory] = {}
_COUNTS: dict[str, Memory] = {}
_BYTE_IDS: dict[str, Memory] = {}


def ids_of(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ids as uint32) for a vocabulary that drops white space. Null is an empty text."""
    bounds, codes, distinct = words_of(texts, lower=None)
    memory = _IDS.setdefault(path, Memory(partial(_ids, path)))
    parts = memory.of(distinct.to_pylist())
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    start = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(parts), "<u4")
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    ids = pool[np.repeat(start[codes] - ends[:-1], n) + np.arange(ends[-1])]
    return ends[bounds], ids


_UNIT = re.compile(r"\s*\S+|\s+")


def counts_of(path: str, texts: pa.Array) -> np.ndarray:
    """Number of tokens of each text for a vocabulary that keeps white space. Null is an empty text.

    A text is cut before each space that follows a character other than white
    space. Where a space follows white space, units of one run of white space
    and one run of other characters are taken instead.
    """
    memory = _COUNTS.setdefault(path, Memory(partial(_counts, path)))

    def counted(units: list[str]) -> np.ndarray:
        return np.array(memory.of(units), np.int64)

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = lists.flatten().dictionary_encode()
    codes, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    total = np.zeros(len(texts), np.int64)
    if not len(codes):
        return total
    odd = np.fromiter((not p or p[-1].isspace() for p in pieces), bool, len(pieces))[codes]
    size = np.diff(bounds)
    plain = (sums_by_row(odd.astype(np.int64), bounds) == 0) & (size > 0)
    each = counted([" " + p for p in pieces])[codes]
    first = bounds[:-1][plain]
    opening = counted([pieces[c] for c in codes[first]])
    total[plain] = sums_by_row(each, bounds)[plain] - each[first] + opening
    other = np.flatnonzero(~plain)
    units = [_UNIT.findall(t) for t in texts.take(pa.array(other)).to_pylist()] if len(other) else []
    for i, us in zip(other, units, strict=True):
        # \x1c-\x1f are white space to Python alone
        whole = any("\x1c" <= u[0] <= "\x1f" or re.search("[\x1c-\x1f]", u) for u in us)
        total[i] = sum(len(e) for e in encode(path, [texts[int(i)].as_py()])) if whole else int(counted(us).sum()) if us else 0
    return total


def odd_ends(pieces: list[str]) -> np.ndarray:
    """Which of the distinct pieces are empty or end with white space."""
    odd = np.fromiter(map(ne, pieces, map(str.rstrip, pieces)), bool, len(pieces))
    if "" in pieces:
        odd[pieces.index("")] = True
    return odd


def byte_ids_of(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ids as uint32) of each text for a vocabulary that keeps white space. Null is an empty text.

    Texts are cut into units as in ``counts_of``.
    """
    memory = _BYTE_IDS.setdefault(path, Memory(partial(_byte_ids, path), REMEMBERED_IDS))
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = lists.flatten().dictionary_encode()
    codes, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    ends_odd = odd_ends(pieces)
    plain = np.diff(bounds) > 0
    if ends_odd.any():
        plain &= sums_by_row(ends_odd[codes].astype(np.int64), bounds) == 0
    openings, first = codes[bounds[:-1][plain]], bounds[:-1][plain]
    parts = memory.of([" " + p for p in pieces]) + memory.of([pieces[c] for c in openings])
    codes[first] = len(pieces) + np.arange(len(first))
    other = np.flatnonzero(~plain)
    if len(other):  # their units take the place of their pieces
        runs = []
        for text in texts.take(pa.array(other)).to_pylist():
            # \x1c-\x1f are white space to Python alone
            known = [np.array(e.ids, "<u4").tobytes() for e in encode(path, [text])] if re.search("[\x1c-\x1f]", text) else memory.of(_UNIT.findall(text))
            runs.append(np.arange(len(parts), len(parts) + len(known)))
            parts += known
        size = np.diff(bounds)
        size[other] = [len(r) for r in runs]
        ends = np.concatenate([[0], np.cumsum(size)])
        whole, kept = np.empty(ends[-1], np.int64), np.repeat(plain, size)
        whole[kept] = codes[np.repeat(plain, np.diff(bounds))]
        whole[~kept] = np.concatenate(runs)
        codes, bounds = whole, ends
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    start = np.cumsum(size) - size
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    # a slice of texts has few ids, so that most places fit in 32 bits
    kind = np.int32 if max(ends[-1], size.sum()) < 1 << 31 else np.int64
    at = np.repeat((start[codes] - ends[:-1]).astype(kind), n)
    at += np.arange(ends[-1], dtype=kind)
    return ends[bounds], np.frombuffer(b"".join(parts), "<u4")[at]


def spliced_count(path: str, text: str, chunk: int = 32_768, overlap: int = 512) -> int:
    """Tokens of a huge text from overlapping chunks.

    Two neighbouring encodings are joined at a position where both have a
    token boundary, where a character other than white space is followed by
    ASCII white space, and which lies inside both chunks: no piece spans it, so
    tokens before it do not depend on what follows, nor tokens after it on what
    went before. Without such a position the overlap is doubled, in the end to
    the whole text.
    """
    total, at, end, counted_to = 0, 0, min(len(text), chunk), 0
    left = tokenizer(path).encode(text[:end], add_special_tokens=False).offsets
    while end < len(text):
        width = overlap
        while True:
            start = max(0, end - width)
            to = min(len(text), end + chunk)
            right = tokenizer(path).encode(text[start:to], add_special_tokens=False).offsets
            left_ends = {at + b for _, b in left}
            joins = [start + a for a, _ in right if start + a in left_ends and counted_to < start + a < end and text[start + a] in " \t\n\r" and not text[start + a - 1].isspace()]
            if joins or start <= counted_to:
                break
            width *= 2
        if joins:
            join = joins[len(joins) // 2]
            total += sum(at + a >= counted_to and at + b <= join for a, b in left)
            counted_to, at, left = join, start, right
        else:  # no stable position at all: the left part is encoded again with what follows
            at, left = counted_to, tokenizer(path).encode(text[counted_to:to], add_special_tokens=False).offsets
        end = to
    return total + sum(at + a >= counted_to for a, _ in left)
