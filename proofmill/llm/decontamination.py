"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may be hidden in a document with up to k = floor((1 - similarity) * m) word edits.
Cut into k + 1 pieces, at least one piece then survives unedited, so exact piece hits give every candidate place;
Myers' bit-parallel algorithm (one machine word of bits per item word, here Python's long integers)
computes the smallest edit distance between the item and any stretch of the text around the hit.

Words are runs of letters, digits and underscores of the lower-cased text, so punctuation and line breaks do not matter.

The test items are a stated query set: they go to the executors in blocks of bounded size, and every block meets all rows.

Defined results: a null or empty text matches nothing; an item without words (or null) matches nothing; equal items each match;
repeated document rows each get their own result; columns beyond the id and the text pass through `decontaminate` untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import computed, text_or_empty

TOKEN = re.compile(r"\w+")
SIMILARITY = 0.8
#: Characters of test items in one broadcast block.
BLOCK_CHARS = 4_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MATCH_TYPE = "array<struct<item_id:bigint,distance:int,first_word:int,last_word:int>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text_or_empty(text).lower())


def budget(m: int, similarity: float = SIMILARITY) -> int:
    """Word edits allowed in an item of m words."""
    return int((1 - similarity) * m + 1e-9)


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 nearly equal pieces of m words as (start, length); fewer when there are not enough words."""
    n = min(k + 1, m)
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict, m: int, text: list) -> tuple[int, int]:
    """Smallest edit distance between a pattern of m symbols and any stretch of text, and the end of the first such stretch."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    positive, negative, score = full, 0, m
    best, at = m, 0
    for i, symbol in enumerate(text):
        eq = masks.get(symbol, 0)
        diagonal = (((eq & positive) + positive) ^ positive) | eq | negative
        up = negative | ~(diagonal | positive) & full
        down = positive & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # a stretch may start anywhere, so the first row stays 0
        down = down << 1 & full
        positive = down | ~(diagonal | up) & full
        negative = up & diagonal
        if score < best:
            best, at = score, i + 1
    return best, at


class Items:
    """One block of test items: their vocabulary, exact pieces by length, and bit masks."""

    def __init__(self, rows: list[tuple[int, list[str]]], similarity: float):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        starts: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for item_id, ws in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            k = budget(len(ids), similarity)
            masks: dict[int, int] = defaultdict(int)
            for i, x in enumerate(ids):
                masks[x] |= 1 << i
            for a, n in pieces(len(ids), k):
                starts[n][tuple(ids[a : a + n])].append((len(self.items), a))
            self.items.append((item_id, len(ids), k, dict(masks)))
        self.starts = {n: dict(x) for n, x in starts.items()}
        self.hashes = {n: np.unique(np.array([rolled(np.array(p, dtype=np.uint64), n)[0] for p in x], dtype=np.uint64)) for n, x in self.starts.items()}

    def find(self, ws: list[str]) -> list[tuple[int, int, int, int]]:
        """(item id, distance, first word, last word) of the best place of each item within its budget, by item id."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in ws), dtype=np.uint64, count=len(ws))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, hashes in self.hashes.items():
            if len(ws) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            at = at[np.isin(rolled_at(ids, at, n), hashes)]
            for p in at.tolist():
                for item, a in self.starts[n].get(tuple(ids[p : p + n].tolist()), ()):
                    _, m, k, _ = self.items[item]
                    places[item].append((max(0, p - a - k), min(len(ws), p - a + m + k)))
        found = []
        for item, spans in places.items():
            item_id, m, k, masks = self.items[item]
            best = None
            for a, b in merged(spans):
                distance, end = myers(masks, m, ids[a:b].tolist())
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, a + end)
            if best:
                found.append((item_id, best[0], max(0, best[1] - m), best[1] - 1))
        return sorted(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    return rolled_at(ids, np.arange(len(ids) - n + 1), n)


def rolled_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n ids from each place; hits are confirmed on the ids themselves."""
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        h = (h ^ ids[at + i]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int):
    """Lists of (item id, words) of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("bigint"), F.col(text_col)).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for item_id, text in rows.toLocalIterator():
        if ws := tokens(text):
            block.append((item_id, ws))
            size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS, into: str = "matches") -> DataFrame:
    """docs with one more column `into`: the best place of every test item that the text holds within the edit budget, by item id.

    A column of docs that is already called `into` is replaced. No shuffle: each block of items is one pass over the rows.
    """
    out = docs.drop(into)
    names = out.columns
    out = out.withColumn(into, F.array().cast(MATCH_TYPE))
    places = F.struct(F.col(text_col).alias("text"), F.col(into).alias("known"))
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def search(held=held):
            items = Items(held.value, similarity)
            return lambda rows: [sorted([*map(as_tuple, r["known"]), *items.find(tokens(r["text"]))]) for r in rows]

        both = "text_and_matches"
        while both in names:
            both += "_"
        out = computed(out.withColumn(both, places), both, into, MATCH_TYPE, search).drop(both)
    return out.select(*names, into)


def as_tuple(match: dict) -> tuple:
    return tuple(match.values())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text holds no test item, with the columns of docs."""
    mark = "matches"
    while mark in docs.columns:
        mark += "_"
    return find_matches(docs, benchmark, text_col, into=mark, **options).where(F.size(mark) == 0).drop(mark)
