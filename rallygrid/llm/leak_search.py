"""Evaluation texts leaking into training text: MinHash containment search, verified exactly.

The stated case (twelve consecutive words of a test item, at most one replaced) is a
containment of a short set in a long document. Documents are read as overlapping segments, so
that every possible passage lies whole in one segment; segments are partitioned by the size of
their shingle set, and each partition gets as many hash functions as make the chance of
missing the least similar true passage smaller than ``miss``. Passages of the items (all their
twelve-word windows) are the queries. A segment whose minimum under any function equals a
passage's is a candidate, and candidates are verified word by word.

One pass over the corpus, no shuffle before the final ``distinct``; items are taken in blocks
of bounded size, one pass each, so a large item table changes the number of passes and not
the memory.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 12
REPLACED = 1
SHINGLE = 5
MISS = 1e-5
#: Items of one block; a block's signatures are sent with the tasks (80 items: some 5 MB).
ITEMS_PER_BLOCK = 2_000
_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"\p{Mn}+")
_CACHE_WORDS = 500_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case and accents."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold() if not text.isascii() else text.lower())


class _Hasher:
    """64-bit hashes of words, remembered between texts."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > _CACHE_WORDS:
            seen.clear()
        try:
            return [seen[w] for w in words]
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh64_intdigest(w)
            return [seen[w] for w in words]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Order-dependent 32-bit hashes of the k-word windows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = _mix(out + hashes[i : i + n])
    return (out >> np.uint64(32)).astype(np.uint32)


def functions_needed(segment_shingles: int, miss: float = MISS) -> int:
    """Hash functions that find the least similar true passage in a segment of the given size
    but for a chance of ``miss``."""
    per_passage = PASSAGE - SHINGLE + 1
    shared = per_passage - REPLACED * SHINGLE  # a replaced word spoils at most so many shingles
    jaccard = shared / (per_passage + max(segment_shingles, shared) - shared)
    if jaccard >= 1:
        return 1
    return max(1, math.ceil(math.log(miss) / math.log(1 - jaccard)))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12345)
    a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 2**32, n, dtype=np.uint32)


#: Largest number of shingles of the segments in each partition.
_FULL = 2 * PASSAGE - SHINGLE + 1
SIZES = (PASSAGE - SHINGLE + 1, 12, 16, _FULL)
#: Segments whose minima are taken at once; their shingles fit a core's cache.
_CHUNK = 2_048
_FILTER = np.uint32(0xFFFF)


class ItemIndex:
    """Signatures of all passages of a block of items."""

    def __init__(self, items: list[tuple[int, str]], miss: float = MISS) -> None:
        hasher = _Hasher()
        self.needed = [functions_needed(s, miss) for s in SIZES]
        self.a, self.c = _coefficients(max(self.needed))
        self.ids, self.words = [], []
        rows, owner = [], []
        for item_id, text in items:
            h = np.array(hasher(words_of(text)), dtype=np.uint64)
            if len(h) < PASSAGE:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(shingles(h), PASSAGE - SHINGLE + 1)
            rows.append(windows)
            owner += [len(self.ids)] * len(windows)
            self.ids.append(item_id)
            self.words.append(h)
        self.values: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.may: list[np.ndarray] = []
        if rows:
            sets = np.ascontiguousarray(np.concatenate(rows).T)
            for j in range(len(self.a)):
                low = (sets * self.a[j] + self.c[j]).min(axis=0)
                pair = np.unique(np.rec.fromarrays([low, np.array(owner)], names="v,o"))
                self.values.append(np.ascontiguousarray(pair["v"]))
                self.owners.append(np.ascontiguousarray(pair["o"]))
                may = np.zeros(int(_FILTER) + 1, dtype=bool)  # by the low bits of the values
                may[pair["v"] & _FILTER] = True
                self.may.append(may)

    def search(self, sets: np.ndarray, functions: int) -> set[tuple[int, int]]:
        """(column of ``sets``, item) pairs whose minima agree under one of the functions."""
        found: set[tuple[int, int]] = set()
        work = np.empty_like(sets)
        low = np.empty(sets.shape[1], dtype=sets.dtype)
        for j in range(functions):
            np.multiply(sets, self.a[j], out=work)
            np.add(work, self.c[j], out=work)
            np.minimum.reduce(work, axis=0, out=low)
            some = np.flatnonzero(self.may[j][low & _FILTER])
            values, asked = self.values[j], low[some]
            lo = np.searchsorted(values, asked, "left")
            hit = np.flatnonzero((lo < len(values)) & (values[np.minimum(lo, len(values) - 1)] == asked))
            if len(hit):
                hi = np.searchsorted(values, asked[hit], "right")
                for at, x, y in zip(some[hit].tolist(), lo[hit].tolist(), hi.tolist()):
                    found.update((at, o) for o in self.owners[j][x:y].tolist())
        return found

    def holds(self, segment: np.ndarray, item: int) -> bool:
        """Exact test: PASSAGE consecutive item words in the segment, REPLACED may differ."""
        # Agreements along the diagonals, in runs of 1, 2, 4, 8 and so on.
        run = (segment[:, None] == self.words[item][None, :]).astype(np.int8)
        n, m = run.shape[0] - PASSAGE + 1, run.shape[1] - PASSAGE + 1
        total, at, width = np.zeros((n, m), dtype=np.int8), 0, 1
        while width <= PASSAGE:
            if PASSAGE & width:
                total += run[at : at + n, at : at + m]
                at += width
            run = run[:-width, :-width] + run[width:, width:] if 2 * width <= PASSAGE else run
            width *= 2
        return bool((total >= PASSAGE - REPLACED).any())


def _search_texts(index: ItemIndex, ids: list[int], lengths: list[int], flat: list[int]) -> set[tuple[int, int]]:
    """Leaks of some texts, given as one run of word hashes and the texts' lengths."""
    words = np.array(flat, dtype=np.uint64)
    grams = shingles(words)  # those across two texts belong to no segment
    n = np.array(lengths, dtype=np.int64)
    offset = np.cumsum(n) - n
    per_text = np.maximum(n - PASSAGE, 0) // PASSAGE + 1
    text = np.repeat(np.arange(len(n)), per_text)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = offset[text] + k * PASSAGE
    held = np.minimum(2 * PASSAGE, n[text] - k * PASSAGE)  # words of the segment
    size = held - SHINGLE + 1
    found: set[tuple[int, int]] = set()
    least = 0
    for most, functions in zip(SIZES, index.needed):
        part = np.flatnonzero((size > least) & (size <= most))
        least = most
        for at in range(0, len(part), _CHUNK):
            seg = part[at : at + _CHUNK]
            # A repeated element changes no minimum, so short segments repeat their last one.
            cols = start[seg][None, :] + np.minimum(np.arange(most)[:, None], size[seg][None, :] - 1)
            for col, item in index.search(grams[cols], functions):
                s = seg[col]
                key = (ids[text[s]], index.ids[item])
                if key not in found and index.holds(words[start[s] : start[s] + held[s]], item):
                    found.add(key)
    return found


def _scan(index: ItemIndex):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for frame in frames:
            found: set[tuple[int, int]] = set()
            ids: list[int] = []
            lengths: list[int] = []
            flat: list[int] = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"]):
                h = hasher(words_of(text))
                if len(h) < PASSAGE:
                    continue
                ids.append(doc_id)
                lengths.append(len(h))
                flat += h
                if len(flat) > 500_000:
                    found |= _search_texts(index, ids, lengths, flat)
                    ids, lengths, flat = [], [], []
            if ids:
                found |= _search_texts(index, ids, lengths, flat)
            if found:
                yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"])

    return run


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    miss: float = MISS,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """``(doc_id long, item_id long)``: documents (``doc_id, text``) that hold twelve
    consecutive words of an item (``item_id, text``), at most one of them replaced.

    Null texts and ids, empty texts and texts of under twelve words give nothing. Texts of any
    length are searched whole. Repeated rows give one result row; other columns are ignored;
    empty tables give an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        "doc_id is not null and text is not null"
    )
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "item_id is not null and text is not null"
    )
    blocks = max(1, -(-queries.count() // items_per_block))
    out = None
    for k in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        index = ItemIndex([(r["item_id"], r["text"]) for r in block], miss)
        if not index.ids:
            continue
        part = docs.mapInPandas(_scan(index), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()
