"""Periodic run detection by the runs theorem.

A run is a stretch of words of smallest period p, at least 2 p long, that no neighbouring word
extends with that period. By the runs theorem each run holds a Lyndon root: a factor of length p that
is the longest Lyndon word starting at its place under one of two opposite orders of the words, and one
such root starts inside the run's first p words. So per document:

1. Suffixes are sorted by prefix doubling, with an end mark that is smaller than every word.
2. The longest Lyndon word at i ends before the next smaller value of the inverse suffix array, under
   the opposite order before the next greater one. That gives two candidates a word, whatever the text.
3. Candidates that cannot reach the least length are passed over by looking at one or two words.
4. The rest is extended to both sides by longest common extensions: the suffix array's LCP with a
   sparse table of range minima, and the same over the reversed words. Equal results are one run.

Documents are worked on together in slices of about a MB; words of different documents never compare
equal. A longer document is a slice of its own: memory and time are n log n in its words, also for one
word repeated throughout. Words are told apart by 64-bit hashes (odds of a mistake in a document of a
million words 1e-7).

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, case matters; null text counts as empty; no words: no
runs and an empty collapsed text. A null doc_id is carried along, rows repeated are treated each for
itself, an empty table gives an empty result, other columns are ignored. Runs come by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, WHITE, bounded, byte_table, mix64, utf8_buffer, word_hashes

_TABLE = byte_table(WHITE, fold=False)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_ranks(first: np.ndarray) -> np.ndarray:
    """The inverse suffix array of ``first``, ranks of single symbols whose last one is smaller than all others.

    Only suffixes that still share their rank are sorted again.
    """
    order = np.argsort(first, kind="stable")
    sorted_ = first[order]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = head
    single = fresh & np.concatenate([fresh[1:], [True]])
    left, h = order[~single], 1
    while len(left):
        low = rank[left + h]  # a shared prefix ends before the end mark
        key = rank[left] * len(rank) + low
        o = np.argsort(key, kind="stable")
        left, key = left[o], key[o]
        own = key // len(rank)
        places = np.arange(len(left))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), places, 0))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[left] = own + head - group
        left = left[~(fresh & np.concatenate([fresh[1:], [True]]))]
        h *= 2
    return rank


def range_minima(x: np.ndarray, reach: int) -> list[np.ndarray]:
    """A sparse table: level k has the least of each 2**k values, for ranges of up to ``reach``."""
    levels = [x]
    while 1 << len(levels) <= min(reach, len(x)):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def next_smaller(x: np.ndarray, reach: int, steps: int = 6) -> np.ndarray:
    """The place of the next smaller value (len(x) if there is none within ``reach``)."""
    n = len(x)
    out, left, at = np.full(n, n, np.int64), np.arange(n), np.arange(1, n + 1)
    padded = np.append(x, np.iinfo(x.dtype).min)
    for _ in range(steps):  # most are near
        hit = padded[at] < x[left]
        out[left[hit]] = at[hit]
        left, at = left[~hit], at[~hit] + 1
    levels = range_minima(padded, reach + 1)
    for k in range(len(levels) - 1, -1, -1):
        inside = at < len(levels[k])
        on = np.zeros(len(at), bool)
        on[inside] = levels[k][at[inside]] > x[left[inside]]
        at = at + (on.astype(np.int64) << k)
    out[left] = np.minimum(at, n)
    return out


class Extensions:
    """Longest common prefixes of any two suffixes of a sequence that ends in a mark."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.rank = suffix_ranks(symbols)
        self.levels = range_minima(self._neighbours(symbols), len(symbols))

    def _neighbours(self, symbols: np.ndarray) -> np.ndarray:
        """The common prefix of each suffix with the one before it in order, in text order with one cursor."""
        rank, text = self.rank.tolist(), symbols.tolist()
        order = np.argsort(self.rank).tolist()
        lcp, h = [0] * len(text), 0
        for i, r in enumerate(rank):
            if r:
                j = order[r - 1]
                while text[i + h] == text[j + h]:
                    h += 1
                lcp[r] = h
                h = h - 1 if h else 0
            else:
                h = 0
        return np.array(lcp, np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at i and j, i <> j."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for level in np.unique(k):
            at = k == level
            x = self.levels[level]
            out[at] = np.minimum(x[lo[at]], x[hi[at] - (1 << int(level))])
        return out


def marked(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first place of each document): documents one after the other, each with an end mark.

    End marks are all different and the smallest symbols; the last document's is the smallest of all.
    """
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    _, symbol = np.unique(words, return_inverse=True)
    out = np.empty(starts[-1], np.int64)
    ends = starts[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = symbol + len(sizes)
    out[ends] = np.arange(len(sizes))[::-1]
    return out, starts[:-1]


def candidates(symbols: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the Lyndon roots under either order that can begin a run of ``least`` words."""
    rank, reach = suffix_ranks(symbols), int(sizes.max(initial=0)) + 1
    i = np.arange(len(symbols))
    found = []
    for x in (rank, -rank):
        p = next_smaller(x, reach) - i
        # The words equal to the one p later are a stretch of at least ``need`` with i in it, less than p of them before i.
        need = np.maximum(least - p, p)
        alike = lambda at, p=p: (at >= 0) & (at + p < len(symbols)) & (symbols[np.maximum(at, 0)] == symbols[np.minimum(at + p, len(symbols) - 1)])
        at = np.flatnonzero(alike(i))
        p, need = p[at], need[at]
        mostly = lambda at, p: (at >= 0) & (at + p < len(symbols)) & (symbols[np.clip(at, 0, len(symbols) - 1)] == symbols[np.clip(at + p, 0, len(symbols) - 1)])
        half = (need + 1) // 2
        ok = mostly(at + half - 1, p) | mostly(at - (need // 2 + 1), p)
        found.append((at[ok], p[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run of at least max(least, 2 * period) words, in order.

    ``words`` are numbers of the words of all documents one after the other, different for different documents.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(words):
        return none
    symbols, starts = marked(words, sizes)
    at, _ = candidates(symbols, sizes, least)
    if not len(at):
        return none
    # Only documents with candidates left are looked at further.
    some = np.unique(np.searchsorted(starts, at, "right") - 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in some])
    words, sizes = words[keep], sizes[some]
    symbols, starts = marked(words, sizes)
    at, p = candidates(symbols, sizes, least)
    after = Extensions(symbols).common(at, at + p)
    need = np.maximum(least - p, p)
    ok = after + p - 1 >= need
    at, p, after, need = at[ok], p[ok], after[ok], need[ok]
    if not len(at):
        return none
    back, _ = marked(words[::-1], sizes[::-1])
    mirror = len(symbols) - 2 - at  # of the word at; marks stand one place on in the mirrored sequence
    before = np.zeros(len(at), np.int64)
    inner = at > starts[np.searchsorted(starts, at, "right") - 1]
    before[inner] = Extensions(back).common(mirror[inner] + 1, mirror[inner] + 1 - p[inner])
    ok = (before < p) & (before + after >= need)
    begin, length, p = (at - before)[ok], (before + after + p)[ok], p[ok]
    doc = np.searchsorted(starts, begin, "right") - 1
    every = np.unique(np.stack([doc, begin - starts[doc], p, length]), axis=1)
    return some[every[0]], every[1], every[3], every[2]


def repeated(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run after its first ``period`` words."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def find(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, runs: array<struct<start, length, period>>, collapsed): one row per document.

    ``collapsed`` are the words that no run repeats, joined by one space: of each run the first period stays.
    """
    fields = [pa.field(n, pa.int64()) for n in ("start", "length", "period")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in bounded(whole, 1, SLICE)):
            raw, off = utf8_buffer(b.column(1))
            words, rows, _, _ = word_hashes(raw, off, _TABLE)
            sizes = np.bincount(rows, minlength=b.num_rows) if len(rows) else np.zeros(b.num_rows, np.int64)
            doc, start, length, period = runs_of(mix64(words ^ mix64(rows.astype(np.uint64) + np.uint64(1))), sizes, least)
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1))
            data, texts = raw.tobytes(), []
            for i in range(b.num_rows):
                own, lo, hi = data[off[i] : off[i + 1]].split(), bounds[i], bounds[i + 1]
                if lo < hi:
                    gone = repeated(len(own), start[lo:hi], length[lo:hi], period[lo:hi])
                    own = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                texts.append(b" ".join(own))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=fields)
            cols = [b.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id bigint, runs array<{RUN}>, collapsed string")
