"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A document is its token ids and an end id; only documents longer than a sequence are cut,
the first piece taking the remainder. Pieces shorter than a sequence are packed by
best-two-fit: a bin is filled greedily with the longest piece that fits its gap, then its
smallest piece is exchanged for two unpacked pieces that together fill the widened gap more
tightly, as long as such two exist.

Bins depend on lengths only, and there are at most ``capacity`` - 1 different ones, so the
plan is made for the histogram of lengths: one bin layout at a time, repeated as often as
the counts allow. That needs memory bounded by ``capacity`` however many documents there
are, and gives the same bins as packing piece by piece. Each piece then finds its slot from
its rank among the pieces of its length: a running number inside its task, and an offset
from the counts of the tasks before.

Defined results: null text counts as empty, an empty text is its end id alone; repeated rows
are packed each for itself; of two pieces that fill a gap alike the pair with the shorter one is
taken, and pieces of one length fill its slots by the number of their task and row; a null doc_id
is carried along; an empty table gives an empty result; other columns are ignored.
A text holding the vocabulary's special string is encoded by the tokenizer as it stands.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


class Encoder:
    """Token ids, as little-endian unsigned 32-bit numbers, of texts under a byte-level BPE file.

    In such a vocabulary a space between two other characters always begins a new unit, so a
    text splits there and most units come from a cache of bounded size; what is new goes
    through the same merges by rank. Texts with other white space go through whole.
    """

    CACHE = 300_000

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.slow = Tokenizer.from_file(json_path)
        self.special = tuple(t.content for t in self.slow.get_added_tokens_decoder().values())
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        units = text.split(" ")
        if len(units) < 3:
            return self._plain(text)
        known = self.known
        out = [self._plain(units[0])]
        new = {u for u in units[1:] if u not in known}
        if new:
            if any(not u or u[0].isspace() or u[-1].isspace() for u in new) or units[0][-1:].isspace():
                return self._plain(text)
            if len(known) + len(new) > self.CACHE:
                known.clear()
                new = set(units[1:])
                if any(not u or u[0].isspace() or u[-1].isspace() for u in new):
                    return self._plain(text)
            for u in new:
                known[u] = self._plain(" " + u)
        elif units[0][-1:].isspace():
            return self._plain(text)
        out.extend(map(known.__getitem__, units[1:]))
        return b"".join(out)


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"


def pieces(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenise and cut; task and rank number the pieces of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = Encoder(json_path, ranks_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                start, size, k = 0, (total - 1) % capacity + 1, 0
                while start < total:
                    out.append((doc_id, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, ranks[size]))
                    ranks[size] += 1
                    start, size, k = start + size, capacity, k + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin layouts (lengths, longest first) with how often each is used, for counts by length."""
    left = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(left)
    bins: list[tuple[tuple[int, ...], int]] = []

    def spare(length: int, own: list[int]) -> int:
        return left.get(length, 0) - own.count(length)

    def longest(gap: int, own: list[int]) -> int:
        i = bisect_right(lengths, gap)
        while i and spare(lengths[i - 1], own) <= 0:
            i -= 1
        return lengths[i - 1] if i else 0

    while lengths:
        own: list[int] = []
        gap = capacity
        while gap and (x := longest(gap, own)):
            own.append(x)
            gap -= x
        while gap and len(own) > 1:
            small = min(own)
            rest = own.copy()
            rest.remove(small)
            room, best = small + gap, (small, 0, 0)
            i, j = 0, bisect_right(lengths, room) - 1
            while i <= j:  # two pointers: the largest sum not above the room
                a, b = lengths[i], lengths[j]
                if a + b > room or spare(b, rest) <= 0:
                    j -= 1
                    continue
                need = 2 if a == b else 1
                if spare(a, rest) >= need and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                i += 1
            if best[0] <= small:
                break
            own, gap = [*rest, best[2], best[1]], room - best[0]
        times = min(left[x] // own.count(x) for x in set(own))
        bins.append((tuple(sorted(own, reverse=True)), times))
        for x in own:
            left[x] -= times
        lengths = [x for x in lengths if left[x] > 0]
    return bins


def slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of it in a bin, first sequence, first offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for layout, times in bins:
        offset = 0
        for x in sorted(set(layout), reverse=True):
            n = layout.count(x)
            out.setdefault(x, []).append((used.get(x, 0), n, sequence, offset))
            used[x] = used.get(x, 0) + n * times
            offset += n * x
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    cutted = cut(pieces(docs, json_path, ranks_path, end_id, capacity))
    counts = cutted.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "task", before.alias("before"))
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(best_two_fit(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), table[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                own = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + own // row[:, 1], row[:, 3] + own % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*NAMES[:5], "sequence_id", "offset"])

    ranked = cutted.join(offsets, ["length", "task"]).select(*NAMES[:5], (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
