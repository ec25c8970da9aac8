"""Substring deduplication over sliding sentence spans.

A text is cut into sentences at ``.``, ``!``, ``?`` and line ends; so that a passage without
them is cut alike wherever it stands, a word whose hash is a multiple of 16 also ends one, and
of LONG words in a row that end none the one with the least hash does, so that a sentence of more
words is always several. From every sentence on, the shortest run of at least ``min_sentences``
sentences with at least ``min_words`` words is a span, and with ``tails`` so is the shortest one up
to every sentence's end. Together they cover each sentence of every longer run that is repeated, so
the result is that of hashing all runs; without ``tails`` a passage's last sentences can stay.
Spans meet by their hash over all documents; of equal spans the first by (doc_id, place) stays,
and every sentence covered by another is removed. A span up to an end can only be repeated where
the shorter one from its start is, so it travels with that one and is looked at only then.

Spans are narrow rows, counted before they meet in a join, and only repeated ones go on, so
a passage that a third of the documents share is split by the skew join. Removals return to
their documents in one join.

Defined results: words are runs of letters, digits and non-ASCII characters after
lower-casing A-Z, so punctuation and case do not matter; a null text stays null, an empty one
empty; rows repeated whole count as one document and are cleaned alike; a null doc_id comes
before every other; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, bounded, byte_table, cut, cut_small, mix64, powers, sealed, utf8_buffer, word_hashes

_TABLE = byte_table(NOT_ALNUM)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True

LONG = 29


def least_of_window(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words have the least hash of some LONG words in a row of which none ends a sentence."""
    n = len(words)
    if n < LONG or np.diff(np.flatnonzero(np.concatenate([[True], ends]))).max(initial=0) <= LONG:
        return np.zeros(n, bool)

    def window(x: np.ndarray, f: np.ufunc) -> np.ndarray:
        for step in (1, 2, 4, 8, LONG - 16):
            x = f(x[:-step], x[step:])
        return x

    x = np.where(ends, np.uint64(0), words)
    least = np.pad(window(x, np.minimum), LONG - 1)
    return (x > 0) & (window(least, np.maximum) == x)


def sentences(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each sentence, its row, its first byte); each array but the first has one entry a sentence."""
    words, rows, starts, ends = word_hashes(raw, off, _TABLE)
    if not len(words):
        none = np.zeros(0, np.int64)
        return words, none, none, none
    closed = np.cumsum(_ENDS[raw], dtype=np.int32)
    fresh = np.ones(len(words), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (closed[starts[1:]] > closed[ends[:-1] - 1]) | (words[:-1] % np.uint64(16) == 0)
    fresh[1:] |= least_of_window(words, np.append(fresh[1:], True))[:-1]
    first = np.flatnonzero(fresh)
    return words, first, rows[first], starts[first]


def spans(raw: np.ndarray, off: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first sentence within the row, sentences) of every span from a start, then bounds and
    values of its list of further spans up to an end: hash, sentences, hash, sentences, ..."""
    words, first, row, _ = sentences(raw, off)
    n = len(first)
    if not n:
        none = np.zeros(0, np.int64)
        return words, none, none, none, np.zeros(1, np.int64), none
    edge = np.append(first, len(words))
    i = np.arange(n)
    stop = np.maximum(np.searchsorted(edge, first + min_words, "left"), i + min_sentences)
    inside = stop <= n
    i, stop = i[inside], stop[inside]
    same = row[stop - 1] == row[i]
    i, stop = i[same], stop[same]
    up, down = powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])

    def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = edge[a], edge[b]
        return mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

    to = np.arange(1, n + 1)
    since = np.minimum(np.searchsorted(edge, edge[1:] - min_words, "right") - 1, to - min_sentences)
    good = since >= 0
    to, since = to[good], since[good]
    shortest = np.full(n, -1)
    shortest[i] = stop
    more = (row[since] == row[to - 1]) & (shortest[since] != to)
    to, since = to[more], since[more]  # both ascend, so the lists of the starts lie in order
    bounds = np.searchsorted(since, np.append(i, n)) * 2
    values = np.stack([code(since, to).view(np.int64), to - since], 1).reshape(-1)
    base = np.searchsorted(row, row[i], "left")
    return code(i, stop), row[i], i - base, stop - i, bounds, values


def later_places(spans: DataFrame) -> DataFrame:
    """The spans (h, doc_id, row_key, start, n) that stand at an earlier place too."""
    first = spans.filter("doc_id = first_doc").groupBy("h").agg(F.min(F.struct("row_key", "start")).alias("f")).select("h", F.col("f.row_key").alias("fk"), F.col("f.start").alias("fs"))
    # Cut as in ``repeats``.
    return spans.join(cut_small(first), "h").filter("NOT (doc_id = first_doc AND row_key = fk AND start = fs)").select("doc_id", "row_key", "start", "n")


def repeats(spans: DataFrame) -> DataFrame:
    """The spans that stand at several places, and the first document of each."""
    repeated = spans.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("times")).filter("times > 1").select("h", "first_doc")
    # Cut, so that the join shuffles both sides anew and can split a span that stands everywhere.
    return cut(spans.join(cut_small(repeated), "h"))


def removed_runs(docs: DataFrame, min_sentences: int, min_words: int, tails: bool) -> DataFrame:
    """(doc_id, row_key, runs: array<struct<start, n>>): the covered sentences of each document that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(whole, 2):
                raw, off = utf8_buffer(b.column(2))
                h, row, start, n, bounds, values = spans(raw, off, min_sentences, min_words)
                at = pa.array(row)
                none = np.diff(bounds) == 0 if tails else np.ones(len(h), bool)
                more = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(none, False)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), more],
                    ["h", "doc_id", "row_key", "start", "n", "more"],
                )

    low = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), low).alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string"))
    hits = repeats(rows.mapInArrow(run, "h bigint, doc_id bigint, row_key bigint, start int, n int, more array<bigint>"))
    later = later_places(hits)
    if tails:
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.size("more") - 2, F.lit(2)), lambda i: F.struct(F.get("more", i).alias("h"), F.get("more", i + 1).cast("int").alias("n"))))
        ends = hits.filter("more IS NOT NULL").select("doc_id", "row_key", "start", pair.alias("x")).select("x.h", "doc_id", "row_key", "start", "x.n")
        later = later.unionByName(later_places(repeats(ends)))
    return later.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def clean(docs: DataFrame, min_sentences: int = 2, min_words: int = 30, tails: bool = True) -> DataFrame:
    """All columns of ``docs``, the text without what other documents or places had before, and
    __sentences, __removed (numbers of sentences) and __removed_words. Columns of ``docs`` with these
    names, as of an earlier pass, are written over."""
    docs = docs.drop("__sentences", "__removed", "__removed_words")
    low = F.lit(-(1 << 63)).cast("long")
    runs = removed_runs(docs, min_sentences, min_words, tails)
    own, at, names = sealed(docs.withColumn("text", F.col("text").cast("string")))
    own = own.withColumn("d", F.coalesce(at("doc_id").cast("long"), low)).withColumn("k", F.xxhash64(at("doc_id"), at("text")))
    met = own.join(runs, (F.col("d") == F.col("doc_id")) & (F.col("k") == F.col("row_key")), "left").drop("d", "k", "doc_id", "row_key")
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(whole, text_at):
                raw, off = utf8_buffer(b.column(text_at))
                words, first, row, byte = sentences(raw, off)
                edge = np.append(first, len(words))
                lo, hi = np.searchsorted(row, np.arange(b.num_rows), "left"), np.searchsorted(row, np.arange(b.num_rows), "right")
                texts, gone, gone_words = [], np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                for i, (text, runs) in enumerate(zip(b.column(text_at), b.column(b.num_columns - 1).to_pylist(), strict=True)):
                    if not runs:
                        texts.append(text.as_py())
                        continue
                    out = np.zeros(hi[i] - lo[i] + 1, np.int64)
                    for r in runs:
                        out[r["start"]] += 1
                        out[r["start"] + r["n"]] -= 1
                    out = np.cumsum(out)[:-1] > 0
                    at = np.append(byte[lo[i] : hi[i]], off[i + 1])
                    at[0] = off[i]
                    texts.append(b"".join(raw[at[j] : at[j + 1]].tobytes() for j in np.flatnonzero(~out)).decode())
                    gone[i], gone_words[i] = out.sum(), np.diff(edge[lo[i] : hi[i] + 1])[out].sum()
                cols = [*b.columns[:-1], pa.array(hi - lo), pa.array(gone), pa.array(gone_words)]
                cols[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "sentences", "removed", "removed_words"])

    schema = met.drop("runs").schema.add("sentences", "long").add("removed", "long").add("removed_words", "long")
    return met.mapInArrow(run, schema).toDF(*names, "__sentences", "__removed", "__removed_words")
