"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is leaked into a document when at least ``containment`` of its distinct shingles of
``k`` words stand in the document. Sets of such different sizes have no useful Jaccard
similarity, so the search is one-sided: items are partitioned by size, and each has the
bottom of its MinHash order as sketch, as many shingles as its size allows to be missing and
one more. The order puts shingles of few items first, so that a phrase of many items is no
one's sketch. A document that reaches the containment must hold a sketch value, so candidates
are complete; documents smaller than what an item asks for are passed over. A candidate is
verified by counting all the item's shingles in the document's set.

Items within ``broadcast_bytes`` of text (counted before) are sent to every task as arrays, and
documents are read once without a shuffle. Larger collections are joined, with the same result:
a bit array of fixed size over the sketch values keeps other shingles out of the shuffle,
candidates meet the items on the shingle, and are counted by shuffle on (document, shingle).

Defined results: words are runs of letters, digits and non-ASCII characters after
lower-casing A-Z; null text counts as empty; an item of fewer than ``k`` words has no shingle
and is never found; a null doc_id or item_id is a value like any other; a document repeated whole
gives its pairs once, an item repeated whole is one item; rows of one item_id with different texts
are one item each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOW, NOT_ALNUM, bit_array, bounded, byte_table, cut, cut_small, in_bits, row_of, sealed, shingles, utf8_buffer, word_hashes

_TABLE = byte_table(NOT_ALNUM)
PAIR = "doc_id bigint, row_key bigint, item_id bigint, item_key bigint, shared bigint, item_shingles bigint"
ITEM = ["item_id", "item_key"]


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw, off = utf8_buffer(column)
    words, rows, _, _ = word_hashes(raw, off, _TABLE)
    return shingles(words, rows, len(off) - 1, k, False)


def fraction(containment: float | str | Fraction) -> Fraction:
    """A threshold as the simplest fraction that it can mean: 0.8 is 4/5, 2 / 3 is 2/3."""
    return Fraction(containment).limit_denominator(1_000_000)


def needed(size: int, containment: float | str | Fraction) -> int:
    """How many of ``size`` shingles must be shared, exactly."""
    return max(1, math.ceil(size * fraction(containment)))


def exploded(rows: DataFrame, k: int, names: list[str], bits: np.ndarray | None = None) -> DataFrame:
    """(id, key, size, shingle): the distinct shingles of each text of (id, key, text) rows, all or those of ``bits``."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in bounded(whole, 2)):
            found, bounds = sets(b.column(2), k)
            size = np.diff(bounds)
            owner = np.repeat(np.arange(len(size)), size)
            if shared is not None:
                known = in_bits(shared.value, found)
                found, owner = found[known], owner[known]
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(size[owner]), pa.array(found.view(np.int64))], [*names, "size", "shingle"])

    return rows.mapInArrow(run, f"{names[0]} bigint, {names[1]} bigint, size bigint, shingle bigint")


def item_shingles(items: DataFrame, k: int, containment: float) -> DataFrame:
    """(item_id, item_key, size, shingle, need, sketch): every distinct shingle of every item."""
    keyed = items.select(*row_of("item_id", "text", ITEM), F.col("text").cast("string")).dropDuplicates(ITEM)
    own = cut(exploded(keyed, k, ITEM))
    often = own.groupBy("shingle").agg(F.count("*").alias("items"))
    order = Window.partitionBy(*ITEM).orderBy("items", "shingle")
    part = fraction(containment)
    least = F.expr(f"(size * {part.numerator}L + {part.denominator - 1}L) div {part.denominator}L")
    need = F.greatest(F.lit(1).cast("long"), least)
    ranked = own.join(cut_small(often), "shingle").withColumn("need", need).withColumn("rank", F.row_number().over(order))
    return ranked.select(*ITEM, "size", "shingle", "need", (F.col("rank") <= F.col("size") - F.col("need") + 1).alias("sketch"))


class Index:
    """Items in partitions by size: sketch values, and all shingles for the check. Arrays only."""

    def __init__(self, table: pa.Table) -> None:
        ids, keys, size, shingle, need, sketch = (table.column(c).to_numpy() for c in (*ITEM, "size", "shingle", "need", "sketch"))
        shingle = shingle.view(np.uint64)
        order = np.lexsort((shingle, keys, ids))
        ids, keys, size, shingle, need, sketch = (x[order] for x in (ids, keys, size, shingle, need, sketch))
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        first = np.flatnonzero(fresh)
        self.ids, self.keys, self.need = ids[first], keys[first], need[first]
        self.bounds, self.shingles = np.append(first, len(ids)), shingle
        item = np.cumsum(fresh) - 1
        self.parts = []
        part = np.frexp(size)[1]
        for p in np.unique(part):
            mine = (part == p) & sketch
            by = np.argsort(shingle[mine], kind="stable")
            values, start = np.unique(shingle[mine][by], return_index=True)
            seen = np.zeros(1 << 20, bool)
            seen[values & np.uint64((1 << 20) - 1)] = True
            items = item[mine][by]
            self.parts.append((int(self.need[items].min()), values, np.append(start, len(items)), items, seen))

    def set_of(self, i: int) -> np.ndarray:
        return self.shingles[self.bounds[i] : self.bounds[i + 1]]

    def pairs(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Candidates, ascending: row * number of items + item."""
        out = [np.zeros(0, np.int64)]
        size = np.diff(bounds)
        low = found & np.uint64((1 << 20) - 1)
        for least, values, start, items, seen in self.parts:
            at = np.flatnonzero(seen[low])
            place = np.minimum(np.searchsorted(values, found[at]), len(values) - 1)
            hit = values[place] == found[at]
            at, place = at[hit], place[hit]
            row = np.searchsorted(bounds, at, "right") - 1
            fits = size[row] >= least
            row, place = row[fits], place[fits]
            n = start[place + 1] - start[place]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, item = np.repeat(row, n), items[np.repeat(start[place], n) + within]
            out.append((row * len(self.ids) + item)[size[row] >= self.need[item]])
        return np.unique(np.concatenate(out))


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, containment: float = 0.8, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): one row per leaked item and document."""
    found = _found(docs, items, k, containment, broadcast_bytes)
    once = found.groupBy("doc_id", "row_key", *ITEM).agg(F.max("shared").alias("shared"), F.max("item_shingles").alias("item_shingles"))
    blank = lambda c: F.when(F.col(c) != LOW, F.col(c)).alias(c)
    return once.select(blank("doc_id"), blank("item_id"), "shared", "item_shingles", F.round(F.col("shared") / F.col("item_shingles"), 6).alias("containment"))


def _found(docs: DataFrame, items: DataFrame, k: int, containment: float, broadcast_bytes: int) -> DataFrame:
    own = item_shingles(items, k, containment)
    rows = docs.select(*row_of("doc_id", "text", ["doc_id", "row_key"]), F.col("text").cast("string"))
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes:
        return _by_broadcast(rows, own, k)
    return _by_join(rows, cut(own), k)


def _by_broadcast(rows: DataFrame, own: DataFrame, k: int) -> DataFrame:
    index = rows.sparkSession.sparkContext.broadcast(Index(own.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index.value
        for b in (x for whole in batches for x in bounded(whole, 2)):
            found, bounds = sets(b.column(2), k)
            out = []
            for r, i in (divmod(p, len(idx.ids)) for p in idx.pairs(found, bounds).tolist()):
                have, want = found[bounds[r] : bounds[r + 1]], idx.set_of(i)
                at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                if (n := int((have[at] == want).sum())) >= idx.need[i]:
                    out.append((b.column(0)[r].as_py(), b.column(1)[r].as_py(), idx.ids[i], idx.keys[i], n, len(want)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], [c.split()[0] for c in PAIR.split(", ")])

    return rows.mapInArrow(run, PAIR)


def _by_join(rows: DataFrame, own: DataFrame, k: int) -> DataFrame:
    sketch = own.filter("sketch").select(*ITEM, "need", "shingle")
    some = exploded(rows, k, ["doc_id", "row_key"], bit_array(sketch, "shingle"))
    met = some.join(sketch, "shingle").filter(F.col("size") >= F.col("need"))
    pairs = cut(met.select("doc_id", "row_key", *ITEM).distinct())
    read = rows.join(pairs.select("doc_id", "row_key").distinct(), ["doc_id", "row_key"], "left_semi")
    have = exploded(read.dropDuplicates(["doc_id", "row_key"]), k, ["doc_id", "row_key"]).drop("size")
    wanted = pairs.join(own.select(*ITEM, "size", "need", "shingle"), ITEM)
    shared = wanted.join(have, ["doc_id", "row_key", "shingle"], "left_semi").groupBy("doc_id", "row_key", *ITEM, "size", "need").agg(F.count("*").alias("shared"))
    return shared.filter("shared >= need").select("doc_id", "row_key", *ITEM, "shared", F.col("size").alias("item_shingles"))


def drop_leaked(docs: DataFrame, items: DataFrame, k: int = 5, containment: float = 0.8, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    own, at, names = sealed(docs)
    bad = cut(_found(docs, items, k, containment, broadcast_bytes).select("doc_id", "row_key").distinct())
    own = own.select("*", *row_of(at("doc_id"), at("text"), ["doc_id", "row_key"]))
    return own.join(bad, ["doc_id", "row_key"], "left_anti").drop("doc_id", "row_key").toDF(*names)
