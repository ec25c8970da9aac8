"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content, into as many as their bytes fill twice
over, so that a bucket should fill half a table. A task puts its bucket into an
open-addressing table that compares complete contents, of a fixed size in bytes. A record
whose content is not in a full table goes to the spill files (checkpoint blocks in the shared
folder, never an executor's own disk), which the next round deals out again by other hash bits,
again by their bytes, until every bucket fits. So only buckets that overflow come back, and the
rounds do not grow with the input. What is in a table is complete: the table only ever refuses
contents, never single records of one.

The same table runs ahead of the shuffle over each input partition, so a content that fills
a third of the table of documents crosses the network once per partition.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z; of equal texts the row with the largest doc_id stays, a null doc_id being
below every other; of rows repeated whole (same doc_id and text) exactly one stays; an
empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_by, sealed

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PARTIAL = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("top", pa.int64()), ("n", pa.int64()), ("n_top", pa.int64()), ("done", pa.bool_())])
PARTIAL_DDL = "digest binary, content binary, top bigint, n bigint, n_top bigint, done boolean"


ENTRY = 200  # bytes of an entry beside its content
FAN_OUT = 4096  # buckets of one shuffle: 100 GB of new contents to a level


class ContentTable:
    """Open addressing with linear probing; an entry is a content with its largest id and counts."""

    def __init__(self, limit_bytes: int) -> None:
        self.limit, self.used = limit_bytes, 0
        self.slots: list[int] = [-1] * 1024
        self.keys: list[int] = []
        self.rows: list[list] = []  # [digest, content, top, n, n_top]

    def _free(self, key: int) -> int:
        at, mask = key & (len(self.slots) - 1), len(self.slots) - 1
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, top: int | None, n: int, n_top: int) -> bool:
        """Merge the record into its content's entry; False if the content is new and the table full."""
        key, mask = int.from_bytes(digest[:8], "little"), len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            row = self.rows[entry]
            if self.keys[entry] == key and row[1] == content:
                row[3] += n
                if top == row[2]:
                    row[4] += n_top
                elif row[2] is None or (top is not None and top > row[2]):
                    row[2], row[4] = top, n_top
                return True
            at = (at + 1) & mask
        if self.rows and self.used + len(content) + ENTRY > self.limit:
            return False
        self.used += len(content) + ENTRY
        self.slots[at] = len(self.rows)
        self.keys.append(key)
        self.rows.append([digest, content, top, n, n_top])
        if 2 * len(self.rows) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for i, k in enumerate(self.keys):
                self.slots[self._free(k)] = i
        return True


def _rows(rows: list, done: bool, keep_content: bool) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    part, size = [], 0
    for r in rows:
        part.append((r[0], r[1] if keep_content else None, *r[2:], done))
        size += len(r[1]) if keep_content else 64
        if size > 8 << 20 or len(part) >= 10_000:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _batch(part: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), PARTIAL, strict=True)], schema=PARTIAL)


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(FOLD)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [hashlib.sha256(normalise(t.as_py())).digest() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, digest binary")


def classes(docs: DataFrame, table_bytes: int = 48 << 20, fan_out: int = FAN_OUT) -> DataFrame:
    """(digest, keep_id, group_size, n_top): one row per distinct content.

    ``table_bytes`` bounds each table, in the tasks before and after the shuffle alike; ``fan_out`` the
    buckets of one shuffle.
    """

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(table_bytes)
        for b in batches:
            refused = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = normalise(text.as_py())
                digest = hashlib.sha256(content).digest()
                if not table.add(digest, content, doc_id, 1, 1):
                    refused.append((digest, content, doc_id, 1, 1))
            yield from _rows(refused, False, True)
        yield from _rows(table.rows, False, True)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(table_bytes)
        for b in batches:
            refused = [r for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True) if not table.add(*r)]
            yield from _rows(refused, False, True)
        seen: dict[bytes, int] = {}
        for r in table.rows:
            if seen.setdefault(r[0], 0):
                raise ValueError("two contents share a SHA-256 digest")
            seen[r[0]] = 1
        yield from _rows(table.rows, True, False)

    def rounds(left: DataFrame, volume: int, level: int) -> Iterator[DataFrame]:
        """Fitting entries of ``left``; what a bucket's table refuses is dealt out again."""
        while True:
            buckets = max(left.sparkSession.sparkContext.defaultParallelism, -(-2 * volume // table_bytes))
            if buckets > fan_out > 1:
                yield from deeper(left, -(-buckets // fan_out), level)
                return
            dealt = left.repartition(buckets, F.xxhash64("digest", F.lit(level)))
            out = cut(dealt.mapInArrow(after, PARTIAL_DDL))
            yield out.filter("done").select("digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), "n_top")
            left, level = out.filter("NOT done"), level + 1
            volume = left.agg(F.sum(F.octet_length("content") + ENTRY)).first()[0]
            if volume is None:
                return

    def deeper(left: DataFrame, groups: int, level: int) -> Iterator[DataFrame]:
        """The spill files of a level: records by group, each group then dealt into buckets of its own."""
        groups = min(groups, fan_out)
        own = F.pmod(F.xxhash64("digest", F.lit(level)), F.lit(groups)).cast("int")
        spilled = cut_by(left.withColumn("group", own).repartition(groups, "group"), "group")
        sizes = spilled.groupBy("group").agg(F.sum(F.octet_length("content") + ENTRY).alias("bytes")).collect()  # fan_out rows at most
        for g in sizes:
            yield from rounds(spilled.filter(F.col("group") == g["group"]).drop("group"), g["bytes"], level + 1)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    volume = docs.agg(F.sum(size + ENTRY)).first()[0] or 0
    found = list(rounds(texts.mapInArrow(before, PARTIAL_DDL), volume, 0))
    return reduce(DataFrame.unionByName, found)


def exact_duplicates(docs: DataFrame, table_bytes: int = 48 << 20, fan_out: int = FAN_OUT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document.

    Equal rows of the output come from rows repeated whole; they are counted before the
    join, so a row repeated any number of times is one row there.
    """
    ids = digests(docs).groupBy("doc_id", "digest").agg(F.count("*").alias("times"))
    out = ids.join(classes(docs, table_bytes, fan_out), "digest").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, table_bytes: int = 48 << 20) -> DataFrame:
    """The documents that stay, with all their columns."""
    own, at, names = sealed(docs)
    keep = classes(docs, table_bytes).select("digest", F.col("keep_id").alias("keep"))
    folded = F.translate(F.coalesce(at("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = own.withColumn("id", at("doc_id").cast("long")).withColumn("hex", F.sha2(folded, 256))
    best = keep.select(F.lower(F.hex("digest")).alias("h"), "keep")
    held = own.join(best, (F.col("hex") == F.col("h")) & F.col("id").eqNullSafe(F.col("keep")), "left_semi")
    one = Window.partitionBy("hex", "id").orderBy(F.lit(1))
    return held.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("id", "hex", "n").toDF(*names)
