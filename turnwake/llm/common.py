"""What the operators of this subpackage share: lineage cuts and byte-level word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; make one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="turnwake-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Narrow rows in a task of an iterative step.
SMALL = 50_000


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` for narrow rows: a table written in the shared checkpoint folder and read back.

    A checkpoint hands on the planner's estimate of a plan's size, which every join multiplies; in
    a loop its digits double at each step. A table has its real size, so joins with it are planned by
    that, and its files fill as many tasks as they need.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """``df``, rows straight from an aggregate, in an eighth of the shuffle's tasks, four for each core at least.

    For a cut: each of its files costs some processes on file systems that set permissions by a command, and
    such a process counts with the memory of the executor that starts it until it runs that command.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def cut_by(df: DataFrame, column: str) -> DataFrame:
    """``cut`` for rows that are read again by the values of a column: a table in the shared checkpoint folder, a folder a value."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what is freed, but still held by the allocators, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow in a worker that begins and ends without freed memory.

    Workers live on from task to task, beside those of other stages, and an executor's
    memory holds them all.
    """

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return then


def sealed(docs: DataFrame):
    """(docs with columns c0, c1, ..., a function from an old name to its column, the old names).

    Columns of the input then can't clash with an operator's own.
    """
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), lambda name: F.col(f"c{names.index(name)}"), names


LOW = -(1 << 63)  # stands for a null id in joins


def row_of(doc_id: str | Column, text: str | Column, names: list[str]) -> list[Column]:
    """What tells a row in joins: its id, never null, and a hash of (id, text)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return [F.coalesce(doc_id.cast("long"), F.lit(LOW)).alias(names[0]), F.xxhash64(doc_id, text).alias(names[1])]


# ---------------------------------------------------------------- bit arrays over hashes

BITS = 25  # of a hash, in a bit array: 4 MB, whatever the input


def bit_of(hash_: str) -> Column:
    """The number of a hash's bit."""
    return F.shiftrightunsigned(hash_, 64 - BITS)


def bit_words(rows: DataFrame, hash_: str) -> DataFrame:
    """(at, bits): the words of a bit array over a column of 64-bit hashes, 2**(BITS - 6) rows at most."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(hash_).bitwiseAND(63).cast("int"))
    return rows.select(F.shiftright(bit_of(hash_), 6).alias("at"), one.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))


def bit_array(rows: DataFrame, hash_: str) -> np.ndarray:
    known = bit_words(rows, hash_).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[known.column("at").to_numpy()] = known.column("bits").to_numpy()
    return out


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    top = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits.view(np.uint64)[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)


# ---------------------------------------------------------------- bytes of an Arrow column


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column, row offsets into them); null counts as empty, nothing is copied."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
SLICE = (1 << 20) - 1  # bytes of whole rows that are hashed at once; their powers take 16 MB


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; those of a slice are kept."""
    if _POWERS and n <= len(_POWERS[0]):
        return _POWERS[0], _POWERS[1]
    size = max(SLICE + 1, n)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    if size == SLICE + 1:
        _POWERS[:] = [up, down]
    return up, down


def byte_table(separators: bytes, fold: bool = True) -> np.ndarray:
    """256 codes: 0 for separators, otherwise a value of the byte after lower-casing A-Z."""
    table = mix64(np.arange(1, 257, dtype=np.uint64))
    if fold:
        table[65:91] = table[97:123]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: The separators of ``[^\x20\x09-\x0D]+``.
WHITE = bytes([32, *range(9, 14)])
#: All ASCII characters but letters and digits.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, its first byte, the byte after it) over the rows of a byte buffer.

    A word is a run of bytes with a non-zero code inside one row; the hash is a polynomial
    in the codes, so it does not depend on where the word stands. Work goes on in slices of
    whole rows of a MB, so that very long texts need memory in proportion to themselves only.
    """
    hashes, rows, starts, ends = [], [], [], []
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi > lo:
            code = table[raw[lo:hi]]
            inside = np.zeros(hi - lo + 2, bool)
            inside[1:-1] = code != 0
            edge = np.zeros(hi - lo + 1, bool)  # rows that meet without a separator
            cuts = offsets[first + 1 : last] - lo
            edge[cuts] = True
            before, now = inside[:-1], inside[1:]
            begin = np.flatnonzero(now & (~before | edge))
            end = np.flatnonzero(before & (~now | edge))
            up, down = powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(code * up[: hi - lo], out=total[1:])
            hashes.append(mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
            rows.append(np.searchsorted(offsets[first : last + 1] - lo, begin, "right") - 1 + first)
            starts.append(begin + lo)
            ends.append(end + lo)
        first = last
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in (hashes, rows, starts, ends))


_STEP = [np.uint64(0xD6E8FEB86659FD93 * (2 * i + 1) % 2**64 | 1) for i in range(64)]


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int, whole_if_shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row bounds): the distinct k-word shingles of each row, ascending within the row.

    A row with fewer than k words has the whole sequence as its one shingle if
    ``whole_if_shorter``, else none. No words: none.
    """
    count = np.bincount(rows, minlength=n_rows)[:n_rows] if len(rows) else np.zeros(n_rows, np.int64)
    found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        same = rows[: len(rows) - k + 1] == rows[k - 1 :]
        h = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            h += words[i : len(words) - k + 1 + i] * _STEP[i]
        found, owner = mix64(h[same]), rows[: len(rows) - k + 1][same]
    if whole_if_shorter and (short := np.flatnonzero((count > 0) & (count < k))).size:
        first = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(short), np.uint64)
        for j, r in enumerate(short):
            part = words[first[r] : first[r + 1]]
            extra[j] = np.bitwise_xor.reduce(part * np.array(_STEP[32 : 32 + len(part)], np.uint64)) + np.uint64(len(part))
        found, owner = np.concatenate([found, mix64(extra)]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[fresh], owner[fresh]
    bounds = np.searchsorted(owner, np.arange(n_rows + 1))
    return found, bounds


def bounded(batch: pa.RecordBatch, column: int, limit: int = 4 << 20):
    """The batch in slices of at most ``limit`` bytes of a string column, or one longer row."""
    _, off = utf8_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
