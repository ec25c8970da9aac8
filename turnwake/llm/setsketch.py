"""MinHash near-duplicates by SetSketch registers.

Each element of a set sends a Poisson stream of points, of rate ``A`` in each of M registers, and a register
keeps the least point it got. Of such a minimum t the register stores K = floor(1 - log_B(t)), held between
0 and Q + 1: exponentially spaced, truncated minima. The sketch of a union is the larger register of both at
each place, and two registers are equal with about the sets' Jaccard similarity.

1. A pass over the texts makes set size, a 128-bit signature of the set, M registers and BANDS tokens (a
   hash of ROWS registers each). Sets with equal signature are one node from here on.
2. Nodes meet on tokens that two nodes have. All tokens first pair their holders with one pivot, the same one
   for most tokens of a group, and links found are contracted to components; then only pairs between
   different components are looked at: by a join on tokens with few holders, and block against block, inside
   tasks, on those with more, where a node brings 256 bytes that bound the overlap. Holders of a token that very
   many have meet instead on the rare end of their sets, where every two similar sets share a shingle.
3. For a pair the similarity J is estimated jointly from sizes and registers by maximum likelihood:
   D+ registers larger in the first, D- in the second, D0 equal, with probabilities p(u - vJ), p(v - uJ) and
   the rest, p(x) = -log_B(1 - x (B - 1) / B), u and v the sizes' shares. A pair goes on unless the likelihood
   of the required similarity is below exp(-SURE) of the best.
4. What goes on is verified on the full sets, once.

A pair of the required 80 % shares a token with odds of all but 3e-6, and more similar pairs miss far less; the
estimate passes over one such pair in a million. Nothing else is ever left out, however many hold a token.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer words than a shingle
is one shingle; null text, or one without words, has an empty set and is linked with nothing; a
component's id is its smallest doc_id that is not null; rows repeated whole are in one component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOW, WHITE, bit_array, bounded, byte_table, cut, cut_small, in_bits, mix64, shingles, utf8_buffer, word_hashes
from .components import components
from .ngram_join import met_in_blocks, verified

_TABLE = byte_table(WHITE)
M = 256  # registers
ROWS, BANDS = 6, 42
A, B, Q = 20.0, 1.001, (1 << 16) - 2
SURE = 14.0
HOT = 16  # tokens with more holders are settled block against block
DEALT = 4096  # holders of tokens with more meet on the rare ends of their sets instead
POINTS = 250_000  # held at once
SLICE = 1 << 20  # bytes of texts, or one longer text
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sketches


def _minima(hashes: np.ndarray, owner: np.ndarray, n: int, each: int) -> np.ndarray:
    """(n, M) least points of n sets; ``each`` points of an element at first, more while they can still count."""
    least, at = np.full(n * M, np.inf), np.zeros(len(hashes))
    step = 0
    while len(hashes):
        j = np.arange(step, step + each, dtype=np.uint64) * _GOLD
        bits = mix64(hashes[:, None] + j)
        points = np.cumsum(-np.log1p(-((bits >> np.uint64(11)) * 2.0**-53)), axis=1) / (A * M) + at[:, None]
        register = owner[:, None] * M + (bits & np.uint64(M - 1)).astype(np.int64)
        np.minimum.at(least, register.ravel(), points.ravel())
        at = points[:, -1]
        on = at < least.reshape(n, M).max(1)[owner]
        hashes, owner, at = hashes[on], owner[on], at[on]
        step, each = step + each, max(1, each // 4)
    return least.reshape(n, M)


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, M) registers; set i has the distinct ``hashes[bounds[i]:bounds[i + 1]]``. Empty sets have zeros."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), M), np.uint16)
    scale = np.frexp(sizes.astype(float))[1]  # sets of alike sizes need alike many points an element
    for s in np.unique(scale[sizes > 0]):
        each = max(1, (8 * M) >> (int(s) - 1))
        rows = np.flatnonzero(scale == s)
        room = np.cumsum(sizes[rows]) * each // POINTS
        for part in np.split(rows, np.flatnonzero(np.diff(room)) + 1):
            own = np.repeat(np.arange(len(part)), sizes[part])
            place = np.arange(len(own)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part]) + np.repeat(bounds[part], sizes[part])
            least = _minima(hashes[place], own, len(part), each)
            out[part] = np.clip(np.floor(1 - np.log(least) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def band_tokens(registers: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of ROWS registers each."""
    parts = registers[:, : ROWS * BANDS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(registers), BANDS)).copy()
    for i in range(ROWS):
        out = mix64(out + (parts[:, :, i] + np.uint64(1)) * _GOLD)
    return out.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def likelihoods(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(similarity of greatest likelihood, how far the log-likelihood of ``least`` is below it) of pairs of sketches.

    ``least`` counts as no more than the sizes allow.
    """
    u = nx / (nx + ny)
    v = 1 - u
    more, fewer = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - fewer
    top = np.minimum(u / v, v / u)
    tiny = 1e-12

    def log_of(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(_p(u - v * j), tiny), np.maximum(_p(v - u * j), tiny)
        return more * np.log(a) + fewer * np.log(b) + same * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros(len(u)), top.copy()
    for _ in range(40):  # the function has one peak
        third = (hi - lo) / 3
        right = log_of(lo + third) < log_of(hi - third)
        lo, hi = np.where(right, lo + third, lo), np.where(right, hi, hi - third)
    best = (lo + hi) / 2
    return best, log_of(best) - log_of(np.minimum(least, top))


# ---------------------------------------------------------------- nodes

SKETCHED = "uid bigint, doc_id bigint, row_key bigint, n_shingles bigint, sig1 bigint, sig2 bigint, tokens array<bigint>, registers binary"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("row_key"))


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """A row per document: size, signature, tokens and registers of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in (x for whole in batches for x in bounded(whole, 1, SLICE)):
            raw, off = utf8_buffer(b.column(1))
            words, rows, _, _ = word_hashes(raw, off, _TABLE)
            found, bounds = shingles(words, rows, b.num_rows, k, True)
            zero = np.zeros(1, np.uint64)
            sums = [np.concatenate([zero, np.cumsum(x, dtype=np.uint64)])[bounds] for x in (found, mix64(found ^ _GOLD))]
            sig = [pa.array(np.diff(x).view(np.int64)) for x in sums]
            registers = sketch(found, bounds)
            binary = pa.array([r.tobytes() for r in registers], pa.binary())
            ids, uid = pa.array(np.arange(uid, uid + b.num_rows)), uid + b.num_rows
            cols = [ids, b.column(0), b.column(2), pa.array(np.diff(bounds)), *sig, _lists(band_tokens(registers)), binary]
            out = pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "row_key", "n_shingles", "sig1", "sig2", "tokens", "registers"])
            for lo in range(0, out.num_rows, 2000):
                yield out.slice(lo, 2000)

    return _texts(docs).mapInArrow(run, SKETCHED)


def with_tokens(nodes: DataFrame) -> DataFrame:
    """(token, uid) of tokens that at least two nodes have."""
    seen = nodes.select("uid", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    shared = cut_small(seen.filter("lo < hi").select("token"))
    bits = nodes.sparkSession.sparkContext.broadcast(bit_array(shared, "token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token = b.column(1).flatten().to_numpy()
            hit = in_bits(bits.value, token)
            uid = np.repeat(b.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(token[hit]), pa.array(uid[hit])], ["token", "uid"])

    # The array keeps most other tokens off the network; the join decides.
    return nodes.select("uid", "tokens").mapInArrow(run, "token bigint, uid bigint").join(shared, "token")


def with_members(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(uid, members, parts) of the documents named in ``wanted`` (uid, id, row_key): their sets, and the sets dealt into 256 parts."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_array(wanted, "row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()  # a row repeated whole is sent once by each task
        for b in (x for whole in batches for x in bounded(whole, 1, SLICE)):
            ids, keys = b.column(0).to_pylist(), b.column(2).to_numpy()
            take = []
            for i in np.flatnonzero(in_bits(bits.value, keys)).tolist():
                if (mark := (ids[i], int(keys[i]))) not in done:
                    done.add(mark)
                    take.append(i)
            if not take:
                continue
            b = b.take(pa.array(take))
            raw, off = utf8_buffer(b.column(1))
            words, rows, _, _ = word_hashes(raw, off, _TABLE)
            found, bounds = shingles(words, rows, b.num_rows, k, True)
            sets = [found[bounds[i] : bounds[i + 1]] for i in range(b.num_rows)]
            parts = [np.minimum(255, np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)).astype(np.uint8).tobytes() for s in sets]
            cols = [b.column(0), b.column(2), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "members", "parts"])

    made = _texts(docs).mapInArrow(run, "doc_id bigint, row_key bigint, members binary, parts binary")
    made = made.select(F.coalesce("doc_id", F.lit(LOW)).alias("id"), "row_key", "members", "parts").join(wanted, ["id", "row_key"])
    return made.groupBy("uid").agg(F.first("members").alias("members"), F.first("parts").alias("parts"))


# ---------------------------------------------------------------- pairs


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose sizes and registers speak for the required similarity."""
    one = nodes.select(F.col("uid").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    two = nodes.select(F.col("uid").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(i).to_numpy().astype(float) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (4, 5))
            best, below = likelihoods(x, y, na, nb, percent / 100)
            ok = pa.array((best >= percent / 100) | (below <= SURE))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(ok)

    sized = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a bigint, b bigint")


def parted(rows: DataFrame) -> DataFrame:
    """``rows`` (token, uid, comp) of tokens in several components, with holders n and whether a row is outside the largest of them."""
    by = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    top = by.groupBy("token").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1")
    top = cut_small(top.select("token", "n", F.col("m.comp").alias("main")))
    return cut_small(rows.join(top, "token").withColumn("probe", F.col("comp") != F.col("main")).select("token", "uid", "comp", "n", "probe"))


def met(rows: DataFrame) -> DataFrame:
    """Distinct pairs of ``rows`` that share a token and are in different components."""
    x = rows.filter("probe").select("token", F.col("uid").alias("x"), F.col("comp").alias("cx"))
    y = rows.select("token", F.col("uid").alias("y"), F.col("comp").alias("cy"))
    return x.join(y, "token").filter("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def rare_ends(large: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(token, uid): shingles of the nodes in ``large`` on which every two that are similar meet.

    Shingles stand by how many of these nodes have them, then by hash. Of two similar sets, the first
    n - needed + 1 shingles of each have one in common, so no pair is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in bounded(whole, 2, SLICE)):
            n = b.column(1).to_numpy()
            found = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            cols = [pa.array(found), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n))]
            yield pa.RecordBatch.from_arrays(cols, ["token", "uid", "n"])

    held = large.select("uid").distinct().join(nodes.select("uid", "n_shingles", "members"), "uid")
    own = held.select("uid", "n_shingles", "members").mapInArrow(run, "token bigint, uid bigint, n bigint")
    often = cut_small(own.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1"))
    by = Window.partitionBy("uid")
    # Shingles of one holder alone come first.
    place = F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("often", "token")) - 1
    placed = own.join(often, "token").select("token", "uid", "n", place.alias("place"))
    return placed.filter(f"place <= n - ({percent} * n + 99) div 100").select("token", "uid")


def node_components(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame | None:
    """(node, comp) over nodes (uid, n_shingles, registers, members, parts) with ``rows`` (token, uid).

    Nodes that are their component's least are left out; None where no row is.
    """
    found: list[DataFrame] = []
    labels: DataFrame | None = None

    def open_rows() -> DataFrame:
        own = rows.withColumn("comp", F.col("uid"))
        if labels is not None:
            own = rows.join(labels, rows["uid"] == labels["node"], "left").select("token", "uid", F.coalesce("comp", "uid").alias("comp"))
        return parted(own)

    def settle(pairs: DataFrame) -> None:
        nonlocal labels
        new = cut_small(verified(cut_small(likely(cut_small(pairs), nodes, percent)), nodes, percent))
        if new.isEmpty():
            return
        found.append(new)
        links = found[0]
        for f in found[1:]:
            links = links.unionByName(f)
        labels = components(links)

    live = open_rows()
    if live.isEmpty():
        return None
    # The same order for all tokens, so that a node meets few different pivots.
    pivot = live.groupBy("token").agg(F.min_by(F.struct("uid", "comp"), F.struct(F.xxhash64("uid"), F.col("uid"))).alias("p"))
    near = live.select("token", "uid", "comp").join(cut_small(pivot.select("token", F.col("p.uid").alias("x"), F.col("p.comp").alias("cx"))), "token").filter("cx <> comp")
    settle(near.select(F.least("x", "uid").alias("a"), F.greatest("x", "uid").alias("b")).distinct())
    live = open_rows()
    large = live.filter(F.col("n") > DEALT)
    if not large.isEmpty():
        rows = cut_small(live.filter(F.col("n") <= DEALT).select("token", "uid").unionByName(rare_ends(large, nodes, percent)))
    # Nearest partners first: what they join need not be looked at again, pair by pair.
    for nearest in (True, False):
        live = open_rows()
        hot = live.filter(F.col("n") > HOT)
        # A token of few has all its pairs looked at in the first turn.
        pairs = [met(live.filter(F.col("n") <= HOT))] if nearest else []
        if not hot.isEmpty():
            sized = hot.select("token", "uid", "comp").join(nodes.select("uid", "n_shingles"), "uid")
            pairs.append(met_in_blocks(cut_small(sized), nodes, percent, nearest))
        if pairs:
            settle(reduce(DataFrame.unionByName, pairs).distinct())
        if hot.isEmpty():
            break
    return labels


def linked_documents(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, first): one row per document; first marks one row of each component."""
    rows = cut_small(sketched(docs, k))
    slim = rows.select("uid", "doc_id", "row_key", "n_shingles", "sig1", "sig2")
    reps = cut_small(slim.filter("n_shingles > 0").groupBy("n_shingles", "sig1", "sig2").agg(F.min("uid").alias("rep")))
    single = rows.filter("n_shingles > 0").join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi")
    met_rows = cut_small(with_tokens(cut_small(single.select("uid", "tokens"))))
    some = met_rows.select("uid").distinct()
    chosen = cut_small(rows.join(some, "uid", "left_semi").select("uid", F.coalesce("doc_id", F.lit(LOW)).alias("id"), "row_key", "n_shingles", "registers"))
    nodes = cut(chosen.select("uid", "n_shingles", "registers").join(with_members(docs, chosen.select("uid", "id", "row_key"), k), "uid"))
    labels = node_components(met_rows, nodes, percent)
    own = slim.join(reps, ["n_shingles", "sig1", "sig2"], "left").select("uid", "doc_id", "row_key", "n_shingles", F.coalesce("rep", "uid").alias("rep"))
    comp = F.col("rep")
    if labels is not None:
        own, comp = own.join(labels, own["rep"] == labels["node"], "left"), F.coalesce("comp", "rep")
    own = cut_small(own.select("uid", "doc_id", "row_key", "n_shingles", comp.alias("comp")))
    least = own.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "uid")).alias("m"))
    out = own.join(cut_small(least.select("comp", F.col("m.doc_id").alias("component_id"), F.col("m.uid").alias("kept"))), "comp")
    return out.select("doc_id", "row_key", "n_shingles", "component_id", (F.col("uid") == F.col("kept")).alias("first"))
