"""N-gram Jaccard join: components of documents whose shingle sets are similar.

Documents with 100 * |A & B| >= percent * |A | B| are linked. The order of shingles is
rare-first: by how many documents of the whole corpus hold a shingle, then by its hash. Of
two similar sets, the first |A| - needed + 1 shingles of each (the prefix) meet in at least
one shingle, and shingles held by one document only cannot meet at all, so most documents
leave here: their prefix is their own.

1. Texts are written once, compressed, in blocks. Each block sends its sorted shingle
   numbers by range; a range counts them and answers each block with one byte a number. That
   is the corpus-wide order at a few bytes a shingle, and no task holds more than one range
   or block.
2. Equal sets are one node from here on, under a 128-bit signature.
3. Nodes meet on prefix shingles. For a shingle held by many nodes, each node is first paired
   with the most central one, and verified pairs are contracted. Then every pair left between
   different components is settled: by a join on shingles with few holders, and block against
   block, inside tasks, on those with many. Blocks are dealt by size and compare 256 bytes a node;
   sets travel for the pairs that pass. So no group's pairs are ever written out, and none between
   components is left out; pairs inside a known component are not verified, and there is no list
   or number of links.
4. Pairs pass a length filter, a positional filter (the places of a shared prefix shingle bound
   the overlap) and a suffix filter (the sets dealt by hash into 256 parts: differences of
   the parts' sizes bound the symmetric difference); what is left is verified once, by
   counting the common hashes of both sets.

Shingles are 64-bit hashes; two different shingles of a pair share one with odds of 1e-13.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer words
than a shingle is one shingle; null text, or one without words, has an empty set and is
linked with nothing; a component's id is its smallest doc_id that is not null; rows repeated
whole are in one component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOW, WHITE, byte_table, cut, cut_small, give_back, lean, row_of, sealed, shingles, utf8_buffer, word_hashes
from .components import components

_TABLE = byte_table(WHITE)
BLOCK = 4 << 20  # bytes of text in a block, or one longer text
HOT = 64  # shingles with more holders are settled block against block
CHUNK = 512  # nodes on each side of such a block
PARTNERS = 512  # partners to which the set of a node is sent at once
U64 = (1 << 64) - 1


def need(size: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of a set of ``size`` with a similar one."""
    return (percent * size + 99) // 100


def overlap(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least common elements of two similar sets of together ``total`` elements."""
    return (percent * total + 99 + percent) // (100 + percent)


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed byte planes of their gaps."""
    gaps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype("<u8")
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8).T.copy().tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(planes.T.copy().reshape(-1).view("<u8"), dtype=np.uint64)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, keys, sizes, texts): whole texts, about BLOCK bytes together; a key is a hash of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, keys, texts, held = TaskContext.get().partitionId() << 24, [], [], [], 0

        def out() -> pa.RecordBatch:
            cols = [pa.array([at]), pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())], ["block", "ids", "keys", "sizes", "texts"])

        for b in batches:
            for i, t, key in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = (t.as_py() or "").encode()
                if texts and (held + len(text) > BLOCK or len(texts) >= 1 << 16):
                    yield out()
                    at, ids, keys, texts, held = at + 1, [], [], [], 0
                ids.append(i)
                keys.append(key)
                texts.append(text)
                held += len(text)
        if texts:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("key"))
    return rows.mapInArrow(lean(run), "block bigint, ids array<bigint>, keys array<bigint>, sizes array<int>, texts binary")


def block_sets(sizes: np.ndarray, texts: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    raw = np.frombuffer(pa.decompress(texts, int(off[-1]), "zstd", asbytes=True), np.uint8) if off[-1] else np.zeros(0, np.uint8)
    words, rows, _, _ = word_hashes(raw, off, _TABLE)
    return shingles(words, rows, len(sizes), k, True)


def frequency_class(n: np.ndarray) -> np.ndarray:
    """Counts as one byte: themselves below 128, then in steps of an eighth of a doubling."""
    return np.where(n < 128, n, 128 + np.minimum(127, np.floor(8 * np.log2(np.maximum(n, 128) / 128)))).astype(np.uint8)


def frequencies(parts: DataFrame, k: int, bits: int, range_bits: int) -> DataFrame:
    """(block, answers: array<struct<range, n, classes>>): how frequent a block's shingle numbers are."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                found, _ = block_sets(np.array(b.column(1)[j].as_py(), np.int64), b.column(2)[j].as_py(), k)
                if not len(found):
                    continue
                number, count = np.unique(found >> np.uint64(64 - bits), return_counts=True)
                owner = (number >> np.uint64(bits - range_bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                out = [(int(owner[lo]), len(number[lo:hi]), packed(number[lo:hi]), pa.compress(count[lo:hi].astype("<u4").tobytes(), "zstd", asbytes=True)) for lo, hi in zip(first, [*first[1:], len(number)], strict=True)]
                r, n, v, c = zip(*out, strict=True)
                cols = [pa.array(r, pa.int32()), pa.array([b.column(0)[j].as_py()] * len(out), pa.int64()), pa.array(n, pa.int32()), pa.array(v, pa.binary()), pa.array(c, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["range", "block", "n", "numbers", "counts"])

    def count(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        numbers = np.concatenate([unpacked(v.as_py(), int(m)) for v, m in zip(table.column("numbers"), n, strict=True)])
        counts = np.concatenate([np.frombuffer(pa.decompress(c.as_py(), 4 * int(m), "zstd", asbytes=True), "<u4") for c, m in zip(table.column("counts"), n, strict=True)])
        order = np.argsort(numbers, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(numbers[order]) != 0]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        classes = np.empty(len(numbers), np.uint8)
        classes[order] = np.repeat(frequency_class(total), np.diff([*first, len(numbers)]))
        cuts = np.concatenate([[0], np.cumsum(n)])
        answer = [pa.compress(classes[lo:hi].tobytes(), "zstd", asbytes=True) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        del numbers, counts, order, first, total, classes
        give_back()
        return pa.table({"block": table.column("block"), "range": table.column("range"), "n": table.column("n"), "classes": pa.array(answer, pa.binary())})

    asked = parts.select("block", "sizes", "texts").mapInArrow(lean(ask), "range int, block bigint, n int, numbers binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(count, "block bigint, range int, n int, classes binary")
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "n", "classes"))).alias("answers"))


NODE = (
    "uid bigint, doc_id bigint, row_key bigint, n_shingles bigint, sig1 bigint, sig2 bigint, rare int, "
    "prefix array<struct<token:bigint,pos:int>>, members binary, parts binary"
)


def with_prefixes(parts: DataFrame, answers: DataFrame, k: int, bits: int, percent: int) -> DataFrame:
    """A row per document: size and signature of its set and, where the prefix is not its own, prefix and set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                block, ids, sizes = b.column(0)[j].as_py(), b.column(1)[j].as_py(), np.array(b.column(2)[j].as_py(), np.int64)
                found, bounds = block_sets(sizes, b.column(3)[j].as_py(), k)
                got = [np.frombuffer(pa.decompress(a["classes"], a["n"], "zstd", asbytes=True), np.uint8) for a in b.column(4)[j].as_py() or []]
                _, inverse = np.unique(found >> np.uint64(64 - bits), return_inverse=True)
                often = (np.concatenate(got) if got else np.zeros(0, np.uint8))[inverse]
                n, owner = np.diff(bounds), np.repeat(np.arange(len(ids)), np.diff(bounds))
                order = np.lexsort((found, often, owner))
                place = np.arange(len(found)) - bounds[owner]
                kept = (place < (n - need(n, percent) + 1)[owner]) & (often[order] > 1)
                single = np.bincount(owner, weights=often == 1, minlength=len(ids)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(ids)))]) if len(found) else np.zeros(len(ids) + 1, np.int64)
                shared = pa.StructArray.from_arrays([pa.array(found[order[kept]].view(np.int64)), pa.array(place[kept].astype(np.int32))], ["token", "pos"])
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shared)
                del order, place, often, owner, kept
                zero = np.zeros(1, np.uint64)
                sig1 = np.concatenate([zero, np.cumsum(found, dtype=np.uint64)])
                sig2 = np.concatenate([zero, np.cumsum((found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64)])
                members, deal = [], []
                for i in range(len(ids)):
                    lo, hi = ends[i], ends[i + 1]
                    own = found[bounds[i] : bounds[i + 1]]
                    members.append(own.tobytes() if hi > lo else None)
                    deal.append(np.minimum(255, np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256)).astype(np.uint8).tobytes() if hi > lo else None)
                uid = pa.array(np.arange(len(ids)) + (block << 16))
                cols = [uid, pa.array(ids, pa.int64()), pa.array(b.column(5)[j].as_py(), pa.int64()), pa.array(n), pa.array((sig1[bounds[1:]] - sig1[bounds[:-1]]).view(np.int64)), pa.array((sig2[bounds[1:]] - sig2[bounds[:-1]]).view(np.int64)), pa.array(single.astype(np.int32)), prefix, pa.array(members, pa.binary()), pa.array(deal, pa.binary())]
                out = pa.RecordBatch.from_arrays(cols, [f.split(" ")[0] for f in ("uid", "doc_id", "row_key", "n_shingles", "sig1", "sig2", "rare", "prefix", "members", "parts")])
                for lo in range(0, out.num_rows, 2000):
                    yield out.slice(lo, 2000)

    return parts.join(answers, "block", "left").select("block", "ids", "sizes", "texts", "answers", "keys").mapInArrow(lean(run), NODE)


# ---------------------------------------------------------------- pairs


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs that pass the length and suffix filters."""
    one = nodes.select(F.col("uid").alias("a"), F.col("n_shingles").alias("na"), F.col("parts").alias("pa"))
    two = nodes.select(F.col("uid").alias("b"), F.col("n_shingles").alias("nb"), F.col("parts").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for i in (4, 5))
            apart = np.abs(x - y).sum(1)
            ok = pa.array(apart <= na + nb - 2 * overlap(na + nb, percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(ok)

    sized = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(lean(run), "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that are links. The set of ``a`` is sent once to every PARTNERS of its partners."""
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    count = cut_small(count.select("a", F.ceil(F.col("n") / PARTNERS).cast("int").alias("salts")))
    sets = nodes.select("uid", "members")
    left = count.join(sets, F.col("a") == F.col("uid")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "members")
    right = pairs.join(count, "a").join(sets, F.col("b") == F.col("uid")).select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), "b", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = None, None
        for b in batches:
            out = []
            for a, other, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                members = np.frombuffer(data.as_py(), np.uint64)
                if other is None:
                    own, key = members, a
                    continue
                assert key == a, "a pair came without its first set"
                small, large = (own, members) if len(own) < len(members) else (members, own)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * common >= percent * (len(own) + len(members) - common):
                    out.append((a, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    dealt = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "members").mapInArrow(lean(run), "a bigint, b bigint")


def clustered(live: DataFrame) -> DataFrame:
    """(uid, cluster): nodes of ``live`` (token, uid) that share a token, over any number of steps."""
    rows = live.select("token", "uid").join(cut_small(live.groupBy("token").agg(F.min("uid").alias("first"))), "token")
    cluster = components(rows.filter("uid <> first").select(F.col("uid").alias("a"), F.col("first").alias("b")).distinct())
    own = live.select("uid").distinct().join(cluster.select(F.col("node").alias("uid"), F.col("comp").alias("cluster")), "uid", "left")
    return own.withColumn("cluster", F.coalesce("cluster", "uid"))


def met_in_blocks(live: DataFrame, nodes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of ``live`` (token, uid, comp) rows that pass the length and suffix filters.

    A cluster's nodes stand by size in chunks of about CHUNK; two chunks meet in a task if their
    sizes fit and one of them has a node outside the cluster's largest component. A node brings 256
    bytes there, not its set, and pairs of one component are passed over. With ``nearest`` a node
    gives only the partner least apart of each block.
    """
    own = clustered(live).join(live.select("uid", "comp", "n_shingles").distinct(), "uid")
    sizes = own.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("cluster", "main")
    own = cut_small(own.join(cut_small(main), "cluster").withColumn("probe", (F.col("comp") != F.col("main")).cast("int")))
    by_size = own.groupBy("cluster", "n_shingles").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cluster").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = cut_small(by_size.withColumn("before", before))
    seat = F.floor((F.col("before") + F.pmod(F.xxhash64("uid"), F.col("n"))) / CHUNK).cast("int")
    own = cut_small(own.join(by_size, ["cluster", "n_shingles"]).select("cluster", "uid", "comp", "n_shingles", "probe", seat.alias("chunk")))
    chunks = own.groupBy("cluster", "chunk").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), F.max("probe").alias("probe"))
    one = chunks.select("cluster", F.col("chunk").alias("i"), F.col("hi").alias("hi1"), F.col("probe").alias("p1"))
    two = chunks.select("cluster", F.col("chunk").alias("j"), F.col("lo").alias("lo2"), F.col("probe").alias("p2"))
    # Numbers of chunks, a row for thousands of nodes.
    met = cut_small(one.join(two, "cluster").filter(f"i <= j AND 100 * hi1 >= {percent} * lo2 AND p1 + p2 > 0").select("cluster", "i", "j"))
    sides = met.select("cluster", F.col("i").alias("chunk"), "i", "j", F.lit(0).alias("role")).unionByName(met.filter("i < j").select("cluster", F.col("j").alias("chunk"), "i", "j", F.lit(1).alias("role")))
    seated = own.join(nodes.select("uid", "parts"), "uid")
    dealt = seated.join(cut_small(sides), ["cluster", "chunk"]).select("cluster", "i", "j", "role", "uid", "comp", "n_shingles", "parts")

    def run(table: pa.Table) -> pa.Table:
        role, uid, comp, size = (table.column(c).to_numpy() for c in ("role", "uid", "comp", "n_shingles"))
        parts = np.frombuffer(b"".join(table.column("parts").to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        within = not len(right)
        a, b = [], []
        for k, i in enumerate(left.tolist()):
            at = left[k + 1 :] if within else right
            at = at[(comp[at] != comp[i]) & (100 * np.minimum(size[i], size[at]) >= percent * np.maximum(size[i], size[at]))]
            total = size[i] + size[at]
            apart = np.abs(parts[at] - parts[i]).sum(1)
            room = total - 2 * overlap(total, percent) - apart
            ok = room >= 0
            if nearest and ok.any():
                ok = np.arange(len(at)) == np.argmax(np.where(ok, room / total, -1.0))
            a += [int(uid[i])] * int(ok.sum())
            b += uid[at[ok]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def node_components(nodes: DataFrame, percent: int, rounds: int = 1) -> DataFrame:
    """(node, comp) over the nodes with prefixes; nodes that are their component's least are left out."""
    rows = nodes.select("uid", "n_shingles", "rare", F.explode("prefix").alias("x")).select(F.col("x.token").alias("token"), "uid", "n_shingles", "rare", F.col("x.pos").alias("pos"))
    shared = rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    # Cut, so that the join shuffles both sides anew and can split a shingle that many hold.
    rows = cut_small(rows.join(cut_small(shared), "token"))
    found, labels = [], None

    def contracted() -> DataFrame:
        """Rows of the tokens that stand in more than one component, with holders."""
        own = rows.withColumn("comp", F.col("uid"))
        if labels is not None:
            own = rows.join(labels, rows["uid"] == labels["node"], "left").withColumn("comp", F.coalesce("comp", "uid")).drop("node")
        many = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("token", "n")
        return cut_small(own.join(cut_small(many), "token"))

    def add(new: DataFrame) -> None:
        nonlocal labels
        found.append(cut_small(new))
        links = found[0]
        for f in found[1:]:
            links = links.unionByName(f)
        labels = components(links)

    for r in range(rounds):
        live = contracted()
        hot = live.filter(F.col("n") > HOT)
        if hot.isEmpty():
            break
        # The same order for all tokens of a round, so that a node meets few different pivots.
        rank = F.struct((F.col("rare") / F.col("n_shingles")).alias("x"), F.col("uid")) if r == 0 else F.struct(F.xxhash64("uid", F.lit(r)).alias("x"), F.col("uid"))
        pivot = hot.groupBy("token").agg(F.min_by(F.struct("uid", "comp"), rank).alias("p")).select("token", F.col("p.uid").alias("a"), F.col("p.comp").alias("pc"))
        pairs = hot.join(cut_small(pivot), "token").filter("comp <> pc").select("a", F.col("uid").alias("b")).distinct()
        add(verified(cut_small(plausible(pairs, nodes, percent)), nodes, percent))
    live = contracted()
    x = live.filter(F.col("n") <= HOT).select("token", F.col("uid").alias("a"), F.col("comp").alias("ca"), F.col("pos").alias("i"), F.col("n_shingles").alias("na"))
    y = x.select("token", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("i").alias("j"), F.col("na").alias("nb"))
    met = x.join(y, "token").filter("a < b AND ca <> cb").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    # What stands before a shared shingle, and what stands from it on, bounds the overlap.
    most = F.least("i", "j") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"))
    total = F.col("na") + F.col("nb")
    once = met.groupBy("a", "b").agg(F.min(most).alias("most"), F.first(total).alias("total"))
    fits = once.filter(F.col("most") * (100 + percent) >= F.col("total") * percent).select("a", "b")
    add(verified(cut_small(plausible(fits, nodes, percent)), nodes, percent))
    # Nearest partners first: what they join need not be looked at again, pair by pair.
    for nearest in (True, False):
        hot = contracted().filter(F.col("n") > HOT)
        if hot.isEmpty():
            break
        add(verified(cut_small(met_in_blocks(hot, nodes, percent, nearest).distinct()), nodes, percent))
    return labels


def linked_documents(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, first): one row per document.

    row_key is a hash of (doc_id, text); first marks one row of each component.
    """
    parts = cut(blocks(docs))
    volume = parts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    # About one shingle in six bytes; numbers have 64 places for each, ranges about 4 million.
    bits = min(60, max(24, int(volume // 6).bit_length() + 6))
    range_bits = min(bits - 8, max(6, (int(volume // 6) >> 22).bit_length()))
    rows = cut(with_prefixes(parts, frequencies(parts, k, bits, range_bits), k, bits, percent))
    slim = rows.select("uid", "doc_id", "row_key", "n_shingles", "sig1", "sig2")
    reps = slim.filter("n_shingles > 0").groupBy("n_shingles", "sig1", "sig2").agg(F.min("uid").alias("rep"))
    reps = cut_small(reps)
    nodes = cut(rows.filter("members IS NOT NULL").join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "n_shingles", "rare", "prefix", "members", "parts"))
    labels = node_components(nodes, percent)
    own = slim.join(reps, ["n_shingles", "sig1", "sig2"], "left").select("uid", "doc_id", "row_key", "n_shingles", F.coalesce("rep", "uid").alias("rep"))
    own = own.join(labels, own["rep"] == labels["node"], "left").select("uid", "doc_id", "row_key", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    own = cut_small(own)
    least = own.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "uid")).alias("m"))
    # Cut, as all the aggregates that meet their own rows here, so that a key many rows have is split.
    out = own.join(cut_small(least.select("comp", F.col("m.doc_id").alias("component_id"), F.col("m.uid").alias("kept"))), "comp")
    return out.select("doc_id", "row_key", "n_shingles", "component_id", (F.col("uid") == F.col("kept")).alias("first"))


def drop_near_duplicates(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One document of each component, with all its columns; of rows repeated whole one stays."""
    own, at, names = sealed(docs)
    keep = linked_documents(docs, k, percent).filter("first").select(F.coalesce("doc_id", F.lit(LOW)).alias("id"), F.col("row_key").alias("key")).distinct()
    own = own.select("*", *row_of(at("doc_id"), at("text"), ["id", "key"]))
    held = own.join(keep, ["id", "key"], "left_semi")
    one = Window.partitionBy("id", "key").orderBy(F.lit(1))
    return held.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("id", "key", "n").toDF(*names)
