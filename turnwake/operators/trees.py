"""Boosted regression trees, grown best-first on histograms.

Turns are first summed into cells of equal features and slice (sixteen slices by a hash, the unit that a
round draws). Trees are grown on the cells. A step of a tree is one aggregate of gradients by (leaf, feature,
bin): of every leaf that may be split next, only the smaller child is summed, its sibling is the parent less
that. The leaf whose split gains most is split first, until there are ``leaves``; children are summed ahead
for all leaves that wait, so a tree takes about as many steps as it is deep, not as many as it has leaves,
and is the same as if each split had been asked for by itself. Only histograms and trees come to the driver,
some 10 KB a node and task, whatever the number of turns.

A step is a job only at the top of a tree. The cells of a leaf that fill one task go there, one shuffle for all
leaves of a tree, and what is below is grown there, to ``leaves`` leaves; the tree keeps of it what best-first growth
takes, as the splits below a leaf do not depend on others. If all cells fill one task there is no job a tree either.

Numbers are binned by whole values, those of more than BINS values with about equally many rows to a bin; categories are put in order of
their mean gradient in each leaf, which makes the best subset a split of that order. A null is in the last
bin of its feature; a category that was not seen goes to the right.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

NUMBERS, CATEGORY = ("i", "s", "hour"), "carrier"
FEATURES = (*NUMBERS, CATEGORY)
SLICES, BINS = 16, 255
CELLS = 200_000  # all trees of so many are grown by one task
KEPT = 5  # of more cells, times as many at most are in a task: waves cost more than rows
GROWN = 2.5  # times as many at most are grown on by a task: below that a step more costs more than rows
BLOCK = 30  # trees after which predictions are computed anew from all trees, so that they do not hang on a long row of steps


@dataclass
class Node:
    """A split (code <= at, or a code of ``left``, goes to ``low``) or, with ``feature`` -1, a leaf."""

    feature: int = -1
    at: int = 0
    left: frozenset[int] = frozenset()
    low: int = -1
    high: int = -1
    value: float = 0.0
    loss: float = 0.0  # of the split, as there

    def goes_low(self, width: int) -> np.ndarray:
        """For each code of the split's feature, whether it goes to ``low``."""
        out = np.zeros(width, bool)
        out[[c for c in self.left if c < width] if self.left else slice(self.at + 1)] = True
        return out


def place(nodes: list[Node], codes: list[np.ndarray], wanted: list[int] | None = None) -> np.ndarray:
    """The node in which each row ends; -1 for rows that do not come to a ``wanted`` one (of those without children).

    A node is a set of codes of each feature. A word has a bit for each of 64 nodes: a code's are those of the nodes that
    it may be in, and of the words of a row's codes only the bit of its own node is in all.
    """
    width = max(1, *(int(c.max(initial=0)) + 1 for c in codes))
    may = np.ones((len(nodes), len(codes), width), bool)
    for at, n in enumerate(nodes):  # children come after their parent
        if n.feature >= 0:
            goes_low = n.goes_low(width)
            may[n.low] = may[n.high] = may[at]
            may[n.low, n.feature] &= goes_low
            may[n.high, n.feature] &= ~goes_low
    ends = np.array([at for at, n in enumerate(nodes) if n.feature < 0] if wanted is None else wanted, np.int32)
    out = np.full(len(codes[0]), -1, np.int32)
    for first in range(0, len(ends), 64):
        own = ends[first : first + 64]
        bits = np.left_shift(np.uint64(1), np.arange(len(own), dtype=np.uint64))
        words = np.bitwise_or.reduce(np.where(may[own], bits[:, None, None], np.uint64(0)))
        word = words[0][codes[0]]
        for k in range(1, len(codes)):
            word &= words[k][codes[k]]
        rows = np.flatnonzero(word)
        out[rows] = own[np.frexp(word[rows].astype(float))[1] - 1]
    return out


@dataclass
class Coding:
    """From values to codes. ``edges``: the largest whole value in each bin of a number; ``names``: the categories."""

    edges: dict[str, np.ndarray]
    names: list[str]

    @property
    def sizes(self) -> list[int]:
        return [len(self.edges[f]) + 1 for f in NUMBERS] + [len(self.names) + 1]

    def codes(self, columns: dict[str, pd.Series]) -> list[np.ndarray]:
        out = []
        for f in NUMBERS:
            v = np.floor(columns[f].to_numpy(float, na_value=np.nan))
            e = self.edges[f]
            code = np.minimum(np.searchsorted(e, v, "left"), max(len(e) - 1, 0))
            out.append(np.where(np.isnan(v), len(e), code).astype(np.int32))
        known = {n: k for k, n in enumerate(self.names)}
        out.append(columns[CATEGORY].map(known).fillna(len(self.names)).to_numpy(np.int32))
        return out


@dataclass
class Boosted:
    coding: Coding
    base: float
    rate: float
    trees: list[list[Node]] = field(default_factory=list)

    def values(self, codes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(codes[0]))
        for t in self.trees:
            out += self.rate * np.array([n.value for n in t])[place(t, codes)]
        return out

    def predict(self, rows: DataFrame, name: str = "p_gbm") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def predicted(i: pd.Series, s: pd.Series, hour: pd.Series, carrier: pd.Series) -> pd.Series:
            return pd.Series(model.base + model.values(model.coding.codes(dict(zip(FEATURES, (i, s, hour, carrier), strict=True)))))

        return rows.withColumn(name, predicted(*(F.col(f) if f == CATEGORY else F.col(f).cast("double") for f in FEATURES)))


# ---------------------------------------------------------------- cells


def cells(train: DataFrame) -> DataFrame:
    """(slice, i, s, hour, carrier, n, sy): rows of equal features and slice as one."""
    part = F.pmod(F.xxhash64(*train.columns), F.lit(SLICES)).cast("int")
    whole = [F.floor(F.col(f).cast("double")).alias(f) for f in NUMBERS]
    return train.select(part.alias("slice"), *whole, CATEGORY, "y").groupBy("slice", *FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("sy"))


def value_counts(all_cells: DataFrame) -> DataFrame:
    """(feature, value, name, n): rows of each whole value and category; as many as the analysis window has minutes."""
    each = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.lit(None).cast("string").alias("name")) for f in NUMBERS]
    each.append(F.struct(F.lit(CATEGORY).alias("feature"), F.lit(None).cast("long").alias("value"), F.col(CATEGORY).alias("name")))
    return all_cells.select("n", F.explode(F.array(*each)).alias("x")).groupBy("x.feature", "x.value", "x.name").agg(F.sum("n").alias("n"))


def coding(counts: pd.DataFrame, bins: int = BINS) -> Coding:
    """A bin for each value, or, of more than ``bins`` values, bins of about equally many rows."""
    edges = {}
    for f in NUMBERS:
        own = counts[(counts["feature"] == f) & counts["value"].notna()].sort_values("value")
        n = own["n"].to_numpy(np.int64)
        which = np.arange(len(n)) if len(n) <= bins else (np.cumsum(n) - n) * bins // int(n.sum())
        last = np.flatnonzero(np.append(np.diff(which), 1)) if len(which) else np.zeros(0, int)
        edges[f] = own["value"].to_numpy(float)[last]
    return Coding(edges, sorted(counts.loc[(counts["feature"] == CATEGORY) & counts["name"].notna(), "name"]))


CODED = "slice int, c0 int, c1 int, c2 int, c3 int, n bigint, sy double, f double"


def coded(all_cells: DataFrame, how: Coding, base: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pandas()
            codes = [pa.array(c) for c in how.codes(t)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *codes, b.column(5), b.column(6), pa.array(np.full(len(t), base))], [c.split(" ")[0] for c in CODED.split(", ")])

    return all_cells.select("slice", *(F.col(f).cast("double").alias(f) for f in NUMBERS), CATEGORY, "n", "sy").mapInArrow(run, CODED)


@dataclass
class Cells:
    """The cells of a task."""

    part: np.ndarray  # the slice
    codes: np.ndarray  # a row a feature
    n: np.ndarray
    sy: np.ndarray
    f: np.ndarray  # the prediction

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> Cells:
        read, kinds = list(batches), (np.int32,) * (1 + len(FEATURES)) + (np.int64, float, float)
        part, *codes, n, sy, f = (np.concatenate([np.zeros(0, kind), *(b.column(k).to_numpy() for b in read)]) for k, kind in enumerate(kinds))
        narrow = lambda x: x.astype(np.min_scalar_type(x.max(initial=0)))
        return cls(narrow(part), narrow(np.stack(codes)), narrow(n), sy, f)

    def with_trees(self, trees: list[list[Node]], rate: float) -> Cells:
        f = self.f
        for t in trees:
            f = f + rate * np.array([n.value for n in t])[place(t, self.codes)]
        return Cells(self.part, self.codes, self.n, self.sy, f)

    def drawn(self, bag: list[int]) -> Rows:
        own = np.flatnonzero(np.isin(self.part, bag))
        return Rows(self.codes[:, own], self.n[own], self.n[own] * self.f[own] - self.sy[own])


@dataclass
class Rows:
    """What trees are grown on: codes, counts and sums of gradients."""

    codes: np.ndarray
    n: np.ndarray
    g: np.ndarray

    def only(self, own: np.ndarray) -> Rows:
        return Rows(self.codes[:, own], self.n[own], self.g[own])

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return cls(np.concatenate([p.codes for p in parts], axis=1), *(np.concatenate([getattr(p, c) for p in parts]) for c in "ng"))

    def histogram(self, sizes: list[int], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, gradient sums) of some rows, the bins of all features laid end to end."""
        codes, each = self.codes[:, own], [self.n[own], self.g[own]]
        n, g = (np.concatenate([np.bincount(c, x, size) for c, size in zip(codes, sizes, strict=True)]) for x in each)
        return n, g

    def tree(self, sizes: list[int], leaves: int, least: int) -> list[Node]:
        """One tree on these rows, in this task; the rows of each node are kept, so that a step passes those that it moves."""
        own, width = {0: np.arange(len(self.n))}, max(sizes)

        def histograms_of(nodes: list[Node], wanted: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            for at in [k for k in own if nodes[k].feature >= 0]:
                node, rows = nodes[at], own.pop(at)
                low = node.goes_low(width)[self.codes[node.feature, rows]]
                own[node.low], own[node.high] = rows[low], rows[~low]
            return {w: self.histogram(sizes, own[w]) for w in wanted}

        return grow(histograms_of, sizes, leaves, least)


@dataclass(order=True)
class Split:
    """Sorted by falling gain, then by feature and place, so that ties fall alike everywhere."""

    loss: float
    feature: int
    at: int
    left: frozenset[int] = field(compare=False, default=frozenset())
    n_low: float = field(compare=False, default=0)


def best_split(n: np.ndarray, g: np.ndarray, sizes: list[int], least: int) -> Split | None:
    """The split of most gain that leaves ``least`` rows on both sides."""
    best, start, least = None, 0, max(least, 1)
    for k, size in enumerate(sizes):
        own_n, own_g, order = n[start : start + size], g[start : start + size], None
        start += size
        total_n, total_g = own_n.sum(), own_g.sum()
        if k == FEATURES.index(CATEGORY):
            order = np.flatnonzero(own_n[:-1] > 0)  # unseen categories are on the right
            order = order[np.argsort(own_g[order] / own_n[order], kind="stable")]
            own_n, own_g = own_n[order], own_g[order]
        nl = own_n.cumsum()
        first, end = np.searchsorted(nl, least), np.searchsorted(nl, total_n - least, "right")
        if first >= end:
            continue
        nl, gl = nl[first:end], own_g.cumsum()[first:end]
        nr, gr = total_n - nl, total_g - gl
        gain = gl * gl / nl + gr * gr / nr - total_g * total_g / total_n
        top = int(gain.argmax())
        if gain[top] > 1e-9:
            at = int(first) + top
            one = Split(-float(gain[top]), k, at, frozenset() if order is None else frozenset(order[: at + 1].tolist()), float(nl[top]))
            best = one if best is None or one < best else best
    return best


def grow(histograms_of, sizes: list[int], leaves: int, least: int, rest_of: Callable | None = None, rows_at_most: float = 0) -> list[Node]:
    """One tree; ``histograms_of(nodes, wanted)`` sums the rows of nodes.

    Nodes are split ahead as ``ahead``; the tree keeps only the splits that best-first growth takes. With ``rest_of(nodes, counts)``,
    which grows the trees below nodes of given counts, steps are taken only for nodes of more than ``rows_at_most`` rows.
    """
    nodes = [Node()]
    sums, split, value = {}, {}, {}

    def known(at: int, n: np.ndarray, g: np.ndarray) -> None:
        sums[at], split[at] = (n, g), best_split(n, g, sizes, least)
        n_all, g_all = rows(at), g[: sizes[0]].sum()
        value[at] = float(-g_all / n_all) if n_all else 0.0

    def rows(at: int) -> float:
        return sums[at][0][: sizes[0]].sum()

    def open_ends() -> list[int]:
        return [at for at, n in enumerate(nodes) if n.feature < 0 and split[at]]

    def split_ahead(chosen: list[int]) -> None:
        small, pairs = [], []
        for at in chosen:
            s, low, high = split[at], len(nodes), len(nodes) + 1
            nodes[at] = Node(s.feature, s.at, s.left, low, high)
            nodes.extend((Node(), Node()))
            less, more = (low, high) if s.n_low <= rows(at) / 2 else (high, low)
            small.append(less)
            pairs.append((at, less, more))
        got = histograms_of(nodes, small)
        for at, less, more in pairs:
            n, g = got[less]
            known(less, n, g)
            known(more, sums[at][0] - n, sums[at][1] - g)

    def graft(at: int, below: list[Node]) -> None:
        """The tree that was grown below a node; its leaves stay as they are."""
        to = [at, *range(len(nodes), len(nodes) + len(below) - 1)]
        nodes.extend(Node() for _ in below[1:])
        for x, n in zip(to, below, strict=True):
            inner = n.feature >= 0
            nodes[x] = Node(n.feature, n.at, n.left, to[n.low], to[n.high]) if inner else Node()
            split[x] = Split(n.loss, n.feature, n.at, n.left) if inner else None
            value[x] = n.value

    known(0, *histograms_of(nodes, [0])[0])
    if rest_of is not None:
        while large := [at for at in open_ends() if rows(at) > rows_at_most]:
            split_ahead(large)
        if ends := open_ends():
            for at, below in sorted(rest_of(nodes, {at: rows(at) for at in ends}).items()):
                graft(at, below)
    waiting = [(split[0], 0)] if split[0] else []
    taken: set[int] = set()
    while waiting and len(taken) < leaves - 1:
        if nodes[waiting[0][1]].feature < 0:
            split_ahead([at for _, at in heapq.nsmallest(leaves - 1 - len(taken), waiting) if nodes[at].feature < 0])
        _, at = heapq.heappop(waiting)
        taken.add(at)
        for child in (nodes[at].low, nodes[at].high):
            if split[child]:
                heapq.heappush(waiting, (split[child], child))
    return _kept(nodes, taken, split, value)


def _kept(nodes: list[Node], taken: set[int], split: dict[int, Split | None], value: dict[int, float]) -> list[Node]:
    """The nodes that best-first growth reached, numbered anew, with their values."""
    out, queue = [Node()], [(0, 0)]
    for at, to in queue:
        if at in taken:
            old, low = nodes[at], len(out)
            out[to] = Node(old.feature, old.at, old.left, low, low + 1, value[at], split[at].loss)
            out += [Node(), Node()]
            queue += [(old.low, low), (old.high, low + 1)]
        else:
            out[to] = Node(value=value[at])
    return out


def fit(train: DataFrame, seed: int = 0, rounds: int = 300, leaves: int = 63, least: int = 200, rate: float = 0.1, share: float = 0.5, bins: int = BINS) -> Boosted:
    """``rounds`` trees, each on the rows of a random ``share`` of the slices."""
    whole = settled(cells(train))
    counts = value_counts(whole).toPandas()
    how = coding(counts, bins)
    top = whole.agg(F.sum("n"), F.sum("sy"), F.count("*")).first()
    model = Boosted(how, float(top[1] / top[0]) if top[0] else 0.0, rate)
    if not top[0]:
        return model
    rng = np.random.default_rng(seed)
    bags = [np.sort(rng.permutation(SLICES)[: max(1, round(share * SLICES))]).tolist() for _ in range(rounds)]
    how_to = (how.sizes, leaves, least)
    if top[2] <= CELLS:
        model.trees = _in_one_task(coded(whole.coalesce(1), how, model.base), bags, rate, *how_to)
        return model
    wide = min(train.sparkSession.sparkContext.defaultParallelism, -(-10 * top[2] // CELLS))  # a tenth of CELLS in a task at least
    tasks = wide * -(-top[2] // int(wide * KEPT * CELLS))  # no wave of few
    model.trees = _in_many_tasks(coded(whole, how, model.base).repartition(tasks), bags, rate, GROWN * CELLS * top[0] / top[2], wide, *how_to)
    return model


def _in_one_task(table: DataFrame, bags: list[list[int]], rate: float, sizes: list[int], leaves: int, least: int) -> list[list[Node]]:
    """The trees on cells that fill one task, CELLS at most: the same steps without a job for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_ = Cells.of(batches)
        for bag in bags:
            tree = cells_.drawn(bag).tree(sizes, leaves, least)
            cells_ = cells_.with_trees([tree], rate)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree)])], ["tree"])

    return [pickle.loads(r["tree"]) for r in table.mapInArrow(run, "tree binary").collect()]


def _in_many_tasks(table: DataFrame, bags: list[list[int]], rate: float, rows_at_most: float, wide: int, sizes: list[int], leaves: int, least: int) -> list[list[Node]]:
    """The trees on cells of many tasks: jobs at the top of each tree, then one in which a task grows what is below a node.

    Predictions are computed from the trees, so that a lost executor costs no more than its cells.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Cells.of(batches))], pa.binary())], ["cells"])

    sc, trees = table.sparkSession.sparkContext, []
    first = old = now = table.mapInArrow(packed, "cells binary").rdd.map(lambda r: pickle.loads(r["cells"])).persist()
    for bag in bags:
        rows = now.map(lambda c, bag=bag: c.drawn(bag)).persist()
        top = lambda nodes, wanted, rows=rows: _histograms(rows, nodes, wanted, sizes)
        below = lambda nodes, counts, rows=rows: _below(rows, nodes, counts, max(wide, int(sum(counts.values()) / rows_at_most)), sizes, leaves, least)
        trees.append(grow(top, sizes, leaves, least, below, rows_at_most))
        rows.unpersist()
        if old is not first:  # the present cells are there by now
            old.unpersist()
        old = now
        start, more = (first, trees) if len(trees) % BLOCK == 0 else (now, trees[-1:])
        now = start.map(lambda c, more=sc.broadcast(more): c.with_trees(more.value, rate)).persist()
    for kept in (first, old, now):
        kept.unpersist()
    return trees


def _histograms(drawn: RDD, nodes: list[Node], wanted: list[int], sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """node: (counts, gradient sums) of ``wanted`` nodes over the rows of all tasks, added in the order of tasks."""

    def sums(rows: Rows) -> tuple[np.ndarray, ...]:
        at = place(nodes, rows.codes, wanted)
        n, g = map(np.stack, zip(*(rows.histogram(sizes, np.flatnonzero(at == w)) for w in wanted), strict=True))
        keys = np.flatnonzero(n)
        return keys, n.flat[keys], g.flat[keys]

    n, g = (np.zeros((len(wanted), sum(sizes))) for _ in "ng")
    for keys, more_n, more_g in drawn.map(sums).collect():
        n.flat[keys] += more_n
        g.flat[keys] += more_g
    return {w: (n[k], g[k]) for k, w in enumerate(wanted)}


def _below(drawn: RDD, nodes: list[Node], counts: dict[int, float], tasks: int, sizes: list[int], leaves: int, least: int) -> dict[int, list[Node]]:
    """node: the tree below it, for nodes of given counts; the largest go first, each to the task with the fewest rows."""
    ends, load, to = sorted(counts, key=counts.get, reverse=True), np.zeros(min(tasks, len(counts))), {}
    for at in ends:
        to[at] = int(load.argmin())
        load[to[at]] += counts[at]

    def deal(source: int, each: Iterator[Rows]) -> Iterator[tuple[int, tuple[int, int, Rows]]]:
        for rows in each:
            at = place(nodes, rows.codes, ends)
            for end in ends:
                yield to[end], (end, source, rows.only(np.flatnonzero(at == end)))

    def grown(dealt: Iterator[tuple[int, tuple[int, int, Rows]]]) -> Iterator[tuple[int, list[Node]]]:
        parts: dict[int, dict[int, Rows]] = {}
        for _, (end, source, rows) in dealt:
            parts.setdefault(end, {})[source] = rows
        for end, by_source in parts.items():
            yield end, Rows.joined([by_source[k] for k in sorted(by_source)]).tree(sizes, leaves, least)

    return dict(drawn.mapPartitionsWithIndex(deal).partitionBy(len(load), int).mapPartitions(grown).collect())


def root_gains(train: DataFrame) -> DataFrame:
    """(feature, upto, n_low, gain): what every first split of the first tree on all rows gains, one value or category a bin.

    ``upto`` is the last whole value on the low side, or the place of the last category in the order of mean gradients.
    """
    whole = cells(train)
    each = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("key"), F.col(f).cast("double").alias("value")) for f in NUMBERS]
    each.append(F.struct(F.lit(CATEGORY).alias("feature"), F.col(CATEGORY).alias("key"), F.lit(None).cast("double").alias("value")))
    # From here on a row a value: minutes of the window, hours and carriers.
    rows = whole.select("n", "sy", F.explode(F.array(*each)).alias("x")).groupBy("x.feature", "x.key", "x.value").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    by = Window.partitionBy("feature").orderBy(F.coalesce("value", -F.col("sy") / F.col("n")), "key")
    low, all_ = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("feature")
    t = rows.select("feature", "value", F.row_number().over(by).alias("at"), *(F.sum(c).over(w).alias(f"{c}_{name}") for c in ("n", "sy") for name, w in (("low", low), ("all", all_))))
    mean = F.col("sy_all") / F.col("n_all")
    high = F.col("n_all") - F.col("n_low")
    # Sums of whole minutes are exact; gradients are taken from them, so that they do not depend on an order of adding.
    gl, gr = F.col("n_low") * mean - F.col("sy_low"), high * mean - (F.col("sy_all") - F.col("sy_low"))
    g = F.col("n_all") * mean - F.col("sy_all")
    gain = gl * gl / F.col("n_low") + gr * gr / high - g * g / F.col("n_all")
    return t.filter("n_low < n_all").select("feature", F.coalesce(F.col("value").cast("long"), F.col("at").cast("long")).alias("upto"), "n_low", gain.alias("gain"))
