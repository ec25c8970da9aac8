"""Boosted trees against a plain best-first tree over sorted rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnwake.operators import trees

SCHEMA = "carrier string, station string, flight_month string, hour int, i double, s double, y double"


def table(n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    i, s, hour = rng.integers(-60, 180, n), rng.integers(25, 90, n), rng.integers(5, 24, n)
    carrier = rng.choice(list("ABCDEFG"), n)
    shift = pd.Series(carrier).map(dict(zip("ABCDEFG", (3, -20, 14, 0, 30, -8, 9), strict=True))).to_numpy()
    y = np.maximum(0, i - (s - 35)) + shift + 0.5 * hour + rng.integers(-9, 10, n)
    return pd.DataFrame({"carrier": carrier, "station": "X", "flight_month": "2026-01", "hour": hour.astype(np.int32), "i": i.astype(float), "s": s.astype(float), "y": y.astype(float)})


def plain_split(rows: pd.DataFrame, g: np.ndarray, least: int):
    """(gain, mask of the low side) by trying every value and, for categories, every step of their order."""
    best = None
    for k, f in enumerate(trees.FEATURES):
        if f == trees.CATEGORY:
            means = pd.Series(g).groupby(rows[f].to_numpy()).mean().sort_values(kind="stable")
            sides = [rows[f].isin(means.index[: j + 1]).to_numpy() for j in range(len(means))]
        else:
            sides = [(rows[f] <= v).to_numpy() for v in np.sort(rows[f].unique())]
        for j, low in enumerate(sides):
            n = low.sum()
            if min(n, len(rows) - n) < least:
                continue
            gain = g[low].sum() ** 2 / n + g[~low].sum() ** 2 / (len(rows) - n) - g.sum() ** 2 / len(rows)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                best = (gain, low)
    return best


def plain_tree(rows: pd.DataFrame, g: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """The value of each row's leaf."""
    parts = [np.arange(len(rows))]
    found = [plain_split(rows, g, least)]
    while len(parts) < leaves and any(found):
        k = max(range(len(parts)), key=lambda j: found[j][0] if found[j] else -1)
        own, low = parts.pop(k), found.pop(k)[1]
        for side in (own[low], own[~low]):
            parts.append(side)
            found.append(plain_split(rows.iloc[side], g[side], least))
    out = np.zeros(len(rows))
    for p in parts:
        out[p] = -g[p].mean()
    return out


def test_equals_a_plain_tree(spark):
    rows = table(2000, 1)
    model = trees.fit(spark.createDataFrame(rows, SCHEMA), rounds=2, leaves=20, least=30, share=1.0)
    f = np.full(len(rows), rows["y"].mean())
    for t in model.trees:
        assert sum(n.feature < 0 for n in t) == 20
        step = plain_tree(rows, f - rows["y"].to_numpy(), 20, 30)
        own = np.array([n.value for n in t])[trees.place(t, model.coding.codes({c: rows[c] for c in trees.FEATURES}))]
        assert np.allclose(own, step, atol=1e-6)
        f = f + model.rate * step
    assert np.allclose(model.predict(spark.createDataFrame(rows, SCHEMA)).toPandas()["p_gbm"], f, atol=1e-6)


def test_same_trees_from_one_and_many_tasks(spark, monkeypatch):
    df = spark.createDataFrame(table(3000, 2), SCHEMA)
    monkeypatch.setattr(trees, "BLOCK", 2)
    one = trees.fit(df, rounds=5, leaves=12, least=40)
    monkeypatch.setattr(trees, "CELLS", 300)
    many = trees.fit(df.repartition(7), rounds=5, leaves=12, least=40)
    shape = lambda m: [[(n.feature, n.at, n.left, n.low, n.high) for n in t] for t in m.trees]
    assert shape(one) == shape(many)
    assert np.allclose([n.value for t in one.trees for n in t], [n.value for t in many.trees for n in t])


def test_cells_of_many_tasks_take_few_jobs_a_tree(spark, monkeypatch):
    """Only the top of a tree is a job a step; what is below is the same as in one task, also where growth would not go."""
    df, group = spark.createDataFrame(table(4000, 8), SCHEMA), "trees of many tasks"
    one = trees.fit(df, rounds=6, leaves=63, least=10)
    monkeypatch.setattr(trees, "CELLS", 400)
    monkeypatch.setattr(trees, "BLOCK", 4)
    spark.sparkContext.setJobGroup(group, group)
    many = trees.fit(df, rounds=6, leaves=63, least=10)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [[(n.feature, n.at, n.left, n.low, n.high) for n in t] for t in one.trees] == [[(n.feature, n.at, n.left, n.low, n.high) for n in t] for t in many.trees]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 10 * len(many.trees)


def test_place_follows_the_splits_of_more_nodes_than_a_word_has_bits():
    rng = np.random.default_rng(9)
    nodes, codes = [trees.Node()], [rng.integers(0, size, 3000) for size in (200, 90, 24, 9)]
    for at in range(150):
        k = int(rng.integers(0, 4))
        left = frozenset(rng.choice(9, 4, replace=False).tolist()) if k == 3 else frozenset()
        nodes[at] = trees.Node(k, int(rng.integers(0, (200, 90, 24, 9)[k])), left, len(nodes), len(nodes) + 1)
        nodes += [trees.Node(), trees.Node()]

    def walk(row: int) -> int:
        at = 0
        while (n := nodes[at]).feature >= 0:
            c = codes[n.feature][row]
            at = n.low if (c in n.left if n.left else c <= n.at) else n.high
        return at

    ends = [walk(r) for r in range(3000)]
    assert trees.place(nodes, codes).tolist() == ends
    wanted = sorted(set(ends))[::2]
    assert trees.place(nodes, codes, wanted).tolist() == [e if e in wanted else -1 for e in ends]


def test_asking_ahead_does_not_change_the_tree():
    """A tree takes fewer requests than splits, each for the smaller children only."""
    rows = table(1500, 3)
    how = trees.coding(pd.concat([rows.groupby(f).size().rename("n").reset_index().rename(columns={f: "name" if f == trees.CATEGORY else "value"}).assign(feature=f) for f in trees.FEATURES]).assign())
    codes, g, asked = how.codes({c: rows[c] for c in trees.FEATURES}), (rows["y"].mean() - rows["y"]).to_numpy(), []

    def sums(nodes, wanted):
        asked.append(len(wanted))
        at, start, out = trees.place(nodes, codes), np.concatenate([[0], np.cumsum(how.sizes)]), {}
        for w in wanted:
            own = at == w
            out[w] = tuple(sum(np.bincount(start[k] + c[own], x, start[-1]) for k, c in enumerate(codes)) for x in (np.ones(own.sum()), g[own]))
        return out

    tree = trees.grow(sums, how.sizes, 31, 10)
    assert sum(n.feature < 0 for n in tree) == 31 and len(asked) < 16
    value = np.array([n.value for n in tree])[trees.place(tree, codes)]
    assert np.allclose(value, plain_tree(rows, g, 31, 10))


def test_bins_hold_about_equally_many_rows():
    counts = pd.DataFrame({"feature": "i", "value": range(1000), "name": None, "n": [1] * 990 + [500] * 10})
    edges = trees.coding(counts, 50).edges["i"]
    assert len(edges) <= 50 and edges[-1] == 999 and (np.diff(edges) > 0).all()
    assert trees.coding(counts.head(0)).sizes == [1, 1, 1, 1]


def test_nulls_unseen_carriers_and_no_rows(spark):
    rows = table(600, 4)
    model = trees.fit(spark.createDataFrame(rows, SCHEMA), rounds=3, leaves=8, least=20)
    odd = spark.createDataFrame([("ZZ", "X", "m", 9, 10.0, 40.0, 0.0), (None, "X", "m", None, None, None, 0.0), ("A", "X", "m", 9, 1e9, -1e9, 0.0)], SCHEMA)
    assert model.predict(odd).filter("p_gbm IS NULL OR isnan(p_gbm)").count() == 0
    empty = trees.fit(spark.createDataFrame([], SCHEMA), rounds=3)
    assert empty.trees == [] and empty.predict(odd).agg(F.max("p_gbm")).first()[0] == 0
    few = trees.fit(spark.createDataFrame(rows.head(30), SCHEMA), rounds=2)
    assert [len(t) for t in few.trees] == [1, 1]


def test_beats_a_line_with_many_leaves(spark):
    train, test = table(6000, 5), table(1500, 6)
    p = trees.fit(spark.createDataFrame(train, SCHEMA), rounds=40, leaves=63, least=50).predict(spark.createDataFrame(test, SCHEMA)).toPandas()
    line = np.polyval(np.polyfit(train["i"], train["y"], 1), test["i"])
    assert (p["y"] - p["p_gbm"]).abs().mean() < 0.6 * np.abs(test["y"] - line).mean()


def test_root_gains_have_the_root_s_split(spark):
    rows = table(2000, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    gains = trees.root_gains(df).toPandas()
    best = gains[(gains["n_low"] >= 30) & (gains["n_low"] <= 1970)]["gain"].max()
    assert best == pytest.approx(plain_split(rows, (rows["y"].mean() - rows["y"]).to_numpy(), 30)[0])
