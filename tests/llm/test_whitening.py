"""Whitening against a plain covariance and eigenvectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwake.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    return e[::-1], v[:, ::-1].T


def test_merging_loses_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(257, 7)) @ rng.normal(size=(7, 7)) + 1e3
    parts = np.split(x, [1, 2, 40, 41, 200])
    s = whitening.Summary.of(parts[0])
    for p in parts[1:]:
        s = s.merge(whitening.Summary.of(p))
    c = x - x.mean(0)
    assert s.n == 257 and np.allclose(s.factor.T @ s.factor, c.T @ c, rtol=1e-11, atol=1e-8)
    # The order of merging does not matter either.
    left, right = (whitening.Summary.of(np.vstack(p)) for p in (parts[:3], parts[3:]))
    other = left.merge(right)
    assert np.allclose(other.factor.T @ other.factor, s.factor.T @ s.factor, rtol=1e-11, atol=1e-8)


def test_query_equals_plain_version(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 40)) @ np.diag(np.linspace(1, 0.05, 40))).astype(np.float32)
    rows = [(i, [float(c) for c in r], 0) for i, r in enumerate(v)]
    rows += [(7, rows[7][1], 1), (None, rows[8][1], None)]  # repeated, and a null id
    bad = [(900, None, 0), (901, [None, *rows[0][1][1:]], 0), (902, [float("nan"), *rows[0][1][1:]], 0), (903, [float("inf"), *rows[0][1][1:]], 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    spark.createDataFrame(rows + bad, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_whitening(spark, str(tmp_path)).toPandas()
    x = np.array([[math.floor(64 * np.float64(np.float32(c))) + 1000000 for c in r[1]] for r in rows])
    n, total = len(x), x.sum(0)
    e, comp = plain(x.astype(float))
    assert set(out["vec_id"].dropna()) == set(range(300)) and len(out) == 32 * n and (out["n"] == n).all()
    assert out["identity_error"].max() < 1e-9 and out["identity_error"].nunique() == 1
    for vec_id in (0, 7, 123):
        own = out[out["vec_id"] == vec_id].sort_values(["component", "whitened"])
        at = [i for i, r in enumerate(rows) if r[0] == vec_id]
        assert set(own["deviation"]) == {int(((n * x[at[0]] - total) ** 2).sum())}
        got = own.groupby("component")["whitened"].first().to_numpy()
        want = ((x[at[0]] - total / n) @ comp[:32].T) / np.sqrt(e[:32])
        assert np.allclose(np.abs(got), np.abs(want), rtol=1e-6, atol=1e-8)
        assert np.allclose(own.groupby("component")["explained"].first(), e[:32] / e.sum(), rtol=1e-9)
    wide = out[out["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = ((x[:300] - total / n) @ comp[:32].T) / np.sqrt(e[:32])
    sign = np.sign((wide * want).sum(0))
    assert np.allclose(wide * sign, want, rtol=1e-5, atol=1e-7)


def test_several_rounds_of_merging_and_a_large_offset(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)) * [5, 4, 3, 2, 1] + 1e9
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3 * whitening.FAN)
    model = whitening.fit(df)
    e, comp = plain(x - 1e9)
    assert model.n == 400 and np.allclose(model.values, e, rtol=1e-6)
    assert np.allclose(np.abs((model.components * comp).sum(1)), 1, atol=1e-6)
    assert np.allclose(model.covariance(), np.cov((x - 1e9).T, bias=True), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(9)]], ids=["empty", "nulls", "no entries", "one row", "equal rows"])
def test_tables_without_components(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = whitening.components(df, 32, keep=["vec_id"])
    assert out.count() == 0 and out.columns == ["vec_id", "component", "whitened", "explained", "identity_error"]


def test_flat_directions_are_no_components_and_names_may_clash(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, r.tolist(), "a", "b") for i, r in enumerate(x)], "vec_id bigint, embedding array<double>, n string, whitened string")
    out = whitening.components(df, 32, keep=["vec_id"])
    assert out.count() == 100 and out.agg(F.max("component")).first()[0] == 2
    assert out.agg(F.max("identity_error")).first()[0] < 1e-9
