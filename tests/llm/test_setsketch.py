"""SetSketch near duplicates against plain sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.brute import jaccard_components
from turnwake.llm import queries, setsketch
from turnwake.llm.common import mix64

SCHEMA = "doc_id bigint, text string"


def sets(*xs) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(mix64(np.array(sorted(x), np.uint64))) for x in xs]
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


@pytest.mark.parametrize("n", [1, 3, 40, 300, 6000])
def test_registers_merge_by_their_maximum(n):
    a, b = set(range(1, n + 1)), set(range(n // 2 + 1, 2 * n + 2))
    one, two, both = setsketch.sketch(*sets(a, b, a | b))
    assert (np.maximum(one, two) == both).all() and one.min() > 0


def test_minima_are_exponential_and_registers_alike():
    rng = random.Random(4)
    found = setsketch.sketch(*sets(*({rng.getrandbits(60) for _ in range(50)} for _ in range(400))))
    least = setsketch.B ** (1.0 - found.astype(float))  # within a factor B of the minimum
    # The least of 50 points of rate A: mean and deviation are 1 / (50 A).
    assert abs(least.mean() * 50 * setsketch.A - 1) < 0.02 and abs(least.std() * 50 * setsketch.A - 1) < 0.03
    assert np.abs(least.mean(0) * 50 * setsketch.A - 1).max() < 0.25
    assert np.abs(np.corrcoef(least[:, :40].T) - np.eye(40)).max() < 0.3


@pytest.mark.parametrize("j", [0.2, 0.5, 0.8, 0.95])
def test_joint_estimate(j):
    rng, xs, sizes = random.Random(7), [], []
    for _ in range(100):
        common = {rng.getrandbits(60) for _ in range(round(300 * j))}
        rest = [rng.getrandbits(60) for _ in range(300 - len(common))]
        cut = rng.randint(0, len(rest))
        xs += [common | set(rest[:cut]), common | set(rest[cut:])]
        sizes.append((len(xs[-2]), len(xs[-1])))
    found = setsketch.sketch(*sets(*xs))
    n = np.array(sizes, float)
    best, below = setsketch.likelihoods(found[::2], found[1::2], n[:, 0], n[:, 1], 0.8)
    assert abs(best.mean() - j) < 0.01 and np.abs(best - j).max() < 0.13
    fits = 100 * n.min(1) >= 80 * n.max(1)  # sizes are compared first
    passed = ((best >= 0.8) | (below <= setsketch.SURE)) & fits
    assert passed[fits].all() if j >= 0.8 else not passed.any()


def texts_of(rng: random.Random) -> list[tuple[int | None, str | None]]:
    rows: list[tuple[int | None, str | None]] = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows) + 10, " ".join(own).title() if rng.random() < 0.3 else " \n".join(own)))
    return rows


def got(df) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_equal_a_plain_comparison(spark):
    rows = texts_of(random.Random(3)) + [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one")]
    want = jaccard_components(rows, 2, 80)
    assert got(setsketch.linked_documents(spark.createDataFrame(rows, SCHEMA).repartition(4))) == want
    assert len({c for _, c in want.values()}) < len(rows) - 30


@pytest.mark.parametrize("hot, dealt", [(2, 4096), (2, 10)])
def test_hot_groups_that_fall_into_many_components(spark, monkeypatch, hot, dealt):
    """A shared frame of some 70 %: nearly all tokens are hot, most pairs are no links."""
    monkeypatch.setattr(setsketch, "HOT", hot)
    monkeypatch.setattr(setsketch, "DEALT", dealt)
    rng, rows = random.Random(9), []
    frame = [f"f{i}" for i in range(85)]
    for g in range(25):
        own = [f"g{g}.{i}" for i in range(18)]
        for i in range(3):
            rows.append((100 * g + i + 1, " ".join([*frame, *own, *(f"u{rng.getrandbits(40)}" for _ in range(i))])))
    assert got(setsketch.linked_documents(spark.createDataFrame(rows, SCHEMA))) == jaccard_components(rows, 2, 80)


def test_similar_nodes_that_share_one_token_of_very_many(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "HOT", 2)
    monkeypatch.setattr(setsketch, "DEALT", 10)
    rng, xs = random.Random(5), []
    frame = {rng.getrandbits(60) for _ in range(30)}
    for _ in range(20):
        common = frame | {rng.getrandbits(60) for _ in range(30)}
        xs += [common | {rng.getrandbits(60) for _ in range(3)} for _ in range(2)]
    found, bounds = sets(*xs)
    nodes = []
    for i, registers in enumerate(setsketch.sketch(found, bounds)):
        own = found[bounds[i] : bounds[i + 1]]
        parts = np.bincount((own >> np.uint64(56)).astype(int), minlength=256).astype(np.uint8)
        nodes.append((i, len(own), registers.tobytes(), own.tobytes(), parts.tobytes()))
    nodes = spark.createDataFrame(nodes, "uid bigint, n_shingles bigint, registers binary, members binary, parts binary")
    rows = spark.createDataFrame([(1, i) for i in range(40)], "token bigint, uid bigint")
    got = setsketch.node_components(rows, nodes, 80).collect()
    assert {(r["node"], r["comp"]) for r in got} == {(2 * i + 1, 2 * i) for i in range(20)}


def test_rows_repeated_whole_null_ids_and_clashing_names(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, None), (None, "z z z")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", comp int, token string")
    out = setsketch.linked_documents(df).collect()
    assert len(out) == 6 and {r["component_id"] for r in out if r["n_shingles"] == 3} == {5}
    assert sum(r["first"] for r in out) == 3


def test_empty_table(spark):
    assert setsketch.linked_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_says_what_stays(spark, tmp_path):
    rows = [(3, "a b c d e f"), (8, "A b c d e f"), (9, "q r s"), (2, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op12_setsketch(spark, str(tmp_path)).collect()}
    assert {d: r["kept"] for d, r in out.items()} == {3: True, 8: False, 9: True, 2: True}
