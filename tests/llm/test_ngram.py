from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from turnwake.llm import common, components
from turnwake.llm import ngram_join as N

from .brute import jaccard_components, word_shingles

SCHEMA = "doc_id long, text string"


def near_copies(n, edits, seed=5, words=150):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(100000)}"
        out.append((i, " ".join(w)))
    return out


EDGE = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c"), (1005, " \t\n"), (1006, "é\u00a0b c d"), (1007, "b"), (1008, "B")]


def check(spark, rows, **options):
    got = N.linked_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()
    want = jaccard_components(rows, **options)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(d, *v) for d, v in want.items()}
    first = [r["component_id"] for r in got if r["first"]]
    assert len(first) == len(set(first)) == len({r["component_id"] for r in got})


def test_against_brute_force_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 20)
    monkeypatch.setattr(N, "CHUNK", 40)
    check(spark, near_copies(160, 7) + EDGE)


def template_pages(n, seed=9):
    """Pages that share a frame of 160 words and differ in 8 to 30 words at its places."""
    rng = random.Random(seed)
    frame = [f"f{i}" for i in range(160)]
    out = []
    for i in range(n):
        w = list(frame)
        for _ in range(rng.randrange(8, 31)):
            w[rng.randrange(len(w))] = f"own{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_pages_of_one_template(spark, monkeypatch):
    """Similarities of 30 to 85 percent: nearly all pairs meet on hot shingles, few may be looked at."""
    monkeypatch.setattr(N, "CHUNK", 60)
    looked = []
    one = N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, *a: looked.append(pairs.count()) or one(pairs, *a))
    check(spark, template_pages(300) + [(1000 + i, t) for i, t in near_copies(20, 3)], k=5, percent=80)
    assert sum(looked) < 300 * 30


def test_small_groups_and_other_parameters(spark):
    rows = [(100 * g + i, t) for g in range(6) for i, t in near_copies(6, 5, g, 40)] + EDGE
    check(spark, rows, k=5, percent=80)


def test_dropping_keeps_one_of_each(spark):
    rows = [(d, t, i) for i, (d, t) in enumerate(near_copies(12, 3) + EDGE)] + [(1004, "a b c", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted((r["doc_id"], r["text"]) for r in N.drop_near_duplicates(df).select("doc_id", "text").collect())
    comps = jaccard_components([r[:2] for r in rows])
    assert [d for d, _ in got] == sorted({c for _, c in comps.values()})
    assert N.drop_near_duplicates(df).columns == df.columns


def test_a_text_of_several_blocks_and_clashing_names(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(700_000)]  # over 5 MB
    near = list(words)
    for _ in range(3000):
        near[rng.randrange(len(near))] = "changed"
    rows = [(1, " ".join(words), "x", 1), (2, " ".join(near), "y", 2), (3, "some other words here", "z", 3), (4, None, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, n_shingles int")
    got = {r["doc_id"]: r for r in N.linked_documents(df).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert [got[d]["n_shingles"] for d in (1, 3, 4)] == [len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}), 2, 0]
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["n_shingles"] for r in kept.collect()) == [1, 3, 4]


def test_empty_and_null_ids(spark):
    assert N.linked_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    got = N.linked_documents(spark.createDataFrame([(None, "a b c d"), (None, "A B C D"), (3, "a b c d"), (None, "")], SCHEMA)).collect()
    assert sorted((r["n_shingles"], str(r["component_id"])) for r in got) == [(0, "None"), (2, "3"), (2, "3"), (2, "3")]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_components_of_a_long_path(spark):
    """Many steps, each planned by the real size of what the one before wrote."""
    ids = list(range(500))
    random.Random(3).shuffle(ids)
    got = components.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert len(got) == 499 and {r["comp"] for r in got} == {0}


def test_shingles_of_bytes():
    texts = ["Aa bb CC dd", None, "x", "", "é ü\tö", " aa  BB cc dd ", "a b a b a b"]
    raw, off = common.utf8_buffer(pa.array(texts))
    words, rows, starts, ends = common.word_hashes(raw, off, common.byte_table(common.WHITE))
    found, bounds = common.shingles(words, rows, len(texts), 3, True)
    assert list(np.diff(bounds)) == [len(word_shingles(t, 3)) for t in texts]
    assert set(found[: bounds[1]]) == set(found[bounds[5] : bounds[6]])
    assert bytes(raw[starts[1] : ends[1]]) == b"bb"


@pytest.mark.parametrize("percent", [80, 90])
def test_bounds(percent):
    for x in range(1, 120):
        for y in range(x, 120):
            least = next((c for c in range(x + 1) if 100 * c >= percent * (x + y - c)), None)
            if least is not None:
                assert N.overlap(x + y, percent) == least and N.need(y, percent) <= least


def test_packed_numbers_come_back():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 50, 1000)).astype(np.uint64)
    assert (N.unpacked(N.packed(v), 1000) == v).all()
