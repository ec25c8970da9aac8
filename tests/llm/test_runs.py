"""Periodic runs against a plain search."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwake.llm import periodic_runs, queries


def plain_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period): maximal stretches of each period, of their smallest period only."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, 2 * p) and not any(all(words[x] == words[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def found(docs: list[list[int]], least: int) -> list[list[tuple[int, int, int]]]:
    sizes = np.array([len(d) for d in docs], np.int64)
    words = np.array([w * 1000 + i for i, d in enumerate(docs) for w in d], np.uint64)
    out = [[] for _ in docs]
    for d, s, n, p in zip(*(x.tolist() for x in periodic_runs.runs_of(words, sizes, least)), strict=True):
        out[d].append((s, n, p))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 4, 12]))
def test_runs_equal_a_plain_search(docs, least):
    assert found(docs, least) == [plain_runs(d, least) for d in docs]


def test_periodic_and_random_stretches():
    rng = random.Random(1)
    docs = []
    for _ in range(60):
        d = []
        for _ in range(rng.randint(1, 4)):
            block = [rng.randint(0, 5) for _ in range(rng.randint(1, 15))]
            d += (block * rng.randint(1, 6))[: rng.randint(1, 60)] + [rng.randint(0, 50) for _ in range(rng.randint(0, 20))]
        docs.append(d)
    assert found(docs, 12) == [plain_runs(d) for d in docs]
    fibonacci = [0], [0, 1]
    while len(fibonacci[-1]) < 300:
        fibonacci = (*fibonacci, fibonacci[-1] + fibonacci[-2])
    assert found([list(fibonacci[-1])], 4) == [plain_runs(fibonacci[-1], 4)]


def test_one_word_repeated_and_long_periods_take_linear_memory():
    n = 200_000
    assert found([[1] * n], 12) == [[(0, n, 1)]]
    block = list(range(n // 2 - 5))
    assert found([block * 2 + block[:10]], 12) == [[(0, n, n // 2 - 5)]]


def planted(doc_id: int | None, text: str | None) -> list[str]:
    words = [w.decode() for w in (text or "").encode().split()]
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text) -> tuple:
    words = planted(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(plain_collapsed(words, runs))),
    )


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t\n ", "word", "na " * 40, "été x Café " * 20, "A a " * 10, "a\x0bb\x0c" * 9, "一二 " * 8 + "x"]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 150))) + rng.choice(["", "\n", "  "]) for _ in range(150)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(4, texts[4], 2), (None, texts[4], 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, (expected(i, t) for i, t, _ in rows)))


@pytest.mark.parametrize("rows", [[], [(1, None)]], ids=["empty", "null"])
def test_small_tables(spark, rows):
    out = periodic_runs.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in out] == [(1, [], "")] * len(rows)


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "x " + "buy  now\n" * 6 + "y")], "doc_id bigint, text string")
    assert [tuple(r) for r in periodic_runs.find(df).collect()] == [(1, [(1, 12, 2)], "x buy now y")]
