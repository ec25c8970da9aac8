from __future__ import annotations

import hashlib
import random

import pytest

from turnwake.llm import exact_dedup as E

from .brute import fold

SCHEMA = "doc_id long, text string"


def expected(rows):
    groups: dict[str, list] = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append(d)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for d in ids:
            kept = d == keep and not done
            done |= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted((tuple(r) for r in E.exact_duplicates(df, **options).collect()), key=str)


@pytest.mark.parametrize("table_bytes", [48 << 20, 3000])
def test_against_brute_force(spark, table_bytes):
    rng = random.Random(1)
    texts = [f"{'Text' if i % 2 else 'tEXT'} {'x' * rng.randrange(900)} {i // 2}" for i in range(60)] + ["É", "é", "", None]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(500, "hot")] * 3 + [(600 + i, "HOT") for i in range(150)] + [(None, "hot"), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df, table_bytes=table_bytes) == expected(rows)


def test_rounds_do_not_grow_with_the_input(spark, monkeypatch):
    rounds, one = [], E.cut
    monkeypatch.setattr(E, "cut", lambda df: rounds.append(1) or one(df))
    for n in (100, 1600):
        rounds.clear()
        texts = spark.range(n).selectExpr("id doc_id", "concat(repeat('x', 500), id) text").repartition(2)
        # One task's own table takes nothing off here, as all contents differ.
        assert E.classes(texts, table_bytes=20_000).count() == n and len(rounds) <= 2


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "A", "x", 1), (2, "a", "y", 2), (3, None, "z", 3), (4, "", "w", 4), (2, "a", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string, c0 int")
    assert sorted(tuple(r) for r in E.drop_exact_duplicates(df).collect()) == [(2, "a", "y", 2), (4, "", "w", 4)]
    assert E.drop_exact_duplicates(df).columns == df.columns


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.exact_duplicates(empty).count() == 0 and E.drop_exact_duplicates(empty).count() == 0


def test_table_refuses_contents_not_records():
    t = E.ContentTable(500)
    assert t.add(b"d" * 32, b"x" * 100, 1, 1, 1) and not t.add(b"e" * 32, b"y" * 400, 2, 1, 1)
    assert t.add(b"d" * 32, b"x" * 100, 7, 2, 1) and t.rows[0][2:] == [7, 3, 1]
    many = E.ContentTable(1 << 20)
    assert all(many.add(hashlib.sha256(bytes([i % 256, i // 256])).digest(), bytes([i % 256, i // 256]), i, 1, 1) for i in range(3000))
    assert len(many.rows) == 3000


@pytest.mark.parametrize("fan_out", [2, 5])
def test_levels_of_bounded_fan_out(spark, monkeypatch, fan_out):
    """More buckets than one shuffle may have: groups are written and dealt out by themselves, two levels and more."""
    levels, widths = [], []
    real, width = E.cut_by, type(spark.range(1)).repartition

    def counted(df, n, *by):
        widths.append(n)
        return width(df, n, *by)

    monkeypatch.setattr(E, "cut_by", lambda df, c: levels.append(df) or real(df, c))
    monkeypatch.setattr(type(spark.range(1)), "repartition", counted)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    rows = [(i, f"text {i % 90} " * 8) for i in range(200)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df, table_bytes=2000, fan_out=fan_out) == expected(rows)
    assert len(levels) > 2 and max(widths) <= fan_out
