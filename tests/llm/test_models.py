"""Packing, language, personal data, the pipeline."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from turnwake.llm import language_id, packing, pii

from .brute import contained, fold, jaccard_components

JSON, RANKS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEST = "/root/testdata/sf0.001"


@functools.cache
def both_encoders():
    return packing.Encoder(JSON, RANKS), Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoders():
    return both_encoders()


def ids(encoded):
    return np.frombuffer(encoded, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é'st1,.\n\t \u00a0\u3000字!"), max_size=60))
def test_encoder_equals_the_tokenizer(text):
    fast, slow = both_encoders()
    assert ids(fast(text)) == slow.encode(text, add_special_tokens=False).ids


def test_encoder_on_documents(spark, encoders):
    fast, slow = encoders
    for r in spark.read.parquet(f"{TEST}/documents.parquet").select("text").collect()[:120]:
        assert ids(fast(r["text"])) == slow.encode(r["text"], add_special_tokens=False).ids
    assert ids(fast("a <|endoftext|> b")) == slow.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_packing(spark, encoders):
    _, slow = encoders
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TEST}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "word " * 3000), (-3, "word " * 3000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, length string").repartition(3)
    rows = packing.pack(df, JSON, RANKS).collect()
    wanted = sorted((d, tuple([*slow.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in docs)
    by_doc = defaultdict(int)
    for d, t in wanted:
        by_doc[d, len(t)] += 1
    spans, total = defaultdict(list), 0
    pieces = defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= 1024
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"]].append(r)
        total += r["length"]
    assert total == sum(len(t) for _, t in wanted)
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for d, t in dict(wanted).items():
        size, start, k = (len(t) - 1) % 1024 + 1, 0, 0
        while start < len(t):
            r = pieces[d, k][0]
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, size, zlib.crc32(np.array(t[start : start + size], "<u4").tobytes()))
            start, size, k = start + size, 1024, k + 1
    assert len(spans) <= total / 1024 * 1.03 + 2
    assert packing.pack(df.limit(0), JSON, RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_best_two_fit_uses_every_piece_once(histogram):
    bins = packing.best_two_fit(histogram, 64)
    used = defaultdict(int)
    for layout, times in bins:
        assert sum(layout) <= 64 and times > 0
        for x in layout:
            used[x] += times
    assert dict(used) == histogram
    # No two bins could be one, so at most one is half empty.
    fills = sorted(sum(layout) for layout, times in bins for _ in range(min(times, 2)))
    assert len(fills) < 2 or fills[0] + fills[1] > 64


def piece_by_piece(lengths, capacity):
    """Best-two-fit on single pieces: (bins, each its lengths)."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            left.remove(fits[-1])
            own.append(fits[-1])
            gap -= fits[-1]
        while gap and len(own) > 1:
            small = min(own)
            two = [(a + b, -a) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= small + gap]
            if not two:
                break
            total, a = max(two)
            own.remove(small)
            # What is taken out can be packed again, but not into this bin.
            for x in (-a, total + a):
                left.remove(x)
                own.append(x)
            left = sorted([*left, small])
            gap = capacity - sum(own)
        bins.append(tuple(sorted(own, reverse=True)))
    return bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_best_two_fit_against_single_pieces(lengths):
    got = packing.best_two_fit(Counter(lengths), 40)
    want = piece_by_piece(lengths, 40)
    assert sum(n for _, n in got) == len(want)
    assert Counter({}) + sum((Counter({b: n}) for b, n in got), Counter()) == Counter(want)


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(docs["doc_id"])
    model = language_id.fit(docs.filter(~out).select("text", "lang"), per_label=100)
    got = language_id.predict(docs.filter(out), model, "doc_id", "lang").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    one = {r["lang"]: r["text"][:700] for r in docs.filter("length(text) > 800").select("lang", "text").collect()}
    rows = [(1, one["de"] + " " + one["fr"]), (2, "12 ..."), (3, None), (4, ""), (5, one["en"].upper()), (5, one["en"].upper())]
    odd = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, "doc_id").collect()
    assert odd[0]["score"] < 0.999 and [r["lang_pred"] for r in odd[1:]] == ["und", "und", "und", "en", "en"]
    assert [r["score"] for r in odd[1:4]] == [0, 0, 0] and all(0 <= r["score"] <= 1 for r in odd)
    rows = [(None, "½ ² Ⅷ 7_"), (None, "ab ½"), (1, " ".join(one[x] for x in sorted(one)) * 200)]
    names = "score long, text string"
    got = language_id.predict(spark.createDataFrame(rows, names), model, "text").collect()
    assert got[0]["lang_pred"] == "und" and got[1]["lang_pred"] != "und" and got[2]["lang_pred"] in one
    none = language_id.fit(docs.limit(0))
    assert none is None and language_id.predict(docs.limit(2), none, "doc_id").collect()[0]["lang_pred"] == "und"


def test_equal_margins_are_ambiguous():
    model = language_id.Model(["a", "b"], np.eye(2, language_id.DIM, dtype=np.float32), np.array([0, 1]), gap=1.0)
    best, score, unsure, _ = model.decode(np.zeros((1, language_id.DIM), np.float32))
    assert unsure[0] and 0.4 < score[0] < 0.8
    best, score, unsure, _ = model.decode(np.eye(2, language_id.DIM, dtype=np.float32))
    assert list(best) == [0, 1] and not unsure.any()


def test_decoding_against_brute_force():
    rng = np.random.default_rng(5)
    x = rng.random((40, language_id.DIM)).astype(np.float32)
    model = language_id.Model([*"abcde"], x, np.arange(40) % 5, gap=2.0, steps=20)
    for row, best, score, unsure, loss in zip(x, *model.decode(x), strict=True):
        margins = [max(-20.0, min(20.0, float(row @ model.w[:, j] + model.b[j]))) for j in range(model.code.shape[1])]
        losses = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margins, strict=True)) for word in model.code.tolist()]
        ranked = sorted(losses)
        assert losses[best] == pytest.approx(ranked[0], abs=1e-3) and loss == pytest.approx(ranked[0] / len(margins), abs=1e-4)
        assert score == pytest.approx(1 / sum(math.exp(ranked[0] - v) for v in losses), abs=1e-3)
        assert unsure == (ranked[1] - ranked[0] < 2.0) or abs(ranked[1] - ranked[0] - 2.0) < 1e-3


def test_copies_are_drawn_once_and_rows_are_bounded(spark):
    rows = [(f"the same text {i // 2000}", "en") for i in range(6000)] + [(f"ein text {i}", "de") for i in range(3000)] + [(None, "de"), ("x", None)]
    got = language_id.drawn(spark.createDataFrame(rows, "text string, lang string").repartition(4), 50).collect()
    n = Counter(r["lang"] for r in got)
    assert n == {"en": 3, "de": 50}


def test_what_is_in_no_learnt_language_is_far(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(6)
    odd = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)) for _ in range(12)]
    odd += ["Это русский текст про данные, модели и таблицы. " * 3, "中文文本测试数据" * 5, None, "12 345", ""]
    planted = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema)
    two = {r["lang"]: r["text"] for r in docs.filter("length(text) > 800").collect()}
    mixed = spark.createDataFrame([(10**9, two["en"][:400] + " " + two["de"][:400], "en")], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(planted).unionByName(mixed), "").collect()}
    assert min(kept) >= 0 and 10**9 in kept and len(kept) >= 0.995 * docs.count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a.@-+1490 (%_é\n"), max_size=50))
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_patterns_on_usual_forms():
    text = "x@y.z@q.w a.b+c@d-e.f.g 4539 1488 0343 6467 +1 (626) 555-5759 001.2.3.255.6 1.2.3.256 4539-1488-0343-6468 é@b.c @x.y"
    assert pii.base_spans(text) == plain_spans(text) and len(plain_spans(text)) == 5
    assert pii.base_spans("1" * 20000 + "." + "2" * 20000) == [] and pii.base_spans("a" * 50000 + "@") == []


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(1)
    common = [f"word{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, some(40)) for i in range(200)]
    rows += [(300 + i, f"{some(9)} Zanzibar {some(1)} joe@corp.example {some(9)}") for i in range(6)]
    rows += [(400 + i, "Copied Quokka ann@corp.example again") for i in range(9)] + [(500, None), (501, ""), (501, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(3)
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        base = plain_spans(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert all(f"{pii.KINDS[k]}:{a}:{b}" in r["spans"].split(",") for a, k, b in base)
        terms = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term:")]
        if 300 <= r["doc_id"] < 400:
            assert [text[a:b] for a, b in terms] == ["Zanzibar"]
            clean = pii.sanitise(text, r["actions"])
            assert "Zanzibar" not in clean and "[EMAIL]" in clean
        else:
            assert terms == [] and r["n_term"] == 0
    assert pii.find(df.limit(0)).count() == 0 and pii.sanitise(None, []) is None


def flagged_words(rows, got):
    """{doc_id: the words of its term spans}"""
    text = {d: t for d, t, *_ in rows}
    return {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["actions"] if s["kind"] == 4] for r in got}


def test_terms_of_rare_entities(spark):
    rng = random.Random(2)
    some = lambda n: " ".join(f"word{rng.randrange(30)}" for _ in range(n))
    rows = [(i, some(12)) for i in range(4000)] + [(5000, f"{some(3)} Xanadu kim@corp.example {some(3)}")]
    found = flagged_words(rows, pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found.pop(5000) == ["Xanadu"] and not any(found.values())
    # In a small corpus a single place proves little, three of one document do.
    rows = [(i, some(40)) for i in range(200)] + [(300, f"{some(9)} Ophir lee@corp.example {some(9)}")]
    rows += [(301, " ".join(f"{some(9)} Ultima kay@corp.example {some(9)}" for _ in range(3)))]
    found = flagged_words(rows, pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found.pop(301) == ["Ultima"] * 3 and not any(found.values())


def test_terms_are_sought_in_whole_documents(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(f"wörd{rng.randrange(30)}" for _ in range(n))
    rows = [(i, some(40)) for i in range(400)]
    rows += [(500 + i, f"Zanzibar {some(200)} {rng.getrandbits(64):x}{'q' * 500} joe@corp.example {some(9)} ZANZIBAR, joe@zanzibar.example") for i in range(6)]
    rows += [(600, f"{some(20)} zanzibar {some(20)}")]
    found = flagged_words(rows, pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert all(found.pop(500 + i) == ["Zanzibar", "ZANZIBAR"] for i in range(6)) and found.pop(600) == ["zanzibar"]
    assert not any(found.values())


def plain_terms(rows, window=5, sure=0.8, generalise=0.8):
    """The words that reveal an entity, by counting everything."""
    word = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    docs_of, of_entity, seen = defaultdict(set), defaultdict(set), defaultdict(set)
    free_of = {}
    for i, (_, t) in enumerate(rows):
        t = t or ""
        spans = plain_spans(t)
        found = [(m.start(), m.end(), fold(m[0])) for m in word.finditer(t)]
        for _, _, w in found:
            docs_of[w].add(i)
        free = [x for x in found if not any(a < x[1] and x[0] < e for a, _, e in spans)]
        free_of[i] = {w for *_, w in free}
        for a, k, e in spans:
            around = (tuple(w for _, end, w in free if end <= a)[-window:], tuple(w for start, _, w in free if start >= e)[:window])
            of_entity[k, t[a:e].lower()].add(i)
            seen[k, t[a:e].lower(), i].add(around)
    total, out = len(rows), set()
    z = NormalDist().inv_cdf(sure)
    for e, where in of_entity.items():
        if len(where) == total:
            continue
        for w in set().union(*(free_of[i] for i in where)):
            both = [i for i in where if w in free_of[i]]
            n = len(set().union(*(seen[(*e, i)] for i in both)))
            certain = 3 * math.log2(max(1e-300, 1 - 1 / (9 * n) - z / (3 * math.sqrt(n))))
            share = (math.log2(total * len(both) / (len(where) * len(docs_of[w]))) + certain) / math.log2(total / len(where))
            if share >= generalise:
                out.add(w)
    return out


def test_terms_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"t{i}" for i in range(60)]
    mails = [f"u{i}@x.example" for i in range(12)]
    rows = []
    for i in range(220):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 25))]
        for _ in range(rng.choice([0, 0, 0, 1, 1, 3])):
            k = rng.randrange(12)
            words.insert(rng.randrange(len(words) + 1), rng.choice([mails[k], mails[k].upper()]))
            words.insert(rng.randrange(len(words) + 1), f"Only{k % 7}" if rng.random() < 0.8 else "other")
        rows.append((i, " ".join(words)))
    rows += [(None, rows[3][1]), (None, None), (500, ""), (501, "Solo9 " * 3 + "10.1.2.3 " + " ".join(vocabulary) * 40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, actions string, near int").repartition(3)
    want = plain_terms(rows)
    assert want
    texts = dict(rows)
    for r in pii.find(df).collect():
        text = texts[r["doc_id"]] if r["doc_id"] is not None else None
        if text:
            said = [fold(text[s["start"] : s["end"]]) for s in r["actions"] if s["kind"] == 4]
            free = [w for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", fold(re.sub(EMAIL, " ", re.sub(IP, " ", text)))) if w in want]
            assert sorted(said) == sorted(free)
    clean = pii.sanitised(df).collect()
    assert len(clean) == len(rows) and not any(re.search(EMAIL, r["text"] or "") for r in clean)
    assert sorted(r["text"] is None for r in clean) == [False] * (len(rows) - 1) + [True]


def test_mentions_cost_linear_time():
    def seconds(n):
        text = " ".join(f"word{i} user{i}@corp.example" for i in range(n))
        t = time.perf_counter()
        spans = pii.base_spans(text)
        list(pii.free_words(pa.array([text]), [spans]))
        return time.perf_counter() - t

    seconds(500)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.01)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TEST}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, TEST).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        if name == "language":
            assert {d for d, t in before if re.search(r"[^\W\d_]", t or "")} >= kept and len(kept) >= 0.99 * len(before)
        elif name == "exact":
            last = {}
            for d, t in before:
                last[fold(t)] = max(d, last.get(fold(t), d))
            assert kept == set(last.values())
        elif name == "near":
            assert kept == {c for _, c in jaccard_components(before, 5, 80).values()}
        elif name == "leaks":
            assert kept == {d for d, _ in before} - {d for d, *_ in contained(before, bench)}
        else:
            assert kept == {d for d, _ in before}
        assert name == "packing" or docs.columns == columns


def test_mirrored_directories_are_counted_once(spark, monkeypatch):
    """Two mirrored documents of many addresses and words: the pairs that are counted do not grow with either."""
    sizes = []
    real = pii.entity_classes
    monkeypatch.setattr(pii, "entity_classes", lambda m, t: sizes.append(["entities", (e := real(m, t)).count()]) or e)
    terms = pii.term_classes
    monkeypatch.setattr(pii, "term_classes", lambda t: sizes.append(["terms", (x := terms(t)).select("like").distinct().count()]) or x)
    for n in (50, 1000):
        page = " ".join(f"name{i} a{i}@example.org " + " ".join(f"w{i}x{j}" for j in range(10)) for i in range(n))
        rows = [(1, page), (2, page)] + [(10 + i, f"filler{i} text of no one") for i in range(300)]
        flagged = pii.disclosing(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8, 0.8)
        sizes.append(["flagged", flagged.count() > 0])
    assert sizes[:3] == sizes[3:] and sizes[0][1] <= 4 and sizes[1][1] <= 4
