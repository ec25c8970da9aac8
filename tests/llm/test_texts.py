"""Line and substring dedup, decontamination, URLs, chat."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnwake.llm import chat_format, decontaminate, language_id, line_dedup, substring_dedup, url_filter

from .brute import contained

SCHEMA = "doc_id long, text string"


# ---------------------------------------------------------------- lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def edits_of_lines(rows, min_chars=10):
    seen, out = [], {}
    for d, j, s in sorted({(d, j, s.strip(" ").lower()) for d, t in rows if t is not None for j, s in enumerate(t.split("\n"))}):
        if not s:
            out[d, j] = None
            continue
        equal = any(s == o for o in seen)
        near = any(min(len(s), len(o)) >= min_chars and within_one(s, o) for o in seen)
        out[d, j] = 0 if equal else 1 if near else None
        seen.append(s)
    return out


def test_lines_against_brute_force(spark):
    rng, rows = random.Random(3), []
    base = ["".join(rng.choice("abcde ") for _ in range(rng.choice([9, 10, 11, 12, 15, 30, 70]))) for _ in range(25)]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, o = rng.randrange(len(s) + 1), rng.randrange(3)
                s = s[:k] + ("" if o == 1 else rng.choice("abcdeé")) + s[k + (o > 0) :]
            lines.append(s)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " Tail\nx" + "y" * 3000), (104, "x" + "y" * 2999)]
    got = line_dedup.line_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(r["doc_id"], r["line_no"]): r["edits"] for r in got} == edits_of_lines(rows)
    assert all(r["kept"] == (r["edits"] is None) == (r["first_doc_id"] is None) for r in got)


def test_long_lines_and_clashing_names(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1100, 20_000, 20_001)]
    rows = []
    for i in range(24):
        s = rng.choice(base)
        for _ in range(rng.choice([1, 1, 2])):
            k, o = rng.choice([0, 1, len(s) - 1, rng.randrange(len(s))]), rng.randrange(3)
            s = s[:k] + ("" if o == 1 else "z") + s[k + (o > 0) :]
        rows.append((i, s, "x", "y", "z"))
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, first string, key string").repartition(3)
    got = {(r["doc_id"], r["line_no"]): r["edits"] for r in line_dedup.line_duplicates(df).collect()}
    want = edits_of_lines([r[:2] for r in rows])
    assert got == want and 1 in want.values()


def test_windows_are_narrow_whatever_the_line(spark):
    text = spark.createDataFrame([("a" * 300_000, 1), ("b" * 300_001, 0), ("b" * 300_000, 1)], "w string, short int")
    rows = text.selectExpr("0L h", "0L g", "0 first", "0L key", "short", "w")
    got = line_dedup.split_windows(rows, 300_000).selectExpr("max(length(w) - 1 + short) m", "count(*) n").first()
    assert got["m"] <= line_dedup.WIDTH and got["n"] > 0


def test_cuts_write_few_files_whatever_the_shuffle(spark, monkeypatch):
    written = []
    for name, count in (("cut", lambda df: df.rdd.getNumPartitions()), ("cut_small", lambda df: len(df.inputFiles()))):
        monkeypatch.setattr(line_dedup, name, lambda df, f=getattr(line_dedup, name), count=count: written.append(count(out := f(df))) or out)
    for key, value in {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(key, value)
    try:
        rows = [(i, f"a line of text {i % 7}\nanother line of text {i}") for i in range(60)]
        got = line_dedup.line_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["doc_id"], r["line_no"]): r["edits"] for r in got} == edits_of_lines(rows)
    assert len(written) >= 5 and max(written) <= 16


def test_repeated_rows_keep_one_line(spark):
    df = spark.createDataFrame([(1, "a line of text"), (1, "a line of text"), (None, "a line of texts")], SCHEMA)
    got = sorted((str(r["doc_id"]), r["kept"]) for r in line_dedup.line_duplicates(df).collect())
    assert got == [("1", False), ("1", False), ("None", True)]
    assert line_dedup.line_duplicates(df.limit(0)).count() == 0


# ---------------------------------------------------------------- spans


def words(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) + ("." if i % 9 == 8 else ""))
    return " ".join(out) + "."


def test_repeated_passages_go_but_for_the_first(spark):
    passage = words(55, 99)
    own = {i: (words(60, i), words(45, 50 + i)) for i in range(8)}
    rows = [(i, f"{a}\n{passage.upper() if i % 2 else passage}\n{b}") for i, (a, b) in own.items()] + [(20, words(80, 20)), (21, None), (22, ""), (23, "..."), (24, "Short one.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string").repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.clean(df).collect()}
    for i, (a, b) in own.items():
        text = got[i]["text"]
        if i == 0:
            assert text == rows[0][1] and got[i]["__removed"] == 0
        else:
            assert passage.lower()[5:-5] not in text.lower() and a in text and b in text
            assert got[i]["__removed_words"] == 55
    for d, t in rows[8:]:
        assert got[d]["text"] == t and got[d]["__removed"] == 0
    assert set(got[20].asDict()) == {"doc_id", "text", "removed", "__sentences", "__removed", "__removed_words"}


def units(text):
    """Sentences as the operator cuts them, from its own word hashes."""
    import pyarrow as pa

    raw, off = substring_dedup.utf8_buffer(pa.array([text]))
    hashes, first, _, _ = substring_dedup.sentences(raw, off)
    edge = [*first.tolist(), len(hashes)]
    return [tuple(hashes[a:b].tolist()) for a, b in zip(edge, edge[1:])]


def test_spans_against_brute_force(spark):
    rng = random.Random(4)
    lines = [words(rng.randrange(4, 20), s) for s in range(12)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randrange(2, 7)))) for i in range(40)]
    first, removed = {}, defaultdict(set)
    for d, t in rows:
        u = units(t)
        for i in range(len(u)):
            j = i + 2
            while j <= len(u) and sum(map(len, u[i:j])) < 12:
                j += 1
            if j <= len(u):
                key = tuple(x for s in u[i:j] for x in s)
                if key in first:
                    removed[d] |= set(range(i, j))
                first.setdefault(key, (d, i))
    got = {r["doc_id"]: r["__removed"] for r in substring_dedup.clean(spark.createDataFrame(rows, SCHEMA).repartition(4), 2, 12, tails=False).collect()}
    assert got == {d: len(removed[d]) for d, _ in rows}
    twice = substring_dedup.clean(spark.createDataFrame([rows[0], rows[0]], SCHEMA), 2, 1000).collect()
    assert len(twice) == 2
    assert substring_dedup.clean(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_cover_every_repeated_run(spark):
    rng = random.Random(14)
    lines = [words(rng.randrange(1, 20), s) for s in range(14)]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randrange(2, 9)))) for i in range(60)]
    cut = {d: units(t) for d, t in rows}
    first, removed = {}, {d: set() for d, _ in rows}
    for d, u in cut.items():
        for i in range(len(u)):
            for j in range(i + 2, len(u) + 1):
                key = tuple(x for s in u[i:j] for x in s)
                if len(key) >= 12 and first.setdefault(key, (d, i)) != (d, i):
                    removed[d] |= set(range(i, j))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r["__removed"] for r in substring_dedup.clean(df, 2, 12, tails=True).collect()}
    assert got == {d: len(x) for d, x in removed.items()}
    assert sum(got.values()) > sum(r["__removed"] for r in substring_dedup.clean(df, 2, 12, tails=False).collect())


def plain_sentences(text):
    """(place of its first word, its words) of each sentence, cut at . ! ? and line ends only."""
    out, end = [], None
    for m in re.finditer(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text):
        if end is None or re.search(r"[.!?\n]", text[end : m.start()]):
            out.append((m.start(), []))
        out[-1][1].append(m[0].lower())
        end = m.end()
    return out


def test_texts_against_brute_force_with_its_own_cutter(spark):
    """Words whose hash ends no sentence, so that punctuation alone does."""
    import pyarrow as pa

    hashed = lambda t: substring_dedup.word_hashes(*substring_dedup.utf8_buffer(pa.array([t])), substring_dedup._TABLE)[0]
    vocabulary = [w for w in (f"w{i}é" for i in range(300)) if hashed(w)[0] % 16]
    rng = random.Random(21)
    lines = ["! ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 15))) for _ in range(rng.choice([1, 1, 2]))) for _ in range(14)]
    ends = [". ", "? ", "\n", " .\n"]
    rows = [(i, "".join((s.replace("w", "W") if rng.random() < 0.3 else s) + rng.choice(ends) for s in (rng.choice(lines) for _ in range(rng.randrange(1, 9))))) for i in range(60)]
    rows += [(None, rows[7][1] + "tail w1é"), (70, ""), (71, None), (72, "..."), (73, " ".join(r[1] for r in rows[:9]) * 2)]
    first, gone, cut = {}, {}, {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        cut[d], gone[d] = plain_sentences(t or ""), set()
        for i in range(len(cut[d])):
            key = ()
            for j in range(i, len(cut[d])):
                key += tuple(cut[d][j][1])
                if j > i and len(key) >= 12 and first.setdefault(key, (d, i)) != (d, i):
                    gone[d] |= set(range(i, j + 1))
    got = {r["doc_id"]: r for r in substring_dedup.clean(spark.createDataFrame(rows, SCHEMA).repartition(4), 2, 12).collect()}
    for d, t in rows:
        if not cut[d]:
            assert got[d]["text"] == t
            continue
        at = [0, *(place for place, _ in cut[d][1:]), len(t)]
        assert got[d]["text"] == "".join(t[at[i] : at[i + 1]] for i in range(len(cut[d])) if i not in gone[d])
        assert got[d]["__removed_words"] == sum(len(cut[d][i][1]) for i in gone[d])
    assert sum(map(len, gone.values())) > 100


def test_a_long_sentence_is_several(spark):
    import pyarrow as pa

    hashes = lambda t: substring_dedup.word_hashes(*substring_dedup.utf8_buffer(pa.array([t])), substring_dedup._TABLE)[0]
    plain = [w for w in (f"w{i}" for i in range(200)) if hashes(w)[0] % 16][:51]
    own = lambda i: " ".join(f"{c}{i}." for c in "abcdefgh")
    rows = [(i, f"{own(i)} {' '.join(plain)}. {own(i + 5)}") for i in range(2)]
    assert len(units(" ".join(plain))) > 1 and len(units(" ".join(plain[:30]))) > 1
    got = {r["doc_id"]: r["text"] for r in substring_dedup.clean(spark.createDataFrame(rows, SCHEMA), tails=True).collect()}
    assert got[0] == rows[0][1] and plain[0] not in got[1].split() and plain[-1] not in got[1]


# ---------------------------------------------------------------- leaks


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_leaks_against_brute_force(spark, limit):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 9, 14, 30, 59]))) for i in range(20)] + [(50, None), (51, ""), (52, "v1, V2; v3 v4 v5")]
    docs = []
    for d in range(60):
        parts = [text(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            parts += [" ".join(w).upper(), text(rng.randrange(3))]
        docs.append((d, " ".join(parts)))
    docs += [(90, None), (91, ""), (92, "V1 v2 v3 v4 v5"), (92, "V1 v2 v3 v4 v5"), (93, text(9000) + " " + items[19][1])]
    df, it = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, it, broadcast_bytes=limit).collect()
    want = contained(docs, items)
    assert want and sorted((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in got) == sorted(want)
    kept = {r["doc_id"] for r in decontaminate.drop_leaked(df.withColumn("row", F.lit(1)), it, broadcast_bytes=limit).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in want}
    assert decontaminate.leaks(df.limit(0), it, broadcast_bytes=limit).count() == 0
    assert decontaminate.leaks(df, it.limit(0), broadcast_bytes=limit).count() == 0
    # Nulls are values, clashing names do no harm, and a phrase of many items is found in each.
    tail = " a phrase that every item of this set ends with"
    items = [(1, "one two three four five six" + tail), (1, "one two three four five six" + tail), (1, "seven eight nine ten" + tail), (None, "eleven twelve thirteen" + tail), (None, None)]
    docs = [(1, items[0][1], "a", 1), (None, f"x {items[2][1]} y", "b", 2), (None, items[3][1], "c", 3), (None, items[3][1], "c", 3), (4, tail, "d", 4), (5, None, "e", 5), (None, "", "f", 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row_key string, item_id int").repartition(2)
    it = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, shingle string")
    got = decontaminate.leaks(df, it, broadcast_bytes=limit).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["shared"], r["item_shingles"]) for r in got) == [("1", "1", 12, 12), ("None", "1", 10, 10), ("None", "None", 9, 9)]
    kept = decontaminate.drop_leaked(df, it, broadcast_bytes=limit)
    assert kept.columns == df.columns and sorted(r["item_id"] for r in kept.collect()) == [4, 5, 6]


# ---------------------------------------------------------------- URLs

RULES = [url_filter.Rule.of(v, t) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def test_rules(spark):
    rows = [
        (1, "https://A.Example.com/en/71?x=1#y", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        (2, "http://notexample.com/en/71", "notexample.com", "/en/71", "com/en/", "block"),
        (3, "http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        (4, "http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        (5, "http://es.org/es/", "es.org", "/es/", "org/es/", "block"),
        (6, "no scheme.com/en/", "", "", None, None),
        (7, None, "", "", None, None),
        (8, "ftp://HOST?q/en/", "host", "", None, None),
        (9, "a://b://c/d", "b:", "//c/d", None, None),
        (10, "x://", "", "", None, None),
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u, *_ in rows], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES).collect()}
    for i, _, host, path, rule, verdict in rows:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), i
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.filter("page_id > 5"), RULES).collect()} == {"allow"}


def test_scores_against_brute_force(spark):
    rng = random.Random(8)
    urls = [f"https://{rng.choice(['a', 'bb', 'c1'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(90)}" for _ in range(150)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES).collect()}
    strings = {i: "^^" + re.sub("[0-9]", "0", r["host"] + r["path"]) + "$" for i, r in got.items()}
    counts = {v: Counter() for v in ("allow", "block")}
    for i, r in got.items():
        if r["rule"]:
            for j in range(len(strings[i]) - 2):
                counts[r["verdict"]][strings[i][j : j + 3]] += 1

    def p(v, g):
        out = 1 / len(url_filter.ALPHABET)
        for k in (1, 2, 3):
            kinds, total, hits = set(), 0, 0
            for gram, n in counts[v].items():
                if gram[3 - k : 2] == g[3 - k : 2]:
                    total, hits = total + n, hits + n * (gram[2] == g[2])
                    kinds.add(gram[2])
            if total:
                out = (hits + len(kinds) * out) / (total + len(kinds))
        return out

    for i in rng.sample(sorted(got), 12):
        s = strings[i]
        llr = [math.log(p("allow", s[j : j + 3]) / p("block", s[j : j + 3])) for j in range(len(s) - 2)]
        assert got[i]["score"] == pytest.approx(sum(llr) / len(llr), abs=1e-7)
    free = [(r["score"], r["verdict"]) for r in got.values() if not r["rule"]]
    allowed, blocked = ([s for s, v in free if v == x] for x in ("allow", "block"))
    assert not allowed or not blocked or min(allowed) > max(blocked)


# ---------------------------------------------------------------- chat


def test_models_see_the_whole_url(spark, monkeypatch):
    from turnwake.llm import queries

    urls = [f"https://a.example.net/de/{i}?page={i}" for i in range(30)] + [f"http://b.example.com/en/{i}?session=x#ad" for i in range(30)]
    own = ["https://c.example.fr/x", "https://c.example.fr/x?page=2", "https://c.example.fr/x?session=x#ad", "http://c.example.fr/x", "page=2", "session=x#ad", None, ""]
    df = spark.createDataFrame(list(enumerate(urls + own)), "page_id long, url string")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {r["page_id"]: r for r in queries.op6_url_filter(spark, "").collect()}
    score = [got[len(urls) + i]["score"] for i in range(len(own))]
    assert len(set(score)) == len(own) - 1 and score[6] == score[7]
    assert score[1] > score[2] and score[4] > score[5]
    assert all((got[len(urls) + i]["host"], got[len(urls) + i]["path"], got[len(urls) + i]["rule"]) == ("c.example.fr", "/x", None) for i in range(4))
    assert [got[len(urls) + i]["verdict"] for i in (4, 5)] == ["allow", "block"]


def test_chat_round_trip(spark):
    rng = random.Random(9)
    pieces = [*chat_format.CONTROL, "&lt;", "&", "plain", "é\n", "", " ", "\\", "[", "</", "$1"]
    convs = {i: [(t, rng.choice(["user", "assistant", "system", "a<b", None]), rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))])) for t in range(rng.randrange(1, 6))] for i in range(80)}
    convs[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = [(i, *t) for i, ts in convs.items() for t in ts]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = chat_format.format_conversations(df).persist()
    got = {r["conv_id"]: r for r in chat_format.digest(made).collect()}
    full = {r["conv_id"]: r for r in made.collect()}
    assert set(got) == set(convs)
    for i, turns in convs.items():
        source = [(r or "", t or "") for _, r, t in turns]
        assert [(t["role"], t["text"]) for t in full[i]["turns"]] == source
        loss = "".join(t for r, t in source if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in source)
        assert got[i]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (got[i]["n_turns"], got[i]["loss_chars"], got[i]["formatted_chars"]) == (len(source), len(loss), len(full[i]["formatted"]))
        assert len(re.findall(re.escape("[/INST]</s>"), full[i]["formatted"])) == len(source)
        assert (full[i]["rounds"] > 0) == any(c in t for _, t in source for c in chat_format.CONTROL)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_parser_refuses_what_is_not_of_the_grammar(spark):
    bad = ["", "<s>user[INST]a", "x<s>user[INST]a[/INST]</s>", "<s>user[INST]a<s>[/INST]</s>", "<s>user[INST]a[/INST]</s>tail"]
    df = spark.createDataFrame([(x,) for x in bad], "f string").select(chat_format.parse(F.col("f")).alias("t"))
    assert [r["t"] for r in df.collect()] == [[], None, None, None, None]


def test_sums_before(spark):
    rows = [([],), ([5],), (list(range(700)),), ([1] * 256,), ([2] * 257,)]
    for xs, got in spark.createDataFrame(rows, "x array<bigint>").select("x", chat_format.sums_before(F.col("x"))).collect():
        assert got == [sum(xs[:i]) for i in range(len(xs))]


def test_long_conversations_and_clashing_names(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>" if i % 97 == 0 else f"turn {i}", "x") for i in range(1500)] + [(None, 0, None, "a", "y"), (None, 1, "assistant", None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, all string").repartition(3)
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    one = got[1]
    assert [t["text"] for t in one["turns"]] == [r[3] for r in rows[:1500]]
    for s, r in zip(one["loss_spans"], rows[1:1500:2], strict=True):
        assert chat_format and one["formatted"][s["start"] : s["start"] + s["chars"]].replace("&lt;", "<") == r[3]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "a"), ("assistant", "")]


@pytest.mark.parametrize("seed", range(4))
def test_threshold_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(-400, 400) / 100, rng.choice([0, 0, 1, 3]), rng.choice([0, 1, 2])) for _ in range(80)]
    got = url_filter.threshold(spark.createDataFrame(rows, "score double, acc long, rej long"))
    acc, rej = sum(r[1] for r in rows), sum(r[2] for r in rows)
    steps = sorted({math.floor(s * 256) for s, a, r in rows if a + r})
    error = lambda k: sum(a for s, a, _ in rows if math.floor(s * 256) < k) / acc + sum(r for s, _, r in rows if math.floor(s * 256) >= k) / rej
    best = min([*steps], key=lambda k: (error(k), k))
    assert error(math.floor(got * 256)) == pytest.approx(error(best)) and got * 256 == best


def test_a_second_pass_writes_its_columns_over(spark):
    rows = [(1, "a b c d e f g. " * 6 + "x y z."), (2, "a b c d e f g. " * 6)]
    once = substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"), min_words=10)
    twice = substring_dedup.clean(once, min_words=10)
    assert twice.columns == once.columns and twice.select("__removed").count() == 2
    model = language_id.fit(spark.createDataFrame([("the cat sat on the mat", "en"), ("el gato duerme en la casa", "es")], "text string, lang string"))
    told = language_id.predict(spark.createDataFrame([(1, "the cat", "old", 0.5)], "doc_id long, text string, lang_pred string, score double"), model, "doc_id", "lang_pred", "score")
    assert told.columns == ["doc_id", "lang_pred", "score", "ambiguous", "far"] and told.first()["lang_pred"] != "old"


def test_thresholds_are_fractions(spark):
    item = "a b c d e f g"  # three shingles of five words
    docs = spark.createDataFrame([(1, "a b c d e f x"), (2, item), (3, "a b c d e y")], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    for broadcast in (8 << 20, 0):
        for third in (2 / 3, "2/3"):
            assert sorted(r["doc_id"] for r in decontaminate.leaks(docs, items, containment=third, broadcast_bytes=broadcast).collect()) == [1, 2]
        assert [r["doc_id"] for r in decontaminate.leaks(docs, items, containment=0.67, broadcast_bytes=broadcast).collect()] == [2]
    assert [decontaminate.needed(n, 0.8) for n in (1, 5, 6, 1000)] == [1, 4, 5, 800]


def test_digest_takes_time_linear_in_the_turns(spark):
    def took(n: int) -> float:
        rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat(repeat('word ', 18), id, if(id % 7 = 0, '</s>', '')) text")
        begun = time.time()
        assert chat_format.digest(chat_format.format_conversations(rows)).first()["n_turns"] == n
        return time.time() - begun

    took(100)
    assert took(16_000) < 5 * max(took(4_000), 0.5)
