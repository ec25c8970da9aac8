"""Personal data: base patterns and information-theoretic sanitisation.

Base spans (email, ip, card, phone) are the protected entities. A term that stands in documents
of an entity discloses it as far as seeing the term makes the entity likely: with document counts
over the whole corpus, PMI(e; t) = log2(N * n(e, t) / (n(e) * n(t))) of the entity's
information IC(e) = log2(N / n(e)) is revealed. A term whose share PMI / IC is at least
``generalise`` is written as its kind, from ``remove`` on it is taken out, wherever in the corpus
it stands outside base spans. There is no least number of mentions: for n(e, t) stands what can be
said of it with confidence ``sure``, the lower limit of a Poisson mean seen as often as there are
different surroundings (``window`` words on both sides) of the entity in documents of the term,
also inside one document. Copies of one passage are so one piece of evidence, and one piece costs
2 bits: too much for an entity of a few bits, little for a rare one of a large corpus.

One pass finds mentions and terms of documents with entities, one counts the terms of all
documents (pre-aggregated in each task). As n(e, t) <= n(e), a term in more than
N ** (1 - g) * n(e) ** g documents cannot reveal the share g of e; only rarer ones are paired with
the entities of their documents. Entities that stand in the same documents alike are paired once, and so are terms of
the same documents, so that a page of many names and its mirror do not make a pair of each name and word. A last pass finds where the flagged terms stand: a bitmap of fixed
size over their hashes keeps most other words out, and a join on the hash decides.

Defined results: null text counts as empty and has no spans, and stays null when sanitised; a null
doc_id is carried along; repeated rows are treated each for itself and count as documents; of spans
that overlap the first by (start, kind) is acted on; a corpus whose every document holds an entity has
nothing to reveal about it (IC = 0); an empty table gives an empty result; other columns are ignored.
Texts of any length are read whole, spans in time linear in their number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, bit_array, bounded, byte_table, cut, cut_small, in_bits, utf8_buffer, word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never begins inside a run of digits, so the look-behind changes no result; it keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns, by start, then kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # the local part is the run left of an @, as far as the last match lets it
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((begin, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_TABLE = byte_table(NOT_ALNUM)
BASE = "base array<struct<start:int,kind:int,end:int>>"
COUNTS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string"


def free_words(text: pa.Array, spans: list[list[tuple[int, int, int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, starts, ends in characters) of the words of each text that touch no span."""
    raw, off = utf8_buffer(text)
    words, rows, starts, ends = word_hashes(raw, off, _TABLE)
    chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])
    at = np.searchsorted(rows, np.arange(len(spans) + 1))
    for i, found in enumerate(spans):
        part = slice(at[i], at[i + 1])
        w, a, b = words[part].view(np.int64), chars[starts[part]] - chars[off[i]], chars[ends[part]] - chars[off[i]]
        if found and len(w):
            reach = np.concatenate([np.zeros(1, np.int64), np.maximum.accumulate([e for *_, e in found])])
            free = reach[np.searchsorted([s for s, *_ in found], b, "left")] <= a
            w, a, b = w[free], a[free], b[free]
        yield w, a, b


def code(s: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


def scan(docs: DataFrame, window: int) -> DataFrame:
    """(uid, mentions, terms) of each document with base spans, keyed by a row number of the task."""
    pair = pa.list_(pa.struct([("entity", pa.int64()), ("window", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in (x for whole in batches for x in bounded(whole, 0)):
            texts = b.column(0).to_pylist()
            spans = [base_spans(t or "") for t in texts]
            some = [i for i, s in enumerate(spans) if s]
            if not some:
                continue
            mentions, terms = [], []
            for i, (w, start, end) in zip(some, free_words(b.column(0).take(pa.array(some)), [spans[i] for i in some]), strict=True):
                seen = set()
                for a, k, e in spans[i]:
                    before, after = np.searchsorted(end, a, "right"), np.searchsorted(start, e, "left")
                    around = np.concatenate([w[max(0, before - window) : before], np.zeros(1, np.int64), w[after : after + window]])
                    seen.add((code(f"{k}:{texts[i][a:e].lower()}".encode()), code(around.tobytes())))
                mentions.append([{"entity": x, "window": y} for x, y in sorted(seen)])
                terms.append(np.unique(w))
            ids, uid = pa.array(range(uid, uid + len(some)), pa.int64()), uid + len(some)
            yield pa.RecordBatch.from_arrays([ids, pa.array(mentions, pair), pa.array(terms, pa.list_(pa.int64()))], ["uid", "mentions", "terms"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "uid bigint, mentions array<struct<entity:bigint,window:bigint>>, terms array<bigint>")


def locate(docs: DataFrame, flagged: DataFrame, with_text: bool) -> DataFrame:
    """A row per document: base spans and the words that may be flagged terms, keyed by a row number of the task."""
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(bit_array(flagged, "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, bits = TaskContext.get().partitionId() << 40, shared.value
        for b in (x for whole in batches for x in bounded(whole, 1)):
            spans = [base_spans(t or "") for t in b.column(1).to_pylist()]
            counts = [[sum(k == i for _, k, _ in s) for s in spans] for i in range(4)]
            sha = [hashlib.sha256(joined(s).encode()).hexdigest() for s in spans]
            base = [[{"start": a, "kind": k, "end": e} for a, k, e in s] for s in spans]
            near = []
            for w, start, end in free_words(b.column(1), spans):
                hit = np.flatnonzero(in_bits(bits, w))
                near.append([{"term": t, "start": s, "end": e} for t, s, e in zip(w[hit].tolist(), start[hit].tolist(), end[hit].tolist(), strict=True)])
            n = b.num_rows
            ids, uid = pa.array(range(uid, uid + n), pa.int64()), uid + n
            text = b.column(1) if with_text else pa.nulls(n, pa.string())
            cols = [ids, b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(base, base_type), pa.array(near, near_type), text]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near", "text"])

    schema = f"uid bigint, doc_id bigint, {COUNTS}, {BASE}, near array<struct<term:bigint,start:int,end:int>>, text string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def document_frequencies(docs: DataFrame, flush: int = 3_000_000) -> DataFrame:
    """(term, n): in how many documents each term stands; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            t, c = np.concatenate(terms), np.concatenate(counts)
            order = np.argsort(t, kind="stable")
            t, c = t[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            return t[first], np.add.reduceat(c, first)

        def out(t: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], ["term", "n"])

        for b in (x for whole in batches for x in bounded(whole, 0)):
            raw, off = utf8_buffer(b.column(0))
            words, rows, _, _ = word_hashes(raw, off, _TABLE)
            if not len(words):
                continue
            order = np.lexsort((rows, words))
            w, r = words[order], rows[order]
            fresh = np.ones(len(w), bool)
            fresh[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
            t, c = np.unique(w[fresh], return_counts=True)
            terms.append(t.view(np.int64))
            counts.append(c.astype(np.int64))
            held += len(t)
            if held > flush:
                t, c = merged()
                if len(t) > flush // 2:
                    yield out(t, c)
                    terms, counts, held = [], [], 0
                else:
                    terms, counts, held = [t], [c], len(t)
        if terms:
            yield out(*merged())

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))


def certain(n: Column, sure: float) -> Column:
    """log2 of the lower limit of a Poisson mean over its observed count (Wilson-Hilferty)."""
    return 3 * F.log2(1 - 1 / (9 * n) - NormalDist().inv_cdf(sure) / (3 * F.sqrt(n)))


def set_hash(of: Column) -> list[Column]:
    """Sums that tell a set, or a multiset, by the hashes of its members; they cannot overflow."""
    h = F.xxhash64(of)
    return [F.count("*").alias("h0"), F.sum(h.bitwiseAND((1 << 32) - 1)).alias("h1"), F.sum(F.shiftrightunsigned(h, 32)).alias("h2")]


HASHED = ("h0", "h1", "h2")


def entity_classes(mentions: DataFrame, total: float) -> DataFrame:
    """(uid, n_entity, entity, windows: array<struct<docs, n>>): one entity for all that cannot be told apart, by document.

    Of an entity's windows counts only in which documents each stands; those of equal documents are one entry, ``n``
    of them. Entities whose windows stand in equal documents alike have equal counts with every term. Of entities that no
    other document has, the one with most windows has the largest share of every term.
    """
    places = mentions.groupBy("entity", "window").agg(*set_hash(F.col("uid")))
    places = cut_small(places.select("entity", "window", F.xxhash64(*HASHED).alias("docs")))
    kinds = cut_small(places.groupBy("entity", "docs").agg(F.count("*").alias("n")))
    signs = kinds.groupBy("entity").agg(*set_hash(F.struct("docs", "n")))
    seen = cut_small(mentions.select("uid", "entity").distinct())
    known = seen.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") < total)
    known = cut_small(known.join(signs, "entity"))
    several = known.filter("n_entity > 1").groupBy("n_entity", *HASHED).agg(F.min("entity").alias("entity")).select("entity", "n_entity")
    single = known.filter("n_entity = 1").join(kinds, "entity").join(seen, "entity")
    single = single.groupBy("uid").agg(F.max_by("entity", F.struct("n", "entity")).alias("entity")).select("entity", F.lit(1).cast("long").alias("n_entity"))
    chosen = cut_small(several.unionByName(single))
    own = mentions.join(chosen, "entity").join(places, ["entity", "window"]).select("uid", "entity", "n_entity", "docs").distinct()
    own = own.join(kinds, ["entity", "docs"])
    return cut_small(own.groupBy("uid", "n_entity", "entity").agg(F.collect_list(F.struct("docs", "n")).alias("windows")))


def term_classes(terms: DataFrame) -> DataFrame:
    """(term, like): terms of equally many documents in all, and of the same documents with entities, have one ``like``."""
    own = cut_small(terms.groupBy("term", "n_term").agg(*set_hash(F.col("uid"))))
    least = cut_small(own.groupBy("n_term", *HASHED).agg(F.min("term").alias("like")))
    return cut_small(own.join(least, ["n_term", *HASHED]).select("term", "like"))


def disclosing(docs: DataFrame, window: int, sure: float, generalise: float) -> DataFrame:
    """(term, share): the terms that reveal at least ``generalise`` of some entity's information."""
    total = float(docs.count())
    scanned = cut(scan(docs, window))
    spoken = entity_classes(scanned.select("uid", F.explode("mentions").alias("x")).select("uid", "x.entity", "x.window"), total)
    most = spoken.agg(F.max("n_entity")).first()[0] or 0
    cap = lambda n: F.pow(F.lit(total), 1 - generalise) * F.pow(n, generalise) * (1 + 1e-6)
    rare = cut_small(document_frequencies(docs).filter(F.col("n_term") <= cap(F.lit(float(most)))))
    bounds = spoken.groupBy("uid").agg(cap(F.max("n_entity")).alias("cap"))
    terms = scanned.select("uid", "terms").join(bounds, "uid").select("uid", "cap", F.explode("terms").alias("term"))
    terms = cut_small(terms.join(rare, "term").filter("n_term <= cap").select("uid", "term", "n_term"))
    alike = term_classes(terms)
    one = terms.join(alike.select(F.col("like").alias("term")).distinct(), "term", "left_semi")
    pairs = one.join(spoken, "uid").filter(F.col("n_term") <= cap(F.col("n_entity")))
    pairs = pairs.select("entity", "term", "n_entity", "n_term", F.posexplode("windows").alias("i", "w"))
    # Distinct documents and windows are counted in two steps, so that no group of copies meets in one task.
    pairs = pairs.groupBy("entity", "term", "n_entity", "n_term", "w").agg(F.sum((F.col("i") == 0).cast("long")).alias("n"))
    pairs = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("n").alias("n_pair"), F.sum("w.n").alias("windows"))
    info = F.log2(F.lit(total) / F.col("n_entity"))
    pmi = F.log2(F.lit(total) * F.col("n_pair") / (F.col("n_entity") * F.col("n_term")))
    share = F.round((pmi + certain(F.col("windows"), sure)) / info, 9)
    told = pairs.select("term", share.alias("share")).filter(F.col("share") >= generalise).groupBy("term").agg(F.max("share").alias("share"))
    return told.withColumnRenamed("term", "like").join(alike, "like").select("term", "share")


def find(docs: DataFrame, window: int = 5, sure: float = 0.8, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, actions): one row per document.

    actions: array<struct<start, kind, end, action>>, what sanitising does with each span.
    """
    return _found(docs, window, sure, generalise, remove, False).drop("text")


def sanitised(docs: DataFrame, window: int = 5, sure: float = 0.8, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(doc_id, text, n_spans): each document with its spans written as their kinds, or taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in bounded(whole, 1)):
            actions = b.column(2).to_pylist()
            text = [sanitise(t.as_py(), a) for t, a in zip(b.column(1), actions, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array([len(a) for a in actions], pa.int64())], ["doc_id", "text", "n_spans"])

    found = _found(docs, window, sure, generalise, remove, True).select("doc_id", "text", "actions")
    return found.mapInArrow(run, "doc_id bigint, text string, n_spans bigint")


def _found(docs: DataFrame, window: int, sure: float, generalise: float, remove: float, with_text: bool) -> DataFrame:
    flagged = cut_small(disclosing(docs, window, sure, generalise))
    scanned = cut(locate(docs, flagged, with_text))
    hits = scanned.select("uid", F.explode("near").alias("x")).select("uid", "x.term", "x.start", "x.end").join(flagged, "term")
    one = F.struct(F.col("start"), F.lit(4).alias("kind"), F.col("end"), F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("action"))
    terms = hits.groupBy("uid").agg(F.collect_list(one).alias("terms"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("generalise").alias("action")))
    out = scanned.join(terms, "uid", "left").withColumn("actions", F.sort_array(F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, F.col("terms")))))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("actions", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_term = F.coalesce(F.size("terms"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.greatest(n_term, F.lit(0).cast("long")).alias("n_term"), "actions", "text")


def sanitise(text: str | None, actions: list) -> str | None:
    """A text with its spans replaced by their kinds, or taken out; of overlapping spans the first counts."""
    if text is None:
        return None
    out, done = [], 0
    for s in actions or []:
        if s["start"] < done:
            continue
        out.append(text[done : s["start"]])
        if s["action"] == "generalise":
            out.append(f"[{KINDS[s['kind']].upper()}]")
        done = s["end"]
    return "".join([*out, text[done:]])
