"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One linear classifier per bit, on hashed character
n-grams of the lower-cased letters, predicts a margin; decoding sums the logistic loss of
the margins against each codeword and takes the codeword of least loss. The score is the
share of the best codeword under exp(-loss), and a text is flagged ambiguous when the second
codeword comes within ``gap`` of the best. A text is flagged ``far`` when even the best codeword
costs more than ``far`` a bit: a coin flip costs log 2 = 0.69, gibberish and languages that were
not learnt cost 0.48 and more, texts of the learnt ones 0.05. A text in two languages is ambiguous,
not far; one of fewer than ENOUGH letters says too little to be far.

Classifiers are fitted on the driver to at most ``per_label`` different labelled texts a language
(documented bound, 400): those of the smallest hashes, chosen in Spark, so that copies count once
and only bounded count vectors travel. Prediction reads whole texts where they lie, without a
shuffle; what is sent along is one matrix of fixed size.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score
0, neither ambiguous nor far; with no labelled row every text is ``und``; of codewords of equal
loss the language first in order is told; of one text under two labels each label counts; repeated
rows are predicted each for itself; an empty table gives an empty result; other columns are ignored
by the prediction and never clash with its own, which come last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sealed

DIM = 1 << 12
ENOUGH = 20  # letters from which on a text can be far from every language
_KEEP = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of hashed 2- and 3-gram counts of a text's bytes, scaled to length 1."""
    raw = np.frombuffer(text.lower().encode().translate(_KEEP), np.uint8)
    out = np.zeros(DIM, np.float32)
    for lo in range(0, len(raw), 1 << 20):  # bounded slices of a very long text
        b = raw[lo : lo + (1 << 20) + 2].astype(np.uint32)
        if len(b) > 1:
            two = b[:-1] << 8 | b[1:]
            out += np.bincount(two * np.uint32(2654435761) >> np.uint32(20), minlength=DIM)
        if len(b) > 2:
            three = (two[:-1] << 8 | b[2:]) + np.uint32(1 << 25)
            out += np.bincount(three * np.uint32(2246822519) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def codewords(n: int, bits: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1 whose least distance is the largest of some hundred draws; no bit is constant."""
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        for j in range(bits):
            while n > 1 and abs(code[:, j].sum()) == n:
                code[:, j] = rng.choice([-1, 1], n)
        d = min((int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2)), default=bits)
        if d > far:
            best, far = code, d
    return best.astype(np.float32)


class Model:
    """Codewords, one linear classifier per bit, and the decoder."""

    def __init__(self, labels: list[str], x: np.ndarray, y: np.ndarray, gap: float, steps: int = 300) -> None:
        self.labels, self.gap = labels, gap
        self.code = codewords(len(labels), max(15, 5 * len(labels).bit_length()))
        target = self.code[y]
        weight = (1 / np.bincount(y, minlength=len(labels)))[y][:, None].astype(np.float32) / len(labels)
        self.w, self.b = np.zeros((DIM, self.code.shape[1]), np.float32), np.zeros(self.code.shape[1], np.float32)
        vw, vb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(steps):  # logistic loss, gradient descent with momentum
            g = -target * weight / (1 + np.exp(np.clip(target * (x @ self.w + self.b), -30, 30)))
            vw, vb = 0.9 * vw - 8.0 * (x.T @ g + 2e-3 * self.w), 0.9 * vb - 8.0 * g.sum(0)
            self.w, self.b = self.w + vw, self.b + vb

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best label, score, ambiguous, loss a bit of the best codeword) of each row."""
        margin = np.clip(x @ self.w + self.b, -20, 20)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        order = np.argsort(loss, 1, kind="stable")
        share = np.exp(loss.min(1, keepdims=True) - loss)
        near = np.take_along_axis(loss, order, 1)
        ambiguous = near[:, 1] - near[:, 0] < self.gap if loss.shape[1] > 1 else np.zeros(len(x), bool)
        return order[:, 0], 1 / share.sum(1), ambiguous, near[:, 0] / self.code.shape[1]


def letters(text: str | None) -> int:
    """How many letters a text has, ENOUGH at most."""
    return sum(1 for _ in islice(filter(str.isalpha, text or ""), ENOUGH))


def drawn(labelled: DataFrame, per_label: int) -> DataFrame:
    """(lang, draw, x): the features of at most ``per_label`` different texts of each language."""
    draw = F.xxhash64("text", F.lit(1)).alias("draw")
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string"), draw)
    # Languages are few; so many different texts each has, within a few percent.
    kinds = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    share = F.create_map(*(F.lit(v) for k, n in kinds.items() for v in (k, min(1.0, 1.4 * per_label / n + 20 / n)))) if kinds else F.create_map(F.lit(""), F.lit(0.0))
    below = F.shiftrightunsigned("draw", 11) / float(1 << 53) < F.element_at(share, F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            new = []
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            x = [features(b.column(1)[i].as_py()).astype(np.float16).tobytes() for i in new]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(new, pa.int64())), b.column(2).take(pa.array(new, pa.int64())), pa.array(x, pa.binary())], ["lang", "draw", "x"])

    some = rows.filter(below).mapInArrow(run, "lang string, draw bigint, x binary").dropDuplicates(["lang", "draw"])
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("draw", 11), "draw")
    return some.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= per_label).drop("i")


def fit(labelled: DataFrame, per_label: int = 400, gap: float = 1.0) -> Model | None:
    """``labelled``: (text, lang) rows. At most ``per_label`` different texts of each language are used."""
    got = sorted(drawn(labelled, per_label).collect(), key=lambda r: (r["lang"], r["draw"]))
    if not got:
        return None
    labels = sorted({r["lang"] for r in got})
    x = [np.frombuffer(bytes(r["x"]), np.float16).astype(np.float32) for r in got]
    return Model(labels, np.array(x), np.array([labels.index(r["lang"]) for r in got]), gap)


def predict(docs: DataFrame, model: Model | None, *keep: str | Column, far: float = 0.46) -> DataFrame:
    """The kept columns and lang_pred, score, ambiguous, far of each row's text; kept columns of these names are written over."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text_to_tell")).drop("lang_pred", "score", "ambiguous", "far")
    schema = rows.drop("__text_to_tell").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            lang, score, unsure, away = ["und"] * n, np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
            for lo in range(0, n, 256):
                texts = [(lo + i, t.as_py()) for i, t in enumerate(b.column(b.num_columns - 1)[lo : lo + 256])]
                texts = [(i, t, k) for i, t in texts if model is not None and (k := letters(t))]
                if texts:
                    for (i, _, k), best, s, u, loss in zip(texts, *model.decode(np.array([features(t) for _, t, _ in texts])), strict=True):
                        lang[i], score[i], unsure[i], away[i] = model.labels[best], s, u, loss > far and k >= ENOUGH
            cols = [*b.columns[:-1], pa.array(lang), pa.array(score), pa.array(unsure), pa.array(away)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "lang_pred", "score", "ambiguous", "far"])

    return rows.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean").add("far", "boolean"))


def keep_told(docs: DataFrame, model: Model | None, far: float = 0.46) -> DataFrame:
    """The documents in a learnt language, or in several, with all their columns.

    Documents that are ``und`` or far from every codeword go.
    """
    own, at, names = sealed(docs)
    told = predict(own.withColumn("text", at("text")), model, *own.columns, far=far)
    return told.filter("lang_pred <> 'und' AND NOT far").select(*own.columns).toDF(*names)


def held_out(doc_id: Column) -> Column:
    """Every fourth document by CRC-32 of its id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
