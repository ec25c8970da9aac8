"""URL filtering by rules and a character language-model ratio.

Rules decide first; the longest that fits wins. Every other URL is judged by two character
models, one of accepted and one of rejected URLs, learnt from the URLs that rules decide.
Each model is a Markov chain of variable order: trigrams back off to bigrams, unigrams and
the uniform distribution by Witten-Bell interpolation. The score is the mean over a URL's
characters of log P(accepted) - log P(rejected); the threshold is calibrated on the decided
URLs, where the sum of both error rates is least.

Characters are mapped to a fixed alphabet, so a model has fewer than 80,000 trigrams whatever
the input; that is the proven size of the only broadcast. Everything is DataFrame functions.

Rules bind host and path; the models see the whole URL with ``whole`` (scheme, query and fragment
too, and URLs without ``://``), else host and path.

Defined results: a null URL, or one without ``://``, has empty host and path; to the models a null
URL is empty; repeated rows
are judged each for itself; with no decided URL of one kind every URL that no rule decides is
allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The alphabet: ``0`` stands for every digit, ``*`` for what is not listed, ``^`` and ``$`` for the ends.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_%?=&#~+:,*^$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def symbols(string: Column) -> Column:
    """A string over the alphabet, with both ends marked."""
    s = F.translate(string, UPPER + "123456789", LOWER + "0" * 9)
    return F.concat(F.lit("^^"), F.regexp_replace(s, r"(?s)[^a-z0./\-_%?=&#~+:,]", "*"), F.lit("$"))


def grams(strings: DataFrame, *keep: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 2))
    return strings.select(*keep, "s", at.alias("i")).select(*keep, F.substring(F.col("s"), F.col("i"), F.lit(3)).alias("gram"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, llr) for every trigram of the alphabet, from (gram, acc, rej) counts."""
    n = len(ALPHABET)
    a, b, c = (F.substring("gram", i, 1).alias(x) for i, x in ((1, "a"), (2, "b"), (3, "c")))
    g3 = counts.select(a, b, c, "acc", "rej")
    both = ("acc", "rej")

    def totals(df: DataFrame, level: int, *keys: str) -> DataFrame:
        """Counts and numbers of different continuations of a context."""
        aggs = [x for k in both for x in (F.sum(k).alias(f"n{level}_{k}"), F.sum((F.col(k) > 0).cast("int")).alias(f"t{level}_{k}"))]
        return (df.groupBy(*keys) if keys else df.withColumn("z", F.lit(0)).groupBy("z")).agg(*aggs)

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in both))

    g2, g1 = summed(g3, "b", "c"), summed(g3, "c")
    named = lambda df, level: df.withColumnsRenamed({k: f"c{level}_{k}" for k in both})
    letters = F.array(*map(F.lit, ALPHABET))
    letter = lambda e: F.element_at(letters, (e + 1).cast("int"))
    grid = counts.sparkSession.range(n**3).select(
        letter(F.floor(F.col("id") / n**2)).alias("a"), letter(F.floor(F.col("id") / n) % n).alias("b"), letter(F.col("id") % n).alias("c"), F.lit(0).alias("z")
    )
    all_ = (
        grid.join(F.broadcast(totals(g1, 0)), "z", "left")
        .join(F.broadcast(named(g1, 1)), "c", "left")
        .join(F.broadcast(totals(g2, 1, "b")), "b", "left")
        .join(F.broadcast(named(g2, 2)), ["b", "c"], "left")
        .join(F.broadcast(totals(g3, 2, "a", "b")), ["a", "b"], "left")
        .join(F.broadcast(named(g3, 3)), ["a", "b", "c"], "left")
    )

    def log_p(k: str) -> Column:
        p: Column = F.lit(1.0 / n)
        for level in (0, 1, 2):
            got, total, kinds = (F.coalesce(F.col(x), F.lit(0)) for x in (f"c{level + 1}_{k}", f"n{level}_{k}", f"t{level}_{k}"))
            p = F.when(total > 0, (got + kinds * p) / (total + kinds)).otherwise(p)
        return F.log(p)

    return all_.select(F.concat("a", "b", "c").alias("gram"), (log_p("acc") - log_p("rej")).alias("llr"))


def threshold(scores: DataFrame) -> float:
    """The score at which the two error rates on (score, acc, rej) rows sum to least; -inf if one kind is missing.

    Scores are counted in steps of 1/256; a mean log ratio lies within +-2 log of the counts, so
    there are some thousand steps at most.
    """
    steps = scores.filter("acc + rej > 0").groupBy(F.floor(F.col("score") * 256).alias("step")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    found = sorted((r["step"], r["acc"], r["rej"]) for r in steps.collect())
    acc, rej = sum(x[1] for x in found), sum(x[2] for x in found)
    if not acc or not rej:
        return float("-inf")
    best, at, lost, passed = 2.0, float("-inf"), 0, rej
    for step, a, r in found:  # a URL is allowed from the step on
        if (error := lost / acc + passed / rej) < best:
            best, at = error, step / 256
        lost, passed = lost + a, passed - r
    return at


def judge(pages: DataFrame, rules: list[Rule], whole: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per page.

    The models see the whole URL with ``whole``, else host and path.
    """
    host, path = host_and_path(F.col("url"))
    seen = F.coalesce(F.col("url").cast("string"), F.lit("")) if whole else F.concat(host, path)
    base = pages.select("page_id", host.alias("host"), path.alias("path"), symbols(seen).alias("s"))
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    pick = lambda field: F.coalesce(*(F.when(r.fits(F.col("host"), F.col("path")), F.lit(getattr(r, field))) for r in ordered), F.lit(None).cast("string"))
    base = base.select("*", pick("text").alias("rule"), pick("verdict").alias("decided"))
    hit = lambda v: F.sum((F.coalesce(F.col("decided"), F.lit("")) == v).cast("int"))
    strings = cut(base.groupBy("s").agg(hit("allow").alias("acc"), hit("block").alias("rej")))
    counts = grams(strings.filter("acc + rej > 0"), "acc", "rej").groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    # len(ALPHABET)**3 rows, whatever the input.
    table = F.broadcast(log_ratios(cut(counts)))
    each = grams(strings.withColumn("key", F.col("s")), "key").join(table, "gram").groupBy("key").agg(F.round(F.avg("llr"), 9).alias("score"))
    scores = cut(strings.join(each, strings["s"] == each["key"]).select("s", "acc", "rej", "score"))
    limit = threshold(scores)
    own = F.when(F.col("score") >= F.lit(limit), F.lit("allow")).otherwise(F.lit("block"))
    return base.join(scores.select("s", "score"), "s").select("page_id", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "score")
