"""Chat formatting with a checked grammar.

Each conversation is rendered, the rendered text is parsed again by a deterministic
grammar, and the turns that come back are compared with the source. Conversations that
do not come back have their conflicting texts escaped and go round again, until source
and parse are identical. Everything is DataFrame functions; one shuffle by conversation.

Grammar (``{`` and ``}`` stand for repetition)::

    conversation = { "<s>" role open body "[/INST]</s>" }
    open         = "[INST]"    (body as it is, without any control string)
                 | "[INST:e]"  (body escaped)

Escaping writes ``&`` as ``&amp;``, ``<`` as ``&lt;`` and ``[`` as ``&lsqb;``, so that an
escaped body holds no control string; roles are always escaped.

Defined results: null role and null text count as empty; turns are ordered by
(turn, role, text), null first, and repeated rows are turns of their own; rows with a null
conv_id form one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings, none of which may stand in an unescaped body.
CONTROL = ("<s>", "</s>", "[INST]", "[INST:e]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: What escaping writes, in the order of writing.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
CLOSE = "[/INST]</s>"
CLOSE_PATTERN = r"\[/INST\]</s>"


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def conflicts(c: Column) -> Column:
    """Whether a text holds a control string."""
    return reduce(lambda x, y: x | y, (c.contains(s) for s in CONTROL))


def render(turns: Column) -> Column:
    """array<struct<role, text, escaped>> as one string of the grammar."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(
                F.lit("<s>"),
                escape(t["role"]),
                F.when(t["escaped"], F.concat(F.lit("[INST:e]"), escape(t["text"]))).otherwise(F.concat(F.lit("[INST]"), t["text"])),
                F.lit(CLOSE),
            ),
        ),
        "",
    )


def sums_before(lengths: Column, chunk: int = 256) -> Column:
    """The sum of all elements before each one. Arrays grow in chunks, so the work is linear for any length."""

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")))["all"]

    whole = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int"))
    chunks = F.when(F.size(lengths) > 0, F.transform(starts, lambda i: F.slice(lengths, i * chunk + 1, F.lit(chunk)))).otherwise(F.array().cast("array<array<bigint>>"))
    return F.flatten(F.zip_with(chunks, running(F.transform(chunks, whole)), lambda xs, at: F.transform(running(xs), lambda x: x + at)))


def parse(formatted: Column) -> Column:
    """The turns of a rendered string: array<struct<role, text, start, chars>>; start and chars give the
    place of the body in code points. Null where the string is not of the grammar."""
    parts = F.split(formatted, CLOSE_PATTERN, -1)
    turns = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            p.alias("part"),
            F.length(F.regexp_extract(p, r"^<s>[^<\[]*\[INST(?::e)?\]", 0)).alias("head"),
            F.regexp_extract(p, r"^<s>([^<\[]*)\[INST", 1).alias("role"),
            (F.regexp_extract(p, r"^<s>[^<\[]*\[INST(:e)?\]", 1) == ":e").alias("escaped"),
        ),
    )
    bodies = F.transform(
        turns,
        lambda t: F.struct(
            unescape(t["role"]).alias("role"),
            F.substring(t["part"], t["head"] + 1, F.length(t["part"])).alias("body"),
            t["escaped"].alias("escaped"),
            t["head"].alias("head"),
        ),
    )
    good = F.forall(bodies, lambda t: (t["head"] > 0) & ~conflicts(t["body"])) & (F.element_at(parts, -1) == "")
    before = sums_before(F.transform(bodies, lambda t: (t["head"] + F.length(t["body"]) + F.lit(len(CLOSE))).cast("long")))
    starts = F.zip_with(bodies, before, lambda t, at: (t["head"] + at).cast("int"))
    out = F.zip_with(
        bodies,
        starts,
        lambda t, s: F.struct(
            t["role"].alias("role"),
            F.when(t["escaped"], unescape(t["body"])).otherwise(t["body"]).alias("text"),
            s.alias("start"),
            F.length(t["body"]).alias("chars"),
        ),
    )
    return F.when(good, out)


def pairs(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows.

    Returns conv_id, formatted, turns (as parsed back: role, text, start, chars), loss_spans
    (start and chars of each body of ``loss_role``) and rounds (0: nothing had to be escaped).
    """
    empty = F.lit("")
    one = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    convs = rows.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    rules = (lambda t: F.lit(False), lambda t: conflicts(t["text"]), lambda t: F.lit(True))

    def tried(k: int) -> Column:
        source = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), rules[k](t).alias("escaped")))
        return render(source)

    def same(turns: Column) -> Column:
        return F.coalesce(pairs(turns) == pairs(F.col("all")), F.lit(False))

    # A later round runs only for the conversations that the one before did not bring back.
    out = convs.withColumn("formatted", tried(0)).withColumn("turns", parse(F.col("formatted"))).withColumn("rounds", F.lit(0))
    for k in (1, 2):
        out = out.withColumn("ok", same(F.col("turns")))
        out = out.withColumn("formatted", F.when(F.col("ok"), F.col("formatted")).otherwise(tried(k)))
        out = out.withColumn("turns", F.when(F.col("ok"), F.col("turns")).otherwise(parse(F.col("formatted"))))
        out = out.withColumn("rounds", F.when(F.col("ok"), F.col("rounds")).otherwise(F.lit(k)))
    broken = F.raise_error(F.lit("a conversation does not come back from its rendered text"))
    out = out.withColumn("turns", F.when(same(F.col("turns")), F.col("turns")).otherwise(broken.cast(out.schema["turns"].dataType)))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars")))
    return out.select("conv_id", "formatted", "turns", loss.alias("loss_spans"), "rounds")


def digest(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Counts and hashes of what was read back from ``format_conversations``."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # The loss text is cut out of the formatted string, which is split once: a body ends its turn's part. Where the
    # parts lie is held against the spans; a body that was escaped is written back.
    parts = F.split("formatted", CLOSE_PATTERN, -1)
    begins = sums_before(F.transform(parts, lambda p: (F.length(p) + F.lit(len(CLOSE))).cast("long")))
    said_by = F.filter(
        F.zip_with(F.col("turns"), F.arrays_zip(F.slice(parts, 1, F.size("turns")).alias("part"), F.slice(begins, 1, F.size("turns")).alias("at")), lambda t, p: F.struct(t["role"].alias("role"), t["text"].alias("text"), p["part"].alias("part"), p["at"].alias("at"))),
        lambda t: t["role"] == loss_role,
    )
    lost = F.raise_error(F.lit("a loss span is not where its turn ends")).cast("string")

    def body(t: Column, s: Column) -> Column:
        there = t["at"] + F.length(t["part"]) == s["start"] + s["chars"]
        own = F.substring(t["part"], F.length(t["part"]) - s["chars"] + 1, s["chars"])
        return F.when(~there, lost).when(F.length(t["text"]) == s["chars"], own).otherwise(unescape(own))

    cut = F.zip_with(said_by, "loss_spans", body)
    loss = F.array_join(cut, "")
    read = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        *("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256")),
        *(F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"),
    )
