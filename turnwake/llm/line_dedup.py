"""Line deduplication within one edit, by deletion neighbourhoods. DataFrame functions only.

Lines (at ``\\n``) are compared after trimming spaces and lower-casing. A line goes when an
equal one, or one within a single insertion, deletion or substitution, stands earlier by
(doc_id, line number); what is earlier counts whether it stays itself or not.

1. Equal lines are one class, with its first place; everything after works on classes.
2. One edit leaves the line before and after it alike. Cut in two halves, one half of a pair
   is equal: classes that share no half with another are done. A bit array of fixed size over
   the hashes of the others keeps most lines out when documents are read again for their text.
3. The others are cut in 16 windows, and a pair shares all but one of them; that one is cut
   again in 16 until it has no more than WIDTH characters, so a line of any length costs work
   in proportion to its length.
4. Inside that window the deletion neighbourhood is emitted as hashed keys: the window
   without each of its characters (with the character's place, for substitutions between
   lines of one length; without it, for the line one shorter) and the window itself. Lines
   that share a key are within one edit, so a key needs only its earliest members, never
   its pairs.
5. The earliest neighbour is verified by edit distance on the whole lines.

Lines of fewer than ``min_chars`` characters have equal lines only, as one edit can change
all they say.

Defined results: null text has no line and gives no row; an empty text is one empty line;
empty lines stay, always; in rows repeated whole each line has its equals at the same place
and number, of which one stays; a null doc_id comes before every other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITS, LOW, bit_of, bit_words, cut, cut_small, gathered

WINDOWS = 16
WIDTH = 64  # characters of a window whose deletion neighbourhood is written out


def _bounds(n: Column, j: Column, parts: int) -> tuple[Column, Column]:
    return F.floor(n * j / parts).cast("int"), F.floor(n * (j + 1) / parts).cast("int")


def _key(s: Column, size: Column, n: Column, j: Column, parts: int, within: Column | None = None) -> Column:
    """Hash of a string without window j, for a pair whose shorter one has n characters."""
    lo, hi = _bounds(n, j, parts)
    return F.xxhash64(n if within is None else within, j, F.substring(s, F.lit(1), lo), F.substring(s, size - (n - hi) + 1, n - hi))


def _window(s: Column, size: Column, n: Column, j: Column) -> Column:
    lo, hi = _bounds(n, j, WINDOWS)
    return F.substring(s, lo + 1, size - lo - (n - hi))


def _meeting(keys: DataFrame) -> DataFrame:
    """Keys that can hold a pair: two members, one of which is the shorter.

    Cut, so that a join on them shuffles both sides anew and can split a key that many share.
    """
    return cut_small(gathered(keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("short").alias("s")).filter("n > 1 AND s > 0").select("key")))


def described(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) rows with the compared form, its size and two hashes."""
    rows = rows.select("doc_id", "line_no", F.lower(F.trim("line")).alias("s"))
    return rows.select("doc_id", "line_no", "s", F.length("s").alias("size"), F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), F.col("s")).alias("g"))


def lines(docs: DataFrame) -> DataFrame:
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    return described(docs.filter("text IS NOT NULL").select(doc_id.alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")))


def bit_column(hashes: DataFrame) -> Column:
    """The bit array over ``h`` of all rows as a column, an array<bigint> of fixed size."""
    blank = hashes.sparkSession.range(1 << (BITS - 6)).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    words = bit_words(hashes, "h").unionByName(blank).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"])).scalar()


def split_windows(windows: DataFrame, longest: int) -> DataFrame:
    """(.., key, short, w) rows with windows of at most WIDTH characters, where ``longest`` bounds them now.

    A window is cut by the length of the shorter partner, which the key holds, so both cut alike.
    """
    while longest > WIDTH:
        size = F.length("w")
        n = size - 1 + F.col("short")
        one = lambda j: F.struct(_key(F.col("w"), size, n, j, WINDOWS, F.col("key")).alias("key"), _window(F.col("w"), size, n, j).alias("w"))  # noqa: B023, E731
        parts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), one)
        each = F.explode(F.when(n > WIDTH, parts).otherwise(F.array(F.struct("key", "w")))).alias("x")
        windows = windows.select("h", "g", "first", "short", each).select("h", "g", "first", "x.key", "short", "x.w")
        windows = windows.join(_meeting(windows.select("key", "short")), "key")
        longest = -(-longest // WINDOWS)
    return windows


def neighbours(docs: DataFrame, classes: DataFrame, min_chars: int) -> DataFrame:
    """(h, g, first, near): the first place of the earliest class within one edit, for classes that have an earlier one."""
    long_ = classes.filter(F.col("size") >= min_chars)
    halves = long_.select("h", F.explode(F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(int(i < 2)).alias("short")) for i in range(4)))).alias("x")).select("h", "x.key", "x.short")
    # One hash of a class is enough to find those that go on; both tell classes apart from here.
    some = cut(gathered(halves.join(_meeting(halves), "key").select("h").distinct()))
    places = long_.join(some, "h").select("h", "g", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))
    candidate = F.bit_get(F.element_at(bit_column(some), (F.shiftright(bit_of("h"), 6) + 1).cast("int")), bit_of("h").bitwiseAND(63).cast("int")) == 1
    # A row repeated whole gives a place twice; one line of it is enough.
    text = lines(docs).filter(F.col("size") >= min_chars).filter(candidate).join(places, ["doc_id", "line_no", "h", "g"])
    text = cut(gathered(text.dropDuplicates(["h", "g"]).select("h", "g", "first", "s", "size")))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2 * WINDOWS - 1)), lambda i: F.struct((F.col("size") - F.floor(i / WINDOWS).cast("int")).alias("n"), (i % WINDOWS).alias("j"))))
    windows = text.select("h", "g", "first", "s", "size", each.alias("x")).select("h", "g", "first", "s", "size", "x.n", "x.j")
    short = F.col("n") == F.col("size")
    windows = windows.filter(F.col("n") >= min_chars).select(
        "h", "g", "first", _key(F.col("s"), F.col("size"), F.col("n"), F.col("j"), WINDOWS).alias("key"), short.cast("int").alias("short"),
        _window(F.col("s"), F.col("size"), F.col("n"), F.col("j")).alias("w"),
    )
    windows = windows.join(_meeting(windows.select("key", "short")), "key")
    windows = split_windows(windows, -(-(text.agg(F.max("size")).first()[0] or 0) // WINDOWS))
    w = F.col("w")
    without = lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    at = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
    one = lambda v, role: F.struct(v.alias("v"), F.lit(role).alias("role"))
    # role 0: of lines of one length; 1: the shorter line of a pair; 2: the longer.
    swapped = F.transform(at, lambda i: one(F.xxhash64(F.lit("s"), F.col("key"), i, without(i)), 0))
    dropped = F.transform(at, lambda i: one(F.xxhash64(F.lit("d"), F.col("key"), without(i)), 2))
    whole = F.array(one(F.xxhash64(F.lit("d"), F.col("key"), w), 1))
    variants = windows.select("h", "g", "first", F.explode(F.when(F.col("short") == 1, F.concat(swapped, whole)).otherwise(dropped)).alias("x")).select("h", "g", "first", "x.v", "x.role")
    variants = variants.dropDuplicates(["v", "role", "h", "g"])
    place = F.struct("first", "h", "g")
    least = lambda role: F.min(F.when(F.col("role") == role, place)).alias(f"m{role}")
    met = variants.groupBy("v").agg(*(least(r) for r in (0, 1, 2)), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = cut_small(gathered(met))  # as in _meeting
    other = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    near = variants.join(met, "v").select("h", "g", "first", other.alias("o")).filter(F.col("o.first") < F.col("first"))
    near = near.groupBy("h", "g").agg(F.min("o").alias("o"), F.first("first").alias("first"))
    near = near.select("h", "g", "first", F.col("o.first").alias("near"), F.col("o.h").alias("oh"), F.col("o.g").alias("og"))
    own, theirs = text.select("h", "g", "s"), text.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("s").alias("os"))
    checked = near.join(own, ["h", "g"]).join(theirs, ["oh", "og"]).filter(F.levenshtein("s", "os", 1) >= 0)
    return checked.select("h", "g", "first", "near")


def line_duplicates(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, line_no, kept, edits, first_doc_id, first_line_no): one row per line.

    first_*: the place for which a line goes; edits: 0 or 1; both null where the line stays.
    """
    keys = [_key(F.col("s"), F.col("size"), F.col("size") - int(i > 1), F.lit(i % 2), 2).alias(f"k{i}") for i in range(4)]
    all_ = lines(docs)
    grouped = all_.filter("size > 0").select("h", "g", "size", F.struct("doc_id", "line_no").alias("at"), *keys).groupBy("h", "g")
    classes = cut(gathered(grouped.agg(F.min("at").alias("first"), F.max("size").alias("size"), *(F.max(f"k{i}").alias(f"k{i}") for i in range(4)))))
    near = neighbours(docs, classes, min_chars).select(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "h", "g", "near")
    # Lines of rows repeated whole share a place; they are counted before the joins and one stays.
    own = all_.groupBy("doc_id", "line_no", "h", "g").agg(F.count("*").alias("times"), F.first("size").alias("size"))
    # Only the first place of a class can go for a near one. The classes are read from their cut, so
    # that the last join shuffles both sides and a line that stands everywhere is split.
    met = own.join(near, ["doc_id", "line_no", "h", "g"], "left").join(classes.select("h", "g", "first"), ["h", "g"], "left")
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    at = F.struct("doc_id", "line_no")
    equal = (F.col("first") < at) | (F.col("copy") > 1)
    edits = F.when(F.col("size") == 0, F.lit(None).cast("int")).when(equal, F.lit(0)).when(F.col("near").isNotNull(), F.lit(1))
    why = F.when(edits == 0, F.col("first")).when(edits == 1, F.col("near"))
    blank = lambda c: F.when(c != LOW, c)
    return met.select(blank(F.col("doc_id")).alias("doc_id"), "line_no", edits.isNull().alias("kept"), edits.alias("edits"), blank(why["doc_id"]).alias("first_doc_id"), why["line_no"].alias("first_line_no"))
