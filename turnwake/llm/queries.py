"""The opN queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, packing, periodic_runs, pii, setsketch, substring_dedup, url_filter, whitening

#: The rules of the URL query.
RULES = [
    url_filter.Rule.of("block", "com/en/"),
    url_filter.Rule.of("allow", "example.com/en/7"),
    url_filter.Rule.of("allow", "net/de/"),
    url_filter.Rule.of("block", "example.net/de/8"),
    url_filter.Rule.of("block", "org/es/"),
]

#: Fixed value: the two rows that join the conversations.
CONTROL_ROWS = "VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", *(F.col(f"__{c}").alias(c) for c in ("sentences", "removed", "removed_words")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    p = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), str(p("byte_bpe_50k.json")), str(p("byte_bpe_50k.tiktoken")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~out).select("text", "lang"))
    return language_id.predict(docs, model, "doc_id", out.alias("held_out"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, whole=True)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("actions")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents")).drop("first", "row_key")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(f"SELECT * FROM {CONTROL_ROWS}"))
    return chat_format.digest(chat_format.format_conversations(rows))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, told by a checksum of the id, repeat a stretch of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = g % n
    rows = rows.select("doc_id", "text", "words", F.when(n > 0, F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))).alias("at"))
    word = lambda i: F.get("words", F.when(i < F.col("at.a"), i).otherwise(F.col("at.a") + (i - F.col("at.a")) % F.col("at.p")).cast("int"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.size("words") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("at").isNull(), F.col("text")).otherwise(again).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = ((-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"))
    milli = F.expr("1000 * best.length div -best.period").alias("exponent_milli")
    return own.select("doc_id", "n_runs", *best, milli, "runs_sha256", "collapsed_sha256")


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setsketch.linked_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries become whole numbers near a million; ``deviation`` is n times a vector's distance from the mean, squared."""
    grid = F.transform("embedding", lambda c: F.floor(64 * c.cast("double")) + F.lit(1_000_000).cast("long"))
    # Not a filter: the planner may put the cast to whole numbers before it, where an infinite entry overflows.
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(whitening.finite(F.col("embedding")), grid).alias("x"))
    model = whitening.fit(rows, "x")
    k = 0 if model is None else min(32, len(model.values))
    if not k:
        return spark.createDataFrame([], "vec_id bigint, n bigint, deviation bigint, component int, whitened double, explained double, identity_error double")
    n, sums = F.lit(model.n).cast("long"), F.array(*(F.lit(s).cast("long") for s in model.sums()))
    apart = F.when(F.size("x") == len(model.origin), F.aggregate(F.zip_with("x", sums, lambda x, s: n * x - s), F.lit(0).cast("long"), lambda acc, d: acc + d * d))
    keep = ["vec_id", "n", "deviation"]
    rows = rows.select("vec_id", n.alias("n"), apart.alias("deviation"), "x")
    return whitening.long_rows(whitening.whiten(rows, model, k, "x", keep), model, k, keep)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_best_fit_packing, op4_language_id, op5_decontaminate, op6_url_filter, op7_pii, op8_exact_dedup, op9_ngram_join, op10_chat_formatting, op11_periodic_runs, op12_setsketch, op13_whitening)}


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
_CONFLICT = " OR ".join(f"contains(text, '{s}')" for s in chat_format.CONTROL)

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _url_sql() -> str:
    """The rules, then back-off over the trigrams that occur, and the threshold of least error."""
    n = len(url_filter.ALPHABET)
    ordered = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')"
    pick = lambda field: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, field)}'" for r in ordered) + " END"
    both = ("acc", "rej")
    sums = ", ".join(f"sum({k}) AS {k}" for k in both)
    kinds = lambda level: ", ".join(f"sum({k}) AS n{level}_{k}, count(*) FILTER ({k} > 0) AS t{level}_{k}" for k in both)

    def log_p(k: str) -> str:
        p = f"(1.0::DOUBLE / {n})"
        for level in (0, 1, 2):
            got, total, different = (f"coalesce({x}, 0)" for x in (f"g{level + 1}.{k}", f"n{level}_{k}", f"t{level}_{k}"))
            p = f"(CASE WHEN {total} > 0 THEN ({got} + {different} * {p}) / ({total} + {different}) ELSE {p} END)"
        return f"ln({p})"

    return f"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             h AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                   '^^' || regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0./\\-_%?=&#~+:,]', '*', 'g') || '$' AS s FROM u),
             b AS (SELECT *, {pick("text")} AS rule, {pick("verdict")} AS decided FROM h),
             t AS (SELECT s, count(*) FILTER (decided = 'allow') AS acc, count(*) FILTER (decided = 'block') AS rej FROM b GROUP BY s),
             g AS (SELECT s, acc, rej, s[i] AS a, s[i + 1] AS b, s[i + 2] AS c FROM t, range(1, length(s) - 1) r(i)),
             g3 AS (SELECT a, b, c, {sums} FROM g GROUP BY a, b, c HAVING sum(acc + rej) > 0), g2 AS (SELECT b, c, {sums} FROM g3 GROUP BY b, c), g1 AS (SELECT c, {sums} FROM g2 GROUP BY c),
             k0 AS (SELECT {kinds(0)} FROM g1), k1 AS (SELECT b, {kinds(1)} FROM g2 GROUP BY b), k2 AS (SELECT a, b, {kinds(2)} FROM g3 GROUP BY a, b),
             l AS (SELECT d.a, d.b, d.c, {log_p("acc")} - {log_p("rej")} AS llr FROM (SELECT DISTINCT a, b, c FROM g) d CROSS JOIN k0 LEFT JOIN g1 ON g1.c = d.c
                   LEFT JOIN k1 ON k1.b = d.b LEFT JOIN g2 ON g2.b = d.b AND g2.c = d.c LEFT JOIN k2 ON k2.a = d.a AND k2.b = d.b LEFT JOIN g3 ON g3.a = d.a AND g3.b = d.b AND g3.c = d.c),
             sc AS (SELECT s, any_value(acc) AS acc, any_value(rej) AS rej, round(avg(llr), 9) AS score FROM g JOIN l USING (a, b, c) GROUP BY s),
             st AS (SELECT floor(score * 256) AS step, sum(acc) AS acc, sum(rej) AS rej FROM sc WHERE acc + rej > 0 GROUP BY 1),
             er AS (SELECT step, coalesce(sum(acc) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(acc) OVER () + sum(rej) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(rej) OVER () AS error,
                    sum(acc) OVER () > 0 AND sum(rej) OVER () > 0 AS told FROM st),
             th AS (SELECT coalesce(min_by(step / 256, (error, step)) FILTER (told AND error < 2), '-infinity'::DOUBLE) AS least FROM er)
        SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score >= (SELECT least FROM th) THEN 'allow' ELSE 'block' END) AS verdict, score FROM b JOIN sc USING (s)"""


def _near_sql(k: int, percent: int, more: str) -> str:
    """Components of sets linked by their overlap; of two similar sets one of the rarest shingles of each is common."""
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0d]+') AS ws FROM documents),
             g AS (SELECT DISTINCT doc_id, ws[i:i + {k - 1}] AS g FROM w, range(1, greatest(len(ws) - {k - 2}, 2)) r(i) WHERE len(ws) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
             f AS (SELECT g, count(*) AS f FROM g GROUP BY g),
             x AS (SELECT doc_id, g, n FROM (SELECT g.*, n, row_number() OVER (PARTITION BY g.doc_id ORDER BY f, g.g) AS i FROM g JOIN f USING (g) JOIN n USING (doc_id)) WHERE i <= n - ({percent} * n + 99) // 100 + 1),
             c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
             l AS (SELECT a, b FROM c JOIN g p ON p.doc_id = a JOIN g q ON q.doc_id = b AND q.g = p.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= {percent} * (na + nb - count(*))),
             e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
             r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, c.least AS component_id{more} FROM documents JOIN (SELECT x, min(y) AS least FROM r GROUP BY x) c ON c.x = doc_id LEFT JOIN n USING (doc_id)"""


ORACLE_SQL = {
    "op6_url_filter": _url_sql(),
    # Two lines are within one edit when they are alike without the character at one place (equal
    # lengths), or when the longer one is the shorter without some character.
    "op1_line_dedup": """
        WITH l AS (SELECT doc_id, i - 1 AS line_no, lower(trim(parts[i], ' ')) AS s
                   FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), range(1, len(parts) + 1) r(i)),
             c AS (SELECT s, min((doc_id, line_no)) AS first FROM l WHERE s <> '' GROUP BY s),
             k AS (SELECT s, first, length(s) AS n FROM c WHERE length(s) >= 10),
             v AS (SELECT s, first, n, i, s[1:i - 1] || s[i + 1:] AS rest FROM k, range(1, n + 1) r(i)),
             p AS (SELECT a.s, b.first AS near FROM v a JOIN v b ON a.n = b.n AND a.i = b.i AND a.rest = b.rest WHERE b.first < a.first
                   UNION ALL SELECT a.s, b.first FROM k a JOIN v b ON b.n = a.n + 1 AND b.rest = a.s WHERE b.first < a.first
                   UNION ALL SELECT a.s, b.first FROM v a JOIN k b ON a.n = b.n + 1 AND a.rest = b.s WHERE b.first < a.first),
             m AS (SELECT s, min(near) AS near FROM p GROUP BY s),
             e AS (SELECT doc_id, line_no, first, near, CASE WHEN s = '' THEN NULL WHEN first < (doc_id, line_no) THEN 0 WHEN near IS NOT NULL THEN 1 END AS edits FROM l LEFT JOIN c USING (s) LEFT JOIN m USING (s))
        SELECT doc_id, line_no, edits IS NULL AS kept, edits, CASE edits WHEN 0 THEN first[1] WHEN 1 THEN near[1] END AS first_doc_id, CASE edits WHEN 0 THEN first[2] WHEN 1 THEN near[2] END AS first_line_no FROM e""",
    "op5_decontaminate": f"""
        WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
             w AS (SELECT kind, id, text, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+') AS ws FROM t),
             g AS (SELECT DISTINCT kind, id, text, ws[i:i + 4] AS g FROM w, range(1, len(ws) - 3) r(i)),
             n AS (SELECT id, text, count(*) AS size FROM g WHERE kind = 1 GROUP BY ALL),
             h AS (SELECT d.id AS doc_id, d.text AS doc, i.id AS item_id, i.text AS item, count(*) AS shared FROM g d JOIN g i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 GROUP BY ALL)
        SELECT doc_id, item_id, shared, size AS item_shingles, round(shared / size, 6) AS containment
        FROM h JOIN n ON h.item_id = n.id AND h.item = n.text WHERE 10 * shared >= 8 * size""",
    "op9_ngram_join": _near_sql(3, 90, ""),
    "op12_setsketch": _near_sql(2, 80, ", doc_id = c.least AS kept"),
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
             d AS (SELECT doc_id, sha256(s) AS text_sha256, s FROM t)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY s ORDER BY doc_id DESC) = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY s)""",
    "op10_chat_formatting": f"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
             e AS (SELECT *, ({_CONFLICT}) AS hit FROM r)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(3 + length({_ESC.format('role')}) + CASE WHEN hit THEN 8 + length({_ESC.format('text')}) ELSE 6 + length(text) END + 11)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
