"""Audit of how sources differ: divergences between the term distributions of a language's sources, relationally and exactly.

Terms are runs of letters and of characters beyond ASCII, of which only A-Z are lower-cased. Every whole text is exploded into its
matches once; occurrences and documents of a term are counted for each (lang, source). A language keeps the terms of
MIN_DOCS documents or more. Groups are crossed with their language's kept terms, so that a term that a source lacks counts as 0, and a
smoothed share p = 1 + floor(SCALE (n + 2) / (N + 2 V)) stands for each. Two shares differ by f = floor((p - q)^2 / (p + q)).

* part `pair`: a group against each other source of its language, f summed over the kept terms, all ranks;
* part `term`: a group's terms that it has and that weigh more in it than in its language, with f, the TOP first ones.

Crossing is an equi-join on language and a hash of the term, to which each group is dealt once for each hash value, so that a
language with most of the corpus is spread over all tasks, and nothing is broadcast whose size isn't known. Counts are summed in each task before
they move; a source with a third of all rows is one row for each term afterwards. f is symmetric, so each pair of sources is
joined once, on lang and term. Integers throughout, with decimals where a count times SCALE might not fit.

Null text, lang and source are ''. Every (lang, source) that occurs is a group, with or without terms; a language that keeps none has pair values
of 0. Every row is a document, repeated ones too, whatever its doc_id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have the term), from one scan of the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # where lower() does the same, and faster
    text = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    words = docs.select(*named, F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("words"))
    both = words.select("lang", "source", F.posexplode(F.array("words", F.array_distinct("words"))).alias("once", "words"))
    terms = both.select("lang", "source", "once", F.explode("words").alias("term"))
    return terms.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once").cast("bigint")).alias("n"), F.sum(F.col("once").cast("bigint")).alias("docs"))


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n of the terms that their language keeps."""
    counts = term_counts(docs).withColumn("all_docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    return counts.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 v)), as bigint."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", top, (total + 2 * v).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, term, source, n, p, q for each group and each kept term of its language: p of the group, q of the language."""
    spark = counts.sparkSession
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sides = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    sides = sides.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = vocabulary.withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(deals)).cast("int"))
    dense = dealt.join(sides, ["lang", "deal"]).join(counts, ["lang", "source", "term"], "left").fillna(0, ["n"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return dense.select("lang", "term", "source", "n", p.alias("p"), q.alias("q"))


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank (see above)."""
    groups = written(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct(), "groups")
    counts = written(kept_counts(docs, min_docs), "terms")
    dense = written(shares(groups, counts), "shares")

    one = dense.select("lang", "term", "source", "p")
    two = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(two, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    sums = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair"), "value").select("lang", "pair.*", "value")
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    pairs = others.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])

    terms = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term", top))


def audit_sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """DuckDB SQL for audit_sources."""
    p = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + 2)) // ({total} + 2 * v))"
    f = "((p - q) * (p - q)) // (p + q)"
    return f"""WITH base AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
        words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM base),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
        langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM base),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
        shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "coalesce(total, 0)")} AS p, {p("lang_n", "lang_total")} AS q
            FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        found AS (SELECT 'pair' AS part, lang, source, item, value FROM pairs UNION ALL SELECT 'term', lang, source, term, {f} FROM shares WHERE n > 0 AND p > q),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranks WHERE part = 'pair' OR rank <= {top}"""


__all__ = ["audit_sources", "audit_sql", "kept_counts", "shares", "term_counts"]
