"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed by cell (source, language, topic); sweeps over the three dimensions scale the cells until each
marginal matches its target share. A cell's documents are kept with a probability, decided for each document by a hash of
its id. Probabilities are at most 1 inside of the fit: more sweeps scale weights whose values up to 1 count, until the
expected sample has the wanted tokens of each value. A value with fewer tokens than its share of the sample gives all it has,
and what is missing goes to the other values by their shares (the sample keeps its size, and a rare value costs no other one anything);
mixing_report tells what is missing. Where cells rule out targets that single values would allow, the sample is as near as
the sweeps come.

Cells are a summary: only their table is joined back, broadcast where its written size is under Spark's threshold
and shuffled otherwise. A source with a third of all rows is one row in it.

Null or absent values of a dimension are a value of their own; null and empty texts weigh one token; a null doc_id draws
by the hash of ''; repeated rows share their fate; an empty table stays empty; columns with other names are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import unused, written

DIMENSIONS = ("source", "lang", "topic")
MISSING = "(none)"


@dataclass(frozen=True)
class Mix:
    """Target shares are the present shares to the power of `temper` (1 keeps them, 0 makes them equal).

    fraction: of all tokens to keep where the targets allow it; sweeps: rounds over the dimensions, of each of both fits.
    """

    temper: tuple[float, ...] = (0.5, 0.7, 0.7)
    fraction: float = 0.5
    sweeps: int = 8
    seed: str = "mix-1"


def tokens(text: Column) -> Column:
    """Token weight of a text: one more than its spaces."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse topic by the form of a text, for corpora without a topic column."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "listing")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(text.rlike("[0-9][0-9][0-9]"), "numeric")
        .otherwise("prose")
    )


def dimension_columns(docs: DataFrame) -> dict[str, Column]:
    known = {c: F.col(c).cast("string") for c in docs.columns}
    given = {"source": F.lit(None), "lang": F.lit(None), "topic": topic(F.col("text"))} | {c: known[c] for c in DIMENSIONS if c in known}
    return {c: F.coalesce(given[c], F.lit(MISSING)) for c in DIMENSIONS}


def rake(cells: DataFrame, mix: Mix, targets: dict[str, DataFrame] | None = None, bounded: bool = False, shares: bool = False) -> DataFrame:
    """cells (source, lang, topic, tokens) with `factor`, how much each is to be scaled, and if bounded `bounded`, its probability.

    targets: for a dimension, a table (value, share) instead of the tempered shares; values without a share go to 0.
    """
    total = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("total", F.sum("tokens").over(total))
    for c, temper in zip(DIMENSIONS, mix.temper, strict=True):
        if targets and c in targets:
            share = targets[c].groupBy(F.coalesce(F.col("value").cast("string"), F.lit(MISSING)).alias(c)).agg(F.sum("share").cast("double").alias("raw"))
        else:
            share = cells.groupBy(c).agg(F.pow(F.sum("tokens") / F.first("total"), F.lit(temper)).alias("raw"))
        norm = share.withColumn(f"share_{c}", F.col("raw") / F.sum("raw").over(total)).drop("raw")
        cells = cells.join(norm, c, "left").fillna(0.0, [f"share_{c}"])
    cells = written(cells.withColumn("factor", F.lit(1.0)), "cells")
    for sweep in range(mix.sweeps):
        for c in DIMENSIONS:
            now = F.sum(F.col("factor") * F.col("tokens")).over(Window.partitionBy(c))
            cells = cells.withColumn("now", now).withColumn("factor", F.when(F.col("now") > 0, F.col("factor") * F.col(f"share_{c}") * F.col("total") / F.col("now")).otherwise(0.0)).drop("now")
        if sweep % 4 == 3:
            cells = written(cells, "raked")
    if not bounded:
        return cells.select(*DIMENSIONS, "factor")
    cells = written(cells, "raked")
    for c in DIMENSIONS:
        cells = cells.join(wanted(cells, c, mix), c)
    cells = written(cells.withColumn("weight", F.col("factor") * mix.fraction), "bounded")
    for sweep in range(mix.sweeps):
        for c in DIMENSIONS:
            now = F.sum(F.least(F.lit(1.0), F.col("weight")) * F.col("tokens")).over(Window.partitionBy(c))
            cells = cells.withColumn("now", now).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"wanted_{c}") / F.col("now")).otherwise(0.0)).drop("now")
        if sweep % 4 == 3:
            cells = written(cells, "bounded")
    more = ["tokens", *[f"share_{c}" for c in DIMENSIONS]] if shares else []
    return cells.select(*DIMENSIONS, "factor", F.least(F.lit(1.0), F.col("weight")).alias("bounded"), *more)


def wanted(cells: DataFrame, c: str, mix: Mix) -> DataFrame:
    """(c, wanted_c): tokens of each value in the sample: its share of a level that all values fill together, but no more
    than it has. The level rises until nothing more is missing; each step is one aggregate."""
    values = cells.groupBy(c).agg(F.sum("tokens").cast("double").alias("has"), F.first(f"share_{c}").alias("share"), F.first("total").cast("double").alias("total"))
    values = written(values, "values")
    level, before = None, -1.0
    scarce = F.lit(False)
    while level is None or level > before * (1 + 1e-12):
        before = level if level is not None else -1.0
        whole = F.max("total") * mix.fraction
        found = values.where("share > 0").agg((whole - F.coalesce(F.sum(F.when(scarce, F.col("has"))), F.lit(0.0))).alias("left"), F.sum(F.when(~scarce, F.col("share"))).alias("shares")).first()
        if not found["shares"]:  # every value gives all it has, or there is none
            return values.select(c, F.when(F.col("share") > 0, F.col("has")).otherwise(0.0).alias(f"wanted_{c}"))
        level = found["left"] / found["shares"]
        scarce = F.col("has") < F.col("share") * level
    return values.select(c, F.least("has", F.col("share") * level).alias(f"wanted_{c}"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and a seed, the same in any engine with MD5."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2**32


def with_probability(docs: DataFrame, mix: Mix = Mix(), targets: dict[str, DataFrame] | None = None, bounded: bool = True) -> DataFrame:
    """docs with struct column `mix` (source, lang, topic, factor, probability, sampled) after their own columns.

    bounded=False cuts factor * fraction at 1 instead, as mixing_sql does; the sample then misses the targets of rare cells.
    """
    names = {c: f"_{c}" for c in DIMENSIONS}
    columns = dimension_columns(docs)
    cells = docs.select(*[v.alias(c) for c, v in columns.items()], tokens(F.col("text")).alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    raked = written(rake(cells, mix, targets, bounded).coalesce(1), "factors").withColumnsRenamed(names)
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), *[v.alias(c) for c, v in columns.items()])
    on = [F.col(c) == F.col(n) for c, n in names.items()]
    probability = F.col("bounded") if bounded else F.least(F.lit(1.0), F.col("factor") * mix.fraction)
    sampled = uniform(F.col("doc.doc_id"), mix.seed) < probability
    told = unused("_mix", docs)
    out = keyed.join(raked, on).select("doc.*", F.struct(*DIMENSIONS, "factor", probability.alias("probability"), sampled.alias("sampled")).alias(told))
    return out.withColumnRenamed(told, "mix") if "mix" not in docs.columns else out


def sample_mix(docs: DataFrame, mix: Mix = Mix(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents that the calibrated probabilities keep, with their own columns."""
    out = with_probability(docs, mix, targets)
    return out.where(out[out.columns[-1]]["sampled"]).select(*docs.columns)


def mixing_digest(docs: DataFrame, mix: Mix = Mix(), bounded: bool = False) -> DataFrame:
    """doc_id, source, lang, topic, probability (6 digits) and sampled of every document; unless bounded, as in mixing_sql."""
    out = with_probability(docs.select("doc_id", "text", "source", "lang"), mix, bounded=bounded)
    return out.select("doc_id", "mix.source", "mix.lang", "mix.topic", F.round("mix.probability", 6).alias("probability"), "mix.sampled")


def mixing_report(docs: DataFrame, mix: Mix = Mix(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """dimension, value, tokens, target (share), expected (share of the expected sample), missing (tokens by which a value falls short of its
    target share of `fraction` of all tokens)."""
    columns = dimension_columns(docs)
    cells = docs.select(*[v.alias(c) for c, v in columns.items()], tokens(F.col("text")).alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    raked = written(rake(cells, mix, targets, bounded=True, shares=True), "report")
    whole = raked.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("bounded")).alias("kept")).first()
    parts = []
    for c in DIMENSIONS:
        part = raked.groupBy(F.col(c).alias("value")).agg(F.sum("tokens").alias("tokens"), F.first(f"share_{c}").alias("target"), F.sum(F.col("tokens") * F.col("bounded")).alias("kept"))
        missing = F.greatest(F.lit(0.0), F.col("target") * float(whole["all"] or 0) * mix.fraction - F.col("kept"))
        parts.append(part.select(F.lit(c).alias("dimension"), "value", "tokens", "target", (F.col("kept") / (whole["kept"] or 1.0)).alias("expected"), missing.alias("missing")))
    return parts[0].union(parts[1]).union(parts[2])


def mixing_sql(mix: Mix = Mix()) -> str:
    """DuckDB SQL for mixing_digest, sweeps unrolled."""
    ctes = [
        f"""base AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
            CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'listing' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
                 WHEN regexp_matches(coalesce(text, ''), '[0-9][0-9][0-9]') THEN 'numeric' ELSE 'prose' END AS topic,
            length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM base GROUP BY ALL)",
        "whole AS (SELECT sum(tokens) AS total FROM cells)",
    ]
    for c, temper in zip(DIMENSIONS, mix.temper, strict=True):
        ctes.append(f"raw_{c} AS (SELECT {c}, pow(sum(tokens) / (SELECT total FROM whole), {temper}) AS raw FROM cells GROUP BY {c})")
        ctes.append(f"share_{c} AS (SELECT {c}, raw / (SELECT sum(raw) FROM raw_{c}) AS share_{c} FROM raw_{c})")
    ctes.append("r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS factor FROM cells JOIN share_source USING (source) JOIN share_lang USING (lang) JOIN share_topic USING (topic))")
    n = 0
    for _ in range(mix.sweeps):
        for c in DIMENSIONS:
            new = f"factor * share_{c} * (SELECT total FROM whole) / sum(factor * tokens) OVER (PARTITION BY {c})"
            ctes.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE ({new} AS factor) FROM r{n})")
            n += 1
    u = f"('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296"
    return f"""WITH {", ".join(ctes)}
        SELECT doc_id, source, lang, topic, round(least(1.0, factor * {mix.fraction}), 6) AS probability, {u} < least(1.0, factor * {mix.fraction}) AS sampled
        FROM base JOIN r{n} USING (source, lang, topic)"""
