"""Blocking: candidates of each address by four equality rules, each against the register and its other spellings.

Each rule is an equi-join. A key whose addresses and register rows would make more than PAIRS pairs (a street name or number of
a large town) is dealt: its addresses to some shares and its register rows to some shares, and each address meets all of them, a
share at a time, so that no task gets more than PAIRS pairs of one key. Sizes of blocks are counted first, by
aggregates with partial sums. What is asked of a block as a whole needs no pairs (`block_summary`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Rule number -> register columns and the address's keys (p: fast parse, q: place fields).
RULES: dict[int, list[tuple[str, str]]] = {
    1: [("POSTCODE", "p.postcode")],
    2: [("pc_area", "p.pc_area"), ("pc_district", "p.pc_district"), ("number_like_0", "number_0")],
    3: [("POST_TOWN", "q.post_town"), ("THOROUGHFARE", "q.thoroughfare")],
    4: [("POST_TOWN", "q.post_town"), ("number_like_0", "number_0")],
}
TABLES = ("indexed", "expanded")
#: Pairs of one key that one task may get, and the rows of a share on either side.
PAIRS, SHARE = 250_000, 500
#: Blocks whose summaries are broadcast, if there are no more of them.
FEW_BLOCKS = 100_000
STAGES = [(rule, table, 2 * (rule - 1) + t + 1) for rule in RULES for t, table in enumerate(TABLES)]


def with_number(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("number_0", F.get("p.number_like", F.lit(0)))


def _on(rule: int) -> Column:
    return reduce(Column.__and__, [F.col(f"r.{theirs}") == F.col(f"a.{mine}") for theirs, mine in RULES[rule]])


def stage_counts(inputs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(input_id, stage, n): candidates of each address in each stage, from block sizes alone."""
    parts = []
    for rule, table, stage in STAGES:
        keys = [theirs for theirs, _ in RULES[rule]]
        sizes = tables[table].groupBy(*keys).agg(F.count("*").alias("n"))
        parts.append(inputs.alias("a").join(sizes.alias("r"), _on(rule)).select("a.input_id", F.lit(stage).alias("stage"), "r.n"))
    return reduce(DataFrame.union, parts)


def last_stage_by_beam(counts: DataFrame, beam: int) -> DataFrame:
    """(input_id, last): the first stage at which more than `beam` candidates have come together, else the last of all."""
    upto = Window.partitionBy("input_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("total", F.sum("n").over(upto))
    return running.groupBy("input_id").agg(F.coalesce(F.min(F.when(F.col("total") > beam, F.col("stage"))), F.lit(len(STAGES))).alias("last"))


def without_repeats(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables in which a row_key comes once, in the earlier one. Equal keys are equal rows, so the rules find as many rows."""
    first, second = (tables[t].dropDuplicates(["row_key"]) for t in TABLES)
    return {TABLES[0]: first, TABLES[1]: second.join(first.select("row_key"), "row_key", "left_anti").select(*second.columns)}


def block_summary(inputs: DataFrame, tables: dict[str, DataFrame], rule: int) -> DataFrame:
    """input_id, candidates, first, last: number, least and greatest UPRN of the candidates that `candidates` would pair by one rule.

    A block is summed up once and meets its addresses as one row, so the work grows with rows, not with pairs. Blocks of
    different keys have no rows in common, so an input_id with several keys gets the sum of theirs.
    """
    keys = [f"_k{i}" for i in range(len(RULES[rule]))]
    asked = inputs.select("input_id", *[F.col(mine).alias(k) for k, (_, mine) in zip(keys, RULES[rule], strict=True)]).distinct()
    rows = reduce(DataFrame.unionByName, [t.select(*[F.col(theirs).alias(k) for k, (theirs, _) in zip(keys, RULES[rule], strict=True)], "UPRN") for t in tables.values()])
    blocks = staged(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("UPRN").alias("first"), F.max("UPRN").alias("last")), "blocks")
    met = asked.join(F.broadcast(blocks) if blocks.count() <= FEW_BLOCKS else blocks.hint("merge"), keys)
    return met.groupBy("input_id").agg(F.sum("n").alias("candidates"), F.min("first").alias("first"), F.max("last").alias("last"))


def dealt_pairs(inputs: DataFrame, table: DataFrame, rule: int, pairs: int = PAIRS, share: int = SHARE) -> DataFrame:
    """Addresses joined to the register rows with a rule's equal keys (columns under `a.` and `r.`), common keys in shares."""
    return dealt(inputs, table, RULES[rule], pairs, share)


def dealt(inputs: DataFrame, table: DataFrame, on: list[tuple[str, str]], pairs: int = PAIRS, share: int = SHARE) -> DataFrame:
    """The same on any pairs of (a column of table, a column of inputs); inputs have an input_id, table has a row_key."""
    mine, theirs = [m for _, m in on], [t for t, _ in on]
    keys = [f"_k{i}" for i in range(len(mine))]
    left = inputs.select("*", *[F.col(m).alias(k) for m, k in zip(mine, keys, strict=True)])
    right = table.select("*", *[F.col(t).alias(k) for t, k in zip(theirs, keys, strict=True)])
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    sizes = left.where(known).groupBy(*keys).agg(F.count("*").alias("_a")).join(right.where(known).groupBy(*keys).agg(F.count("*").alias("_r")), keys)
    shares = lambda n: F.ceil(F.col(n) / share).cast("int")
    common = staged(sizes.where(F.col("_a") * F.col("_r") > pairs).select(*keys, shares("_a").alias("_as"), shares("_r").alias("_rs")), "common")
    if common.isEmpty():
        return left.alias("a").join(right.alias("r"), reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"r.{k}") for k in keys]))

    def deal(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row goes to one share of its own side, and to that one once for each share of the other side."""
        out = side.join(common, keys, "left")
        mine_at = F.pmod(F.xxhash64(key), F.coalesce(f"_{own}s", F.lit(1))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}s", F.lit(1)) - 1))
        return out.select("*", mine_at.alias(f"_{own}_at"), others.alias(f"_{other}_at")).drop("_as", "_rs")

    same = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"r.{k}") for k in (*keys, "_a_at", "_r_at")])
    return deal(left, "input_id", "a", "r").alias("a").join(deal(right, "row_key", "r", "a").alias("r"), same)


def candidates(inputs: DataFrame, tables: dict[str, DataFrame], rules: list[int] | None = None, last: DataFrame | None = None, pairs: int = PAIRS, share: int = SHARE) -> DataFrame:
    """Pairs of addresses and register rows with their stage; an equi-join for each stage, never an OR.

    `tables` are those of without_repeats. `last` (input_id, last) leaves later stages out.
    """
    if last is not None:
        inputs = inputs.join(last, "input_id")
    mine, parts = [c for c in inputs.columns if c != "last"], []
    for rule, table, stage in STAGES:
        if rules and rule not in rules:
            continue
        some = inputs.where(F.col("last") >= stage) if last is not None else inputs
        found = dealt_pairs(some, tables[table], rule, pairs, share)
        parts.append(found.select(*[f"a.{c}" for c in mine], F.lit(stage).alias("stage"), F.lit(rule).alias("rule"), *[f"r.{c}" for c in tables[table].columns]))
    return reduce(DataFrame.unionByName, parts)
