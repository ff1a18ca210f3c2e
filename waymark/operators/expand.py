"""Register rows for other spellings: ranges of building numbers, and alternative flat numberings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import LEVEL_WORDS, SIDE_WORDS
from ..schema import NUMBER_SLOTS
from .register import number_columns

# Fixed values.
RANGE = "^([A-Z ]+)?(\\d+)([A-Z])?-(\\d+)([A-Z])?([A-Z ]+)?$"
LEVEL_CODES = {"BASEMENT": ["BF"], "BOTTOM": ["BF"], "GROUND": ["G", "0"], "FIRST": ["1"], "SECOND": ["2"], "THIRD": ["3"], "FOURTH": ["4"], "MIDDLE": ["M"], "MID": ["M"]}
TOP_WORDS = ["ATTIC", "TOP"]
SIDE_CODES = {"LEFT": ["L", "1"], "RIGHT": ["R", "2"]}
SIDE_CODES_WITH_CENTRE = {"LEFT": ["L", "1"], "RIGHT": ["R", "3"], "CENTRE": ["C", "2"]}
#: Flats to a level where levels and flats are ranked.
FLATS_PER_LEVEL = 20


def range_values(name: Column) -> Column:
    """What a range such as 12-18, 3A-3D, 7-7B or FLATS 1-3 stands for; an empty array for anything else."""
    part = lambda i: F.regexp_extract(name, RANGE, i)
    number = lambda i: F.expr("null").cast("int") if i is None else part(i).try_cast("int")
    prefix, c0, c1, suffix, n0, n1 = part(1), part(3), part(5), part(6), number(2), number(4)
    step = F.when(((n0 + n1) % 2 == 1) | (prefix != "") | (suffix != ""), 1).otherwise(2)
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    none = F.array().cast("array<string>")
    upto = lambda end: F.when(n0 <= end, text(F.sequence(n0, F.greatest(n0, end), step))).otherwise(none)
    last = F.concat(n1.cast("string"), c1)
    letters = F.transform(F.sequence(F.ascii(c0), F.greatest(F.ascii(c0), F.ascii(c1))), lambda x: F.concat(n0.cast("string"), F.char(x)))
    values = (
        F.when(n0.isNull() | n1.isNull(), none)
        .when((c0 == "") & (c1 == ""), upto(n1))
        .when((c0 == "") & (n0 == n1), F.array(n0.cast("string"), last))
        .when((c0 == "") & (n0 < n1), F.concat(upto(n1 - 1), F.array(last)))
        .when((c0 != "") & (c1 != "") & (n0 == n1) & (c0 <= c1), letters)
        .otherwise(none)
    )
    return F.transform(F.coalesce(values, none), lambda v: F.concat(prefix, v, suffix))


def expand_ranges(indexed: DataFrame) -> DataFrame:
    """One row for each value of a range in BUILDING_NAME: as building name if it has letters, else as building number."""
    rows = indexed.where(F.col("BUILDING_NAME").rlike(RANGE)).withColumn("_v", F.explode(range_values(F.col("BUILDING_NAME"))))
    lettered = F.col("_v").rlike("[A-Z]")
    rows = rows.withColumns(
        {
            "BUILDING_NUMBER": F.when(lettered, F.col("BUILDING_NUMBER")).otherwise(F.col("_v")),
            "BUILDING_NAME": F.when(lettered, F.col("_v")).otherwise(""),
            "ex_label": F.concat("ex_label", F.lit("-1rng")),
        }
    )
    return number_columns(rows.drop("_v")).select(*indexed.columns)


def _lookup(value: Column, codes: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("array<string>")
    for word, to in codes.items():
        out = F.when(value == word, F.array(*map(F.lit, to))).otherwise(out)
    return out


def alternatives(indexed: DataFrame, level: int) -> DataFrame:
    """alt_<level>: other values for a number slot, judged among the rows of one street and equal earlier slots.

    A rule fires for a group if some value fits it and none contradicts it; values come from what is written in the
    register, and repeated or unchanged ones are dropped.
    """
    slot, mark = NUMBER_SLOTS[level], f"alt_{level}"
    keys = ["POSTCODE", "THOROUGHFARE", *NUMBER_SLOTS[:level]]
    v = F.col(slot)
    group = Window.partitionBy(*keys)
    some = lambda c: F.coalesce(F.bool_or(c).over(group), F.lit(False))
    digits, letter = v.rlike("^\\d+$"), v.rlike("^[A-Z]$")
    floor, flat = (F.regexp_extract(v, "^(\\d+)F(\\d+)$", i).try_cast("int") for i in (1, 2))
    multiple = v.rlike("^\\d+F\\d+$")
    linear = (floor - 1) * FLATS_PER_LEVEL + flat
    by_rank = Window.partitionBy(*keys, multiple).orderBy(linear, "row_order")
    rank = F.row_number().over(by_rank).cast("string")
    one = lambda c: F.array(c)
    none = F.array().cast("array<string>")
    side_words, level_words = "|".join(SIDE_WORDS), "|".join(LEVEL_WORDS)
    centre, has_c, has_i = some(v == "CENTRE"), some(v == "C"), some(v == "I")
    lone = F.sum(F.when(v.rlike("^(L|C|R)$"), 1).otherwise(0)).over(group) == 1
    lcr = (
        F.when(~has_c, _lookup(v, {"L": ["1"], "R": ["2"]}))
        .when(lone, _lookup(v, {"C": ["3"]}))
        .otherwise(_lookup(v, {"L": ["1"], "C": ["2"], "R": ["3"]}))
    )
    ordinal = (F.ascii(v) - 64 - F.when(~has_i & (v > "I"), 1).otherwise(0)).cast("string")
    rules = [
        (multiple, digits, one(rank)),
        (v.rlike(level_words), F.lit(False), F.coalesce(_lookup(v, LEVEL_CODES), F.when(v.isin(TOP_WORDS), F.array(F.lit("<max>"))))),
        (v.rlike(side_words), digits | letter, F.when(centre, _lookup(v, SIDE_CODES_WITH_CENTRE)).otherwise(_lookup(v, SIDE_CODES))),
        (v.rlike("^(L|C|R)$"), digits | v.rlike("^[ABD-KM-QT-Z]$"), lcr),
        (letter, digits, one(ordinal)),
        (v == "G", v.rlike("^[A-FH-Z]$"), F.array(F.lit("0"))),
    ]
    found = [F.when(fits & some(fits) & ~some(against), F.coalesce(values, none)).otherwise(none) for fits, against, values in rules]
    out = indexed.withColumn(mark, F.array_distinct(F.concat(*found)))
    numbers = F.filter(F.concat(F.array(v), F.col(mark)), lambda x: x.rlike("^\\d+$"))
    highest = F.coalesce(F.max(F.array_max(F.transform(numbers, lambda x: x.try_cast("int")))).over(group), F.lit(0)) + 1
    resolved = F.transform(mark, lambda x: F.when(x == "<max>", F.col("_highest").cast("string")).otherwise(x))
    out = out.withColumn("_highest", highest).withColumn(mark, F.array_distinct(F.array_except(resolved, F.array(v))))
    return out.drop("_highest")


def expand_numbers(indexed: DataFrame) -> DataFrame:
    """All combinations of alternative number slots of each row, without the original one."""
    out = indexed.withColumn("row_order", F.xxhash64(*indexed.columns))
    levels = range(1, len(NUMBER_SLOTS))
    for level in levels:
        out = alternatives(out, level)
    out = out.where(" or ".join(f"size(alt_{i}) > 0" for i in levels))
    for i in levels:
        own = F.when(F.size(f"alt_{i}") > 0, F.col(f"alt_{i}")).otherwise(F.array(NUMBER_SLOTS[i]))
        out = out.withColumn(NUMBER_SLOTS[i], F.explode(own))
    return out.withColumn("ex_label", F.concat("ex_label", F.lit("_2_nl"))).select(*indexed.columns)


def expanded(indexed: DataFrame, keep_plain_ranges: bool = True) -> DataFrame:
    """Range rows and alternative numberings of register rows and of range rows; ex_label tells which."""
    ranges = expand_ranges(indexed)
    numbers = expand_numbers(indexed.unionByName(ranges))
    return ranges.unionByName(numbers) if keep_plain_ranges else numbers
