"""Normalisation and text rendering as Column expressions. Blank fields are '' throughout, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ADDRESS_FIELDS

# Fixed values.
POSTCODE = "([A-Z]{1,2})([0-9][A-Z0-9]?)(?: *\\n?)?([0-9])([A-Z])([A-Z])"
WHOLE_POSTCODE = "^([A-Z]{1,2})([0-9][A-Z0-9]?) ?([0-9][A-Z]{2})$"
#: Characters outside of words, - / ' . ( ) and white space become spaces; runs of spaces, - and / become one.
NOISE = [("(?U)[^\\w\\-/\\s'.()]", " "), ("  +", " "), ("--+", "-"), ("//+", "/")]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_address(address: Column | str) -> Column:
    """Noise to spaces, runs to one, upper case; no trim. Null stays null and '' stays ''."""
    out = col(address)
    for pattern, to in NOISE:
        out = F.regexp_replace(out, pattern, to)
    return F.upper(out)


def noise_count(address: Column | str) -> Column:
    """How many replacements normalise_address makes."""
    out, n = col(address), F.lit(0)
    for pattern, to in NOISE:
        n = n + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, to)
    return n


def usable(address: Column | str) -> Column:
    return F.coalesce(F.length(col(address)) > 0, F.lit(False))


def is_postcode(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(WHOLE_POSTCODE), F.lit(False))


def format_postcode(value: Column | str) -> Column:
    """One space before the inward part; what isn't a postcode stays as it is."""
    return F.when(is_postcode(value), F.regexp_replace(col(value), WHOLE_POSTCODE, "$1$2 $3")).otherwise(col(value))


def find_postcode(address: Column | str) -> Column:
    """The first postcode-like part of a text as a struct of its five parts and the formatted code; nulls without one."""
    part = lambda i: F.regexp_extract(col(address), POSTCODE, i)
    found = F.coalesce(part(0) != "", F.lit(False))
    full = F.concat(part(1), part(2), F.lit(" "), part(3), part(4), part(5))
    names = ["pc_area", "pc_district", "pc_sector", "pc_unit_0", "pc_unit_1"]
    return F.struct(F.when(found, full).alias("postcode"), *[F.when(found, part(i + 1)).alias(n) for i, n in enumerate(names)])


def split_register_postcode(postcode: Column | str) -> dict[str, Column]:
    """pc0, pc1 and the five parts of a register's postcode, anchored at its start; '' where it doesn't parse."""
    at = lambda i: F.coalesce(F.regexp_extract(col(postcode), f"^(?:{POSTCODE})", i), F.lit(""))
    names = ["pc_area", "pc_district", "pc_sector", "pc_unit_0", "pc_unit_1"]
    parts = {n: at(i + 1) for i, n in enumerate(names)}
    return {"pc0": F.concat(parts["pc_area"], parts["pc_district"]), "pc1": F.concat(*[parts[n] for n in names[2:]])} | parts


def masked(value: Column, start: Column, length: Column) -> Column:
    """`length` characters from 1-based `start` as asterisks."""
    return F.overlay(value, F.repeat(F.lit("*"), length.cast("int")), start, length)


def joined_fields(prefix: str = "") -> Column:
    """The eleven address fields by comma; blanks keep theirs."""
    return F.concat_ws(",", *[F.coalesce(F.col(prefix + c), F.lit("")) for c in ADDRESS_FIELDS])


def pretty_fields(prefix: str = "") -> Column:
    """Four lines: occupant, street, place, postcode; fields by ' | '."""
    groups = [ADDRESS_FIELDS[:4], ADDRESS_FIELDS[4:7], ADDRESS_FIELDS[7:10], ADDRESS_FIELDS[10:]]
    return F.concat_ws("\n", *[F.concat_ws(" | ", *[F.coalesce(F.col(prefix + c), F.lit("")) for c in g]) for g in groups])


def parse_pretty(text: Column | str) -> Column:
    """The inverse of pretty_fields, as a map from field to value."""
    parts = F.flatten(F.transform(F.split(col(text), "\n", -1), lambda line: F.split(line, " \\| ", -1)))
    n = F.least(F.size(parts), F.lit(len(ADDRESS_FIELDS)))
    return F.map_from_arrays(F.slice(F.array(*map(F.lit, ADDRESS_FIELDS)), F.lit(1), n), F.slice(parts, F.lit(1), n))


def tokens(text: Column | str) -> Column:
    """Runs of digits, runs of letters or _, and every other character."""
    return F.regexp_extract_all(col(text), F.lit("(?U)(\\d+|[^\\W\\d]+|\\W)"), F.lit(1))


def as_text(value: Column | str, kind: str) -> Column:
    """Numbers as integer text, blanks for null and NaN."""
    c = col(value)
    if kind in ("double", "float"):
        c = F.when(F.isnan(c), None).otherwise(c).cast("bigint")
    return F.coalesce(c.cast("string"), F.lit(""))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """Weighted harmonic mean; 0 where it isn't defined."""
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))
