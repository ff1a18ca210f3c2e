import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import numbers, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("flat 3,  12 High St.", "FLAT 3 12 HIGH ST."), ("a--b///c", "A-B/C"), ("Café; Écosse", "CAFÉ ÉCOSSE"), ("O'Neil (rear)", "O'NEIL (REAR)"), (" x ", " X "), ("a_b\nc", "A_B\nC")],
)
def test_normalise(spark, given, expected):
    assert one(spark, text.normalise_address("a"), a=given) == expected


def test_null_and_blank_are_unusable(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "a string")
    assert [r[0] for r in df.select(text.usable("a")).collect()] == [False, False, True]
    assert df.select(text.normalise_address("a").alias("n")).collect()[0]["n"] is None


@pytest.mark.parametrize(("given", "valid", "shown"), [("EH64RD", True, "EH6 4RD"), ("EH6 4RD", True, "EH6 4RD"), ("EH6  4RD", False, "EH6  4RD"), ("x", False, "x"), (None, False, None)])
def test_postcode(spark, given, valid, shown):
    assert one(spark, text.is_postcode("a"), a=given) is valid
    assert one(spark, text.format_postcode("a"), a=given) == shown


def test_find_postcode_takes_the_first(spark):
    found = one(spark, text.find_postcode("a"), a="X EH64RD AND G1 1AA")
    assert found.asDict() == {"postcode": "EH6 4RD", "pc_area": "EH", "pc_district": "6", "pc_sector": "4", "pc_unit_0": "R", "pc_unit_1": "D"}
    assert one(spark, text.find_postcode("a"), a="NOTHING")["postcode"] is None


def test_pretty_round_trip(spark):
    fields = {c: f"v{i}" if i % 2 else "" for i, c in enumerate(text.ADDRESS_FIELDS)}
    assert one(spark, text.parse_pretty(text.pretty_fields()), **fields) == fields


def test_tokens(spark):
    assert one(spark, text.tokens("a"), a="12A HIGH-ST") == ["12", "A", " ", "HIGH", "-", "ST"]


def test_noise_count_and_f_beta(spark):
    assert one(spark, text.noise_count("a"), a="a,,b--c") == 4
    assert spark.range(1).select(text.f_beta(F.lit(0.0), F.lit(0.0)).alias("v")).first()["v"] == 0.0


@pytest.mark.parametrize(
    ("address", "slots", "textual"),
    [
        ("FLAT 3 12 HIGH STREET EDINBURGH EH6 4RD", ["12", "3"], None),
        ("12 FLAT 3 HIGH STREET", ["12", "3"], None),
        ("1/2 12 HIGH STREET", ["12", "1", "2"], "*/**** HIGH STREET"),
        ("7 F3 GRANVILLE TERRACE EDINBURGH", ["7", "3"], "* ** GRANVILLE TERRACE EDINBURGH"),
        ("1F2 21 HIGH STREET", ["21", "1F2"], None),
        ("", [], ""),
    ],
)
def test_parse_numbers(address, slots, textual):
    p = numbers.parse_numbers(address)
    assert [s for s in p["number_like"] if s] == slots and len(p["number_like"]) == 5
    assert len(p["textual"]) == len(address)
    if textual is not None:
        assert p["textual"] == textual


def test_parse_numbers_postcode():
    p = numbers.parse_numbers("FLAT 3 12 HIGH STREET EDINBURGH EH6 4RD")
    assert p["postcode"] == "EH6 4RD" and p["parts"] == ["EH", "6", "4", "R", "D"]


def test_register_numbers():
    assert numbers.register_numbers("", "", "99") == ["99", "", "", "", ""]
    assert numbers.register_numbers("FLAT 2", "", "5") == ["5", "2", "", "", ""]
    assert numbers.register_numbers("GROUND FLOOR LEFT", "", "5")[:3] == ["5", "GROUND", "LEFT"]
    assert numbers.register_numbers("1F2", "", "21")[:2] == ["21", "1F2"]


@pytest.mark.parametrize(
    ("address", "slots"),
    [
        ("3 FLAT 2", ["3", "2"]),  # a bare number before a led one is the building's
        ("3 FLAT 2 UNIT 9", ["3", "2", "9"]),
        ("1/2 ALDER ROAD", ["1", "2"]),
        ("FLAT 1F2", ["1F2"]),
        ("12A", ["12", "A"]),
        ("ALDER ROAD", []),
    ],
)
def test_number_slots(address, slots):
    assert numbers.parse_numbers(address)["number_like"] == slots + [""] * (5 - len(slots))


def test_one_bad_row_is_told_and_not_fatal(monkeypatch):
    from waymark.operators import parse

    known = parse.parse_numbers
    monkeypatch.setattr(parse, "parse_numbers", lambda a: 1 / 0 if "BAD" in a else known(a))
    out = parse.parse_fast.func(pd.Series(["1 BAD ROAD", None, "1 ALDER ROAD", ""]))
    assert out["error"].tolist() == ["ZeroDivisionError: division by zero", None, None, None]
    assert out["textual"].isna().tolist() == [True, True, False, True]
