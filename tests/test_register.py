import pytest
from pyspark.sql import functions as F

from waymark.operators import expand, multiplier
from waymark.operators.register import derive, vocabulary_by_outward, vocabulary_map
from waymark.schema import RAW_COLUMNS


def raw(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c, "") for c in RAW_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in RAW_COLUMNS))


ROW = {"UPRN": "1", "ORGANISATION_NAME": "ORG", "BUILDING_NUMBER": "99", "THOROUGHFARE": "HIGH STREET", "POST_TOWN": "EDINBURGH", "POSTCODE": "EH6 4RD"}


def test_derived_columns(spark):
    r = derive(raw(spark, ROW, ROW)).collect()
    assert len(r) == 1
    d = r[0].asDict()
    assert (d["n_tenement"], d["type_of_micro"], d["type_of_macro"], d["pc0"], d["pc1"]) == (1, "10001", "0100", "EH6", "4RD")
    assert [d[f"number_like_{i}"] for i in range(5)] == ["99", "", "", "", ""]


def test_bad_postcode_is_kept(spark):
    assert derive(raw(spark, ROW | {"POSTCODE": "?"})).first()["pc0"] == ""


def test_tenements_prefer_numbers(spark):
    rows = [ROW | {"UPRN": str(i), "BUILDING_NAME": "ROWAN", "BUILDING_NUMBER": "1" if i < 2 else ""} for i in range(3)]
    got = {r["UPRN"]: r["n_tenement"] for r in derive(raw(spark, *rows)).collect()}
    assert got == {"0": 2, "1": 2, "2": 3}


@pytest.mark.parametrize(
    ("name", "values"),
    [
        ("12-18", ["12", "14", "16", "18"]), ("12-15", ["12", "13", "14", "15"]), ("3A-3D", ["3A", "3B", "3C", "3D"]), ("FLATS 1-3", ["FLATS 1", "FLATS 2", "FLATS 3"]),
        ("7-7B", ["7", "7B"]), ("18-12", []), ("3D-3A", []), ("3A-5", []), ("ROWAN HOUSE", []), ("", []), (None, []),
    ],
)
def test_ranges(spark, name, values):
    df = spark.createDataFrame([(name,)], "n string").select(expand.range_values(F.col("n")).alias("v"))
    assert df.first()["v"] == values


def test_expanded_rows(spark):
    base = derive(raw(spark, ROW | {"BUILDING_NUMBER": "", "BUILDING_NAME": "12-14"}, *[ROW | {"UPRN": str(10 + i), "SUB_BUILDING_NAME": s} for i, s in enumerate(["1F1", "1F2", "2F1"])]))
    rows = expand.expanded(base).collect()
    assert {(r["BUILDING_NUMBER"], r["ex_label"]) for r in rows if r["UPRN"] == "1"} == {("12", "0-1rng"), ("14", "0-1rng")}
    assert {r["UPRN"]: r["number_like_1"] for r in rows if r["UPRN"] != "1"} == {"10": "1", "11": "2", "12": "3"}
    assert all(r["ex_label"] == "0_2_nl" for r in rows if r["UPRN"] != "1")


def alternatives(spark, *values):
    df = spark.createDataFrame([(str(i), "P", "T", "1", v) for i, v in enumerate(values)], "row_order string, POSTCODE string, THOROUGHFARE string, number_like_0 string, number_like_1 string")
    return {r["number_like_1"]: sorted(r["alt_1"]) for r in expand.alternatives(df, 1).collect()}


def test_alternative_rules(spark):
    assert alternatives(spark, "GROUND", "FIRST", "TOP") == {"GROUND": ["0", "G"], "FIRST": ["1"], "TOP": ["2"]}
    assert alternatives(spark, "LEFT", "RIGHT") == {"LEFT": ["1", "L"], "RIGHT": ["2", "R"]}
    assert alternatives(spark, "LEFT", "CENTRE", "RIGHT") == {"LEFT": ["1", "L"], "CENTRE": ["2", "C"], "RIGHT": ["3", "R"]}
    assert alternatives(spark, "LEFT", "7") == {"LEFT": [], "7": []}
    assert alternatives(spark, "A", "J")["J"] == ["9"]
    assert alternatives(spark, "A", "I", "J")["J"] == ["10"]
    assert alternatives(spark, "1F1", "3") == {"1F1": [], "3": []}


@pytest.mark.parametrize(
    ("level", "flat", "n", "expected"),
    [(4, 2, 8, (2, "exact")), (3, 2, 8, (2, "high_for_flat")), (3, 2, 7, (2, "medium_for_flat")), (4, 0, 8, (2, "high_for_level")), (4, 0, 9, (2, "guess")), (0, 0, 6, (2, "low")), (0, 0, 9, (3, "low")), (0, 0, 25, (5, "low")), (0, 0, 7, (2, "guess"))],
)
def test_guess_multiplier(spark, level, flat, n, expected):
    assert tuple(spark.range(1).select(multiplier.guess_multiplier(F.lit(level), F.lit(flat), F.lit(n)).alias("g")).first()["g"]) == expected


def test_vocabulary(spark):
    m = vocabulary_map(vocabulary_by_outward(derive(raw(spark, ROW, ROW | {"UPRN": "2", "THOROUGHFARE": "LOW ROAD"})))).first()
    assert m["pc0"] == "EH6" and m["vocabulary"] == {"THOROUGHFARE": ["HIGH STREET", "LOW ROAD"], "POST_TOWN": ["EDINBURGH"]}
