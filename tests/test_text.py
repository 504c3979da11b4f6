from pyspark.sql import functions as F
import pytest

from tagloom.functions.text import building_id, is_digits, is_number_token, is_point_like, strip, tokenize


def values(spark, function, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, s string")
    return [r.v for r in rows.select("i", function(F.col("s")).alias("v")).orderBy("i").collect()]


def test_tokenize(spark):
    cases = {
        "KWM-7.ENRG/kWh": ["KWM", "7", "ENRG", "kWh"],
        "lab204b": ["lab", "204", "b"],
        "N_WING.CT12:FAN3 Amps": ["N", "WING", "CT", "12", "FAN", "3", "Amps"],
        "": [],
        " _.-/:": [],
        "p\tq r": ["p", "q", "r"],
        "m³/h%": ["m", "³", "h", "%"],
        "ø#&": ["ø", "#", "&"],
        "T١٢x": ["T", "١٢", "x"],
        "😀1": ["😀", "1"],
    }
    assert values(spark, tokenize, list(cases)) == list(cases.values())
    assert values(spark, tokenize, [None]) == [None]


def test_point_like(spark):
    yes = ["KWM", "ct-04/fan", "Wet_Bulb", "lift4 B", "  GPM "]  # capitals; a separator and a digit; and a capital; a digit and a capital; blanks
    no = ["wet_bulb", "remarks", "Remark", "CamelWord", "heat pump", None, "Q", "Q7", "   ", "456"]
    assert values(spark, is_point_like, yes) == [True] * len(yes)
    assert values(spark, is_point_like, no) == [False] * len(no)


@pytest.mark.parametrize("name, expected", [("17_harbour_depot.csv", "harbour_depot"), ("4-_Mill.csv", "Mill"), ("annex.csv", "annex"), ("55.csv", ""), ("v1.2.csv", "v1.2")])
def test_building_id(spark, name, expected):
    assert values(spark, building_id, [name]) == [expected]


def test_number_tokens(spark):
    tokens = ["12", "²", "١", "ab", "%", "é", "#", "①", "\u3007", ""]
    assert values(spark, is_number_token, tokens) == values(spark, is_digits, tokens)


def test_digits_and_strip(spark):
    assert values(spark, is_digits, ["12", "²", "١", "1a", ""]) == [True, True, True, False, False]
    assert values(spark, strip, ["  a b \x1c"]) == ["a b"]
