from fractions import Fraction

import pytest

from wayloom.operators.units import common_speeds, common_units, quantity, unit_scale, whole

MILE = Fraction("1609.344")


@pytest.mark.parametrize(("text", "scale"), [("km/h", 1000), ("Km / h", 1000), ("kmh", 1000), ("kmph", 1000), ("kph", 1000), ("mph", MILE), ("m.p.h.", MILE), ("mi/h", MILE), ("miles per hour", MILE), ("m/s", 3600), ("mps", 3600), ("metres per second", 3600), ("m s-1", 3600), ("knots", 1852), ("kt", 1852), ("fps", Fraction("1097.28")), ("ft/s", Fraction("1097.28")), ("m/min", 60), ("m per min", 60), ("cm/s", 36), ("kilometres per hour", 1000), ("nautical miles per hour", 1852)])
def test_units(text, scale):
    assert unit_scale(text) == scale


@pytest.mark.parametrize("text", ["", "h", "metre", "wet", "bananas", "@ (Sa)", "km" * 40, "per"])
def test_no_units(text):
    assert unit_scale(text) is None


def test_quantities():
    assert quantity("max 32,5 mph") == ("number", Fraction(65, 2), MILE)
    assert quantity("km/h 070") == ("number", Fraction(70), 1000)
    assert quantity(" 50 ") == ("number", Fraction(50), None)
    assert quantity("Walk")[0] == "word"
    assert quantity('50 "wet"')[0] == "word"
    assert quantity("tbd")[0] == "none"
    assert whole(Fraction(5, 2)) == 3


def test_operator(spark):
    feeds = spark.createDataFrame([("a", "km/h", 1.0), ("b", "mph", 1.0), ("c", "km/h", 0.1), ("d", None, None)], "feed string, unit string, scale double")
    rows = [(1, "50", "a"), (2, "50", "b"), (3, "500", "c"), (4, "50", "d"), (5, "50 km/h", "b"), (6, "30;40", "b"), (7, "walk", "b"), (8, "-1", "b"), (9, None, "b"), (10, "N/A", "a"), (11, "5 kn;", "d"), (12, "50", None), (13, "50", "zz"), (14, " ", "a"), (14, " ", "a"), (15, "x" * 100_000, "a")]
    df = spark.createDataFrame(rows, "edge_id int, maxspeed string, feed string")
    got = {r[0]: tuple(r)[1:] for r in common_speeds(df, feeds, ["edge_id"]).collect()}
    assert got[1] == (50000, None, True, False)
    assert got[2] == (80467, None, False, False)
    assert got[3] == (50000, None, False, False)
    assert got[4] == got[8] == got[9] == got[10] == got[12] == got[13] == got[14] == (None, None, False, True)
    assert got[5] == (50000, None, True, False)
    assert got[6] == (None, None, False, False)
    assert got[7] == (None, "walk", False, False)
    assert got[11] == (9260, None, False, False)
    assert len(got[15][1]) == 100_000
    assert common_speeds(df.limit(0), feeds, ["edge_id"]).count() == 0
    clash = common_speeds(df.withColumnRenamed("edge_id", "Speed_mh"), feeds.limit(0), ["Speed_mh"])
    assert clash.columns == ["Speed_mh", "speed_mh_", "word", "is_kmh", "vacant"]
    assert clash.count() == len(rows)


def test_other_dimensions():
    assert unit_scale("m", "length") == 1 and unit_scale("m", "duration") == Fraction(1, 60) and unit_scale("m") is None
    assert unit_scale("ft", "length") == Fraction("0.3048") and unit_scale("km/h", "length") is None and unit_scale("h", "duration") == 1
    with pytest.raises(KeyError):
        unit_scale("m", "colour")


def test_long_units():
    assert unit_scale("kilometres" + " " * 500 + "per" + " " * 500 + "hour") == 1000
    assert unit_scale("km" * 50_000) is None and unit_scale("m/s" + "*m/m" * 3) == 3600


def test_lengths(spark):
    rows = [(1, "3 m"), (2, "10 ft"), (3, "2km"), (4, "50 km/h"), (5, None), (6, "1;2"), (7, "90 cm"), (8, "7")]
    df = spark.createDataFrame(rows, "id int, width string")
    got = {r[0]: tuple(r)[1:] for r in common_units(df, None, ["id"], "width", "length", "cm", "m", ("cm", "word", "is_m", "vacant"), feed=None).collect()}
    assert got[1] == (300, None, True, False) and got[2] == (305, None, False, False) and got[3][0] == 200_000 and got[7][0] == 90
    assert got[4] == (None, "50 km/h", False, False) and got[5][3] and got[6] == (None, None, False, False) and got[8] == (None, None, False, True)
