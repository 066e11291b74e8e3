import datetime as dt
from decimal import Decimal

import pytest

from wayloom.operators import eav

KEYS = [("height", "height", "num"), ("hoehe", "height", "num"), ("name", "name", "text"), ("open since", "since", "date"), ("lit", "lit", "bool"), ("storeys", "storeys", "int"), ("kind", "kind", "word")]


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame(KEYS, "spelling string, attribute string, dtype string")


def table(spark, rows):
    return spark.createDataFrame(rows, "object_ string, key string, value string, rev int, edited_at timestamp")


def wide(spark, keys, rows):
    return {r.object_: r.asDict() for r in eav.widen(table(spark, rows), keys).collect()}


def test_types_and_spellings(spark, keys):
    t = dt.datetime(2024, 1, 1)
    out = wide(spark, keys, [("a", "HEIGHT ", "3,50 m", 1, t), ("a", "Open-Since", "7.3.2001", 1, t), ("a", "lit", "YES", 1, t), ("a", "storeys", "+4.0", 1, t), ("a", "kind", "  Barn ", 1, t), ("a", "name", " Old Barn ", 1, t)])["a"]
    assert out == {"object_": "a", "height": Decimal("3.50"), "name": "Old Barn", "since": dt.date(2001, 3, 7), "lit": True, "storeys": 4, "kind": "barn"}


@pytest.mark.parametrize(("text", "day"), [("2019-02-28", "2019-02-28"), ("2019/2/8", "2019-02-08"), ("20190208", "2019-02-08"), ("8 Feb 2019", "2019-02-08"), ("Feb 8, 2019", "2019-02-08"), ("2019-02-08T00:00:00", "2019-02-08"), ("31.02.2020", None), ("2019", None), ("2019-02", None), ("spring 2019", None), ("0000-00-00", None)])
def test_dates(spark, text, day):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(text,)], "v string").select(eav.typed_text(F.col("v"), "date")).first()[0]
    assert got == day


def test_highest_usable_revision_wins(spark, keys):
    t = dt.datetime(2024, 1, 1)
    out = wide(spark, keys, [("a", "storeys", "2", 1, t), ("a", "storeys", "3", 2, t), ("a", "storeys", "many", 9, t), ("a", "storeys", "?", 10, t), ("b", "storeys", "5", 1, t), ("b", "storeys", "7", 1, t), ("b", "storeys", "7", 1, t)])
    assert out["a"]["storeys"] == 3
    assert out["b"]["storeys"] == 7  # a tie: the greatest text


def test_nulls_long_texts_and_unknown_keys(spark, keys):
    t = dt.datetime(2024, 1, 1)
    out = wide(spark, keys, [(None, "name", "x", 1, t), ("a", None, "x", 1, t), ("a", "name", None, 1, t), ("a", "colour", "red", 1, t), ("b", "name", "x" * 100_000, None, None), ("b", "", "y", 1, t)])
    assert set(out) == {"a", "b"}
    assert out["a"]["name"] is None
    assert len(out["b"]["name"]) == 100_000


def test_empty_tables_and_clashes(spark, keys):
    assert eav.widen(table(spark, []), keys).count() == 0
    no_keys = keys.limit(0)
    assert eav.widen(table(spark, [("a", "name", "x", 1, None)] * 2), no_keys).collect() == [("a",)]
    clash = spark.createDataFrame([("object_", "object_", "word"), ("id", "Object_", "text")], KEYS_SCHEMA)
    out = eav.widen(table(spark, [("a", "id", "X", 1, None), ("a", "object_", "Y", 1, None)]), clash)
    assert out.columns == ["object_", "Object__", "object___"]
    with pytest.raises(ValueError):
        eav.discover(spark.createDataFrame([("a", "x", "int"), ("b", "x", "num")], KEYS_SCHEMA))


KEYS_SCHEMA = "spelling string, attribute string, dtype string"


def test_extra_columns_and_cells(spark, keys):
    from pyspark.sql import functions as F

    rows = table(spark, [("a", "name", "N", 1, None), ("a", "lit", "n", 1, None)]).withColumn("name", F.lit("other")).withColumn("attribute", F.lit(1))
    got = {tuple(r) for r in eav.cells(eav.widen(rows, keys)).collect()}
    assert got == {("a", "name", "N"), ("a", "lit", "false")}


def test_numbers_are_rounded_once(spark, keys):
    t = dt.datetime(2024, 1, 1)
    out = wide(spark, keys, [("a", "height", "1.00499999999999", 1, t), ("b", "height", "1.005", 1, t)])
    assert out["a"]["height"] == Decimal("1.00") and out["b"]["height"] == Decimal("1.01")
