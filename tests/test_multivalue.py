import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.operators.multivalue import single_values, split_array, split_values


def by_hand(text):
    """The same grammar read character by character, for texts whose quotes and brackets are balanced."""
    out, part, quoted, depth, i = [], "", False, 0, 0
    while i < len(text):
        c = text[i]
        quoted ^= c == '"'
        if not quoted:
            depth += (c == "(") - (c == ")")
        if not quoted and not depth and c != ")":
            word = i and text[i - 1] in " \t\n" and re.match(r"and[ \t\n]", text[i:], re.I)
            if word:
                out.append(part)
                part, i = "", i + 3
                continue
            comma = c == "," and not (i and i + 1 < len(text) and text[i - 1] in "0123456789" and text[i + 1] in "0123456789")
            slash = c == "/" and not (re.search(r"(?<![a-z])(km|m|mi|ft)\s*$", text[:i], re.I) and re.match(r"\s*(h|s|min|sec)(?![a-z])", text[i + 1 :], re.I)) and not (re.search(r"(?<![a-z])n\s*$", text[:i], re.I) and re.match(r"\s*a(?![a-z])", text[i + 1 :], re.I))
            if c in ";|&\t\n" or comma or slash:
                out.append(part)
                part, i = "", i + 1
                continue
        part += c
        i += 1
    out.append(part)
    clean = []
    for p in out:
        p = p.strip(" \t\n")
        if len(p) >= 2 and p[0] == '"' == p[-1]:
            p = p[1:-1].replace('""', '"')
        clean.append(p)
    return clean


def split(text):
    parent, pos, items = split_array(pa.array([text]))
    assert pos.tolist() == list(range(1, len(pos) + 1))
    return items.to_pylist()


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("1;2", ["1", "2"]), (";1;;2", ["", "1", "", "2"]), ("1 and 2 AND 3", ["1", "2", "3"]), ("32,5 km/h, 4", ["32,5 km/h", "4"]), ("70 km / h / 50 mph", ["70 km / h", "50 mph"]), ("1/2", ["1", "2"]),
        ('"50 ""wet"""|6', ['50 "wet"', "6"]), ('"a;b";c', ["a;b", "c"]), ("5 @ (Mo,We; x)\t6", ["5 @ (Mo,We; x)", "6"]), ("n/a", ["n/a"]), ("sand", ["sand"]), ("", [""]), ('a"b;c', ['a"b', "c"]), ("(a;b", ["(a", "b"]),
    ],
)
def test_grammar(text, items):
    assert split(text) == items


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([";", "|", "&", ",", "/", " ", '"x;y"', '""', "(a,b)", "12", "3", " and ", "km/h", "m / s", "é", "\t", "n/a", "band"]), max_size=9).map("".join), max_size=6))
def test_same_as_by_hand(texts):
    parent, _, items = split_array(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for p, i in zip(parent.tolist(), items.to_pylist()):
        got[p].append(i)
    assert got == [by_hand(t) for t in texts]


def test_slices_nulls_and_long_texts():
    a = pa.array(["x", None, "1;2", "9;" * 50_000, "3"]).slice(1)
    parent, pos, items = split_array(a)
    assert parent.tolist()[:3] == [0, 1, 1]
    assert len(items) == 1 + 2 + 50_001 + 1
    assert single_values(pa.array(["1", "1;", None, ";", "1;2", ""])).to_pylist() == ["1", "1", None, None, None, None]
    assert single_values(pa.array([], pa.string())).to_pylist() == []


def test_operator(spark):
    df = spark.createDataFrame([(1, "1;;2", None, "p"), (1, "1;;2", None, "p"), (2, "3", "a|b", "q"), (None, "5;6", "", "r")], "edge int, lanes string, maxspeed string, item string")
    got = sorted(map(tuple, split_values(df, "edge", ["lanes", "maxspeed"]).collect()), key=str)
    assert got == sorted([(1, "lanes", 1, "1"), (1, "lanes", 3, "2")] * 2 + [(2, "maxspeed", 1, "a"), (2, "maxspeed", 2, "b"), (None, "lanes", 1, "5"), (None, "lanes", 2, "6")], key=str)
    assert split_values(df.limit(0), "edge", ["lanes"]).count() == 0
    assert split_values(df.withColumnRenamed("edge", "field_"), "field_", ["lanes"], least=1).count() == 7


def test_streaming_frame(spark, tmp_path):
    spark.createDataFrame([(1, "1;2")], "e int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("e int, v string").parquet(str(tmp_path / "in"))
    q = split_values(stream, "e", ["v"]).writeStream.format("memory").queryName("split_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("split_out").count() == 2
