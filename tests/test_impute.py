import random
from collections import Counter

from pyspark.sql import functions as F

from wayloom.functions.text import is_placeholder, usable_word
from wayloom.operators.impute import Field, chained_imputation

SCHEMA = "id long, way string, kind string, top string, mh double"


def fill(df, **more):
    fields = [Field("kind", usable_word(F.col("kind")), is_placeholder(F.col("kind"))), Field("top", F.col("top"), F.col("top").isNull(), F.col("mh"))]
    return {r.id: r for r in chained_imputation(df, "id", "way", fields, **more).collect()}


def test_groups_that_agree_and_masks(spark):
    rows = [(1, "w", "road", "50", 50.0), (2, "w", " ROAD", None, None), (3, "w", "n/a", "50", 50.0), (4, "v", "path", "5", 5.0), (5, "v", "track", "walk", None), (6, "v", None, None, None), (7, None, None, "20", 20.0)]
    got = fill(spark.createDataFrame(rows, SCHEMA))
    assert len(got) == 7
    assert (got[3].kind, got[3].kind_filled, got[3].kind_alike) == ("road", True, True)
    assert (got[2].top, got[2].top_filled, got[2].top_alike) == ("50", True, True)
    assert got[2].kind == "road" and not got[2].kind_filled
    assert got[6].kind in ("path", "track") and got[6].kind_filled and got[6].kind_alike is False
    assert got[6].top_filled and got[6].top == "5"  # held within the range of the group's numbers
    assert got[7].kind_filled and got[7].kind in ("road", "path", "track") and got[7].kind_alike is None


def test_relations_and_variation(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        kind = rng.choice(["a", "b"])
        speed = (100.0 if kind == "a" else 20.0) * rng.choice([0.8, 1.0, 1.25])
        hide = rng.random()
        rows.append((i, f"w{i}", None if hide < 0.15 else kind, None if hide > 0.85 else str(int(speed)), None if hide > 0.85 else speed))
    got = fill(spark.createDataFrame(rows, SCHEMA))
    true = {i: rng for i, *rng in rows}
    kinds = [(got[i].kind, "a" if float(r[4]) > 50 else "b") for i, r in ((r[0], r) for r in rows) if r[2] is None]
    assert sum(a == b for a, b in kinds) / len(kinds) > 0.9
    a = [float(got[i].top) for i, r in true.items() if r[2] is None and r[1] == "a"]
    b = [float(got[i].top) for i, r in true.items() if r[2] is None and r[1] == "b"]
    assert sum(a) / len(a) > 3 * sum(b) / len(b)
    assert len(Counter(a)) > 20  # residual variation, not one predicted value


def test_repeatable_and_empty(spark):
    rows = [(i, "hot", "a" if i % 3 else "b", None if i % 5 == 0 else str(i % 7 + 1), None if i % 5 == 0 else float(i % 7 + 1)) for i in range(2000)] + [(5000, "hot", None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = fill(df), fill(df.repartition(3))
    assert one == two
    assert fill(df.limit(0)) == {}
    nothing = fill(spark.createDataFrame([(1, "w", None, None, None), (2, None, "?", None, None)], SCHEMA))
    assert nothing[1].kind is None and not nothing[1].kind_filled and nothing[2].top is None


def test_more_levels_than_the_models_know(spark):
    # 64 levels of 20 rows each, 300 of 4 each: nearly half of the observed cells are of a rarer level
    kinds = [f"t{i:02}" for i in range(64) for _ in range(20)] + [f"r{i:03}" for i in range(300) for _ in range(4)]
    rows = [(i, f"w{i}", k, "1", 1.0) for i, k in enumerate(kinds)]
    rows += [(10_000 + i, None, None, "1", 1.0) for i in range(1000)] + [(20_000 + i, f"v{i}", None, "1", 1.0) for i in range(1000)]
    rows += [(30_000 + i, "both", k, "1", 1.0) for i, k in enumerate(["t00", *["r000"] * 9])] + [(40_000 + i, "both", None, "1", 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fill(df)
    assert len(got) == len(rows) and all(got[r[0]].kind in set(kinds) and got[r[0]].kind_filled == (r[2] is None) for r in rows)
    free = Counter(got[i].kind for i, *_ in rows if 10_000 <= i < 30_000)
    assert 0.4 < sum(c for k, c in free.items() if k[0] == "r") / 2000 < 0.56 and sum(k[0] == "r" for k in free) > 230 and sum(k[0] == "t" for k in free) == 64
    # by number and probability: 9 of r000 (13 rows in all) against 1 of t00 (21 rows in all)
    both = Counter(got[i].kind for i, *_ in rows if i >= 40_000)
    assert set(both) == {"r000", "t00"} and 0.75 < both["r000"] / 300 < 0.93
    assert fill(df.repartition(3)) == got


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "w", "a", "1", 1.0, "x", "y" * 50_000)], SCHEMA + ", kind_filled string, v_kind string")
    out = chained_imputation(df, "id", "way", [Field("kind", F.col("kind"), F.lit(False))], keep=["kind_filled", "v_kind", "kind"])
    assert out.columns == ["id", "way", "kind_filled", "v_kind", "kind", "kind_", "kind_filled_", "kind_alike"]
    assert len(out.first().v_kind) == 50_000


def test_rarer_levels_are_filled_and_drawn_by_their_counts(spark):
    # 200 levels, 600 cells without evidence of a group
    rows = [(i, f"w{i}", f"t{i % 200:03}", "1", 1.0) for i in range(2000)] + [(10_000 + i, None, None, "1", 1.0) for i in range(600)]
    got = fill(spark.createDataFrame(rows, SCHEMA), rounds=1)
    assert all(got[10_000 + i].kind and got[10_000 + i].kind_filled for i in range(600))
    # groups with a rare value three times and a common one once
    rows = [(i, f"c{i}", f"t{i % 64:02}", "1", 1.0) for i in range(64 * 60)]
    for g in range(500):
        values = [f"rare{g % 100}"] * 3 + ["t00"]
        rows += [(100_000 + 10 * g + i, f"g{g}", v, "1", 1.0) for i, v in enumerate(values)] + [(100_000 + 10 * g + 5, f"g{g}", None, "1", 1.0)]
    got = fill(spark.createDataFrame(rows, SCHEMA), rounds=1)
    drawn = Counter(got[100_000 + 10 * g + 5].kind == f"rare{g % 100}" for g in range(500))
    assert 0.68 < drawn[True] / 500 < 0.82 and all(got[100_000 + 10 * g + 5].kind in ("t00", f"rare{g % 100}") for g in range(500))


def test_filled_cells_are_the_draws(spark, monkeypatch):
    """Where a group agrees its fitted distribution has one value; the cell has what was drawn from it, not a copy past the model."""
    from wayloom.operators import impute

    rows = [(i, f"w{i // 4}", None if i % 4 == 3 else "ab"[i // 4 % 2], "1", 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {got.kind for i, got in fill(df, rounds=1).items() if i % 8 == 3} == {"a"}
    real = impute._class_draw
    monkeypatch.setattr(impute, "_class_draw", lambda model: lambda *_: F.lit("z") if set(model[0]) == {"a", "b"} else real(model)(*_))
    assert {got.kind for i, got in fill(df, rounds=1).items() if i % 4 == 3} == {"z"}


def test_words_of_a_numeric_field(spark):
    rows = [(i, f"w{i}", "a", "walk" if i % 2 else "50", None if i % 2 else 50.0) for i in range(400)] + [(1000 + i, None, "a", None, None) for i in range(400)]
    got = fill(spark.createDataFrame(rows, SCHEMA), rounds=1)
    drawn = Counter(got[1000 + i].top == "walk" for i in range(400))
    assert 120 < drawn[True] < 280


def test_held_out(spark):
    from wayloom.operators.impute import held_out

    rng = random.Random(8)
    rows = [(i, f"w{i // 5}", "ab"[i // 5 % 2], "10" if i // 5 % 2 else "90", 10.0 if i // 5 % 2 else 90.0) for i in range(3000)]
    rng.shuffle(rows)
    fields = [Field("kind", F.col("kind"), F.col("kind").isNull()), Field("top", F.col("top"), F.col("top").isNull(), F.col("mh"))]
    got = {r.field: r for r in held_out(spark.createDataFrame(rows, SCHEMA), "id", "way", fields).collect()}
    assert set(got) == {"kind", "top"} and all(r.accuracy > 0.97 and 0.4 < r.most_frequent < 0.65 and 80 < r.cells < 250 for r in got.values())
