import math

import pytest
from pyspark.sql import functions as F

from wayloom.llm.mixing import bisect_exponent, entropy, mix_sources, plan_mix, shares, tempered


def test_weights_and_limits():
    plan = {p.source: p for p in plan_mix({"a": 1000, "b": 100, "c": 0}, {"a": (0.6, 1), "b": (0.3, 2), "c": (0.1, 5)})}
    assert plan["a"].share == pytest.approx(2 / 3) and plan["c"].budget == 0
    assert plan["b"].budget == pytest.approx(200)  # the limit that binds: each use of b
    assert plan["a"].budget == pytest.approx(400)
    more = {p.source: p for p in plan_mix({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 2)}, budget=1000)}
    assert more["b"].budget == pytest.approx(200, rel=1e-3) and sum(p.share for p in more.values()) == pytest.approx(1)


def test_budgets_are_fractions(spark):
    # weights times the budget may come out a little above the limit, which is a whole number
    plans = [plan_mix({"a": n, "b": 7 * n + 1}, {"a": (0.1, 3), "b": (0.7, 1)}) for n in range(1, 300)]
    assert {type(p.budget) for plan in plans for p in plan} == {float}
    uses = spark.createDataFrame([], "doc_id long, source string, n_tokens long, uses int")
    assert all(shares(uses, plan).count() == 2 for plan in plans[:3])


def test_temperature():
    n = [0.7, 0.2, 0.1]
    assert tempered(n, 1.0) == pytest.approx(n) and tempered(n, 0.0) == pytest.approx([1 / 3] * 3)
    want = 0.9
    e = bisect_exponent(0.0, 16.0, lambda x: entropy(tempered(n, x)) >= want)
    assert entropy(tempered(n, e)) == pytest.approx(want, abs=1e-9)
    plan = plan_mix({"a": 70, "b": 20, "c": 10}, {s: (1 / 3, 10) for s in "abc"}, target_entropy=want)
    assert entropy([p.share for p in plan]) == pytest.approx(want, abs=1e-9)
    assert plan_mix({}, {"a": (1.0, 1)})[0].budget == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(6000)] + [(10_000 + i, "small", 8) for i in range(300)] + [(20_000, None, 5), (20_001, "stray", 5), (None, "big", 5), (20_002, "big", 0), (20_003, "big", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("uses", F.lit("x"))


def test_mix_reaches_its_weights(spark, docs):
    targets = spark.createDataFrame([("big", 0.75, 1), ("small", 0.25, 3), ("none", 0.1, 1), (None, 0.5, 1), ("null", None, None)], "source string, weight double, max_repeat int")
    uses, plan = mix_sources(docs, targets)
    rows = uses.collect()
    size = {s: sum(r.n_tokens * r.uses for r in rows if r.source == s) for s in ("big", "small")}
    assert size["small"] == 7200  # three whole passes
    assert size["big"] == pytest.approx(21_600, abs=17)  # within a document
    assert {r.source for r in rows} == {"big", "small"} and max(r.uses for r in rows) == 3
    assert len({r.doc_id for r in rows}) == len(rows)
    again = {tuple(r) for r in mix_sources(docs.repartition(5), targets)[0].collect()}
    assert again == {tuple(r) for r in rows}
    other = {r.doc_id for r in mix_sources(docs, targets, seed=9)[0].collect() if r.source == "big"}
    assert other != {r.doc_id for r in rows if r.source == "big"}
    report = {r.source: r for r in shares(uses, plan).collect()}
    assert set(report) == {"big", "small", "none", "null"}
    assert report["big"].reached_share == pytest.approx(0.75, abs=1e-3) and report["none"].mix_tokens == 0
    assert math.isclose(sum(r.reached_share for r in report.values()), 1.0)


def test_mix_reaches_an_entropy(spark, docs):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, weight double, max_repeat int")
    uses, plan = mix_sources(docs, targets, target_entropy=0.3)
    reached = [r.reached_share for r in shares(uses, plan).collect()]
    assert entropy(reached) == pytest.approx(0.3, abs=1e-2) and max(r.uses for r in uses.where("source = 'big'").collect()) == 1


def test_budget_at_the_end_of_a_block(spark):
    even = spark.createDataFrame([(i, "even", 8) for i in range(10)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("even", 1.0, 3)], "source string, weight double, max_repeat int")
    for budget in (8, 40, 72, 80, 120, 240):
        uses = mix_sources(even, targets, budget=float(budget))[0].collect()
        assert sum(r.n_tokens * r.uses for r in uses) == budget


def test_repeats_and_empty(spark, docs):
    targets = spark.createDataFrame([("big", 1.0, 2)], "source string, weight double, max_repeat int")
    twice = docs.unionByName(docs)
    uses, _ = mix_sources(twice, targets, budget=1000.0)
    assert sum(r.n_tokens * r.uses for r in uses.collect()) == pytest.approx(1000, abs=17)
    none, plan = mix_sources(docs.limit(0), targets)
    assert none.count() == 0 and plan[0].budget == 0
    assert mix_sources(docs, targets.limit(0))[0].count() == 0
    assert shares(none, plan).first().reached_share == 0


def test_the_default_mix_comes_from_the_bisection(spark, docs, monkeypatch):
    from wayloom.llm import mixing

    targets = spark.createDataFrame([("big", 0.75, 1), ("small", 0.25, 3)], "source string, weight double, max_repeat int")
    asked = []
    real = mixing.bisect_exponent
    monkeypatch.setattr(mixing, "bisect_exponent", lambda *a, **k: asked.append(real(*a, **k)) or asked[-1])
    uses, plan = mix_sources(docs, targets)
    assert asked == [1.0] and {p.exponent for p in plan} == {1.0} and uses.count() > 0
    monkeypatch.setattr(mixing, "bisect_exponent", lambda *a, **k: 0.0)
    natural = {p.source: p.share for p in mix_sources(docs, targets)[1]}
    assert natural["small"] == pytest.approx(2400 / 80_000, rel=0.1)  # another exponent gives another mix


def test_budgets_beyond_the_weights():
    tokens, targets = {"a": 10_000, "b": 100, "c": 400}, {"a": (0.2, 1), "b": (0.4, 2), "c": (0.4, 2)}
    plan = plan_mix(tokens, targets, budget=5000.0)
    assert 0 < plan[0].exponent < 1 and sum(p.budget for p in plan) == pytest.approx(5000)
    assert all(p.budget <= p.limit * p.tokens * (1 + 1e-9) for p in plan)
    assert max(p.budget / (p.limit * p.tokens) for p in plan) == pytest.approx(1, rel=1e-6)  # a limit binds
    full = plan_mix(tokens, targets, budget=10_800.0)
    assert sum(p.budget for p in full) == pytest.approx(10_800) and all(p.budget <= p.limit * p.tokens + 1e-6 for p in full)
    assert sum(p.budget for p in plan_mix(tokens, targets, budget=1e9)) == pytest.approx(11_000)
    # limits may be met by exponents of several intervals
    assert bisect_exponent(0.0, 1.0, lambda e: e <= 0.2 or 0.5 <= e <= 0.7) == pytest.approx(0.7)
    assert bisect_exponent(0.0, 1.0, lambda e: False) is None
