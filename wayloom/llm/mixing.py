"""Mixing of sources to target weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from wayloom.session import bounded_rows, materialize

#: Sources that a table of targets may list.
MAX_SOURCES = 10_000
#: Blocks into which each pass over a source is cut; a block is taken whole, but for the last one.
BLOCKS = 4096


@dataclass(frozen=True)
class Plan:
    """Of one source: its target weight and what the mix takes.

    ``budget`` tokens in all; ``passes`` whole passes, then ``rest`` tokens of one more. ``exponent``: the one that was found for the mix.
    """

    source: str
    weight: float
    share: float
    tokens: int
    limit: int
    budget: float
    exponent: float

    @property
    def passes(self) -> int:
        return min(self.limit, int(self.budget // self.tokens)) if self.tokens else 0

    @property
    def rest(self) -> float:
        return max(0.0, self.budget - self.passes * self.tokens) if self.passes < self.limit else 0.0


def tempered(shares: list[float], exponent: float, prior: list[float] | None = None) -> list[float]:
    """Normalised shares^exponent x prior^(1 - exponent); without a prior, towards equal weights as the exponent falls to 0."""
    prior = prior or [1.0] * len(shares)
    raw = [s**exponent * p ** (1 - exponent) if s > 0 and p > 0 else 0.0 for s, p in zip(shares, prior)]
    total = sum(raw)
    return [x / total for x in raw] if total else raw


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def bisect_exponent(low: float, high: float, meets, steps: int = 60, grid: int = 64) -> float | None:
    """The largest exponent from ``low`` to ``high`` that ``meets``; None where none does.

    The exponents that meet a limit may form several intervals, so a grid is walked down from ``high`` first, and the bisection runs between
    the first one on it that meets and its neighbour above.
    """
    if meets(high):
        return high
    above = high
    for k in range(grid - 1, -1, -1):
        at = low + (high - low) * k / grid
        if meets(at):
            for _ in range(steps):
                middle = (at + above) / 2
                at, above = (middle, above) if meets(middle) else (at, middle)
            return at
        above = at
    return None


def _filled(shares: list[float], budget: float, most: list[float]) -> list[float]:
    """``budget`` shared out by ``shares``, none above its ``most``: what is over goes to the others in proportion."""
    out, free = [0.0] * len(shares), {i for i, s in enumerate(shares) if s > 0}
    while free:
        rest, total = budget - sum(out), sum(shares[i] for i in free)
        full = {i for i in free if rest * shares[i] / total > most[i] - out[i]}
        for i in full or free:
            out[i] = most[i] if full else rest * shares[i] / total
        free = free - full if full else set()
    return out


def plan_mix(
    tokens: dict[str, int],
    targets: dict[str, tuple[float, int]],
    budget: float | None = None,
    target_entropy: float | None = None,
) -> list[Plan]:
    """How much of each source to take.

    ``tokens``: tokens of each source, ``targets``: its weight and the most uses of one document. Sources without tokens or weight can't be
    drawn from; the weights of the others are normalised.

    The shares are always those of a temperature mix, source token shares^(1 - e) x weights^e, and e is always bisected: to the greatest
    exponent for which the limits of repetition leave room for the size wanted. Exponent 1 keeps the weights, 0 the natural shares.
    Without ``budget`` the size wanted is what the weights themselves allow, so the exponent comes out as 1, and the mix is then as large as
    the limits let it be. With a larger ``budget`` it comes out lower; where even the natural shares leave no room, sources at their
    limit are used up and the others give the rest. ``target_entropy``: the weights are replaced by natural shares^x, x bisected to that entropy.
    """
    usable = [s for s in sorted(targets) if tokens.get(s, 0) > 0 and targets[s][0] > 0 and targets[s][1] > 0]
    if not usable:
        return [Plan(s, targets[s][0], 0.0, tokens.get(s, 0), targets[s][1], 0.0, 1.0) for s in sorted(targets)]
    total = sum(tokens[s] for s in usable)
    natural = [tokens[s] / total for s in usable]
    wanted = [targets[s][0] for s in usable]
    wanted = [w / sum(wanted) for w in wanted]
    if target_entropy is not None:
        # the entropy falls as the exponent grows
        power = bisect_exponent(0.0, 16.0, lambda e: entropy(tempered(natural, e)) >= target_entropy)
        wanted = tempered(natural, 0.0 if power is None else power)
    most = [float(targets[s][1] * tokens[s]) for s in usable]

    def room(e: float) -> float:
        """The largest mix at exponent ``e`` that no limit of repetition stops."""
        return min(m / w for m, w in zip(most, tempered(wanted, e, natural)) if w > 0)

    size = room(1.0) if budget is None else min(budget, sum(most))
    exponent = bisect_exponent(0.0, 1.0, lambda e: room(e) * (1 + 1e-12) >= size)
    shares = tempered(wanted, exponent or 0.0, natural)
    taken = _filled(shares, size, most) if exponent is None else [min(s * size, m) for s, m in zip(shares, most)]
    got = dict(zip(usable, zip(shares, taken)))
    return [
        Plan(s, targets[s][0], got.get(s, (0.0,))[0], tokens.get(s, 0), targets[s][1], float(got.get(s, (0.0, 0.0))[1]), exponent or 0.0)
        for s in sorted(targets)
    ]


def mix_sources(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", budget: float | None = None,
    seed: int = 0, target_entropy: float | None = None
) -> tuple[DataFrame, list[Plan]]:
    """Draw documents so that each source has its weight in the total size. Returns (uses, plan).

    ``docs`` has a row per document with its ``size`` in tokens; ``targets`` the columns ``source``, ``weight``, ``max_repeat``. Uses: ``key``,
    ``source``, ``n_tokens``, ``uses`` (1 up to max_repeat; documents that are
    not used have no row). Every document of a source is used in each whole pass; the remaining part of a pass is the head of a random permutation by
    hash, cut at the budget: the pass is divided
    into ``BLOCKS`` blocks by hash, whose sizes are summed first; blocks within the budget are taken whole and only the block at its end is ordered
    document by document. So no source is ever
    sorted or gathered in one task, however many of the rows it holds. A source misses its budget by less than one document. ``budget`` and
    ``target_entropy`` are those of ``plan_mix``.

    Documents of a source that is null or not listed, with a null key, or without tokens are not drawn. Rows that repeat a key are documents of their
    own. Of several targets of a source the
    greatest (weight, max_repeat) counts; null weights and limits count as 0. Empty tables give an empty mix. Other columns are ignored.
    """
    rows = bounded_rows(
        targets.where(F.col("source").isNotNull()).select(
            "source", F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("max_repeat"), F.lit(0)).alias("max_repeat")
        ),
        MAX_SOURCES, "sources"
    )
    goal = {r.source: (float(r.weight), int(r.max_repeat)) for r in sorted(rows, key=lambda r: (r.source, r.weight, r.max_repeat))}
    clean = docs.select(
        F.col(key).alias("k_"), F.col(source).alias("s_"), F.col(size).cast("long").alias("n_")
    ).where("k_ is not null and s_ is not null and n_ > 0")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("s_"), F.col("k_").cast("string")), F.lit(BLOCKS)).cast("int").alias("b_")
    clean = clean.select("*", block)
    spark = docs.sparkSession
    # at most MAX_SOURCES x BLOCKS small rows, summed before the shuffle; only listed sources
    listed = F.broadcast(spark.createDataFrame([(s,) for s in goal], T.StructType([T.StructField("s_", T.StringType())])))
    blocks = clean.join(listed, "s_", "left_semi").groupBy("s_", "b_").agg(F.sum("n_").alias("t_"))
    totals = {r.s_: r.t_ for r in blocks.groupBy("s_").agg(F.sum("t_").alias("t_")).collect()}
    plan = plan_mix(totals, goal, budget, target_entropy)
    drawn = F.broadcast(
        spark.createDataFrame(
            [(p.source, p.passes, p.rest) for p in plan if p.budget > 0],
            T.StructType([T.StructField("s_", T.StringType()), T.StructField("p_", T.IntegerType()), T.StructField("r_", T.DoubleType())])
        )
    )
    by_source = Window.partitionBy("s_").orderBy("b_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = blocks.withColumn("end_", F.sum("t_").over(by_source)).withColumn("start_", F.col("end_") - F.col("t_")).join(drawn, "s_")
    last = heads.where("start_ < r_ and end_ >= r_").select("s_", "b_", (F.col("r_") - F.col("start_")).alias("left_"))
    edge = [(r.s_, r.b_, float(r.left_)) for r in bounded_rows(last, MAX_SOURCES, "sources")]
    ends = F.broadcast(
        spark.createDataFrame(
            edge, T.StructType([T.StructField("s_", T.StringType()), T.StructField("e_", T.IntegerType()), T.StructField("left_", T.DoubleType())])
        )
    )
    every = clean.join(drawn, "s_").join(ends, "s_", "left")
    full = F.when(F.col("r_") <= 0, 0).when(F.col("e_").isNull() | (F.col("b_") < F.col("e_")), 1).otherwise(0)
    within = every.where("b_ = e_")
    order = Window.partitionBy("s_", "b_").orderBy(
        F.xxhash64(F.lit(seed + 1), F.col("k_").cast("string")), "k_", "n_"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = within.withColumn("sum_", F.sum("n_").over(order)).withColumn("more_", (F.col("sum_") - F.col("n_") / 2 <= F.col("left_")).cast("int"))
    outside = every.where("e_ is null or b_ <> e_").withColumn("more_", full)
    picked = outside.unionByName(within.drop("sum_")).withColumn("u_", F.col("p_") + F.col("more_")).where("u_ > 0")
    return picked.select(
        F.col("k_").alias(key), F.col("s_").alias("source"), F.col("n_").alias("n_tokens"), F.col("u_").cast("int").alias("uses")
    ), plan


def shares(uses: DataFrame, plan: list[Plan]) -> DataFrame:
    """The report, one row per listed source: its target, what was reached in the total, and what stands against it."""
    spark = uses.sparkSession
    table = spark.createDataFrame(
        [(p.source, p.weight, p.share, p.tokens, p.limit, p.budget, p.exponent) for p in plan],
        "source string, weight double, planned_share double, source_tokens long, max_repeat int, planned_tokens double, exponent double",
    )
    got = uses.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("mix_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses")
    )
    out = table.join(F.broadcast(got), "source", "left").fillna(0, ["mix_tokens", "documents", "most_uses"])
    return out.withColumn("reached_share", F.coalesce(F.try_divide("mix_tokens", F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))
