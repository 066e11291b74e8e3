"""Chained-equation imputation of categorical and numeric fields, with group evidence, masks and residual variation."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.session import forget, free_name, materialize, salted_join

#: Levels of a field that have coefficients of their own in the models; the rarer ones share theirs. Every level can be filled in.
MAX_LEVELS = 64
OTHER = "\u0000other"
#: The class of all numbers of a numeric field; its words are classes of their own.
NUMBER = "\u0000number"
#: Parts by hash in which rarer levels are kept, so that no list of them is long.
RARE_PARTS = 1024


@dataclass(frozen=True)
class Field:
    """A field to fill.

    ``value``: its usable value as text, null where it has none to learn from. ``missing``: whether it is to be filled. ``number``: its size,
    for numeric fields; a usable value without one is a word.
    """

    name: str
    value: Column
    missing: Column
    number: Column | None = None

    @property
    def numeric(self) -> bool:
        return self.number is not None


def uniform(*by: Column) -> Column:
    """A fixed number in [0, 1) for each row, from a hash of ``by``."""
    return F.pmod(F.xxhash64(*by), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _bin(c: Column) -> Column:
    """The level of a number in the models of other fields: steps of a fifth of its size. Null below or at 0."""
    return F.when(c > 0, F.concat(F.lit("\u0000b"), F.round(F.log2(c) * 5).cast("int").cast("string")))


def _pick(weighted: Column, u: Column) -> Column:
    """Of an array of struct(v, w), a ``v`` drawn by weight: the first whose running sum exceeds ``u`` of the total."""
    total = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x["w"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("v"))

    def step(s: Column, x: Column) -> Column:
        taken = F.coalesce(s["v"], F.when(s["sum"] + x["w"] > u * total, x["v"].cast("string")))
        return F.struct((s["sum"] + x["w"]).alias("sum"), taken.alias("v"))

    return F.coalesce(F.aggregate(weighted, start, step)["v"], F.element_at(weighted, -1)["v"].cast("string"))


class _Rarer:
    """The levels of a field without coefficients of their own, by group and over all, as tables to draw from by their counts.

    First a part by hash is drawn from the sums of at most ``RARE_PARTS`` parts, then a level of that part.
    """

    ALL = "a"

    def __init__(self, counted: DataFrame):
        """``counted``: ``group__``, ``v``, ``n``; the group may be null."""
        part = F.pmod(F.xxhash64("v"), F.lit(RARE_PARTS)).cast("int").alias("part__")
        whole = counted.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit(self.ALL).alias("at__"), "v", "n")
        own = counted.where("group__ is not null").select(self.key(F.col("group__")).alias("at__"), "v", "n")
        every = whole.unionByName(own).select("at__", part, "v", F.col("n").cast("double").alias("w"))
        lists = every.groupBy("at__", "part__").agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("levels__"), F.sum("w").alias("w"))
        self.lists = materialize(lists)
        parts = F.sort_array(F.collect_list(F.struct(F.col("part__").alias("v"), "w"))).alias("parts__")
        self.parts = materialize(self.lists.groupBy("at__").agg(parts))

    @staticmethod
    def key(group: Column) -> Column:
        return F.concat(F.lit("g"), group.cast("string"))

    def draw(self, frame: DataFrame, column: str, of_group: Column, *by: Column) -> DataFrame:
        """``frame`` with a level in place of ``OTHER``; of those of the group where ``of_group``."""
        rare = F.col(column) == OTHER
        rest = frame.where(~F.coalesce(rare, F.lit(False)))
        todo = frame.where(rare).withColumn("at__", F.when(of_group, self.key(F.col("group__"))).otherwise(self.ALL))
        todo = todo.join(self.parts, "at__", "left").withColumn("part__", _pick(F.col("parts__"), uniform(*by, F.lit("part"))).cast("int"))
        todo = todo.drop("parts__").join(self.lists.drop("w"), ["at__", "part__"], "left")
        todo = todo.withColumn(column, _pick(F.col("levels__"), uniform(*by, F.lit("level"))))
        return rest.unionByName(todo.drop("at__", "part__", "levels__"))


class _Tables:
    """Pairwise sufficient statistics for one field: counts of its classes with the levels of each other field and, for numbers, moments."""

    def __init__(self, rows: list, others: list[str]):
        self.others = others
        self.prior: dict[str, float] = {}
        self.given: dict[str, dict[str, dict[str, float]]] = {o: {} for o in others}
        self.moment: dict[tuple, tuple[float, float]] = {}
        self.both: dict[tuple, float] = {}
        self.n = self.sx = self.sxx = 0.0
        for r in rows:
            if r.q:
                self.both[r.p, r.b, r.q, r.c] = self.both.get((r.p, r.b, r.q, r.c), 0.0) + r.n
                continue
            if not r.p:
                self.prior[r.a] = self.prior.get(r.a, 0.0) + r.n
                if r.a == NUMBER:
                    self.n, self.sx, self.sxx = self.n + r.m, self.sx + r.sx, self.sxx + r.sxx
                continue
            at = self.given[r.p].setdefault(r.b, {})
            at[r.a] = at.get(r.a, 0.0) + r.n
            if r.a == NUMBER:
                n, s = self.moment.get((r.p, r.b), (0.0, 0.0))
                self.moment[r.p, r.b] = n + r.m, s + r.sx

    def classifier(self) -> tuple[list[str], np.ndarray, list[tuple[list[str], np.ndarray]]]:
        """Smoothed naive Bayes: the classes, their log prior, and of each other field its levels with log P(level | class); the last row is that of
        levels never met.
        """
        classes = sorted(self.prior)
        count = np.array([self.prior[a] for a in classes])
        tables = []
        for o in self.others:
            levels = sorted(self.given[o])
            n = np.array([[self.given[o][b].get(a, 0.0) for a in classes] for b in levels] + [[0.0] * len(classes)])
            tables.append((levels, np.log((n + 0.5) / (count + 0.5 * (len(levels) + 1)))))
        return classes, np.log(count / max(1.0, count.sum())), tables

    def regression(self) -> tuple[float, list[tuple[list[str], np.ndarray]], float]:
        """Ridge regression of the logarithm on the others' levels by the normal equations: intercept, coefficients by level, residual deviation."""
        names = [(o, b) for o in self.others for b in sorted(self.given[o])]
        index = {x: i + 1 for i, x in enumerate(names)}
        xx, xy = np.eye(len(names) + 1) * 1e-3, np.zeros(len(names) + 1)
        xx[0, 0] += self.n
        xy[0] = self.sx
        for x, (n, s) in self.moment.items():
            i = index[x]
            xx[i, i] += n
            xx[0, i] = xx[i, 0] = n
            xy[i] = s
        for (p, b, q, c), n in self.both.items():
            i, j = index[p, b], index[q, c]
            xx[i, j] = xx[j, i] = n
        beta = np.linalg.solve(xx, xy)
        deviation = math.sqrt(max(0.0, (self.sxx - beta @ xy) / max(1.0, self.n - 1)))
        tables = []
        for o in self.others:
            levels = sorted(self.given[o])
            tables.append((levels, np.array([beta[index[o, b]] for b in levels] + [0.0])))
        return float(beta[0]), tables, deviation


def _rows_of(levels: pa.Array, known: list[str]) -> np.ndarray:
    """The rows of a table of coefficients for ``levels``; the last for those never met."""
    at = pc.index_in(levels, value_set=pa.array(known, pa.string()))
    return pc.fill_null(at, len(known)).to_numpy(zero_copy_only=False).astype(int)


def _class_draw(model) -> Callable:
    """A vectorised draw of a class from the classifier.

    Where the group has observed values it is one more predictor, with P(group | class) as it was counted: the group's classes are then weighed by
    their number in the group times P(other fields | class), and no other class is possible.
    """
    classes, prior, tables = model
    place = {a: i for i, a in enumerate(classes)}

    @F.arrow_udf("string")
    def draw(need: pa.Array, u: pa.Array, group: pa.Array, *levels: pa.Array) -> pa.Array:
        at = np.flatnonzero(pc.fill_null(need, False).to_numpy(zero_copy_only=False))
        pick = pa.array(at)
        score = np.zeros((len(at), len(classes)))
        for (known, table), column in zip(tables, levels):
            score += table[_rows_of(column.take(pick), known)]
        u, group = u.take(pick).to_numpy(zero_copy_only=False), group.take(pick)
        alone = group.is_null().to_numpy(zero_copy_only=False)
        value = pa.array(classes, pa.string())
        chosen = np.full(len(at), -1)
        if alone.any():
            s = score[alone] + prior
            running = np.cumsum(np.exp(s - s.max(1, keepdims=True)), axis=1)
            chosen[alone] = np.minimum((running <= u[alone, None] * running[:, -1:]).sum(1), len(classes) - 1)
        if not alone.all():
            owner = pc.list_parent_indices(group).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(group)
            names, n = pc.struct_field(flat, "v"), pc.struct_field(flat, "n").to_numpy(zero_copy_only=False)
            code = np.array([place.get(v, -1) for v in names.to_pylist()])
            fit = np.where(code >= 0, score[owner, code], 0.0)
            top = np.full(len(at), -np.inf)
            np.maximum.at(top, owner, fit)
            running = np.cumsum(n * np.exp(fit - top[owner]))
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            last = np.concatenate([first[1:], [len(owner)]]) - 1
            rows = owner[first]
            before = np.concatenate([[0.0], running])[first]
            goal = before + u[rows] * (running[last] - before)
            chosen[rows] = len(classes) + np.clip(np.searchsorted(running, goal, side="right"), first, last)
            value = pa.concat_arrays([value, names.cast(pa.string())])
        out = np.full(len(need), -1)
        out[at] = chosen
        return value.take(pa.array(out, mask=out < 0))

    return draw


def _number_draw(model) -> Callable:
    """A vectorised draw of a number: the regression's prediction, the group's own deviation from it, and a residual, within the range of the group's
    numbers.
    """
    base, tables, deviation = model

    @F.arrow_udf("double")
    def draw(need: pa.Array, z: pa.Array, sx: pa.Array, nx: pa.Array, least: pa.Array, most: pa.Array, *levels: pa.Array) -> pa.Array:
        number = lambda c, empty: pc.fill_null(c.cast(pa.float64()), empty).to_numpy(zero_copy_only=False)
        mean = np.full(len(need), base)
        for (known, table), column in zip(tables, levels):
            mean += table[_rows_of(column, known)]
        n = number(nx, 0.0)
        mean += np.where(n > 0, (number(sx, 0.0) / np.maximum(n, 1) - mean) * n / (n + 1), 0.0)
        drawn = np.clip(np.round(np.exp(np.minimum(mean + deviation * number(z, 0.0), 700.0))), number(least, -np.inf), number(most, np.inf))
        return pa.array(drawn, mask=~pc.fill_null(need, False).to_numpy(zero_copy_only=False))

    return draw


def chained_imputation(df: DataFrame, key: str, group: str, fields: list[Field], keep: list[str] | None = None, rounds: int = 2) -> DataFrame:
    """Fill ``fields`` of ``df`` by chained equations, one row out for each row in.

    Output: ``key``, ``group``, ``keep``, and of each field F ``F`` (text; digits for numbers), ``F_filled`` (mask: the cell had no usable value
    and has been filled) and ``F_alike`` (the values observed in the cell's group all agree; null without any).

    ``rounds`` times, each field in turn is refitted on the current values of the others and all its vacant cells are redrawn from their fitted
    distribution. A class is drawn by naive Bayes on the levels of the other fields and, where there is evidence of it, the group. A numeric field has
    two
    parts, a classifier for numbers or words and a ridge regression of the logarithm of the numbers with a deviation by
    group and a residual draw, held within the range of the group's numbers. So where a group's values all agree, their fitted
    distribution has that value only. Draws are hashes of key and field: a rerun or a lost executor gives the same values.

    The models are fitted on all rows: one aggregation a step, combined before the shuffle, gives the counts of pairs of levels, of which there are
    at most (``MAX_LEVELS`` + 2)^2 for two fields, however many fields there are. Levels beyond the ``MAX_LEVELS`` most frequent share their
    coefficients, and which of them it is is drawn by their counts in the group, else over all. Group evidence is an aggregate by group and
    value, joined to the rows with vacant cells only; a group that holds much of the table is salted. Each step is written once.

    Rows with a null group have no group evidence; rows with a null key or the same key are filled alike. A field without any observed value
    stays null. Empty tables give empty tables. Other columns of ``df`` are not read; names that clash get ``_``.
    """
    keep = [c for c in keep or [] if c not in (key, group)]
    names, numeric = [f.name for f in fields], {f.name for f in fields if f.numeric}
    columns = [F.col(key).alias("key__"), F.col(group).alias("group__"), *[F.col(c).alias(f"keep{i}__") for i, c in enumerate(keep)]]
    for f in fields:
        columns += [f.value.cast("string").alias(f"v_{f.name}"), F.coalesce(f.missing, F.lit(True)).alias(f"m_{f.name}")]
        if f.numeric:
            columns.append(f.number.cast("double").alias(f"x_{f.name}"))
    base = materialize(df.select(*columns))

    def class_of(n: str, text: Column, number: Column | None) -> Column:
        return F.when(number > 0, F.lit(NUMBER)).otherwise(text) if n in numeric else text

    def level_of(n: str, text: Column, number: Column | None) -> Column:
        return F.coalesce(_bin(number), text) if n in numeric else text

    def of(n: str, prefix: str, wide: str) -> tuple[Column, Column | None]:
        return F.col(f"{prefix}_{n}"), F.col(f"{wide}_{n}") if n in numeric else None

    top, top_class, rarer = {}, {}, {}
    for n in names:
        seen = base.where(~F.col(f"m_{n}"))
        frequent = lambda c: [r[0] for r in seen.groupBy(c.alias("l")).count().where("l is not null").orderBy(F.desc("count"), "l").limit(MAX_LEVELS + 1).collect()]
        top[n] = frequent(level_of(n, *of(n, "v", "x")))[:MAX_LEVELS]
        classes = frequent(class_of(n, *of(n, "v", "x"))) if n in numeric else [*top[n], *frequent(F.col(f"v_{n}"))[MAX_LEVELS:]]
        top_class[n] = classes[:MAX_LEVELS]
        if len(classes) > MAX_LEVELS:
            text = class_of(n, *of(n, "v", "x"))
            counted = seen.where(text.isNotNull() & ~text.isin(top_class[n])).groupBy("group__", text.alias("v"))
            rarer[n] = _Rarer(counted.agg(F.count(F.lit(1)).alias("n")))

    def known(c: Column, levels: list[str]) -> Column:
        return F.when(c.isNull(), "").when(c.isin(levels), c).otherwise(OTHER) if levels else F.when(c.isNull(), "").otherwise(OTHER)

    evidence, vacant = _evidence(base, names, numeric, lambda n: class_of(n, *of(n, "v", "x")), top_class)
    gaps = salted_join(base.where(vacant), evidence, "group__", "size__", spread=F.col("key__")).drop("size__")
    for n in names:
        gaps = gaps.withColumn(f"c_{n}", F.when(~F.col(f"m_{n}"), F.col(f"v_{n}")))
        if n in numeric:
            gaps = gaps.withColumn(f"y_{n}", F.when(~F.col(f"m_{n}"), F.col(f"x_{n}")))
    whole, current = base.where(~vacant), materialize(gaps)

    def entries(n: str) -> Column:
        """What the rows of a combination of levels, with an observed value of ``n``, add to its pairwise statistics."""
        others = [o for o in names if o != n]
        sums = [F.col("n__").alias("n"), *[F.col(f"{c}_{n}").alias(c) if n in numeric else F.lit(0.0).alias(c) for c in ("m", "sx", "sxx")]]

        def cell(p: str = "", q: str = "") -> Column:
            level = lambda o: F.col(f"l_{o}") if o else F.lit("")
            return F.struct(
                F.lit(n).alias("f"), F.lit(p).alias("p"), level(p).alias("b"), F.lit(q).alias("q"), level(q).alias("c"), F.col(f"k_{n}").alias("a"),
                *sums
            )

        single = F.array(cell(), *[cell(o) for o in others])
        double = [cell(o, p) for i, o in enumerate(others) for p in others[i + 1 :]]
        every = F.when(F.col(f"k_{n}") == NUMBER, F.concat(single, F.array(*double))).otherwise(single) if n in numeric and double else single
        return F.when(F.col(f"k_{n}").isNotNull(), every).otherwise(F.slice(single, 1, 0))

    def statistics(frame: DataFrame, prefix: str, wide: str, of_fields: list[str]) -> dict[str, list]:
        """The rows of ``_Tables`` of each of ``of_fields``: rows are summed by the combinations of levels that occur, before those are taken apart
        into pairs.
        """
        columns = [known(level_of(n, *of(n, prefix, wide)), top[n]).alias(f"l_{n}") for n in names]
        moments = []
        for n in of_fields:
            seen = ~F.col(f"m_{n}") & F.col(f"v_{n}").isNotNull()
            columns.append(F.when(seen, known(class_of(n, *of(n, "v", "x")), top_class[n])).alias(f"k_{n}"))
            if n in numeric:
                columns.append(F.when(seen & (F.col(f"x_{n}") > 0), F.log(F.col(f"x_{n}"))).alias(f"x_{n}"))
                x = F.col(f"x_{n}")
                moments += [
                    F.count(x).cast("double").alias(f"m_{n}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"sx_{n}"),
                    F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"sxx_{n}")
                ]
        combined = frame.select(*columns).groupBy(
            *[f"l_{n}" for n in names], *[f"k_{n}" for n in of_fields]
        ).agg(F.count(F.lit(1)).alias("n__"), *moments)
        parts = [entries(n) for n in of_fields]
        rows = combined.select(F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))
        totals = rows.groupBy(*"fpbqca").agg(*[F.sum(c).alias(c) for c in ("n", "m", "sx", "sxx")])
        out: dict[str, list] = {}
        for r in totals.collect():  # at most (MAX_LEVELS + 2)^2 for each pair of fields
            out.setdefault(r.f, []).append(r)
        return out

    fixed = statistics(whole, "v", "x", names) if names else {}
    for turn in range(rounds):
        for n in names:
            others = [o for o in names if o != n]
            rows = fixed.get(n, []) + statistics(current, "c", "y", [n]).get(n, [])
            tables = _Tables(rows, others)
            if not tables.prior:
                continue
            u = uniform(F.col("key__"), F.lit(n), F.lit(turn))
            levels = [known(level_of(o, *of(o, "c", "y")), top[o]) for o in others]
            need, g = F.col(f"m_{n}"), F.col(f"g_{n}")
            step = current.withColumn("class__", _class_draw(tables.classifier())(need, u, F.when(need, g), *levels))
            if n in rarer:
                step = rarer[n].draw(step, "class__", g.isNotNull(), F.col("key__"), F.lit(n), F.lit(turn))
            text = F.col("class__")
            if n in numeric:
                wanted = need & (text == NUMBER)
                if tables.n:
                    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * uniform(F.col("key__"), F.lit(n), F.lit(-1 - turn)))
                    r = F.col(f"r_{n}")
                    drawn = _number_draw(tables.regression())(wanted, normal, r["sx"], r["nx"], r["least"], r["most"], *levels)
                else:
                    drawn = F.lit(None).cast("double")
                step = step.withColumn("drawn__", drawn)
                drawn = F.col("drawn__")
                digits = F.when(drawn == F.round(drawn), drawn.cast("bigint").cast("string")).otherwise(drawn.cast("string"))
                text = F.when(text == NUMBER, digits).otherwise(text)
                step = step.withColumn(f"y_{n}", F.when(need, drawn).otherwise(F.col(f"y_{n}")))
            step = step.withColumn(f"c_{n}", F.when(need, text).otherwise(F.col(f"c_{n}"))).select(*current.columns)
            old, current = current, materialize(step)
            forget(old)

    def result(frame: DataFrame, filled: bool) -> DataFrame:
        taken = df.select(key, group, *keep)
        out = [F.col("key__").alias(key), F.col("group__").alias(group), *[F.col(f"keep{i}__").alias(c) for i, c in enumerate(keep)]]
        for n in names:
            a, b, c = free_name(taken, n, f"{n}_filled", f"{n}_alike")
            if not filled:
                out += [F.col(f"v_{n}").alias(a), F.lit(False).alias(b), F.lit(None).cast("boolean").alias(c)]
                continue
            agree = F.col(f"one_{n}")
            out += [
                F.col(f"c_{n}").alias(a), (F.col(f"m_{n}") & F.col(f"c_{n}").isNotNull()).alias(b),
                F.when(F.col(f"g_{n}").isNotNull(), agree).alias(c)
            ]
        return frame.select(*out)

    return result(whole, False).unionByName(result(current, True))


def _evidence(base: DataFrame, names: list[str], numeric: set[str], class_of: Callable, top_class: dict[str, list[str]]) -> tuple[DataFrame, Column]:
    """What the observed values of each group say, one row a group with vacant cells, and the condition of rows with such cells.

    Of each field n: ``g_n`` its classes with their numbers (at most ``MAX_LEVELS`` and one for the rarer), ``one_n`` whether all values agree,
    ``r_n`` range and moments of its numbers; and in ``size__`` the vacant rows.
    """
    vacant = F.lit(False)
    for n in names:
        vacant = vacant | F.col(f"m_{n}")
    seen = base.where(F.col("group__").isNotNull())
    out = seen.where(vacant).groupBy("group__").agg(F.count(F.lit(1)).alias("size__"))
    blank = {"least": "double", "most": "double", "sx": "double", "nx": "bigint"}
    parts = []
    for n in names:
        one = class_of(n)
        x = F.when(F.col(f"x_{n}") > 0, F.col(f"x_{n}")) if n in numeric else F.lit(None).cast("double")
        short = F.when(one.isin(top_class[n]), one).otherwise(OTHER) if top_class[n] else F.lit(OTHER)
        rows = seen.where(F.col(f"v_{n}").isNotNull() & ~F.col(f"m_{n}")).select(
            "group__", short.alias("v"), F.col(f"v_{n}").alias("t"), x.alias("x")
        )
        stats = [
            F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("x").alias("least"), F.max("x").alias("most"),
            F.sum(F.log("x")).alias("sx"), F.count("x").alias("nx")
        ]
        parts.append(rows.groupBy("group__", "v").agg(*stats).withColumn("f", F.lit(n)))
    if not parts:
        return out, vacant
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    aggs = []
    for n in names:
        mine = F.col("f") == n
        # a list of a group has an entry a class, so it is short by construction
        aggs.append(F.collect_list(F.when(mine, F.struct("v", "n"))).alias(f"g_{n}"))
        aggs.append((F.min(F.when(mine, F.col("lo"))) == F.max(F.when(mine, F.col("hi")))).alias(f"one_{n}"))
        if n in numeric:
            most = {"least": F.min, "most": F.max, "sx": F.sum, "nx": F.sum}
            aggs.append(F.struct(*[most[c](F.when(mine, F.col(c))).cast(t).alias(c) for c, t in blank.items()]).alias(f"r_{n}"))
    by_group = every.groupBy("group__").agg(*aggs)
    for n in names:
        by_group = by_group.withColumn(f"g_{n}", F.when(F.size(f"g_{n}") > 0, F.sort_array(f"g_{n}")))
    return materialize(out.join(by_group, "group__", "left")), vacant


def held_out(df: DataFrame, key: str, group: str, fields: list[Field], share: float = 0.05, rounds: int = 2) -> DataFrame:
    """(``field``, ``cells``, ``right``, ``accuracy``, ``most_frequent``): how often the imputation gives back observed values that were hidden from
    it.

    ``share`` of the observed cells of each field, chosen by a hash of the key, are hidden at once. ``most_frequent`` is what always taking the most
    frequent of the hidden values would give. Rows of the same key are hidden alike.
    """
    names = [f.name for f in fields]
    hide = {
        f.name: ~F.coalesce(f.missing, F.lit(True)) & f.value.isNotNull() & (uniform(F.col(key), F.lit("hide " + f.name)) < share) for f in fields
    }
    shown = df.select(
        F.col(key).alias("k_"), F.col(group).alias("g_"),
        *[F.when(hide[f.name], f.value.cast("string")).alias(f"t{i}_") for i, f in enumerate(fields)],
        *[F.when(~hide[f.name], f.value.cast("string")).alias(f"u{i}_") for i, f in enumerate(fields)],
        *[(F.coalesce(f.missing, F.lit(True)) | hide[f.name]).alias(f"m{i}_") for i, f in enumerate(fields)],
        *[F.when(~hide[f.name], f.number.cast("double")).alias(f"x{i}_") for i, f in enumerate(fields) if f.numeric],
    )
    blind = [
        replace(
            f, name=f"f{i}_", value=F.col(f"u{i}_"), missing=F.col(f"m{i}_"), number=F.col(f"x{i}_") if f.numeric else None
        ) for i, f in enumerate(fields)
    ]
    got = chained_imputation(shown, "k_", "g_", blind, [f"t{i}_" for i in range(len(fields))], rounds)
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"), F.col(f"t{i}_").alias("truth"), F.col(f"f{i}__" if f"f{i}__" in got.columns else f"f{i}_").alias("got")
            ) for i, n in enumerate(names)
        ]
    )
    cells = got.select(F.inline(pairs)).where("truth is not null")
    by_value = cells.groupBy("field", "truth").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("truth") == F.col("got")).cast("long")).alias("hit"))
    out = by_value.groupBy("field").agg(F.sum("n").alias("cells"), F.coalesce(F.sum("hit"), F.lit(0)).alias("right"), F.max("n").alias("top"))
    return out.select(
        "field", "cells", "right", (F.col("right") / F.col("cells")).alias("accuracy"), (F.col("top") / F.col("cells")).alias("most_frequent")
    )
