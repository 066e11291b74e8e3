"""Searches by parts of the graph: no route leaves a weak component, so the edges of some components and the sources in them make a part that a task
searches for itself. The graph is sent nowhere whole and may be of any size, as long as each of its components fits a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.kernel import Csr
from wayloom.operators.structure import component_labels
from wayloom.schema import TRAVELLED, Graph
from wayloom.session import materialize, small

#: Edges that small components are put together to; a component of more is a part of its own.
PART_EDGES = 20_000
#: Edges that a component may have in one region; one of more is cut into regions of about as many.
REGION_EDGES = 500_000
#: What a row of a part is: an edge, something that is held for all sources of the part, or a source.
EDGE, HELD, SOURCE = 0, 1, 2


@dataclass
class Parts:
    """``edges``: ord, from_id, to_id, w, d, ``home`` and ``slices``; ``homes``: the same of each ``id``. A home is some small components or a large
    one; the sources of a large one are cut into slices, each with all of its edges.
    """

    edges: DataFrame
    homes: DataFrame
    largest: int
    tasks: int

    def at_home(self, frame: DataFrame, column: str) -> DataFrame:
        """The rows of ``frame`` whose id in ``column`` is in the graph, with ``home`` and ``slices``."""
        return frame.join(self.homes.withColumnRenamed("id", "id__"), F.col(column) == F.col("id__")).drop("id__")

    def outside(self, frame: DataFrame, column: str) -> DataFrame:
        return frame.join(self.homes.select(F.col("id").alias("id__")), F.col(column) == F.col("id__"), "left_anti")

    def run(
        self, rows: DataFrame, source: str, work: Callable[[Csr, list[pa.RecordBatch], pa.RecordBatch], Iterator[pa.RecordBatch]],
        schema: T.StructType, target: str | None = None, number: str | None = None, held: DataFrame | None = None, turned: bool = False,
        numbers: bool = True
    ) -> DataFrame:
        """``work(csr, held rows, rows)`` over all parts; ``rows`` and ``held`` (``id``, ``n``) are of ``at_home``. The rows reach ``work`` with the
        columns home, a (source), b (target) and x (number), in the order of their sources. ``numbers``: whether ``work`` asks for the graph's own numbers of edges.
        """
        kinds = {f.name: f.dataType for f in self.edges.schema.fields}
        none = lambda kind: F.lit(None).cast(kind)
        tail, head = ("to_id", "from_id") if turned else ("from_id", "to_id")

        def shaped(frame: DataFrame, role: int, part: Column, a, b, x, y, o) -> DataFrame:
            return frame.select(
                part.alias("part"), F.lit(role).alias("role"), F.col("home"), a.alias("a"), b.alias("b"), x.cast("double").alias("x"), y.alias("y"),
                o.alias("o")
            )

        each = F.when(F.col("slices") == 1, F.array("home")).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.xxhash64("home", s))
        )
        own = F.when(F.col("slices") == 1, F.col("home")).otherwise(
            F.xxhash64("home", F.pmod(F.xxhash64(source), F.col("slices")).cast("int"))
        )
        no_y, no_o = none("double"), none(kinds["ord"])
        both = shaped(
            self.edges.withColumn("p__", F.explode(each)), EDGE, F.col("p__"), F.col(tail), F.col(head), F.col("w"), F.col("d"), F.col("ord") if numbers else no_o
        ).unionByName(
            shaped(
                rows, SOURCE, own, F.col(source), F.col(target) if target else none(kinds["from_id"]), F.col(number) if number else none("double"),
                no_y, no_o
            )
        )
        if held is not None:
            both = both.unionByName(
                shaped(held.withColumn("p__", F.explode(each)), HELD, F.col("p__"), F.col("id"), none(kinds["from_id"]), F.col("n"), no_y, no_o)
            )

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, edges, kept, csr = None, [], [], None
            for b in batches:
                at, role = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(role) != 0)) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                    if i == j:
                        continue
                    if at[i] != part:
                        part, edges, kept, csr = at[i], [], [], None
                    piece = b.slice(i, j - i)
                    if role[i] != SOURCE:
                        (edges if role[i] == EDGE else kept).append(piece)
                        continue
                    if csr is None:
                        t = pa.Table.from_batches(edges)
                        c = lambda k: t.column(k).combine_chunks()  # noqa: B023, E731
                        csr, edges = Csr(c(3), c(4), c(5).to_numpy(), c(6).to_numpy(), c(7)), []
                    yield from work(csr, kept, pa.RecordBatch.from_arrays(piece.columns[2:6], names=["home", "a", "b", "x"]))

        return both.repartition(self.tasks, "part").sortWithinPartitions("part", "role", "a").mapInArrow(search, schema)


def _label_pairs(graph: Graph, edges: DataFrame, weight: str, length: str) -> tuple[DataFrame, bool]:
    """(pairs of ids that have the components of ``edges``, whether they are those of the plain graph): every compound edge stands for two edges of
    the plain graph, which are far fewer.
    """
    plain = graph.attributes.get("plain")
    if plain is not None:
        e = plain.standard(weight, length, whole=True).where(TRAVELLED).select(F.col("from_id").cast("string").alias("a"), F.col("to_id").cast("string").alias("b"))
        if not e.where(F.col("a").rlike("_(start|end)$") | F.col("b").rlike("_(start|end)$")).limit(1).count():
            return e, True
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), False


def parts_of(graph: Graph, edges: DataFrame, weight: str = "d_weighted", length: str = "d") -> Parts:
    """The parts of an edge table of ``Graph.standard``."""
    pairs, plain = _label_pairs(graph, edges, weight, length)
    labels = component_labels(pairs)
    if plain:  # a junction's vertices are in the component of the junction
        names = F.array("id", F.concat("id", F.lit("_start")), F.concat("id", F.lit("_end")))
        labels = labels.select(F.explode(names).alias("id"), "label")
    written = materialize(labels)
    labels = small(written)
    marked = edges.select("ord", "from_id", "to_id", "w", "d").join(labels, F.col("from_id") == F.col("id")).drop("id")
    if labels is written:  # else the labels go to the edges, which are not written again
        marked = materialize(marked)
    sizes = marked.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    n, largest, n_large = sizes.agg(
        F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0)), F.count(F.when(F.col("k") > PART_EDGES, 1))
    ).first()
    cores = edges.sparkSession.sparkContext.defaultParallelism
    bins, slices = max(1, -(-n // PART_EDGES)), max(1, -(-2 * cores // max(1, n_large)))
    shared, own = F.pmod(F.xxhash64("label"), F.lit(bins)), F.xxhash64("label", F.lit(-1))
    if n_large:
        large = small(sizes.where(F.col("k") > PART_EDGES).select("label", F.lit(True).alias("large__")))
        place = lambda frame: frame.join(large, "label", "left").withColumns({"home": F.when(F.col("large__"), own).otherwise(shared), "slices": F.when(F.col("large__"), F.lit(slices)).otherwise(F.lit(1))}).drop("label", "large__")
    else:
        place = lambda frame: frame.withColumns({"home": shared, "slices": F.lit(1)}).drop("label")
    homes = place(labels) if labels is written else F.broadcast(place(labels))
    return Parts(place(marked), homes, largest, max(2 * cores, min(4 * n_large * slices, 2000), min(bins, -(-n // 250_000))))


@dataclass
class RegionOf:
    """Of the vertices of a region's arrays: the region of each, and whether it is another than theirs; ``open``: whether any is."""

    region: np.ndarray
    outside: np.ndarray

    @cached_property
    def outside_list(self) -> list[bool]:
        return self.outside.tolist()

    @cached_property
    def open(self) -> bool:
        return bool(self.outside.any())


@dataclass
class Regions:
    """``edges``: ord, from_id, to_id, w, d, ``region`` of the start and ``beyond``, that of the end; ``homes``: the region of each ``id``. Small components
    are put together in regions of 0 or more; a region below 0 is a larger component or a piece of one, whose sources are cut into ``slices``.
    """

    edges: DataFrame
    homes: DataFrame
    borders: bool
    slices: int
    tasks: int

    def run(self, labels: DataFrame, work: Callable[[Csr, RegionOf, pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
        """``work(csr, regions of its vertices, labels)`` over the regions of ``labels`` (``source``, ``vertex``, ``region``, ``l``, ``fresh``, ``top_w``);
        all labels of a source in a region reach it at once.
        """
        kinds = {f.name: f.dataType for f in self.edges.schema.fields}
        none = lambda kind: F.lit(None).cast(kind)
        large = F.col("region") < 0
        each = F.when(large & F.lit(self.slices > 1), F.transform(F.sequence(F.lit(0), F.lit(self.slices - 1)), lambda s: F.xxhash64("region", s))).otherwise(F.array("region"))
        own = F.when(large & F.lit(self.slices > 1), F.xxhash64("region", F.pmod(F.xxhash64("source"), F.lit(self.slices)).cast("int"))).otherwise(F.col("region"))
        held = self.edges
        if self.borders:
            held = held.join(labels.select("region").distinct(), "region", "left_semi")
        held = held.withColumn("part", F.explode(each)).select(
            "part", F.lit(EDGE).alias("role"), none(kinds["from_id"]).alias("source"), F.col("from_id").alias("vertex"), "region", "w", "d",
            F.lit(0).cast("bigint").alias("hops"), F.col("to_id").alias("prev"), F.col("ord").alias("edge"), F.lit(False).alias("fresh"),
            F.lit(0.0).alias("top_w"), "beyond"
        )
        both = held.unionByName(labels.select(own.alias("part"), F.lit(SOURCE).alias("role"), "source", "vertex", "region", "l.*", "fresh", "top_w", F.col("region").alias("beyond")))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, edges, waiting, made = None, [], None, None
            for b in batches:
                at, role = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(role) != 0)) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                    if i == j:
                        continue
                    if at[i] != part:
                        if waiting is not None:
                            yield from work(*made, waiting)
                        part, edges, waiting, made = at[i], [], None, None
                    piece = pa.Table.from_batches([b.slice(i, j - i)])
                    if role[i] == EDGE:
                        edges.append(piece)
                        continue
                    if made is None:
                        made, edges = _arrays(edges, piece), []
                    rows = piece if waiting is None else pa.concat_tables([waiting, piece])
                    # the last source's labels may go on in the next batch
                    names = rows.column("source").combine_chunks()
                    same = pc.equal(names, names[-1]).to_numpy(zero_copy_only=False)
                    last = int(np.argmax(same))
                    if last:
                        yield from work(*made, rows.slice(0, last))
                    waiting = rows.slice(last)
            if waiting is not None:
                yield from work(*made, waiting)

        return both.repartition(self.tasks, "part").sortWithinPartitions("part", "role", "source").mapInArrow(search, schema)


def _arrays(edges: list[pa.Table], rows: pa.Table) -> tuple[Csr, RegionOf]:
    """The arrays of a region's edges, and the regions of their vertices. A vertex from which no edge starts has a label and no more."""
    own = rows.column("region")[0].as_py()
    t = pa.concat_tables(edges or [rows.slice(0, 0)])
    c = lambda k: t.column(k).combine_chunks()
    csr = Csr(c("vertex"), c("prev"), c("w").to_numpy(), c("d").to_numpy(), c("edge"))
    region = np.full(csr.n, own, np.int64)
    region[csr.index(c("prev"))] = c("beyond").to_numpy()
    return csr, RegionOf(region, region != own)


def regions_of(edges: DataFrame) -> Regions:
    """The regions of an edge table of ``Graph.standard``."""
    written = materialize(component_labels(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))))
    labels = small(written)
    marked = edges.select("ord", "from_id", "to_id", "w", "d").join(labels, F.col("from_id") == F.col("id")).drop("id")
    if labels is written:
        marked = materialize(marked)
    sizes = marked.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    n, n_large, n_cut, cut = sizes.agg(
        F.coalesce(F.sum("k"), F.lit(0)), F.count(F.when(F.col("k") > PART_EDGES, 1)), F.count(F.when(F.col("k") > REGION_EDGES, 1)),
        F.coalesce(F.sum(F.when(F.col("k") > REGION_EDGES, F.col("k"))), F.lit(0))
    ).first()
    bins, pieces = max(1, -(-n // PART_EDGES)), -(-cut // REGION_EDGES)
    shared = F.pmod(F.xxhash64("label"), F.lit(bins))
    region = shared
    if n_large:
        large = materialize(sizes.where(F.col("k") > PART_EDGES))
        marked, labels = marked.join(small(large), "label", "left"), labels.join(small(large), "label", "left")
        region = F.when(F.col("k").isNull(), shared).otherwise(-1 - pieces - F.pmod(F.xxhash64("label", F.lit(-1)), F.lit(1 << 60)))
    if n_cut:
        cut_up = F.coalesce("k", F.lit(0)) > REGION_EDGES
        apart = labels.where(cut_up).repartitionByRange(pieces, "label", "id").select("id", (-1 - F.spark_partition_id()).cast("bigint").alias("region"))
        homes = materialize(labels.where(~cut_up).select("id", region.alias("region")).unionByName(materialize(apart)))
        starts, ends = small(homes.select(F.col("id").alias("at__"), "region")), small(homes.select(F.col("id").alias("to__"), F.col("region").alias("beyond")))
        held = marked.drop("label", "k").join(starts, F.col("from_id") == F.col("at__")).join(ends, F.col("to_id") == F.col("to__"))
        held = materialize(held.drop("at__", "to__"))
    else:
        homes = labels.select("id", region.alias("region"))
        held = marked.withColumn("region", region).withColumn("beyond", F.col("region")).drop("label", "k")
    cores = edges.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-2 * cores // max(1, n_large - n_cut + pieces)))
    tasks = max(2 * cores, min(4 * (n_large - n_cut + pieces) * slices, 2000), min(bins, -(-n // 250_000)))
    return Regions(held, homes, bool(n_cut), slices, tasks)
