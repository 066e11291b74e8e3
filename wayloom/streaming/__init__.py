"""Streams. Routing works on fixed graphs and has no streaming form.

The one-pass operators (splitting fields, common units, encoding and canonical texts with a given vocabulary) and the weighting of edges have
neither actions nor shuffles inside, so they take streaming frames as they are; ``latest_edges`` keeps deliveries of edges current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_edges(stream: DataFrame, key: str = "edge_id", at: str = "loaded_at", delay: str = "30 days", every: str = "30 days") -> DataFrame:
    """The last delivery of each edge within each span of ``every`` event time; of the same time the greatest row.

    One aggregation with partial results: in append mode a span's rows come out once the watermark (``delay`` behind the latest delivery) has
    passed it, and its state is dropped; in update mode a row comes out whenever a later delivery replaces it. Rows without key or time are dropped.
    On a fixed table it is the same aggregation. Names beyond the table's: ``span_start``.
    """
    rest = [c for c in stream.columns if c not in (key, at)]
    rows = stream.withWatermark(at, delay).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    last = rows.groupBy(F.window(at, every).alias("w_"), key).agg(F.max(F.struct(F.col(at), *rest)).alias("m_"))
    return last.select(key, f"m_.{at}", *[f"m_.{c}" for c in rest], F.col("w_.start").alias("span_start"))
