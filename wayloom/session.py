"""What the operators share: shared-folder tables, size-checked broadcasts, joins on skewed keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be sent to every executor. Anything that may hold more is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes that may be sent to every executor, as text.
BROADCAST_BYTES = 64 << 20
#: Bytes of a written table from which the shuffle files behind it are worth being deleted at once.
TIDY_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a folder of our own is taken in local mode only, in which driver and executors are one process. On a cluster that
    would be a machine-local folder that other executors can't read, so there it is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="wayloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again. Survives lost executors.

    The table belongs to the session and is deleted by ``forget``, by ``clear_tables``, or with the driver's end.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"t-{uuid.uuid4().hex}")
    if not _TABLES:
        atexit.register(clear_tables)
    _TABLES[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength() >= TIDY_BYTES:
        # the shuffle files behind the table are deleted when the driver collects its garbage, which may not be for long
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


#: Tables that ``materialize`` has written and nothing has deleted yet, with their sessions.
_TABLES: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _TABLES.pop(path, None)
    if spark is not None and spark._jsc is not None and spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing needs any more, so that long loops don't fill the shared folder."""
    for t in tables:
        if path := getattr(t, "_shared_path", None):
            _delete(path)


def clear_tables() -> None:
    """Delete every table of ``materialize`` that is left. Frames that still read them can't be used any more."""
    for path in list(_TABLES):
        try:
            _delete(path)
        except Exception:  # the session has ended, and with it the way to its file system
            _TABLES.pop(path, None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, with underscores where the frame already has such a column (letter case apart, as Spark resolves names)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a frame that must be small; an error instead of an unbounded collect."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def small(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``limit`` rows whose texts measure at most ``limit_bytes``, else as it is."""
    part = df.limit(limit + 1)
    texts = [F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields]
    size = F.lit(0)
    for t in texts:
        size = size + F.coalesce(t, F.lit(0)) + 8
    n, total = part.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= limit_bytes else df


def salted_join(
    left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, share: int = 64, salts: int = 32, how: str = "left"
) -> DataFrame:
    """Join on ``key`` where a few keys of ``left`` may hold most of its rows.

    ``right`` has one row per key and in ``weight`` the number of rows of that key. At most ``share`` keys can hold more than one
    ``share``-th of all rows; those are split over ``salts`` parts by ``spread`` (an expression on ``left``) and their right rows are repeated.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = [r[0] for r in right.where(F.col(weight) * share > F.lit(total)).select(key).limit(share).collect() if r[0] is not None]
    if not hot:
        return left.join(right, key, how)
    (salt,) = free_name(left, "salt_")
    is_hot = F.col(key).isin(hot)
    a = left.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    b = right.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, salt], how).drop(salt)
