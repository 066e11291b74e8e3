"""The queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import lookalike, mixing, tokens
from wayloom.session import materialize, read


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return materialize(tokens.count_tokens(read(spark, d, "documents"), ["doc_id", "source"]))


def _mix(spark: SparkSession, d: str):
    return mixing.mix_sources(_counted(spark, d), read(spark, d, "mix_target"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix as large as all documents of listed sources together: more than the weights allow, so the exponent is below 1."""
    docs, goal = _counted(spark, d), read(spark, d, "mix_target")
    size = docs.join(goal.select("source"), "source", "left_semi").agg(F.sum("n_tokens")).first()[0]
    return mixing.shares(*mixing.mix_sources(docs, goal, budget=float(size or 0)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(read(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_text(read(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p7_tempered, p8_found, p8_canonical, p8_classes)}

ORACLES: dict[str, str] = {}
