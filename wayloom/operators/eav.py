"""Attribute-value rows into a wide table with one typed column per attribute, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.text import PLACEHOLDERS, is_placeholder, plain_key, trimmed
from wayloom.session import bounded_rows, small

DTYPES = {"word": "string", "text": "string", "int": "bigint", "num": "decimal(20,2)", "bool": "boolean", "date": "date"}

# Spellings of the two truth values, and the English month names.
TRUE = ["yes", "y", "true", "t", "1", "on"]
FALSE = ["no", "n", "false", "f", "0", "off"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


@dataclass(frozen=True)
class Attribute:
    name: str
    dtype: str


def typed_text(value: Column, dtype: str) -> Column:
    """``value`` as the canonical text of ``dtype`` (castable without loss), null where it is not usable."""
    return F.when(~is_placeholder(value), _typed(trimmed(value), dtype))


def _typed(text: Column, dtype: str) -> Column:
    """The canonical text of a trimmed text that is no placeholder."""
    if dtype == "word":
        return F.lower(text)
    if dtype == "text":
        return text
    if dtype == "int":
        return F.when(text.rlike(r"^[+-]?\d{1,18}(\.0*)?$"), F.regexp_extract(text, r"^\+?(-?\d+)", 1).try_cast("bigint").cast("string"))
    if dtype == "num":
        number = F.regexp_extract(text, r"^\+?(-?\d+(?:[.,]\d*)?|-?[.,]\d+)[\s]*(?:%|°|[A-Za-z]{1,8}\.?)?$", 1)
        return F.when(number != "", F.replace(number, F.lit(","), F.lit(".")).try_cast("decimal(20,2)").cast("string"))
    if dtype == "bool":
        return F.when(F.lower(text).isin(TRUE), "true").when(F.lower(text).isin(FALSE), "false")
    if dtype == "date":
        return date_of(text).cast("string")
    raise ValueError(f"unknown dtype {dtype!r}")


def date_of(text: Column) -> Column:
    """A full calendar date in one of the usual orders; null for incomplete or impossible ones. Day before month where points separate."""
    month = F.lpad(
        F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(text, r"([A-Za-z]{3,9})", 1), 1, 3))).cast("string"), 2,
        "0"
    )
    named = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
    part = lambda pattern, i: F.lpad(F.regexp_extract(text, pattern, i), 2, "0")
    iso, compact, point, day_first, month_first = (
        r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ]\d{1,2}:\d{2}.*)?$", r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})$",
        rf"^(?i)(\d{{1,2}})\.?\s+{named}\s+(\d{{4}})$", rf"^(?i){named}\s+(\d{{1,2}}),?\s+(\d{{4}})$",
    )
    ymd = (
        F.when(text.rlike(iso), F.concat_ws("-", F.regexp_extract(text, iso, 1), part(iso, 2), part(iso, 3)))
        .when(text.rlike(compact), F.concat_ws("-", F.regexp_extract(text, compact, 1), part(compact, 2), part(compact, 3)))
        .when(text.rlike(point), F.concat_ws("-", F.regexp_extract(text, point, 3), part(point, 2), part(point, 1)))
        .when(text.rlike(day_first), F.concat_ws("-", F.regexp_extract(text, day_first, 2), month, part(day_first, 1)))
        .when(text.rlike(month_first), F.concat_ws("-", F.regexp_extract(text, month_first, 2), month, part(month_first, 1)))
    )
    return ymd.try_cast("date")


def discover(keys: DataFrame, max_attributes: int = 5_000) -> list[Attribute]:
    """Attributes and types named by ``keys`` (``spelling``, ``attribute``, ``dtype``), each once, by name. An attribute with two types is an error.
    """
    rows = bounded_rows(
        keys.where(F.col("attribute").isNotNull()).select("attribute", "dtype").distinct().orderBy("attribute"), max_attributes, "attributes"
    )
    names = [r.attribute for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("an attribute has more than one dtype")
    if unknown := [r.dtype for r in rows if r.dtype not in DTYPES]:
        raise ValueError(f"unknown dtype {unknown[0]!r}")
    return [Attribute(r.attribute, r.dtype) for r in rows]


def widen(
    rows: DataFrame, keys: DataFrame, entity: str = "object_", key: str = "key", value: str = "value", order: tuple[str, ...] = ("rev", "edited_at")
) -> DataFrame:
    """One row per entity of ``rows``, with a typed column for each attribute of ``keys``.

    The attribute list and types are read first. Duplicates are resolved next: of the usable values of an entity's attribute the one with the
    highest ``order`` columns counts, the greatest text deciding ties; one narrow aggregate. Then one conditional aggregation per attribute
    pivots what is left. Both have partial aggregates before their shuffle, so a hot entity is no problem.
    Null keys and keys of no attribute are left out, null values, placeholders and values that don't fit the type are not usable. An entity
    without any usable value keeps a row of nulls; rows without an entity make none. Repeated rows change nothing; no rows give no rows.
    Other columns of ``rows`` are ignored. An attribute named like the entity gets the suffix ``_``.
    """
    attributes = discover(keys)
    spelled = keys.where(F.col("attribute").isNotNull()).select(
        plain_key(F.col("spelling")).alias("k_"), F.col("attribute").alias("a_"), F.col("dtype").alias("d_")
    ).where("k_ <> ''").distinct()
    tagged = rows.where(F.col(entity).isNotNull()).select(
        F.col(entity).alias("e_"), plain_key(F.col(key)).alias("k_"), F.col(value).cast("string").alias("v_"), *[
            F.col(c).alias(f"o{i}_") for i, c in enumerate(order)
        ]
    )
    text = F.lit(None).cast("string")
    for dtype in sorted({a.dtype for a in attributes}):
        text = F.when(F.col("d_") == dtype, _typed(F.col("v_"), dtype)).otherwise(text)
    # trimmed once, and only where the key is that of an attribute
    tagged = tagged.join(small(spelled), "k_", "left").withColumn("v_", F.when(F.col("a_").isNotNull(), trimmed(F.col("v_"))))
    tagged = tagged.withColumn("t_", F.when(~F.coalesce(F.lower("v_").isin(PLACEHOLDERS), F.lit(True)), text))
    # rows without a usable value only say that the entity is there
    named = F.when(F.col("t_").isNotNull(), F.col("a_"))
    ranked = F.when(F.col("t_").isNotNull(), F.struct(*[F.col(f"o{j}_") for j in range(len(order))], F.col("t_")))
    one = tagged.groupBy("e_", named.alias("a_")).agg(F.max(ranked).alias("b_")).select("e_", "a_", F.col("b_.t_").alias("t_"))
    best = [F.max(F.when(F.col("a_") == a.name, F.col("t_"))).alias(f"b{i}_") for i, a in enumerate(attributes)]
    wide = one.groupBy("e_").agg(*best) if best else one.select("e_").distinct()
    taken = {entity.lower()}
    out = [F.col("e_").alias(entity)]
    for i, a in enumerate(attributes):
        name = a.name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(F.col(f"b{i}_").cast(DTYPES[a.dtype]).alias(name))
    return wide.select(*out)


def cells(wide: DataFrame, entity: str = "object_") -> DataFrame:
    """The filled cells of a wide table as (entity, ``attribute``, ``item``), typed values as text."""
    parts = [F.struct(F.lit(c).alias("attribute"), F.col(f"`{c}`").cast("string").alias("item")) for c in wide.columns if c != entity]
    if not parts:
        return wide.select(entity, F.lit("").alias("attribute"), F.lit("").alias("item")).limit(0)
    return wide.select(entity, F.inline(F.filter(F.array(*parts), lambda c: c["item"].isNotNull())))
