"""Quantities recorded in different units: unit texts are segmented and resolved to one common unit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions.text import PLACEHOLDERS
from wayloom.operators.multivalue import single_values
from wayloom.session import bounded_rows

# Roots with their size in metres and hours and the powers of length and time, and how usual each spelling is.
_METRE, _MILE, _FOOT, _NM, _S = Fraction(1), Fraction("1609.344"), Fraction("0.3048"), Fraction(1852), Fraction(1, 3600)
ROOTS: dict[str, list[tuple[Fraction, int, int, float]]] = {
    **dict.fromkeys(["m", "metre", "metres", "meter", "meters", "mtr"], [(_METRE, 1, 0, 0.9)]),
    **dict.fromkeys(["mi", "mile", "miles"], [(_MILE, 1, 0, 0.9)]),
    **dict.fromkeys(["ft", "foot", "feet"], [(_FOOT, 1, 0, 0.9)]),
    **dict.fromkeys(["nm", "nmi"], [(_NM, 1, 0, 0.5)]),
    **dict.fromkeys(["yd", "yard", "yards"], [(Fraction("0.9144"), 1, 0, 0.9)]),
    **dict.fromkeys(["h", "hr", "hrs", "hour", "hours", "std"], [(Fraction(1), 0, 1, 0.9)]),
    **dict.fromkeys(["s", "sec", "secs", "second", "seconds"], [(_S, 0, 1, 0.9)]),
    **dict.fromkeys(["min", "mins", "minute", "minutes"], [(Fraction(1, 60), 0, 1, 0.9)]),
    **dict.fromkeys(["kn", "kt", "kts", "knot", "knots"], [(_NM, 1, -1, 0.9)]),
    "f": [(_FOOT, 1, 0, 0.2)],
    "k": [(Fraction(1000), 1, 0, 0.2)],
}
ROOTS["m"] = [*ROOTS["m"], (_MILE, 1, 0, 0.2), (Fraction(1, 60), 0, 1, 0.05)]
PREFIXES = {
    "k": Fraction(1000), "kilo": Fraction(1000), "c": Fraction(1, 100), "centi": Fraction(1, 100), "m": Fraction(1, 1000), "milli": Fraction(1, 1000),
    "nautical ": Fraction("1852") / _MILE
}
EXPONENTS = {"-1": -1, "^-1": -1, "⁻¹": -1, "2": 2, "^2": 2, "²": 2}
OVER = {"/": 0.95, " per ": 0.95, "per": 0.5, "p": 0.4, " p ": 0.4, " an ": 0.3}
TIMES = {" ": 0.3, "*": 0.3, "·": 0.3, "": 0.2}

#: Of the dimensions (power of length, of time) and the sizes in metres and hours that a field holds, how likely each is.
PRIORS = {
    "speed": {
        "dimension": {(1, -1): 1.0},
        "scale": {Fraction(1000): 0.6, _MILE: 0.2, Fraction(3600): 0.1, _NM: 0.05, _FOOT * 3600: 0.03, Fraction(60): 0.02},
    },
    "length": {
        "dimension": {(1, 0): 1.0},
        "scale": {_METRE: 0.6, Fraction(1000): 0.2, _FOOT: 0.1, _MILE: 0.05, Fraction(1, 100): 0.03, _NM: 0.02},
    },
    "duration": {
        "dimension": {(0, 1): 1.0},
        "scale": {_S: 0.5, Fraction(1, 60): 0.3, Fraction(1): 0.2},
    },
}
_RARE = 1e-4
#: Roots that one unit may be made of. A text that needs more isn't read as a unit; so texts of any length take time in proportion.
MAX_FACTORS = 8


def _trie(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


_ROOT_TRIE, _PREFIX_TRIE, _EXPONENT_TRIE, _LINK_TRIE = _trie(ROOTS), _trie(PREFIXES), _trie(EXPONENTS), _trie([w for w in [*OVER, *TIMES] if w])


def _matches(trie: dict, text: str, at: int) -> Iterator[str]:
    node = trie
    while True:
        if "" in node:
            yield node[""]
        if at >= len(text) or text[at] not in node:
            return
        node, at = node[text[at]], at + 1


@lru_cache(maxsize=100_000)
def unit_scale(text: str, prior: str = "speed") -> Fraction | None:
    """The size of a unit text in metres and hours; None if it isn't a unit of a dimension that ``prior`` (a name in ``PRIORS``) knows.

    Dynamic programming over the text: from each position the tries give the prefixes, roots, exponents and links that begin there; a state
    is (position, roots so far, length, time, kinds of roots, size) and keeps its best score. Complete decompositions, in which no kind of
    root cancels out, are then weighed with the field's priors of dimension and size, so that in a speed field "mph" is miles and "mps" metres, and
    "kmh" a quotient though no
    stroke says so, while in a field of lengths "m" are metres and in one of durations minutes.
    """
    table = PRIORS[prior]
    s = re.sub(r"\s+", " ", text.strip().lower())
    s = re.sub(r" ?([/*·]) ?", r"\1", s)
    s = re.sub(r"(?<=[a-z])\.(?=[a-z]|$)", "", s)
    if not s:
        return None
    # states[i]: {(roots, length, time, (a length, a time), size): log score} of the decompositions of s[:i] that end with a root
    states: dict[int, dict] = {}

    def term(at: int, sign: int, state: tuple, score: float) -> None:
        roots, length, time, used, size = state
        if roots == MAX_FACTORS:
            return
        for prefix in ["", *_matches(_PREFIX_TRIE, s, at)]:
            for root in _matches(_ROOT_TRIE, s, at + len(prefix)):
                end = at + len(prefix) + len(root)
                for exponent in ["", *_matches(_EXPONENT_TRIE, s, end)]:
                    power = sign * EXPONENTS.get(exponent, 1)
                    for metres, of_length, of_time, usual in ROOTS[root]:
                        if prefix and not (of_length == 1 and of_time == 0 and usual >= 0.5) or prefix == "nautical " and metres != _MILE:
                            continue
                        factor = PREFIXES.get(prefix, Fraction(1)) * metres
                        new = (
                            roots + 1, length + power * of_length, time + power * of_time, (used[0] or of_length != 0, used[1] or of_time != 0),
                            size * factor**power
                        )
                        value = score + log(usual) + (log(0.8) if prefix else 0)
                        here = states.setdefault(end + len(exponent), {})
                        if value > here.get(new, -1e9):
                            here[new] = value

    term(0, 1, (0, 0, 0, (False, False), Fraction(1)), 0.0)
    for at in range(1, len(s)):
        for state, score in states.pop(at, {}).items():
            for link in ["", *_matches(_LINK_TRIE, s, at)]:
                if link in OVER:
                    term(at + len(link), -1, state, score + log(OVER[link]))
                if link in TIMES:
                    term(at + len(link), 1, state, score + log(TIMES[link]))
                    if state[1] and not state[2]:  # a quotient of which the stroke was left out
                        term(at + len(link), -1, state, score + log(TIMES[link] / 2))
        if not states:
            return None
    best, found = -1e9, None
    for (_roots, length, time, used, size), score in states.get(len(s), {}).items():
        if (length, time) in table["dimension"] and used == (length != 0, time != 0):
            score += log(table["dimension"][length, time]) + log(table["scale"].get(size, _RARE))
            if score > best:
                best, found = score, size
    return found


_NUMBER = re.compile(r"[+-]?(?:\d+(?:[.,]\d+)?|[.,]\d+)")
_LEAD = re.compile(r"^(?:max(?:imum)?|limit|speed|ca|approx|about)\b[.:]?\s*", re.I)


@lru_cache(maxsize=200_000)
def quantity(text: str, prior: str = "speed") -> tuple[str, Fraction | None, Fraction | None]:
    """(kind, number, size of the unit in the text). Kinds: ``none`` for placeholders, ``number`` (unit None: none named), ``word`` for anything else.
    """
    plain = text.strip()
    if plain.lower() in PLACEHOLDERS:
        return "none", None, None
    body = _LEAD.sub("", plain)
    m = _NUMBER.search(body)
    if not m:
        return "word", None, None
    before, after = body[: m.start()].strip(), body[m.end() :].strip()
    number = Fraction(m[0].replace(",", "."))
    if not before and not after:
        return "number", number, None
    if before and after:
        return "word", None, None
    scale = unit_scale(before or after, prior)
    return ("number", number, scale) if scale is not None else ("word", None, None)


def whole(x: Fraction) -> int:
    """The nearest integer, halves away from zero."""
    return int((Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal(1), ROUND_HALF_UP))


@lru_cache(maxsize=1_000)
def _default(unit: str | None, scale: float | None, prior: str) -> Fraction | None:
    """The size of one counted step of a feed; None where it names its units in the text."""
    if unit is None or scale is None or scale != scale:
        return None
    base = unit_scale(unit, prior)
    return None if base is None else base * Fraction(str(scale))


def _parse(values: pa.Array, defaults: list[tuple[str | None, float | None]], prior: str, common: Fraction) -> list[pa.Array]:
    """Value, word, as it is, vacant: the columns of ``common_units`` for each text. Texts are read once per batch and feed."""
    coded = values.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_pylist()
    singles = single_values(words).to_pylist()
    vacant = [t is None or t.strip(' \t\r\n;|&,/"').lower() in PLACEHOLDERS for t in words.to_pylist()]
    seen: dict = {}
    value, word, same, empty = [], [], [], []
    for code, unit in zip(codes, defaults):
        key = (code, unit)
        if key not in seen:
            out: tuple = (None, None, False, True)
            if code is not None:
                text = singles[code]
                if text is None:
                    out = (None, None, False, vacant[code])
                else:
                    kind, number, named = quantity(text, prior)
                    scale = named if named is not None else _default(*unit, prior)
                    if kind == "word":
                        out = (None, text.strip().lower(), False, False)
                    elif kind == "number" and number > 0 and scale is not None:
                        out = (whole(number * scale / common), None, scale, False)
            seen[key] = out
        a, b, c, d = seen[key]
        value.append(a), word.append(b), same.append(c), empty.append(d)
    return [pa.array(value, pa.int64()), pa.array(word, pa.string()), same, pa.array(empty, pa.bool_())]


def common_units(
    df: DataFrame, feeds: DataFrame | None, keep: list[str], field: str, prior: str, common: str, usual: str, names: tuple[str, ...], feed: str | None = "feed", max_feeds: int = 10_000
) -> DataFrame:
    """``keep`` of ``df`` and the quantity of ``field`` in whole units of ``common``, in one pass over Arrow batches.

    ``prior``: the kind of quantity, a name in ``PRIORS``. ``feeds`` (``feed``, ``unit``, ``scale``) says what numbers without a unit mean; a
    unit in the text overrides both. Added columns, under ``names``: the quantity (long; null unless the field holds exactly one
    value and that is a positive quantity), the word (the one value in lower case, where it is no quantity), whether it was recorded in
    ``usual`` at scale 1, and whether there is no usable value: null, blank, placeholder, a number not above 0, or one without any unit.
    Fields with several values have neither quantity nor word. Rows of a feed that isn't listed, or is null, count as feeds that name
    their units. Of several rows of a feed the smallest (unit, scale) counts. Added names that clash get the suffix ``_``.
    """
    from wayloom.session import free_name

    rows = bounded_rows(feeds.select("feed", "unit", F.col("scale").cast("double")), max_feeds, "feeds") if feeds is not None else []
    table = {r.feed: (r.unit, r.scale) for r in sorted(rows, key=str, reverse=True)}
    size, plain = unit_scale(common, prior), unit_scale(usual, prior)
    if size is None or plain is None:
        raise ValueError(f"{common!r} and {usual!r} must be units of a {prior}")
    n = len(keep)
    kinds = [T.LongType(), T.StringType(), T.BooleanType(), T.BooleanType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            defaults = [table.get(f, (None, None)) for f in batch.column(n + 1).to_pylist()]
            value, word, scales, empty = _parse(batch.column(n), defaults, prior, size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], value, word, pa.array([s == plain for s in scales], pa.bool_()), empty], names=schema.names
            )

    kept = df.select(*keep)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(a, k) for a, k in zip(free_name(kept, *names), kinds)]])
    source = F.col(feed).cast("string") if feed else F.lit(None).cast("string")
    return df.select(*keep, F.col(field).cast("string").alias("value__"), source.alias("feed__")).mapInArrow(run, schema)


def common_speeds(df: DataFrame, feeds: DataFrame, keep: list[str], field: str = "maxspeed", feed: str = "feed") -> DataFrame:
    """``common_units`` of speeds, in metres an hour: ``speed_mh``, ``word``, ``is_kmh`` (recorded in km/h at scale 1), ``vacant``."""
    return common_units(df, feeds, keep, field, "speed", "metres per hour", "km/h", ("speed_mh", "word", "is_kmh", "vacant"), feed)
