"""Fields that hold several values: one row per value, with its position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What may stand on the two sides of a slash within a unit.
UNIT_OVER = [
    "km", "m", "mi", "ft", "nm", "nmi", "metre", "metres", "meter", "meters", "mile", "miles", "foot", "feet", "kilometre", "kilometres", "kilometer",
    "kilometers"
]
UNIT_UNDER = ["h", "hr", "hrs", "hour", "s", "sec", "secs", "second", "min", "mins", "minute"]

QUOTE, OPEN, CLOSE, COMMA, SLASH = b'"(),/'


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BLANK, DELIMITER, DIGIT = _table(b" \t\n\r\x0b\x0c"), _table(b";|&\t\n"), _table(b"0123456789")
LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
_OVER, _UNDER = frozenset(w.encode() for w in UNIT_OVER), frozenset(w.encode() for w in UNIT_UNDER)


def _unit_slash(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which slashes at ``at`` (their rows from ``lo`` to ``hi``) stand inside a unit, or in n/a."""
    raw, out = data.tobytes(), np.zeros(len(at), bool)
    for i, (p, a, z) in enumerate(zip(at.tolist(), lo.tolist(), hi.tolist())):
        left = raw[max(a, p - 24) : p].rstrip()
        right = raw[p + 1 : min(z, p + 25)].lstrip()
        j, k = len(left), 0
        while j and LETTER[left[j - 1]]:
            j -= 1
        while k < len(right) and LETTER[right[k]]:
            k += 1
        sides = left[j:].lower(), right[:k].lower()
        out[i] = sides[0] in _OVER and sides[1] in _UNDER or sides == (b"n", b"a")
    return out


def split_array(values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(parent, position from 1, item) of every value of a string array, empty places included as empty items.

    The string buffer is scanned once: the parity of the quotes and the depth of the brackets before each byte, each relative to its row's start, mask
    the delimiters. A quote or
    bracket that is never closed is an ordinary character. Null and empty texts give one empty item.
    """
    values = pc.fill_null(values.cast(pa.string()), "")
    n = len(values)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int32), pa.array([], pa.string())
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offs = offsets - offsets[0]
    size, lengths = len(data), np.diff(offs)
    row = np.repeat(np.arange(n), lengths)

    def within(flags: np.ndarray) -> np.ndarray:
        """Running sum of ``flags`` before each byte, from the start of its row."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[:-1] - np.repeat(total[offs[:-1]], lengths)

    quotes = data == QUOTE
    odd = np.flatnonzero(np.bincount(row[quotes], minlength=n) & 1)
    if len(odd):  # the last quote of such a row closes nothing
        places = np.flatnonzero(quotes)
        quotes = quotes.copy()
        quotes[places[np.searchsorted(places, offs[odd + 1]) - 1]] = False
    free = (within(quotes) & 1) == 0
    brackets = ((data == OPEN) & free).astype(np.int64) - ((data == CLOSE) & free)
    if brackets.any():
        for r in np.unique(row[brackets != 0]).tolist():  # leave only brackets with a partner
            stack, alone = [], []
            for p in (np.flatnonzero(brackets[offs[r] : offs[r + 1]]) + offs[r]).tolist():
                if brackets[p] > 0:
                    stack.append(p)
                elif stack:
                    stack.pop()
                else:
                    alone.append(p)
            brackets[stack + alone] = 0
        free &= within(brackets) == 0

    before, after = np.zeros(size, bool), np.zeros(size, bool)
    digit = DIGIT[data]
    before[1:], after[:-1] = digit[:-1], digit[1:]
    inner = lengths > 0
    before[offs[:-1][inner]] = False
    after[offs[1:][inner] - 1] = False
    cut = free & (DELIMITER[data] | ((data == COMMA) & ~(before & after)))
    slash = np.flatnonzero(free & (data == SLASH))
    cut[slash[~_unit_slash(data, slash, offs[row[slash]], offs[row[slash] + 1])]] = True
    starts = np.flatnonzero(cut)
    ends = starts + 1
    if size >= 5:
        low = data | 0x20
        word = np.flatnonzero((low[1:-3] == 97) & (low[2:-2] == 110) & (low[3:-1] == 100) & BLANK[data[:-4]] & BLANK[data[4:]] & free[1:-3]) + 1
        word = word[(word - 1 >= offs[row[word]]) & (word + 3 < offs[row[word] + 1])]
        starts, ends = np.concatenate([starts, word]), np.concatenate([ends, word + 3])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]

    owner = row[starts]
    parent = np.concatenate([np.arange(n), owner])
    order = np.lexsort((np.concatenate([np.full(n, -1), starts]), parent))
    a = np.concatenate([offs[:-1], ends])[order]
    parent = parent[order]
    last = np.concatenate([parent[1:] != parent[:-1], [True]])
    z = np.empty(len(a), np.int64)
    z[last], z[~last] = offs[1:], starts
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    position = (np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]]))) + 1).astype(np.int32)

    solid = ~BLANK[data]
    index = np.arange(size)
    following = np.concatenate([np.minimum.accumulate(np.where(solid, index, size)[::-1])[::-1], [size]])
    preceding = np.concatenate([[-1], np.maximum.accumulate(np.where(solid, index, -1))])
    a = np.minimum(following[a], z)
    z = np.maximum(preceding[z] + 1, a)
    quoted = z - a >= 2
    quoted[quoted] = (data[a[quoted]] == QUOTE) & (data[z[quoted] - 1] == QUOTE)
    a, z = a + quoted, z - quoted
    length = z - a
    ends = np.cumsum(length)
    take = np.arange(ends[-1]) + np.repeat(a - (ends - length), length)
    items = pa.StringArray.from_buffers(
        len(a), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[take]))
    )
    if quoted.any():
        items = pc.if_else(pa.array(quoted), pc.replace_substring(items, '""', '"'), items)
    return parent.astype(np.int64), position, items


def _empty(items: pa.Array) -> np.ndarray:
    return pc.equal(pc.utf8_trim_whitespace(items), "").to_numpy(zero_copy_only=False)


def single_values(values: pa.Array) -> pa.Array:
    """For each text its only non-empty value; null where it has none or several."""
    parent, _, items = split_array(values)
    full = ~_empty(items)
    one = np.bincount(parent[full], minlength=len(values)) == 1
    keep = full & one[parent]
    at = np.full(len(values), -1)
    at[parent[keep]] = np.flatnonzero(keep)
    return items.take(pa.array(at, mask=at < 0))


def split_values(df: DataFrame, key: str, fields: list[str], least: int = 2) -> DataFrame:
    """(``key``, ``field``, ``pos``, ``item``): one row per value of each of ``fields`` that holds at least ``least`` non-empty values.

    Values are separated by ; | & tab, line end, the word "and" between blanks, a slash outside units, and a comma that isn't directly between digits;
    not
    within quotes or round brackets. ``pos`` counts from 1 and counts empty places, which give no row. No shuffle: one pass over Arrow batches.
    Null, empty and blank fields give no rows; repeated rows give repeated rows; other columns are not read. Texts of any length are scanned whole.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields):
                column = batch.column(i + 1)
                parent, pos, items = split_array(column)
                full = ~_empty(items)
                full &= (np.bincount(parent[full], minlength=len(column)) >= least)[parent]
                at = np.flatnonzero(full)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(parent[at])), pa.array([field] * len(at), pa.string()), pa.array(pos[at]),
                        items.take(pa.array(at))
                    ], names=["key_", "field", "pos", "item"]
                )

    schema = T.StructType(
        [
            T.StructField("key_", kind), T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()),
            T.StructField("item", T.StringType())
        ]
    )
    has_two = [
        F.when(
            F.col(f).rlike(r"[;|&\t\n,/]|(?i)\sand\s"), F.col(f)
        ).alias(f"f{i}_") if least > 1 else F.col(f).alias(f"f{i}_") for i, f in enumerate(fields)
    ]
    read = df.select(F.col(key).alias("key_"), *has_two).where(F.coalesce(*[F.col(f"f{i}_") for i in range(len(fields))]).isNotNull())
    return read.mapInArrow(run, schema).withColumnRenamed("key_", key)
