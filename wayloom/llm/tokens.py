"""Encoding of whole texts by byte-level pair merges of a public vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files are; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: how byte_bpe_50k cuts a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes up to which a word is merged by scanning a contiguous rank array; longer ones use a heap, as the scan is quadratic.
SHORT = 256
#: Words a worker remembers at a time.
REMEMBERED = 300_000
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a short word: part boundaries and the ranks of adjacent parts in two contiguous arrays.

    The least rank (the first of equals) is searched, the boundary between its two parts deleted, and the ranks of the two neighbours looked up anew,
    until no adjacent parts merge.
    """
    get = ranks.get
    bounds = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == _NONE:
            break
        i = rank.index(least)
        del bounds[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            rank[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length, in O(n log n): a heap of adjacent pairs over a linked list of parts."""
    n, get = len(word), ranks.get
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], _NONE)) != _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue
        end[i], after[i], alive[j] = to, after[j], 0
        if after[j] < n:
            before[after[j]] = i
            if (r := get(word[i : end[after[j]]], _NONE)) != _NONE:
                heapq.heappush(heap, (r, i, end[after[j]]))
        h = before[i]
        if h >= 0 and (r := get(word[h:to], _NONE)) != _NONE:
            heapq.heappush(heap, (r, h, to))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Texts to ids; remembers the ids of the words it met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.cut, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "replace")
        one = self.ranks.get(raw)
        if one is not None:
            ids = (one,)
        else:
            ids = tuple((merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks))
        if len(raw) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode_into(self, text: str, out: array) -> None:
        get, word, extend = self.known.get, self.word, out.extend
        for w in self.cut(text):
            extend(get(w) or word(w))

    def count(self, text: str) -> int:
        get, word = self.known.get, self.word
        return sum([len(get(w) or word(w)) for w in self.cut(text)])


def _shared_ranks(spark: SparkSession, vocabulary: str, tokenizers: str):
    """The vocabulary is read once, on the driver, and sent to the executors: a fixed file of under 1 MB."""
    return spark.sparkContext.broadcast(read_ranks(os.path.join(tokenizers, vocabulary + ".tiktoken")))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(``key``, ``ids``): the token ids of the whole text of each row, without special tokens. One pass over Arrow batches, no shuffle.

    Null and empty texts have an empty list; blanks are encoded as any text. Each row gives one row, repeated or not, also for null keys. Empty tables
    give empty tables, other
    columns are not read. A key named ``ids`` is returned as it is and the list is then called ``ids_``.
    """
    ranks = _shared_ranks(df.sparkSession, vocabulary, tokenizers)
    name = "ids" if key.lower() != "ids" else "ids_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            ids, offsets = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                if t:
                    encoder.encode_into(t, ids)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(
                pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]),
                pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, name])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(name, T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text).cast("string").alias("text__")).mapInArrow(run, schema)


def count_tokens(
    df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, name: str = "n_tokens"
) -> DataFrame:
    """``keep`` and the number of tokens (long) of each text; 0 for null and empty texts."""
    ranks = _shared_ranks(df.sparkSession, vocabulary, tokenizers)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            counts = [encoder.count(t) if t else 0 for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64())], names=[*keep, name])

    kept = df.select(*keep)
    return df.select(*keep, F.col(text).cast("string").alias("text__")).mapInArrow(
        run, T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])
    )
