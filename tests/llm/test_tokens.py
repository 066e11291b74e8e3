import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.llm.tokens import PATTERN, TOKENIZERS, Encoder, count_tokens, encode, merge_long, merge_short, read_ranks

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(FILE)


@pytest.fixture(scope="module")
def public(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text(alphabet="ab ethin'sl0.\n\t", max_size=200)))
def test_same_as_public_library(ranks, public, text):
    from array import array

    out = array("i")
    Encoder(ranks).encode_into(text.encode("utf-8", "replace").decode(), out)
    assert out.tolist() == public.encode_ordinary(text.encode("utf-8", "replace").decode())


def test_same_as_json_vocabulary(ranks):
    from array import array

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ["Grüße, <|endoftext|> it's 1234 m²!", "путь и дорога  \n\n", "日本語のテスト", "a" * 5000, "don't\tdo  that "]:
        out = array("i")
        Encoder(ranks).encode_into(text, out)
        assert out.tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_and_short_merges_agree(ranks):
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("etaoinshr=-") for _ in range(rng.randint(1, 300))).encode()
        assert merge_short(word, ranks) == merge_long(word, ranks)
    assert b"".join({v: k for k, v in ranks.items()}[i] for i in merge_long(b"xyz" * 20_000, ranks)) == b"xyz" * 20_000


def test_operator(spark, public):
    rows = [(1, "hello world", "x"), (2, "", "y"), (3, None, "z"), (None, " ", "w"), (1, "hello world", "x"), (5, "ab " * 40_000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode(df).collect()), key=str)
    assert got == sorted(((d, public.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    counts = [(r.doc_id, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()]
    assert sorted(counts, key=str) == sorted(((d, len(i)) for d, i in got), key=str)
    assert encode(df.limit(0)).count() == 0
    assert encode(df, key="ids").columns == ["ids", "ids_"]
