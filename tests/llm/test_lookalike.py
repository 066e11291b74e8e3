import unicodedata

import pytest

from wayloom.llm.lookalike import Canonical, Trie, canonical_text, plain_table, same_look, script_form, skeleton, vocabulary

O, A, E = "о", "а", "е"  # Cyrillic letters


@pytest.fixture(scope="module")
def form():
    return Canonical({}, plain_table()).text


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("road", f"r{O}{A}d"), ("full width 12!", "ｆｕｌｌ ｗｉｄｔｈ　１２！"), ("café", "café"), ("office", "oﬃce"), ("a b", "a b"), ("a b", "a b"), ("a b", "a\tb"), ("soft", "so­ft"), ("join", "jo‍﻿in"), ("non-break", "non‑break"), ("well-known", "well‐known"),
        ("больше", "бoльшe"), ("é", f"{E}́"), ("ёж", "ëж"), ("e‍́", "é"), ("Τo", "To"), ("x\r\ny", "x\ny"), ("cop", "сор"), ("Москва", "Mocквa"),
    ],
)
def test_looks_the_same(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("A", "a"), ("e", "é"), ("a.", "a,"), ("-", "–"), ("-", "−"), ("1", "l"), ("a b", "a\nb"), ("a b", "a  b"), ("a b", "ab"), ("ﬁ", "f1"), ("½", "1/2"), ("oe", "œ"), ("ss", "ß")])
def test_looks_different(form, a, b):
    assert form(a) != form(b)


def test_form_is_stable_and_keeps_plain_text(form):
    for t in ["Plain ASCII, kept.", "Привет, мир!", "Καλημέρα κόσμε", "日本語、テスト。", "naïve façade", "x" * 100_000, "Москва" * 20_000]:
        assert form(t) == unicodedata.normalize("NFC", t)
        assert form(form(t)) == form(t)
    assert script_form("сор") == "cop" and skeleton("сор") == skeleton("cop")


def test_trie_automaton():
    t = Trie({"road": "road", "roads": "roads", "cop": "сор"})
    assert t.match(f"r{O}\u200b{A}d") == "road" and t.match("ｒｏａｄ") == "road" and t.match("cop") == "сор" and t.match("rod") is None
    assert t.match("rod", budget=1) == "road" and t.match("roaxs", budget=1) in ("road", "roads") and t.match("zzzz", budget=1) is None


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_vocabulary_prefers_what_the_corpus_writes(spark):
    rus = "сор в доме"
    words, rest = vocabulary(table(spark, [(1, rus), (2, rus), (3, "cоp и дом"), (4, None), (5, "")]))
    assert words["cop"] == "сор" and rest is None
    mixed, _ = vocabulary(table(spark, [(1, rus), (2, "a cop"), (3, rus)]))
    assert mixed["cop"] == "cop"
    docs = table(spark, [(1, rus), (2, "cоp в доме")])
    got = {r.doc_id: r.canonical for r in canonical_text(docs).collect()}
    assert got[1] == got[2] == rus


def test_pairs(spark):
    rows = [(1, "the road"), (2, "the rоad"), (3, "the road"), (4, "the ｒｏａｄ"), (5, "the Road"), (6, None), (7, ""), (8, " "), (9, "​"), (10, " "), (11, "other"), (11, "оther"), (12, "x" * 50_000), (13, "х" + "x" * 49_999), (None, "the rоad"), (2, "the rоad")]
    df = table(spark, rows).selectExpr("doc_id", "text", "1 as look", "2 as k")
    got = sorted(map(tuple, same_look(df).collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (12, 13)]
    assert same_look(df.limit(0)).count() == 0


def test_words_with_digits(spark):
    spellings = [["B8", "В8", "Β8"], ["XX25", "ХХ25", "ХX25"], ["4x4", "4х4"]]
    docs = table(spark, [(10 * i + j, f"the {w}, then") for i, ws in enumerate(spellings) for j, w in enumerate(ws)])
    got = {r.doc_id: r.canonical for r in canonical_text(docs).collect()}
    assert got == {10 * i + j: f"the {ws[0]}, then" for i, ws in enumerate(spellings) for j in range(len(ws))}
    assert sorted(map(tuple, same_look(docs).collect())) == [(0, 1), (0, 2), (1, 2), (10, 11), (10, 12), (11, 12), (20, 21)]
    # without an ASCII spelling the corpus' own one is kept, as of words without digits; bare numbers are no words of any script
    assert vocabulary(table(spark, [(1, "ХХ25 25 8"), (2, "В8")]))[0] == {"XX25": "ХХ25", "B8": "В8"}


def test_canonical_cases(spark):
    rows = [(1, None), (2, ""), (3, "ａ"), (3, "ａ"), (None, "b c")]
    got = sorted(map(tuple, canonical_text(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c")], key=str)
    clash = spark.createDataFrame([("k", "t")], "canonical string, text string")
    assert canonical_text(clash, key="canonical").columns == ["canonical", "canonical_"]
    assert canonical_text(table(spark, []), words={}).count() == 0


def test_other_scripts(form):
    for odd, plain in [("ԌОLD", "GOLD"), ("ᏟᎪᎡ", "CAR"), ("հօոե", "hoոե"), ("ӀХ", "IX"), ("νia", "via"), ("\u212a", "K"), ("ℂ", "C")]:
        assert form(odd) == form(plain), (odd, plain)
    assert {"Ꭱ": "R", "օ": "o", "Ӏ": "I"}.items() <= __import__("wayloom.llm.lookalike", fromlist=["x"])._TO_LATIN.items()


def test_the_trie_is_what_unites(spark):
    """The corpus' own spelling, which the table doesn't know, reaches odd words only through the automaton."""
    rows = [(1, "сор в доме"), (2, "сор в доме"), (3, "c\u200bор в доме"), (4, "ｃор в доме"), (5, "ro\u200bad"), (6, "road")]
    docs = table(spark, rows)
    got = {r.doc_id: r.canonical for r in canonical_text(docs).collect()}
    assert got[3] == got[4] == got[1] == "сор в доме" and got[5] == got[6]
    words = vocabulary(docs)[0]
    assert words == {"cop": "сор", "road": "road"}
    without = {r.doc_id: r.canonical for r in canonical_text(docs, words={}).collect()}
    assert without[1] == "cop в доме"
    trie = Trie(words)
    assert trie.match("c\u200bор") == trie.match("ｃор") == "сор" and trie.match("ro\u200bad") == "road"


def test_a_vocabulary_beyond_the_trie(spark, monkeypatch):
    from wayloom.llm import lookalike

    rng = __import__("random").Random(4)
    letters = list("асерохув")
    latin = dict(zip("асерохув", "acepoxyв"))
    words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(60)]
    rows = [(i, " ".join("".join(latin[c] if rng.random() < 0.1 else c for c in rng.choice(words)) for _ in range(12))) for i in range(80)] + [(100, None), (101, ""), (102, "plain")]
    docs = table(spark, rows)
    whole = {r.doc_id: r.canonical for r in canonical_text(docs).collect()}
    pairs = sorted(map(tuple, same_look(docs).collect()))
    monkeypatch.setattr(lookalike, "MAX_VOCABULARY", 3)
    assert vocabulary(docs)[1] is not None
    assert {r.doc_id: r.canonical for r in canonical_text(docs).collect()} == whole
    assert sorted(map(tuple, same_look(docs).collect())) == pairs


def test_classes_and_blocks(spark, monkeypatch):
    from wayloom.llm import lookalike

    rows = [(i, "the rоad" if i % 3 else "the road") for i in range(60)] + [(100, "alone"), (101, None), (102, " ")]
    docs = table(spark, rows)
    classes = {r.doc_id: r for r in lookalike.look_classes(docs).collect()}
    assert set(classes) == {*range(60), 100} and classes[100].n_links == 0
    assert len({classes[i].look_class for i in range(60)}) == 1 and classes[0].n_links == 40 and classes[1].n_links == 20
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if (a % 3 == 0) != (b % 3 == 0))
    monkeypatch.setattr(lookalike, "PAIR_BLOCK", 7)
    assert sorted(map(tuple, same_look(docs).collect())) == want
    assert lookalike.look_classes(docs.limit(0)).count() == 0
