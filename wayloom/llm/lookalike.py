"""Text that looks the same but is made of different characters, in one consistent form."""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.session import materialize, small

# Letters of other scripts that are drawn as a Latin letter, and those Latin letters in the same order.
CYRILLIC = "АВЕЅІЈКМНОРСТҮХԜԚԌаеѕіјорсухһԁԛԝӀӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXWQGaesijopcyxhdqwIl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜοϲϳν"
GREEK_AS = "ABEZHIKMNOPTYXCJFocjv"
ARMENIAN = "ՕՍՏօոսհզց"
ARMENIAN_AS = "OUSonuhqg"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWYZ"

# Hyphens that are drawn as the ASCII one (dashes and minus signs are longer and stay).
HYPHENS = "\u2010\u2011"

#: The scripts in the order in which a word is given to one that has a letter of its own in it, Latin before all.
SCRIPTS = {"C": (CYRILLIC, CYRILLIC_AS), "G": (GREEK, GREEK_AS), "A": (ARMENIAN, ARMENIAN_AS), "K": (CHEROKEE, CHEROKEE_AS)}

#: Words whose spellings are sent to every task; texts with further ones get those by a join.
MAX_VOCABULARY = 100_000
#: Characters up to which a word is looked up in the trie; the table spells longer ones, whatever the corpus.
MAX_WORD = 64
#: Documents of one look that are paired with each other in one task.
PAIR_BLOCK = 4096

_TO_LATIN = {a: b for letters, latin in SCRIPTS.values() for a, b in zip(letters, latin)}


def _in_script(letters: str, latin: str) -> dict[int, str]:
    """Character table of the look-alikes of all scripts to those of one; of two letters that are drawn alike the first."""
    own: dict[str, str] = {}
    for a, b in zip(letters, latin):
        own.setdefault(b, a)
    return str.maketrans(own | {a: own[b] for a, b in _TO_LATIN.items() if b in own and a not in letters})


_LATIN, _OWN = str.maketrans(_TO_LATIN), {s: _in_script(*pair) for s, pair in SCRIPTS.items()}
_SHARED = frozenset(_TO_LATIN.values())
_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\x00-\x08\x0d-\x1f\x7f]")
# What words are made of: ASCII letters and digits, and from U+00C0 on all but blocks of punctuation and symbols.
_BEYOND = "\u00c0-\u1fff\u2c00-\u2dff\u3040-\U0010ffff"
_IS_WORD = re.compile(f"[0-9A-Za-z{_BEYOND}]*")
_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SHOWN_AS_LETTER = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")


@lru_cache(maxsize=1)
def plain_table() -> dict[int, str]:
    """Character table by rule.

    Ignorables become nothing, blanks within a line a space, hyphens the ASCII one, and full-width, half-width, joined and styled forms their
    plain letters, as do characters that stand for another one. Raised and lowered forms, fractions and circled ones stay. Built once, on the driver.
    """
    table: dict[int, str] = {}
    for code in (*range(0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)):
        c = chr(code)
        kind = unicodedata.category(c)
        if _IGNORABLE.match(c):
            table[code] = ""
        elif c in HYPHENS:
            table[code] = "-"
        elif kind == "Zs" and c != " " or c in "\t\x0b\x0c":
            table[code] = " "
        elif c in "\u2028\u2029\x85":
            table[code] = "\n"
        elif (form := unicodedata.decomposition(c).split())[:1]:
            if form[0][0] != "<":
                if len(form) == 1:
                    table[code] = unicodedata.normalize("NFC", c)
                continue
            joined = form[0] == "<compat>" and len(form) > 2 and kind[0] == "L"
            if joined or form[0] in _SHOWN_AS_LETTER:
                table[code] = unicodedata.normalize("NFKC", c)
    return table


def _class(codes: list[int]) -> str:
    """The inside of a character class, as ranges."""
    out, codes = [], sorted(codes)
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in out)


def _script(c: str) -> str:
    if c < "ɐ":
        return "L"
    return "G" if "Ͱ" <= c < "Ѐ" else "C" if "Ѐ" <= c < "԰" else "A" if "԰" <= c < "֐" else "K" if "Ꭰ" <= c < "᐀" else ""


def script_form(word: str) -> str:
    """The word with its look-alike letters in one script.

    That is one that has a letter of its own in the word (Latin first, then in the order of ``SCRIPTS``), else Latin. Depends only on how the word
    looks.
    """
    latin = unicodedata.normalize("NFD", word).translate(_LATIN)
    own = {_script(c) for c in latin if c not in _SHARED and c.isalpha()}
    script = None if "L" in own else next((s for s in SCRIPTS if s in own), None)
    return unicodedata.normalize("NFC", latin.translate(_OWN[script]) if script else latin)


def skeleton(word: str) -> str:
    """How a word looks, as letters: the key under which all its spellings meet."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(_LATIN))


class Trie:
    """A vocabulary of canonical spellings, walked by a weighted edit automaton."""

    def __init__(self, words: dict[str, str], table: dict[int, str] | None = None):
        """``words``: skeleton to canonical spelling. ``table``: characters that are read as others, or as nothing."""
        self.root: dict = {}
        self.table = plain_table() if table is None else table
        self.seen: dict[str, str] = {}
        for look, spelling in words.items():
            self.add(look, spelling)

    def add(self, look: str, spelling: str) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", look):
            node = node.setdefault(c, {})
        node[""] = spelling

    def shown(self, c: str) -> str:
        """The letters of the trie as which a character is read at no cost: itself, what it looks like, or nothing."""
        out = self.seen.get(c)
        if out is None:
            out = self.seen[c] = unicodedata.normalize("NFD", self.table.get(ord(c), c)).translate(_LATIN)
        return out

    def match(self, token: str, budget: float = 0.0) -> str | None:
        """The canonical spelling within ``budget`` edits of ``token`` as it was written; the cheapest, of equals the smallest.

        A state is (node, place in the token) with its cost; the cheapest is followed first. Reading a look-alike of the node's letter, a
        form of it, and skipping an ignorable cost nothing; a letter that differs, is left out or is put in costs 1.
        """
        text = unicodedata.normalize("NFD", token)
        front: list[tuple[float, int, int, dict]] = [(0.0, 0, 0, self.root)]
        best, done, found, made = {(id(self.root), 0): 0.0}, set(), [], 0
        while front:
            cost, at, _, node = heapq.heappop(front)
            state = (id(node), at)
            if state in done or cost > best[state]:
                continue
            done.add(state)
            if found and cost > found[0][0]:
                break
            if at == len(text) and "" in node:
                found.append((cost, node[""]))
            steps = []
            if at < len(text):
                to = node
                for c in self.shown(text[at]):
                    to = to.get(c) if to is not None and c else None
                if to is not None:
                    steps.append((cost, at + 1, to))
            if cost + 1 <= budget:
                others = [to for c, to in node.items() if c]
                steps += [(cost + 1, at, to) for to in others]
                if at < len(text):
                    steps += [(cost + 1, at + 1, to) for to in (node, *others)]
            for price, place, to in steps:
                key = (id(to), place)
                if price < best.get(key, float("inf")):
                    best[key] = price
                    made += 1
                    heapq.heappush(front, (price, place, made, to))
        return min(found)[1] if found else None


class Canonical:
    """Texts to their consistent form."""

    def __init__(self, vocabulary: dict[str, str], table: dict[int, str], remembered: int = 200_000):
        self.trie, self.table = Trie(vocabulary, table), table
        inner = [c for c, form in table.items() if c > 0x7F and _IS_WORD.fullmatch(form)]
        #: what is replaced before words are cut: blanks, punctuation, what isn't a word when written plainly
        self.outer = re.compile("[" + _class(list(table.keys() - set(inner))) + "]")
        beyond = _BEYOND + _class([c for c in inner if not _IS_WORD.fullmatch(chr(c))])
        self.tail = re.compile(f"[{beyond}][0-9A-Za-z{beyond}]*+")
        edge = f"0-9A-Za-z{beyond}"
        classes = [f"[0-9{''.join(sorted(set(latin)))}]" for _, latin in SCRIPTS.values()]
        alike = "|".join(f"(?<={c}){c}*+(?![{edge}])" for c in classes)
        first = f"[0-9{''.join(sorted(_SHARED))}]"
        #: ASCII words that may be the look of a word of one other script; looked behind after the first letter, for speed
        self.shared = re.compile(f"{first}(?<![{edge}]{first})(?:{alike})")
        self.known: dict[str, str] = {}
        self.remembered = remembered

    def words(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the words with a character beyond ASCII; found from that character, so ASCII text is passed over quickly."""
        done = 0
        for m in self.tail.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _ALNUM:
                start -= 1
            done = m.end()
            yield start, done

    def plain(self, word: str) -> str:
        """The word without what can't be seen, in plain forms, accents composed; its script stays."""
        return unicodedata.normalize("NFC", word.translate(self.table))

    def word(self, w: str) -> str:
        out = self.known.get(w)
        if out is None:
            plain = None
            if len(w) <= 2 * MAX_WORD:
                out = self.trie.match(w)
            if out is None:
                plain = self.plain(w)
                # marks that an invisible character kept apart are in another order in the plain word
                out = self.trie.match(plain) if plain != w and len(plain) <= MAX_WORD else None
            if out is None:
                out = script_form(plain)
            if len(self.known) >= self.remembered:
                self.known.clear()
            if len(w) <= MAX_WORD:
                self.known[w] = out
        return out

    def cut(self, text: str) -> str:
        """The text with what isn't a word in its plain form."""
        return self.outer.sub(lambda m: self.table[ord(m[0])], text)

    def text(self, text: str, own: dict[str, str] | None = None) -> str:
        """``own``: spellings by skeleton that this text needs beyond the vocabulary."""
        out = self.cut(text)
        if out.isascii():
            return out
        parts, done = [], 0
        for start, end in self.words(out):
            w = out[start:end]
            spelled = own.get(skeleton(self.plain(w))) if own else None
            parts += (out[done:start], self.word(w) if spelled is None else spelled)
            done = end
        return unicodedata.normalize("NFC", "".join([*parts, out[done:]]))


def spellings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(``look``, ``spelling``, ``n``): the canonical spelling of each look that the corpus writes in several ways.

    The words of all texts are counted, each partition's summed before the shuffle. Of the spellings of a look an all-ASCII one is canonical;
    else the most frequent that keeps to one script, of equals the greatest; else that of the table. Looks are kept that have several
    spellings, a word written with invisible characters or other forms, or a canonical spelling that isn't the table's.
    """
    table = docs.sparkSession.sparkContext.broadcast(plain_table())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, raw, words = Canonical({}, table.value), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            rows: dict[tuple[str, str], list[int]] = {}
            for w, n in words.items():
                if not w.isdigit():
                    rows[w, w] = [2, n, 0]
            for w, n in raw.items():
                plain = form.plain(w)
                if plain and len(plain) <= MAX_WORD:
                    # of one script and, but for its accents, nothing else
                    one = len({_script(c) for c in unicodedata.normalize("NFD", plain) if c.isalpha()}) == 1
                    row = rows.setdefault((skeleton(plain), plain), [2 if plain.isascii() else int(one), 0, 0])
                    row[1] += n
                    row[2] |= int(plain != w)
            words.clear(), raw.clear()
            columns = [[k[0] for k in rows], [k[1] for k in rows], *([v[i] for v in rows.values()] for i in range(3))]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["look", "word", "clean", "n", "odd"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                t = form.cut(t)
                words.update(form.shared.findall(t))
                if not t.isascii():
                    raw.update(t[a:z] for a, z in form.words(t))
                if len(words) + len(raw) > 200_000:
                    yield flush()
        yield flush()

    texts = docs.select(F.col(text).cast("string").alias("t")).where("t <> ''")
    counted = texts.mapInArrow(count, "look string, word string, clean int, n long, odd int")
    counted = counted.groupBy("look", "word", "clean").agg(F.sum("n").alias("n"), F.max("odd").alias("odd"))
    best = counted.groupBy("look").agg(
        F.max(F.struct("clean", "n", "word")).alias("best"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max("odd").alias("odd")
    )
    shared = "^[0-9" + "".join(sorted(_SHARED)) + "]+$"
    keep = best.where((F.col("k") > 1) | (F.col("odd") > 0) | (F.col("look").rlike(shared) & (F.col("best.clean") == 1)))
    return keep.select("look", "best.word", "best.clean", "n").mapInArrow(_spelled, "look string, spelling string, n long")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        word, clean = b.column(1).to_pylist(), b.column(2).to_pylist()
        spelling = pa.array([w if c else script_form(w) for w, c in zip(word, clean)], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), spelling, b.column(3)], names=["look", "spelling", "n"])


def vocabulary(docs: DataFrame, text: str = "text", limit: int | None = None) -> tuple[dict[str, str], DataFrame | None]:
    """The ``limit`` most frequent of ``spellings`` for the trie, and a table (``look``, ``spelling``) of those beyond; None where there are none."""
    limit = MAX_VOCABULARY if limit is None else limit
    table = materialize(spellings(docs, text))
    first = table.orderBy(F.desc("n"), "look").select("look", "spelling").limit(limit + 1).collect()
    words = {r.look: r.spelling for r in first[:limit]}
    if len(first) <= limit:
        return words, None
    sent = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in words], "look string"))
    return words, table.join(sent, "look", "left_anti").select("look", "spelling")


def _own_spellings(docs: DataFrame, rest: DataFrame, table) -> DataFrame:
    """``docs`` (``k``, ``t``) with ``own``: the spellings of ``rest`` for the words of each text, by a join of looks and texts' digests."""

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Canonical({}, table.value)
        for b in batches:
            h, look = [], []
            for digest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = form.cut(t)
                found = {skeleton(form.plain(t[a:z])) for a, z in form.words(t)}
                h += [digest] * len(found)
                look += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(look, pa.string())], names=["h", "look"])

    marked = docs.withColumn("h", F.when(~F.col("t").rlike(r"^\p{ASCII}*$"), F.sha2("t", 256)))
    asked = marked.where("h is not null").select("h", "t").mapInArrow(looks, "h string, look string").distinct()
    own = asked.join(rest, "look").groupBy("h").agg(F.collect_list(F.struct("look", "spelling")).alias("own"))
    return marked.join(own, "h", "left").select("k", "t", "own")


def _canonical_rows(docs: DataFrame, key: str, text: str, words: dict[str, str] | None, out, schema: T.StructType) -> DataFrame:
    """``out(keys, texts, canonical texts)`` of each batch, the canonical texts by the vocabulary of the corpus (or ``words``)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(plain_table())
    rest = None
    if words is None:
        words, rest = vocabulary(docs, text)
    sent = spark.sparkContext.broadcast(words)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    if rest is not None:
        rows = _own_spellings(rows, rest, table)
    joined = rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Canonical(sent.value, table.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            more = [dict((r["look"], r["spelling"]) for r in m) if m else None for m in b.column(2).to_pylist()] if joined else [None] * len(texts)
            yield out(b.column(0), texts, [None if t is None else form.text(t, m) for t, m in zip(texts, more)])

    return rows.mapInArrow(run, schema)


def canonical_text(docs: DataFrame, key: str = "doc_id", text: str = "text", words: dict[str, str] | None = None) -> DataFrame:
    """(``key``, ``canonical``): each text in one consistent form, so that texts that look the same are equal strings.

    Words as they are written, with whatever is invisible or of another form in them, are looked up in the trie of the corpus' vocabulary by an
    automaton for which look-alikes, forms and ignorables cost nothing; words without a match are put in plain forms and one script
    by the table, as are blanks within a line (spaces) and what isn't a word. Case, accents, digits, raised digits and punctuation stay. Whole
    texts, one pass after that of the vocabulary; spellings beyond ``MAX_VOCABULARY`` come by a join, with the same result.

    Null texts stay null, empty ones empty. Each row gives one row; other columns are not read. A key named ``canonical`` keeps its name and
    the text is then called ``canonical_``.
    """
    name = "canonical" if key.lower() != "canonical" else "canonical_"
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(name, T.StringType())])

    def out(keys: pa.Array, _texts: list, forms: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array(forms, pa.string())], names=[key, name])

    return _canonical_rows(docs, key, text, words, out, schema)


def look_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", words: dict[str, str] | None = None) -> DataFrame:
    """(``k``, ``look``, ``exact``): 16-byte digests of the canonical text and of the text itself, for rows with a key whose canonical text has a
    visible character.
    """
    schema = T.StructType(
        [T.StructField("k", docs.schema[key].dataType), T.StructField("look", T.BinaryType()), T.StructField("exact", T.BinaryType())]
    )

    def out(keys: pa.Array, texts: list, forms: list) -> pa.RecordBatch:
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        at = [i for i, c in enumerate(forms) if c and c.strip()]
        columns = [pa.array([digest(rows[i]) for i in at], pa.binary()) for rows in (forms, texts)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], names=["k", "look", "exact"])

    return _canonical_rows(docs.where(F.col(key).isNotNull()), key, text, words, out, schema)


def _cases(keys: DataFrame) -> DataFrame:
    """The rows of looks with more than one text, with the number of rows of their look."""
    several = keys.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    return keys.join(small(several.select("look", "n")), "look").distinct()


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``look_class``, ``n_links``): each document with a visible character, the class of all that look like it, and the number of documents
    of its class with another text.

    The class is a digest of the canonical text. Nothing is paired, so a look that a third of all documents have is no problem. Null, empty and
    blank texts have no row. Repeated rows count once, several texts of one key each have a row.
    """
    keys = materialize(look_keys(docs, key, text).distinct())
    cases = _cases(keys)
    same = cases.groupBy("look", "exact").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m")).select(
        "look", "exact", (F.col("n") - F.col("m")).alias("n_links")
    )
    out = keys.join(small(same), ["look", "exact"], "left")
    return out.select(
        F.col("k").alias(key), F.lower(F.hex("look")).alias("look_class"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")
    )


def same_look(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_a``, ``doc_b``): pairs of documents, the smaller key first, whose texts look the same but are not equal as strings.

    Texts are compared by digests of their canonical forms. Only looks with more than one text are joined, found by an aggregate with partial
    sums; a look with a single text, however often it occurs, is never paired. A look of more than ``PAIR_BLOCK`` documents is cut into blocks
    by hash, and each pair of blocks is a task's work of its own. Null, empty and blank texts and texts of invisible
    characters are no cases. Rows of the same key are no pair.
    """
    cases = _cases(materialize(look_keys(docs, key, text)))
    cases = materialize(cases.withColumn("parts", F.ceil(F.col("n") / PAIR_BLOCK).cast("int")))
    part = F.pmod(F.xxhash64("k", "exact"), F.col("parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = cases.select("look", F.col("k").alias("doc_a"), F.col("exact").alias("exact_a"), part.alias("i"), each.alias("j"))
    b = cases.select("look", F.col("k").alias("doc_b"), F.col("exact").alias("exact_b"), part.alias("j"), each.alias("i"))
    return a.join(b, ["look", "i", "j"]).where("exact_a <> exact_b and doc_a < doc_b").select("doc_a", "doc_b").distinct()
