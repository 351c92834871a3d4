"""Near-, line and substring deduplication and packing against brute force on a small fixture with every odd row."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm.common import mix, rolled, words
from latticework.llm.components import components, joined_up
from latticework.llm.line_dedup import drop_repeated_lines
from latticework.llm.near_dedup import near_duplicates
from latticework.llm.packing import WordTokenizer, default_tokenizer, pack
from latticework.llm.substring_dedup import drop_repeated_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, bucket string, n_lines int, __keep int"


def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice(["the", "an", "ing", "tion", "é", "ñ"]) for _ in range(r.randint(1, 3)))
    make = lambda n: [word() for _ in range(n)]
    passage, common = make(70), "A very common closing line."
    out = [None, "", " \t\n", "one", "One", "one two three four", "ONE two three four", "five words are in here", "line\n\n\n line \x0b", " a b c　d"]
    for i in range(12):
        base = make(r.randint(60, 200))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            out.append("\n".join([" ".join(copy[: len(copy) // 2]), "  " + common.upper(), " ".join(copy[len(copy) // 2 :])]))
        if i % 3 == 0:
            out.append(" ".join(make(30) + passage + make(20) + (passage[10:] if i else [])) + "\n" + common)
    out.append(" ".join(make(6000)))
    out += ["same words again and again " * 40] * 25
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    order = list(range(len(t)))
    random.Random(9).shuffle(order)
    return list(zip(order, t))


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, None, None, None, "x", "y", 3, 1) for i, t in rows] + [(None, "a text without an id, of six words", None, None, None, None, None, None, None)]
    return spark.createDataFrame(made, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().split()


def test_near_duplicates(docs, rows, none):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, t in rows for w in [split((t or "").encode().lower().decode())]}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert got[None].component_id is None and got[None].kept
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root(i), root(i) == i)
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_a_family_about_the_threshold(spark):
    """Versions of one text with similarities about 0.7; a few pairs reach 0.75, in buckets of many unlinked members."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        copy = list(base)
        for p in r.sample(range(400), 8):
            copy[p] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [t.split()]}
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a + 1, len(rows)):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert 250 < len({root(i) for i in sets}) < 300
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: root(i) for i in sets}


@pytest.mark.parametrize("n", [300, 1500, 6000])
def test_near_duplicates_among_documents_of_one_template(spark, n):
    """Documents of one template, with similarities about 0.6 and so no links, crowd the buckets; every planted pair is found."""
    r = random.Random(n)
    new = lambda k: [f"u{r.randrange(10**9)}" for _ in range(k)]
    template = new(140)
    rows = [template + new(44) for _ in range(n)]
    planted = []
    for i in range(0, 80, 2):
        copy = list(rows[i])
        copy[-22:] = new(22)
        rows.append(copy)
        planted.append((i, len(rows) - 1))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for pair in planted for i in pair for w in [rows[i]]}
    near = [(a, b) for a, b in planted if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(near) == 40 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.65
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_duplicates(df).collect()}
    assert got == {i: i for i in range(len(rows))} | {b: a for a, b in planted}


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(500, 560)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    want = {x: root(x) for x in list(up)}
    links = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    assert dict(map(tuple, components(links).collect())) == want
    first = components(spark.createDataFrame(pairs[:100], "a long, b long"))
    assert dict(map(tuple, joined_up(first, spark.createDataFrame(pairs[100:], "a long, b long")).collect())) == want
    assert components(links.limit(0)).count() == 0


def test_word_hashes_have_no_linear_structure():
    import pyarrow as pa

    for n in (256, 1024, 4096):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        hashes, *_ = words(pa.array([word, other, word + " " + "é" * 3000]))
        assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
        assert [g.tolist() for g in WordTokenizer(default_tokenizer()).encode(pa.array([word, other]))] == [Tokenizer.from_file(default_tokenizer()).encode(x, add_special_tokens=False).ids for x in (word, other)]
    values = mix(np.arange(1, 301, dtype=np.uint64))
    for k in (1, 2, 5, 16, 50):
        assert len(set(rolled(values, k).tolist())) == 301 - k and (rolled(values[9 : 9 + k], k) == rolled(values, k)[9]).all()
    assert len(rolled(values[:4], 5)) == 0


def test_line_dedup(docs, rows, none):
    key = lambda x: x.strip(" \t\n\x0b\f\r").encode().lower().decode()
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    got = {r.doc_id: r for r in drop_repeated_lines(docs).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(left), len(lines), len(lines) - len(left))
        assert got[i].bucket == "y"
    assert got[None].n_dropped == 0
    assert drop_repeated_lines(none).count() == 0


def test_line_dedup_of_long_documents(spark):
    lines = [f"a line of number {i % 150}" for i in range(400)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(reversed(lines)) + "\nonly here, this one"), (2, "a line of number 7\nx")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_repeated_lines(df).collect())
    assert [g[:3] for g in got] == [(1, 400, 0), (2, 2, 1), (2, 401, 400)] and got[2][3] == "only here, this one" and got[1][3] == "x"


@pytest.mark.parametrize("span,k", [(50, 16), (10, 4)])
def test_substring_dedup(docs, rows, none, span, k):
    first = defaultdict(lambda: 1 << 60)
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - span + 1):
            first[tuple(w[p : p + span])] = min(first[tuple(w[p : p + span])], i)
    got = {r.doc_id: r for r in drop_repeated_passages(docs, span, k).collect()}
    for i, t in rows:
        w = split(t)
        gone = {q for p in range(len(w) - span + 1) if first[tuple(w[p : p + span])] < i for q in range(p, p + span)}
        want = b" ".join(x for q, x in enumerate(w) if q not in gone).decode()
        assert (got[i].n_words, got[i].n_removed, hashlib.sha256(got[i].text.encode()).digest()) == (len(w), len(gone), hashlib.sha256(want.encode()).digest())
    assert got[None].n_removed == 0
    assert drop_repeated_passages(none).count() == 0


def test_substring_dedup_of_periodic_and_branching_texts(spark):
    """Loops, repeats inside a document, forks in a passage, and rows of one doc_id, against brute force."""
    r = random.Random(8)
    a, b = [f"w{r.randrange(60)}" for _ in range(90)], [f"q{i}" for i in range(40)]
    texts = [(1, a + b), (2, ["x", "y"] * 60), (3, b + a[20:]), (4, ["z"] + ["x", "y"] * 45 + a[:60]), (5, ["t"] * 130), (6, ["t"] * 70 + ["u"] + ["t"] * 60), (7, a + a + b), (7, a + a + b), (8, a[:55] + ["v"] + a[56:])]
    rows = [(i, " ".join(w)) for i, w in texts]
    span = 20
    first = {}
    for i, w in texts:
        for p in range(len(w) - span + 1):
            first[tuple(w[p : p + span])] = min(first.get(tuple(w[p : p + span]), i), i)
    want = []
    for i, w in texts:
        gone = {q for p in range(len(w) - span + 1) if first[tuple(w[p : p + span])] < i for q in range(p, p + span)}
        want.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    got = drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), span, 6).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing(docs, rows, none):
    own = Tokenizer.from_file(default_tokenizer())
    made = pack(docs.where("doc_id is not null"), window=128).toPandas().sort_values(["doc_id", "start"])
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        mine = made[made.doc_id == i]
        assert b"".join(mine.ids) == np.array(ids, "<u4").tobytes() and set(mine.doc_tokens) == {len(ids)}
        assert [zlib.crc32(x) for x in mine.ids] == mine.ids_crc32.tolist() and (mine.start.tolist() == np.cumsum([0, *mine.length[:-1]]).tolist())
    by = made.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all(g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() for _, g in by)
    total = by.length.sum()
    assert (total.iloc[:-1] == 128).all() and total.index.tolist() == list(range(len(total)))
    assert pack(none).count() == 0


def test_words_are_tokenised_as_texts_are():
    import pyarrow as pa

    path = default_tokenizer()
    own = Tokenizer.from_file(path)
    odd = ["İstanbul İ. x. 7. 7 é. é, ... a.. .a 'S a's. ½. ﬁ. ﬁ x́y.", "It's DON'T we'll", "a b c", "x  \t y\r\nz", "日本 語 <|endoftext|> q<|startoftext|>", "Σίσυφος ΣΑΣ. İ", "é å", "1234 5,6 $%& <html>", "", None]
    got = WordTokenizer(path).encode(pa.array(odd, pa.string()))
    assert [g.tolist() for g in got] == [own.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_repeated_ids(spark):
    df = spark.createDataFrame([(5, "alpha beta gamma delta epsilon zeta"), (5, "other words stand in this row"), (6, "Alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False)]
    assert pack(df).select("doc_id").where(F.col("doc_id") == 5).count() == 2
