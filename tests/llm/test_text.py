"""HTML text, quality, toxicity, languages, WARC and decontamination on small fixtures."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from latticework.llm import decontamination, html_text, lang_id, quality, toxicity, warc


@pytest.fixture(scope="module")
def some(spark):
    rows = [(1, "The " * 12), (2, None), (3, ""), (4, "one two three"), (5, " ".join(f"word{i}" for i in range(40))), (6, "a | b | c | d | e | f\n" * 3 + "x"), (7, "HELLO WORLD AGAIN AND MORE!! " * 3)]
    return spark.createDataFrame([(i, t, "z", 1.0) for i, t in rows], "doc_id long, text string, kept string, __w double")


def test_quality(some):
    got = {r.doc_id: r for r in quality.judged(some).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (12, 12, True)
    assert got[2].n_words == got[3].n_words == 0 and got[2].base_failed and not got[3].kept
    assert got[5].kept and got[5].n_repeat_words == 0
    assert got[6].n_symbols == 15 and not got[6].kept and got[6].n_dup_lines == 2
    assert not got[7].kept
    assert quality.judged(some.limit(0)).count() == 0


def test_quality_by_line(spark):
    """Each kind of rule takes the lines that it is for, and prose stays."""
    prose = "The river was quiet in the evening, and nobody walked along it."
    bad = [
        "Home » News » Sport » Weather", "one | two | three", "well!! now?? then!! yes!!", "a long line of many words goes on and on here without any sentence mark",
        "Alle Rechte vorbehalten", "lire la suite", "### ***", "12 34 -- 56", "THIS IS A LINE IN CAPITALS",
    ]
    rows = [(i, prose + "\n" + x + "\n" + prose) for i, x in enumerate(bad)] + [(50, prose), (51, "Short title\n" + prose), (52, "a " * 12 + "“end.”"), (53, (prose + "\n") * 30_000 + "x")]
    got = {r.doc_id: (r.clean_text, r.kept) for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i][0] == prose + "\n" + prose for i in range(len(bad)))
    assert got[50] == (prose, True) and got[51][0] == "Short title\n" + prose and got[52][0] == rows[-2][1] and len(got[53][0]) == len(rows[-1][1])


def test_repeat_words_against_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(40)]
    got = {x.doc_id: x.n_repeat_words for x in quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
        assert got[i] == len({q for p, g in enumerate(grams) if grams.count(g) > 1 for q in range(p, p + 5)})


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body><header>Site</header><nav><ul><li>A<li>B</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>The  title</h1></header><p>One &amp; <b>two</b><br>three<p>Four<div class="ad">Buy</div><ul><li>five</li><li>six</ul><script>if (a</b) "<p>no</p>"</script>
<section class="comments"><p>a reader</p></section></article><aside>Side</aside><form>Name<input></form><footer>&copy; x</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The title\nOne & two three\nFour\nfive\nsix"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("plain <i>text</i> &lt;") == "plain text <"
    assert html_text.main_text("<p>a<!-- x > y --><p title='a>b'>c<p") == "a\nc"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"
    assert html_text.main_text('<div id="main-content"><p>Text</p></div><div>Other</div>') == "Text"


def test_site_templates_go(spark):
    page = lambda i: f"<div><span>Our site</span> since 1990</div><div><p>Story {i} is told.</p></div><div>Bottom line</div>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)] + [(50, "https://b.example/1", page(99)), (51, None, None), (52, "https://b.example/2", "")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Story 3 is told." and got[3].n_chars == 16
    assert got[50].text == "Our site since 1990\nStory 99 is told.\nBottom line" and got[51].text == "" and got[52].n_chars == 0


def test_templates_inside_an_article_go(spark):
    page = lambda i: f"<body><article><div class='x1'>Read our other stories</div><p>Story {i} is told.</p><p>Shared by some {i // 4}.</p></article></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)] + [(50, "https://b.example/1", page(99))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 is told.\nShared by some 0." and got[50] == "Read our other stories\nStory 99 is told.\nShared by some 24."


def test_words_of_a_class_only_break_ties(spark):
    """Inside an article, what one page alone has stays, whatever its class; what recurs goes, and with it the words' elements that differ from page to page."""
    own = '<div class="legal">Terms of the treaty.</div><p class="bottom">At the bottom.</p><section class="paywall related">Walls.</section>'
    assert html_text.main_text(f"<article><p>Text</p>{own}<div class='comments'>Nice</div></article>") == "Text\nTerms of the treaty.\nAt the bottom.\nWalls."

    def page(i):
        more = own if i == 3 else ""
        return f"<article><header><h1>Title {i}</h1></header><p>Story {i}.</p>{more}<div class='x9'>Read us daily</div><section class='related'>See {i * 7} too</section></article>"

    rows = [(i, f"https://a.example/{i}", page(i), "clash") for i in range(20)] + [(3, "https://a.example/3", page(3), None), (60, "https://c.example/", "<article>" + "<p>long text</p>" * 50_000 + "</article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got[0] == (0, "Title 0\nStory 0.") and len(got) == 22
    assert got[3] == got[4] == (3, "Title 3\nStory 3.\nTerms of the treaty.\nAt the bottom.\nWalls.") and got[-1][1].count("\n") == 49_999
    assert html_text.main_text(page(0)) == "Title 0\nStory 0.\nRead us daily\nSee 0 too"
    assert html_text.extract(df.limit(0)).count() == 0


def test_templates_against_plain_counting(spark):
    """The digests that Spark counts are those of the subtrees that a plain count finds on enough pages of their host."""
    r = random.Random(12)
    block = lambda: r.choice(["<div>Menu</div>", "<p>Buy now</p>", "<ul><li>a</li><li>b</li></ul>", f"<p>{r.random()}</p>"])
    rows = [(i, f"http://{r.choice('abc')}.example/{i}", "".join(block() for _ in range(4)) + "<article>" + "".join(block() for _ in range(3)) + "</article>") for i in range(90)]
    pages, seen = {}, {}
    for _, url, page in rows:
        host = url[7:16]
        pages[host] = pages.get(host, 0) + 1
        outside, inside = html_text.subtrees_of(page)
        for d, kind in [(d, 10) for d in outside] + [(d, 50) for d in inside]:
            seen[host, d, kind] = seen.get((host, d, kind), 0) + 1
    want = {h: {html_text.COUNTED} | {d for (k, d, p), n in seen.items() if k == h and n >= 5 and 100 * n >= p * pages[h]} for h in pages}
    got = {x.host: set(x.template) for x in html_text.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def _archive():
    payloads = [(1, b"<p>one</p>"), (2, b"<p>one</p>"), (3, b""), (4, b"four" * 50)]
    sha = lambda b: hashlib.sha1(b).digest()
    return payloads, [warc.record(i, f"http://x/{i}", p, sha(p), 1 if i == 2 else None) for i, p in payloads]


def test_warc_members_read_back():
    payloads, members = _archive()
    found = list(warc.salvage(b"".join(members)))
    assert [warc.page_of(x.headers["warc-record-id"]) for x in found] == [1, 2, 3, 4]
    assert found[1].kind == "revisit" and found[0].block.endswith(payloads[0][1])


@pytest.mark.parametrize("at", range(4))
def test_warc_salvage(at):
    _, members = _archive()
    whole = b"".join(members)
    start = sum(map(len, members[:at]))
    damaged = bytearray(whole)
    for i in range(start + 20, start + 40):
        damaged[i] ^= 0xFF
    found = list(warc.salvage(bytes(damaged)))
    pages = [warc.page_of(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert pages == [i + 1 for i in range(4) if i != at] and [(g.start, g.size) for g in gaps] == [(start, len(members[at]))]


def test_warc_salvage_of_plain_and_cut_files():
    import zlib

    _, members = _archive()
    plain = [zlib.decompress(m, 31) for m in members]
    bad = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(warc.salvage(plain[0] + bad + plain[2] + b"junk" + plain[3] + members[0]))
    assert [warc.page_of(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)] == [1, 3, 4, 1]
    assert [x.size for x in found if isinstance(x, warc.Gap)] == [len(bad), 4]
    cut = list(warc.salvage(members[0] + members[1][:-7]))
    assert isinstance(cut[0], warc.Record) and cut[1].problem == "member without end"
    assert list(warc.salvage(b"")) == []


def test_warc_reader_is_linear_and_leaves_gzip_payloads_alone():
    import gzip
    import time
    import zlib

    sha = lambda b: hashlib.sha1(b).digest()
    took = []
    for n in (2000, 16000):
        whole = b"".join(warc.record(i, f"http://x/{i}", b"<p>text %d</p>" % i, sha(b"<p>text %d</p>" % i), None) for i in range(n))
        began = time.process_time()
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(whole)) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]
    packed = gzip.compress(b"hello " * 200)
    plain = [zlib.decompress(warc.record(i, "http://x", packed, sha(packed), None), 31) for i in range(3)]
    found = list(warc.salvage(b"".join(plain)))
    assert [type(x) for x in found] == [warc.Record] * 3 and all(x.block.endswith(packed) for x in found)
    old = plain[1].replace(b"WARC/1.1", b"WARC/0.9", 1)
    found = list(warc.salvage(b"\x1f\x8b\x08 broken" + old + plain[2]))
    assert [type(x) for x in found] == [warc.Gap, warc.Record, warc.Record] and found[0].size == 10


def test_warc_damage_is_not_lost(spark):
    rows = [(1, "u", "one"), (1, "u", "one"), (1, "u", "two"), (2, "u", "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.intact(warc.round_trip(df)).collect())
    assert got == [(1, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]
    whole = spark.createDataFrame([("a.warc.gz", bytearray(_archive()[1][0][:-9]))], "path string, content binary")
    with pytest.raises(Exception, match="gap in a.warc.gz"):
        warc.intact(warc.read_archives(whole)).collect()


def test_warc_against_plain_grouping(spark):
    r = random.Random(4)
    rows = [(i, None if i % 9 == 0 else f"http://x/{i}", r.choice(["", None, "a" * 50, "é", "b" * 2000])) for i in range(120)]
    rows += [(i, "http://y", "once %d" % i) for i in range(200, 260)]
    r.shuffle(rows)
    by = {}
    for i, _, html in rows:
        by.setdefault(html or "", []).append(i)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for least in (0, 51):
        got = {x.page_id: (x.record_type, x.refers_to, x.payload_bytes, x.payload_digest) for x in warc.intact(warc.round_trip(df, least)).collect()}
        assert len(got) == len(rows)
        for i, _, html in rows:
            b = (html or "").encode()
            first = min(by[html or ""])
            again = len(b) >= least and i != first
            assert got[i] == ("revisit" if again else "response", first if again else None, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())


def test_warc_round_trip(spark):
    rows = [(5, "http://a/ 5", "é<p>"), (3, "http://a/3", "é<p>"), (7, None, None), (9, "http://a/9", ""), (None, "http://a/n", "é<p>"), (11, "http://a/11", "x" * 100_000), (11, "http://a/11", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, sha1 string").repartition(3)
    got = warc.round_trip(df).where("problem is null").collect()
    assert len(got) == len(rows) and warc.round_trip(df.limit(0)).count() == 0
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    by = {r.page_id: r for r in got}
    assert (by[5].record_type, by[5].refers_to, by[5].payload_bytes, by[5].payload_digest) == ("revisit", 3, 5, digest("é<p>"))
    assert by[3].record_type == "response" and by[9].refers_to == 7 and by[7].payload_digest == digest("") and by[None].payload_bytes == 5
    large = {r.page_id: r.record_type for r in warc.round_trip(df, least_bytes=50_000).where("problem is null").collect()}
    assert large[5] == "response"


def test_contaminated(spark):
    item = "The quick brown fox jumps over the lazy dog while seventeen sheep look on from the far side of the hill."
    edited = item.replace("quick", "quack").replace("sheep", "sheeps").replace("far", "near")
    rows = [(1, "before " + item + " after"), (2, "x\n" + edited.upper() + "\ty"), (3, item[: len(item) // 2]), (4, None), (5, ""), (6, item.replace(" ", "\n  ")), (None, item), (7, "z " * 40_000 + item)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(8, item), (9, None), (10, ""), (11, "short"), (None, item), (12, "nothing like this is anywhere in the documents of this test")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(i, 8) for i in (1, 2, 6, None, 7)} and got[1, 8].edits == 0 and 0 < got[2, 8].edits <= 4
    assert {k for k in ((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, block_bytes=50).collect())} == set(got)
    left = decontamination.decontaminate(docs, bench)
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, None} and left.columns == docs.columns
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), bench).count() == 0


def fewest_edits(item, text):
    """Of item against any part of text, by the plain recurrence."""
    above = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != t)))
        above = row
    return min(above)


@pytest.mark.parametrize("size", [60, decontamination.SLICE])
def test_contaminated_against_brute_force(size, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE", size)
    r = random.Random(8)
    words = ["the", "an", "tion", "ing", "er", "of", "re"]
    make = lambda n: " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))
    items = [(i, make(11).encode()) for i in range(10)]
    texts = [b"", b"short"]
    for n in range(50):
        t = list(items[n % 10][1].decode())
        for _ in range(n % 14):
            t[r.randrange(len(t))] = r.choice(["", "x", "yz"])
        texts.append((make(r.randint(0, 15)) + " " + "".join(t) + " " + make(r.randint(0, 15))).encode())
    want = {}
    for d, t in enumerate(texts):
        for i, x in items:
            if (n := fewest_edits(x, t)) <= decontamination.budget(len(x), 10):
                want[d, i] = n
    found = list(decontamination.search(texts, decontamination.Items(items, 10)))
    assert {(d, i): edits for d, i, _, _, edits, *_ in found} == want and len(want) > 20
    assert all(fewest_edits(dict(items)[i], texts[d][s:e]) == edits for d, i, s, e, edits, *_ in found)


def test_contaminated_long_items_and_repeated_grams():
    import tracemalloc

    r = random.Random(2)
    item = bytes(r.choice(b"abcdefghij ") for _ in range(6000))
    copy = bytearray(item)
    copy[::40] = b"~" * len(copy[::40])
    tracemalloc.start()
    found = list(decontamination.search([b"q " * 3000 + bytes(copy) + b" z" * 3000], decontamination.Items([(1, item)], 10)))
    assert [(x[1], x[2], x[4]) for x in found] == [(1, 6000, len(item[::40]))]
    items = decontamination.Items([(1, b"=" * 1000), (2, b"=" * 500 + b" abcdefgh " + b"=" * 490), (3, b"-" * 500)], 10)
    found = list(decontamination.search([b"=" * 400_000], items))
    assert [(x[1], x[4]) for x in found] == [(1, 0), (2, 10)]
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


SPEECH = {"en": "the house and the garden with that thing of which they were thinking", "de": "das haus und der garten mit der sache über die sie gedacht haben würden"}


def test_languages(spark):
    r = random.Random(2)
    say = lambda lang, n: " ".join(r.choice(SPEECH[lang].split()) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(["en", "de"] * 40)]
    train = spark.createDataFrame(rows + [(900, None, "en"), (901, "no label", None)], "doc_id long, text string, lang string")
    model = lang_id.fit(train)
    ask = spark.createDataFrame([(1, say("en", 20), "q"), (2, say("de", 20).upper(), "q"), (3, None, "q"), (4, "12 34 !?", "q"), (5, "", "q"), (None, say("de", 3000), "q")], "doc_id long, text string, score string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in lang_id.identify(ask, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "de"] and 0.5 < got[1][1] <= 1 and got[3][1] == 0
    assert lang_id.fit(train.limit(0)) is None and lang_id.identify(ask, None).where("lang_pred <> 'und'").count() == 0
    assert lang_id.identify(ask, model, ask.columns).columns == ["doc_id", "text", "lang_pred", "score"]
    assert lang_id.identify(ask.limit(0), model).count() == 0
    twice = spark.createDataFrame([(7, "½ ² ① Ⅷ 5"), (7, "½ ² ① Ⅷ 5"), (8, say("de", 9))], "doc_id long, text string")
    assert sorted((x.doc_id, x.lang_pred) for x in lang_id.identify(twice, model).collect()) == [(7, "und"), (7, "und"), (8, "de")]


def test_long_texts_are_coded_in_slices(spark, monkeypatch):
    import numpy as np

    r = random.Random(3)
    text = " ".join(r.choice(SPEECH["en"].split()) for _ in range(400))
    model = lang_id.fit(spark.createDataFrame([(1, text, "x"), (2, text[::-1], "y")], "doc_id long, text string, lang string"))
    asked = [text[:90].encode(), text.encode(), b"", text[50:70].encode(), (text * 3).encode()]
    whole = model.total(asked)
    monkeypatch.setattr(lang_id, "SLICE", 100)
    assert np.allclose(model.total(asked), whole)
    plain = [model.bits(np.frombuffer(lang_id.PAD + t, np.uint8)).sum(axis=0) if t else np.zeros(2) for t in asked]
    assert np.allclose(whole, plain, rtol=1e-4)


def test_stray_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MOST_LANGS", 2)
    rows = [(i, "some text", lang) for i, lang in enumerate(["en"] * 5 + ["de"] * 4 + ["zz", "yy"])]
    assert lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["de", "en"]


def test_code_lengths_against_plain_ppm(spark):
    import numpy as np

    text = "abracadabra\nabra"
    model = lang_id.fit(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string"))
    held = (lang_id.PAD + text.encode()).decode()
    seen = {w: [held[i : i + w] for i in range(len(held) - w + 1)] for w in range(1, lang_id.ORDER + 2)}

    def cost(gram):
        if not gram:
            return 8.0
        own = [g for g in seen[len(gram)] if g[:-1] == gram[:-1]]
        kinds, n = len(set(own)), len(own)
        if gram in own:
            return -np.log2(own.count(gram) / (n + kinds))
        return (-np.log2(kinds / (n + kinds)) if n else 0) + cost(gram[1:])

    asked = lang_id.PAD.decode() + "cabbage abra zz"
    want = [cost(asked[i - lang_id.ORDER : i + 1]) for i in range(lang_id.ORDER, len(asked))]
    got = model.bits(np.frombuffer(asked.encode(), np.uint8))[:, 0]
    assert got == pytest.approx(want, rel=1e-5)


def test_toxicity(spark):
    r = random.Random(6)
    plain = lambda n: [r.choice("river stone walks quiet evening market bread window letter garden".split()) for _ in range(n)]
    rows = []
    for i in range(240):
        w = plain(40)
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(40), r.choice(["grobnik", "zorfling", "mulchface"]))
        rows.append((i, " ".join(w) + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 160] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels)
    got = {x.doc_id: x.score for x in toxicity.scored(docs, grammar).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    score = lambda t: grammar.score(grammar.features(t))
    assert score("you are a grobnik") >= score("grobnik") > 0.5 > score("you are not a grobnik") and score("grobnik") > score("she said grobnik")
    assert score("I will kill you tonight.") > 0.5 > score("I will not kill you.") and score("They kill time.") == score("A quiet evening.") < 0.5
    assert score("Ich werde dich töten") > 0.5
    long = "river stone. " * 200_000
    assert score(long) < 0.5 and score(long + "You are a grobnik, you zorfling, you mulchface.") > score(long)
    odd = toxicity.scored(spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string"), grammar)
    assert all(0 <= x.score < 0.5 for x in odd.collect())
    assert toxicity.scored(docs.limit(1), toxicity.learn(docs, labels.limit(0))).count() == 1
    assert toxicity.scored(docs.limit(0), grammar).count() == 0
    twice = toxicity.scored(docs.where("doc_id = 4").union(docs.where("doc_id = 4")), grammar).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_composed_grammar_against_a_walk():
    """Every event is found again by looking around each token, without states."""
    x = toxicity
    r = random.Random(5)
    classes = (x.TARGET, x.NEGATION, x.REPORT, x.OBJECT | x.TARGET, x.THREAT, x.INSULT)
    behind = lambda s, i, bit: any(s[j] & bit for j in range(max(0, i - x.REACH[bit]), i))
    for _ in range(400):
        s = [r.choice((0, 0, 0, *classes, x.INSULT | x.THREAT)) for _ in range(r.randint(1, 14))]
        w = [r.randint(3, 9) for _ in s]
        want = 0.0
        for i, symbol in enumerate(s):
            left = (x.UNDER_NEGATION if behind(s, i, x.NEGATION) else 1) * (x.UNDER_REPORT if behind(s, i, x.REPORT) else 1)
            for kind, before, bonus in ((x.INSULT, x.TARGET, x.AIM), (x.THREAT, x.OBJECT, x.MENACE)):
                if symbol & kind:
                    ahead = next((j for j in range(i + 1, min(len(s), i + x.REACH[kind] + 1)) if s[j] & (x.TARGET | kind)), None)
                    met = behind(s, i, before) or ahead is not None and s[ahead] & x.TARGET
                    want += left * ((w[i] if kind == x.INSULT else 0) + (bonus if met else 0))
        assert x.clause_weight(s, w) == pytest.approx(want)


def test_toxicity_held_out(spark):
    from latticework.llm.common import table

    at = "/root/testdata/sf0.1"
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels").where("toxic is not null")
    grammar = toxicity.learn(docs, labels.where(lang_id.remainder(5) != 0))
    got = toxicity.scored(docs, grammar).join(labels.where(lang_id.remainder(5) == 0), "doc_id").select("score", "toxic").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() >= 0.99


def test_held_out_rows_are_not_read(spark):
    frame = spark.range(50).select(F.col("id").alias("doc_id"))
    import zlib

    assert {r.doc_id for r in frame.where(lang_id.remainder(4) == 2).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2}
