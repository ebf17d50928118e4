import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twigline.llm import langid, maintext, queries, simhash, tiff
from twigline.llm.components import connected_components


def prose(lang, rng, n=60):
    parts = {"en": ["the", "ing", "ther", "wh", "and"], "de": ["sch", "ung", "der", "ü", "und"], "fr": ["eau", "le", "è", "tion", "et"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_language_model(spark):
    rng = random.Random(3)
    rows = [(i, lang := ("en", "de", "fr")[i % 3], prose(lang, rng)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    fold = langid.held_out()
    model = langid.train_language_model(df.filter(~fold))
    odd = spark.createDataFrame(
        [(900, None, None), (901, "en", ""), (902, None, "123 !!"), (903, "xx", prose("de", rng, 3000)), (None, None, "the and")],
        "doc_id long, lang string, text string",
    )
    out = {r.doc_id: r for r in langid.predict_language(df.unionByName(odd), model).collect()}
    held = [r for r in df.filter(fold).collect()]
    assert held and sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    for i in (900, 901, 902):
        assert (out[i].lang_pred, out[i].lang_score, out[i].lang_rejected) == ("und", 0.0, True)
    assert out[903].lang_pred == "de" and out[None].lang_pred in model.langs
    assert all(0 <= r.lang_score <= 1 for r in out.values())
    clash = df.selectExpr("text", "1 as lang_pred")
    assert langid.predict_language(clash, model).columns == ["text", "lang_pred", "lang_score", "lang_rejected"]
    empty = langid.train_language_model(df.filter("false"))
    assert {r.lang_pred for r in langid.predict_language(df.limit(3), empty).collect()} == {"und"}


def test_long_texts_are_read_in_slices(monkeypatch):
    text = prose("de", random.Random(14), 400) + "\n123  " + prose("fr", random.Random(15), 300)
    whole = np.bincount(langid.subwords(text), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "SLICE", 50)
    ids, counts = langid.subword_counts(text)
    assert len(list(langid.slices(text))) > 20 and (whole[ids] == counts).all() and whole.sum() == counts.sum()


def test_unknown_languages_are_rejected():
    rng = random.Random(16)
    rows = [(x, *langid.subword_counts(prose(x, rng))) for x in ("en", "de") for _ in range(300)]
    model = langid.fit(rows)
    known = [model.predict(prose(x, rng))[2] for x in ("en", "de") for _ in range(200)]
    other = [model.predict(" ".join("".join(rng.choices(["ko", "zja", "mbu", "ó", "ivy"], k=3)) for _ in range(60)))[2] for _ in range(100)]
    assert sum(known) <= 4 and sum(other) >= 95


def test_languages_that_share_subwords_do_not_reject_odd_words():
    rng = random.Random(18)
    parts = ["ka", "lo", "mi", "ne", "tu"]

    def text(lang, n=60):
        weights = [5, 4, 3, 2, 1] if lang == "a" else [1, 2, 3, 4, 5]
        return " ".join("".join(rng.choices(parts, weights, k=3)) for _ in range(n))

    model = langid.fit([(x, *langid.subword_counts(text(x))) for x in ("a", "b") for _ in range(300)])
    keyed = [model.predict(f"{text(x, 12)} AKIA{rng.getrandbits(60):X} {text(x, 12)}") for x in ("a", "b") for _ in range(100)]
    assert model.least_seen == 0 and sum(rejected for _, _, rejected in keyed) <= 4


def test_sample_is_bounded(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, "en", prose("en", rng, 20)) for i in range(300)] + [(5, "en", "same id")] * 200 + [(9000, "xx", prose("fr", rng))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda samples: seen.append(samples))
    langid.train_language_model(df, rows_per_lang=50)
    of = [lang for lang, _, _ in seen[0]]
    assert of.count("xx") == 1 and 40 <= of.count("en") <= 50
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 40_000)
    langid.train_language_model(df, rows_per_lang=50)
    assert sum(6 * len(ids) for _, ids, _ in seen[1]) <= 60_000 and {x for x, _, _ in seen[1]} == {"en", "xx"}


def test_language_query_on_held_out_rows(spark):
    """The query's rows against the labels it did not learn from."""
    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, zlib.crc32(str(r.doc_id).encode()) % 4 == 2, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_language_id"](spark, data).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if truth[r.doc_id][0] and r.held_out]
    assert len(held) > 100 and all(r.held_out == truth[r.doc_id][1] and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    assert all((r.lang_pred == "und") == (not langid.has_letter(truth[r.doc_id][2])) for r in rows)
    assert sum(r.rejected for r in held) <= 0.01 * len(held)


def test_folding_equals_averaging():
    rng = np.random.default_rng(0)
    samples = [(x, *np.unique(langid.subwords(t), return_counts=True)) for x, t in [("a", "abc abd"), ("b", "xyz xyw")] * 20]
    m = langid.fit(samples)
    ids = langid.subwords("abc xyz other")
    plain = m.embeddings[ids].mean(axis=0) @ m.weights
    assert np.allclose(m.folded()[ids].mean(axis=0), plain, atol=1e-4)
    assert rng is not None


# ---- TIFF


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate", "packbits"])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(4)
    pages = [
        rng.integers(0, 4, (50, 70), dtype=np.uint8), rng.integers(0, 60000, (20, 33, 3), dtype=np.uint16),
        np.zeros((40, 64), np.uint8),
    ]
    data = tiff.write_tiff(pages, compression, predictor, strip_bytes=900, tile=tile, order=order)
    back = list(tiff.read_pages(data))
    assert len(back) == 3
    for p, b in zip(pages, back, strict=True):
        assert (b["pixels"].reshape(p.shape) == p).all()


def test_lzw_and_packbits_long():
    rng = np.random.default_rng(5)
    for raw in (b"", b"a", rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes(), b"ab" * 30_000, bytes(70_000)):
        assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw
        assert tiff.packbits_decode(tiff.packbits_encode(raw)) == raw


def test_fixed_vectors():
    """Byte strings worked out by hand from the TIFF 6.0 specification's rules, not by this module's encoders."""
    # PackBits: the specification's own example
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(b"\x80\x00A") == b"A"  # 128 says nothing
    # LZW: clear, 7, 258 (7 7), 8, 8, 258, 6, 6, end, each in 9 bits
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_bilevel_and_unknown_pages():
    import struct

    def page(entries, data, at):
        head = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHIHH", t, 3, 1, v, 0) for t, v in sorted(entries))
        return data + head

    # 10 x 2 pixels of 1 bit, PackBits; then a page with an unknown compression; then a plain one
    strip = bytes([3, 0b10101010, 0b01000000, 0b11111111, 0b11000000])
    common = [(256, 10), (257, 2), (277, 1), (278, 2)]
    one = [*common, (258, 1), (259, 32773), (273, 8), (279, 5)]
    two = [*common, (258, 1), (259, 7), (273, 8), (279, 5)]
    body = b"II*\0" + struct.pack("<I", 14) + strip + b"\0"
    for k, entries in enumerate([one, two, [*common, (258, 8), (259, 1), (273, 0), (279, 20)]]):
        body = page([*entries] if k < 2 else [(t, v if t != 273 else 0) for t, v in entries], body, 0)
        body += struct.pack("<I", len(body) + 4 if k < 2 else 0)
    pages = list(tiff.read_directories(body))
    assert len(pages) == 3 and isinstance(pages[1], tiff.TiffError)
    assert pages[0]["pixels"][:, :, 0].tolist() == [[1, 0] * 4 + [0, 1], [1] * 10]
    assert pages[2]["pixels"].tobytes() == body[:20]


def test_tiff_survives_hostile_bytes(spark):
    rng = random.Random(13)
    files = [
        tiff.write_tiff([np.arange(640, dtype=np.uint8).reshape(10, 64)] * 2, c, p, 200, t, o)
        for c in tiff.COMPRESSIONS for p in (True, False) for t in (None, (16, 16)) for o in "<>"
    ]
    bad = []
    for f in files:
        bad += [f[: rng.randrange(len(f))] for _ in range(8)]
        for _ in range(60):
            b = bytearray(f)
            for _ in range(rng.randint(1, 4)):
                b[rng.randrange(len(b))] = rng.choice([0, 1, 255, 128, rng.randrange(256)])
            bad.append(bytes(b))
    # huge sizes, an ASCII-typed and a negative width, an empty tag
    base = tiff.write_tiff([np.zeros((2, 64), np.uint8)], "deflate")
    at = base.index(bytes.fromhex("0001040001000000"))
    for kind, count, value in ((4, 1, 1 << 20), (4, 1, (1 << 32) - 1), (2, 1, 65), (9, 1, (1 << 32) - 5), (4, 0, 0), (5, 1, 8)):
        entry = kind.to_bytes(2, "little") + count.to_bytes(4, "little") + value.to_bytes(4, "little")
        bad.append(base[: at + 2] + entry + base[at + 12 :])
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "k int, media binary")
    rows = tiff.tiff_pages(df, "media").select("k", "page", "error").collect()
    assert {r.k for r in rows} == set(range(len(bad)))
    assert all(r.error for r in rows if r.k >= len(bad) - 6)


def test_tiff_tables(spark):
    good = tiff.write_tiff([np.arange(64, dtype=np.uint8).reshape(1, 64)] * 2)
    rows = [(1, good, 5), (2, None, 5), (3, b"", 5), (4, b"II*\0" + b"\xff" * 4, 5), (5, good[:-30], 5), (6, good, 5)]
    df = spark.createDataFrame(rows, "k int, media binary, width int")
    out = tiff.tiff_pages(df, "media").collect()
    assert [(r.k, r.page) for r in out if r.error is None and r.k in (1, 6)] == [(1, 0), (1, 1), (6, 0), (6, 1)]
    assert {r.k for r in out if r.error} == {3, 4, 5} and [r.page for r in out if r.k == 3] == [0] and not [r for r in out if r.k == 2]
    assert out[0].width == 64 and out[0].pixels == bytes(range(64))
    assert tiff.tiff_pages(df.filter("false"), "media").count() == 0


def test_texts_as_media(docs):
    texts = [None, "", "abc", "é" * 32, "x" * 64, "long " * 50_000, "abc"]
    stored = tiff.text_media(docs(texts), keep=["doc_id"])
    pages = tiff.tiff_pages(stored, "media").orderBy("doc_id").collect()
    for r, t in zip(pages, texts, strict=True):
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, hashlib.sha256(r.pixels).digest(), zlib.crc32(r.pixels[-64:])) == (
            len(raw), hashlib.sha256(want).digest(), zlib.crc32(want[-64:]),
        )
    assert pages[2].feature == pages[6].feature


# ---- main text


def test_main_text_drops_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
    <header><h2>Site</h2></header><div class="cookie-notice">We use cookies.</div><nav><ul><li><a href=x>Menu</a></ul></nav>
    <main><article><h1>Head &amp; line</h1><p>One   two<br>three <b>four</b>
    five.<p>Short.</p><div class="ad">Buy</div><form><label>Mail</label><input></form><p>Last &lt;p&gt;.</p></article>
    <section id="comments"><article><p>First!</p></article></section></main><aside>Side text here</aside>
    <footer>&copy; me</footer></body></html>"""
    assert maintext.main_text(page) == "Head & line\n\nOne two three four five.\n\nShort.\n\nLast <p>."


def test_main_text_without_article():
    body = "".join(f"<p>{'A sentence of the story. ' * 8}</p>" for _ in range(5))
    menu = "<div>" + "".join(f"<div><a href=x>Entry {i}</a></div>" for i in range(12)) + "</div>"
    got = maintext.main_text(f"<body>{menu}<div>{body}</div>{menu}")
    assert got.count("\n\n") == 4 and "Entry" not in got


def test_main_text_goes_on_after_furniture():
    story = [f"Part {i}: {'A sentence of the story. ' * 16}".strip() for i in range(25)]
    end = "The closing paragraph. " * 80
    ad = "<div class=ad>Buy</div>"
    menu = "<div>" + "".join(f"<div><a href=x>Entry {i}</a></div>" for i in range(12)) + "</div>"
    paragraphs = "".join(f"<p>{x}</p>" for x in story)
    got = maintext.main_text(f"<body>{menu}<div><h1>Head</h1>{ad}{paragraphs}{ad}<p>{end}</p>{menu}<p>Fin.</p></div>{menu}")
    assert got == "\n\n".join(["Head", *story, end.strip(), "Fin."])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content no-sidebar"><article><p>Hello there</p></article></div>', "Hello there"),
        ('<article class="post has-sidebar comments-open"><p>Hi you</p></article>', "Hi you"),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>x y</p></article>', "Title\n\nx y"),
        ('<article><section id="related-work"><p>Related</p></section><p class="notice-of-sale">Sale</p></article>', "Related\n\nSale"),
        ("<article><p>for <math><mi>x</mi></math> in y</p></article>", "for x in y"),
        ("<article><p>one</p></article><p>between</p><article><p>two</p></article>", "one\n\ntwo"),
        ("<form><h1>T</h1><p>all the text</p></form>", "T\n\nall the text"),
        ('<article><p>a</p><div id="comment-12" class="comment-list"><p>First!</p></div></article>', "a"),
        ('<article><p>See <a href=x>this</a></p><p><a href=x>and that</a></p></article>', "See this\n\nand that"),
    ],
)
def test_names_and_containers(page, text):
    assert maintext.main_text(page) == text


def test_names_do_not_decide_alone_and_dives_cut_articles():
    story = " ".join(["A sentence of the story."] * 6)
    links = "".join(f"<li><a href=x>Another story {i}</a></li>" for i in range(5))
    page = lambda inside: f"<body><article><h1>Head</h1><p>{story}</p>{inside}<p>{story}</p></article></body>"
    kept = lambda inside: maintext.main_text(page(inside)).split("\n\n")[2:-1]
    # a block named as a list of links is furniture if it is one, and a story's if it holds text with few links
    assert kept(f'<section id="related"><p>{story}</p></section>') == [story]
    assert kept(f'<section id="related"><p>{story} See <a href=x>this</a>.</p></section>') == [story + " See this."]
    assert kept(f'<section id="related"><ul>{links}</ul></section>') == []
    assert kept('<div class="share">Share this story</div>') == []
    assert kept(f'<div class="comments"><p>{story}</p></div>') == []
    assert kept(f'<div class="ad related"><p>{story}</p></div>') == []
    # a window of lines that are all links is a menu wherever it is; fewer, or headings, are not
    assert kept(f"<ul>{links}</ul>") == []
    assert kept("<p><a href=x>one</a></p><p><a href=x>two</a></p>") == ["one", "two"]
    assert kept("".join(f"<h2><a href=x>Part {i}</a></h2>" for i in range(4))) == [f"Part {i}" for i in range(4)]
    assert kept(f'<div class="ad">Buy</div><ul>{links}</ul><form>Mail</form>') == []
    # a headline in a block named as a head
    for top in (f'<article><div class="banner"><h1>Head</h1></div><p>{story}</p></article>', f'<div class="banner"><h1>Head</h1></div><p>{story}</p>'):
        assert maintext.main_text(f"<body>{top}</body>") == f"Head\n\n{story}"
    assert maintext.main_text(f'<body><div class="banner"><h1>Site</h1></div><article><p>{story}</p></article></body>') == story
    assert maintext.main_text(f'<body><div class="banner">Site</div><article><p>{story}</p></article></body>') == story


def test_link_runs():
    rng = random.Random(4)
    for n in range(40):
        linked = [rng.random() < 0.7 for _ in range(n)]
        runs = [[j for j in range(n) if all(linked[min(i, j) : max(i, j) + 1])] for i in range(n)]
        assert maintext.link_runs(np.array(linked, dtype=bool)).tolist() == [a and len(r) >= 3 for a, r in zip(linked, runs, strict=True)]


def test_surging_text_decides():
    menu = "".join(f"<div><a href=x>Entry {i}</a></div>" for i in range(5))
    story = f"<h2>Head</h2><p>{'A sentence of the story. ' * 12}</p><p>{'It goes on. ' * 12}</p>"
    short = "<div>(c) 2020 Someone</div>"
    # a short line cut off from the story goes, one beside it stays
    got = maintext.main_text(f"<body>{short}{menu}<div>{story}</div>{menu}{short}")
    assert got.startswith("Head") and got.count("\n\n") == 2 and "Someone" not in got
    # text that surges outside the main block stays
    far = "<div>" + "Far away text. " * 8 + "</div>"
    assert maintext.main_text(f"<body><div>{story}</div>{menu}{far}").endswith("Far away text.")
    # an article that most text lies outside of is no guide
    assert maintext.main_text(f"<body><article><p>Teaser</p></article>{menu}<div>{story * 3}</div>").count("Head") == 3


def plain_surges(sizes, surge, window):
    half = window // 2
    sums = [sum(sizes[max(0, i - half) : i + half + 1]) for i in range(len(sizes))]
    out = [False] * len(sizes)
    for i in range(len(sizes)):
        a = b = i
        while a > 0 and sums[a - 1] > 0:
            a -= 1
        while b + 1 < len(sizes) and sums[b + 1] > 0:
            b += 1
        out[i] = sums[i] > 0 and max(sums[a : b + 1]) >= min(surge, max(sums))
    return out


def test_surges_against_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 0, 0, 3, 20, 90]) for _ in range(rng.randint(0, 40))]
        for window in (1, 3, 5):
            assert maintext.surges(np.array(sizes, dtype=np.int64), 60, window).tolist() == plain_surges(sizes, 60, window)


def test_main_text_is_linear():
    import time

    began = time.perf_counter()
    assert maintext.main_text("<div>" * 40_000 + "deep") == "deep"
    assert maintext.main_text("<p><b>" * 40_000 + "x") == "x"
    assert time.perf_counter() - began < 5


def test_main_text_query_against_the_template(spark):
    """All pages of the small table hold one article, cut here by regular expressions."""
    import html
    import re

    data = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = queries.QUERIES["op7_main_text"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.sub("<[^>]*>", "", re.sub("<br>", " ", re.sub("</?(?:p|h1|h2|ul|li|div)>", "\0", inner))).split("\0")
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in want if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p>", "<!--", "<div class='", "<script>x", "<a href=\"x>y", "<" * 2000])
def test_main_text_of_odd_pages(page):
    assert isinstance(maintext.main_text(page), str)


def test_main_text_table(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "t"), (1, "<p>x</p>", "t"), (2, None, None)], "page_id long, html string, text string")
    assert sorted(r.text for r in maintext.extract_main_text(df).collect()) == ["", "x", "x"]
    assert maintext.extract_main_text(df.filter("false")).count() == 0


# ---- near-duplicates


def brute_components(ids, fps, distance=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def plain_fingerprint(text):
    import xxhash

    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(6)
    for text in [None, "", " \n", "One", "a b c", "ÄB c d e F", " ".join(rng.choices("abcdefg", k=300))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_native_hash_agrees(spark):
    import xxhash

    assert spark.sql("select xxhash64('a b ü c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b ü c".encode(), 42)


@pytest.mark.parametrize("node_size", [8, 64, 4096])
def test_links_against_brute_force(spark, node_size):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(250)} | {0, (1 << 64) - 1}
    centre = rng.getrandbits(64)
    for base in [*list(fps)[:60], *[centre] * 150]:  # near copies, and one crowd of them
        x = base
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    links = simhash.fingerprint_links(df, len(fps), 4, node_size)
    pairs = [(u % 2**64, v % 2**64) for u, v in links.collect()]
    assert all((u ^ v) and u in set(fps) and v in set(fps) for u, v in pairs)
    want = brute_components(fps, fps)
    roots = {r.node % 2**64: r.root for r in connected_components(links).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(roots.get(x, ("alone", x)), set()).add(x)
    wanted = {}
    for x in fps:
        wanted.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicate_table(docs):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=150)) for _ in range(20)]
    texts = base + [t + " tail" for t in base] + [None, "", "Same text here now", "same TEXT here now", "a b"]
    df = docs(texts, 10).unionByName(docs(texts[:1], 10))
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(texts) + 1
    ids, fps = list(range(10, 10 + len(texts))), [plain_fingerprint(t) for t in texts]
    want = brute_components(ids, fps)
    for r in got:
        assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id - 10], want[r.doc_id]) and len(r.fingerprint) == 16
    assert simhash.simhash_components(df.filter("false")).count() == 0


def test_components_of_a_path(spark):
    links = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = connected_components(links.unionByName(links.filter("u = 5")))
    assert {r.root for r in got.collect()} == {0} and got.count() == 200
