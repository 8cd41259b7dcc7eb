"""Extraction, tokens, language, quality: per-row operators against simple versions and planted cases."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallywise.llm import html, language, quality, tokens
from tallywise.llm.batches import drop_kept, kept_by_worker, with_computed

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def coder():
    return tokens.Encoder(tokens.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={}
    )


def test_computed_columns_are_made_for_few_rows_at_a_time(spark):
    docs = spark.range(5000).coalesce(1).select(F.col("id").alias("doc_id"))
    sized = with_computed(docs, "rows int", lambda: lambda b: [pa.array([b.num_rows] * b.num_rows, pa.int32())])
    found = sized.collect()
    assert [r.doc_id for r in found] == list(range(5000)) and max(r.rows for r in found) <= 1024


def test_rare_words_leave_few_states(library):
    draw, coder = random.Random(12), tokens.Encoder(tokens.read_ranks(RANKS), public_tokenizers.PATTERN)
    words = ["".join(draw.choice("abdeghilmnorstuäß") for _ in range(draw.randint(8, 30))) for _ in range(1500)]
    words += ["".join(draw.choice("eé日") for _ in range(n)) for n in (63, 64, 65, 400)]
    assert [coder.encode(w) for w in words] == [library.encode_ordinary(w) for w in words]
    assert len(coder.transducer.states) < 8 * len(words)


def test_tokens_equal_the_library_on_random_strings(coder, library):
    draw = random.Random(3)
    spelled = list(tokens.read_ranks(RANKS))
    for i in range(3000):
        if i % 2:
            text = b"".join(draw.choice(spelled) for _ in range(draw.randint(1, 6))).decode("utf-8", "replace")
        else:
            text = "".join(draw.choice("aabb .'s\n\té中👩0123ÀÉ") for _ in range(draw.randint(0, 40)))
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(coder.decode(ids)) == text


def test_a_long_run_of_one_letter(coder, library):
    text = "a" * 20000
    assert coder.encode(text) == library.encode_ordinary(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "_STATES", 40)
    monkeypatch.setattr(tokens, "_PAIRS", 20)
    monkeypatch.setattr(tokens, "_PIECES", 8)
    small = tokens.Encoder(tokens.read_ranks(RANKS), public_tokenizers.PATTERN)
    text = "The quick brown fox déjà vu jumped over thirteen lazy dogs again and again" * 3
    assert small.encode(text) == library.encode_ordinary(text)


def test_lookahead_is_bounded():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"cd": 258, b"abcd": 259}
    machine = tokens.Transducer(ranks)
    for piece in (b"abcdabcd", b"abcabcdcd", b"cdabcab", b"dcba"):
        expected = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(
            piece.decode()
        )
        assert list(machine.encode(piece)) == expected
    longest = max(map(len, ranks))
    assert all(len(way[0]) <= longest for state in machine.states for way in state)


def test_utf8_stream_never_splits_a_character():
    data = "aé中👩z".encode() * 5
    for size in (1, 2, 3, 5):
        stream = tokens.Utf8Stream()
        parts = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)] + [stream.end()]
        assert "".join(parts).encode() == data and "�" not in "".join(parts)
    broken = tokens.Utf8Stream()
    assert broken.feed(b"a\xe4\xb8") + broken.end() == "a�"


def test_round_trip_rows(spark, library):
    texts = [(1, "Hello wörld"), (2, None), (3, ""), (4, "x " * 30000), (4, "Hello wörld"), (None, "a")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, n_tokens int")
    coded = tokens.round_trip(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    import hashlib

    for r in coded.collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    there = tokens.decode_ids(tokens.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "") for r in there.collect())
    assert tokens.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="ads">
<header><h1>Site name</h1><nav><a href="/">Home</a></nav></header><div class="cookie-notice">We use cookies here</div>
%s
<aside><p>Side words that go on for quite some time, and more</p></aside><form><label>Name</label><input></form>
<div id="comments"><p>A reader's long comment about the text above, with opinions</p></div><footer>&copy; 2020 all rights</footer></body></html>"""


@pytest.mark.parametrize(
    "inner, expected",
    [
        (
            "<article><h1>Title</h1><p>First &amp; <i>long</i>er\n para.<p><b>Second</b><br>line<ul><li>one<li>two</ul></article>",
            "Title First & longer para. Second line one two",
        ),
        ("<article><p>Short.</p></article>", "Short."),
        (
            "<div class='story'><h1>Title</h1><p>One para of some length, with words.</p><p>Another one, longer than that.</p></div>",
            "Title One para of some length, with words. Another one, longer than that.",
        ),
        (
            "<h1>Title</h1><div><p>One para of some length, <a href=x>a link</a>.</p><p>Another one, longer than that.</p></div>",
            "Title One para of some length, a link. Another one, longer than that.",
        ),
        (
            "<main><article><p>Body text that matters.</p><div class='ad'>Buy</div><p>And its end &lt;here&gt; &#233;&nbsp;x</p></article></main>",
            "Body text that matters. And its end <here> é x",
        ),
    ],
)
def test_main_text(inner, expected):
    assert html.main_text(PAGE % inner) == expected


@pytest.mark.parametrize(
    "inner",
    [
        "<article><p>%s</p><section id='discussion'><h2 id='related-work'>Related work</h2><p>%s</p></section></article>",
        "<div class='layout has-sidebar'><article><p>%s</p><h2>Then</h2><p>%s</p></article></div>",
        "<article><p>%s</p><p>%s</p><ul><li><a href=x>First source</a></li><li><a href=y>Second source</a></li></ul></article>",
        "<article><p>%s</p><div class='reactions'><p>%s</p></div></article>",
    ],
)
def test_no_part_of_an_article_is_lost_for_its_name_or_links(inner):
    import re

    inner %= ("Words of the first part that go on for a while. " * 3, "Words of the second part that go on for a while. " * 3)
    assert html.main_text(PAGE % inner) == " ".join(re.sub(r"<[^>]*>", " ", inner).split())


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- x", "<script>x", "</p></div>", "&", "<a <b", "<div>" * 5000])
def test_odd_pages_give_a_text(page):
    assert isinstance(html.main_text(page), str)


def test_cut_off_pages_and_plain_text():
    assert html.main_text("<article><p>One &am") == "One &am"
    assert html.main_text("a < b & c") == "a < b & c"
    assert html.main_text("<p>a<p>b<br>c") == "a b c"


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    import re
    from html import unescape

    for r in html.extract_pages(pages).collect():
        inner = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*(>|$)", " ", inner)).split())
    odd = spark.createDataFrame([(1, None, "old"), (1, "", "old"), (None, "<p>x</p>", "old")], "page_id long, html string, text string")
    assert [r.text for r in html.extract_pages(odd).collect()] == ["", "", "x"]
    assert html.extract_pages(odd.limit(0)).count() == 0


def test_bundles_equal_the_definition():
    texts, dims = ["Aba c", "ÉÉ!", "", "  9"], 64
    found = language.bundle(texts, dims, 7)
    vector = lambda ch: language.letter_vector(ord(ch) if ch != " " else 0, dims, 7).astype(int)
    for text, v in zip([" aba c ", " éé ", "", ""], found):
        grams = [text[i : i + 3] for i in range(len(text) - 2)]
        expected = sum((np.roll(vector(g[0]), 2) * np.roll(vector(g[1]), 1) * vector(g[2]) for g in grams), np.zeros(dims, int))
        assert (v == expected).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    prototypes = language.learn_languages(docs.where(~held_out))
    assert list(prototypes) == ["de", "en", "es", "fr"]
    found = language.identify_languages(docs.where(held_out), prototypes).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edges(spark):
    rows = [(1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "the", None), (None, "the", "en"), (5, "", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    prototypes = language.learn_languages(docs)
    assert list(prototypes) == ["de", "en"]
    found = {r.doc_id: r for r in language.identify_languages(docs, prototypes).collect()}
    assert found[1].lang_pred == "de" and found[2].lang_pred == "en"
    assert found[3].lang_pred == found[5].lang_pred == "und" and found[3].score == 0.0
    digits = spark.createDataFrame([(1, "12 ... 9"), (2, "the " * 50000)], DOCS)
    assert [r.lang_pred for r in language.identify_languages(digits, prototypes).orderBy("doc_id").collect()] == ["und", "en"]
    assert language.learn_languages(docs.limit(0)) == {}
    assert [r.lang_pred for r in language.identify_languages(digits, {}).collect()] == ["und", "und"]


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    weights = quality.fit_quality(docs, labels.where(fold != 1), max_rows=1500)
    test = docs.join(labels.where(fold == 1), "doc_id").select("text", "quality")
    rows = quality.score_quality(test, weights).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(np.array(good) >= 0.5) > 0.99
    assert np.mean(np.array(bad) < 0.5) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words"), (2, "bad ### ###"), (3, None), (None, "x"), (1, "good words")], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 0), (2, None), (9, 1), (1, 7)], "doc_id long, quality int")
    weights = quality.fit_quality(docs, labels, epochs=30, l1=0.0)
    scored = quality.score_quality(docs.withColumn("score", F.lit("x")), weights)
    found = {r.text: r.score for r in scored.collect()}
    assert found["good words"] > 0.5 > found["bad ### ###"]
    assert 0 < found[None] < 1
    nothing = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), nothing).count() == 0


def test_training_follows_the_update_rule():
    rows = [(np.array([1, 1, 2]), 1), (np.array([3]), 0)]
    w = quality.train(rows, 3, 1, alpha=0.5, beta=1.0, l1=0.0, l2=0.0)
    z, n = np.zeros(9), np.zeros(9)
    for idx, y in rows:
        x = np.zeros(9)
        for i in idx:
            x[i] += 1 / len(idx) ** 0.5
        x[8] = 1
        at = np.flatnonzero(x)
        wt = np.zeros(9)
        wt[at] = -z[at] / ((1.0 + np.sqrt(n[at])) / 0.5)
        g = (1 / (1 + np.exp(-wt @ x)) - y) * x
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5
        z += g - sigma * wt
        n += g * g
    assert np.allclose(w, -z / ((1.0 + np.sqrt(n)) / 0.5))
    assert len(quality.features("a b a", quality._Hashes(), 18)) == 5
    assert zlib.crc32(b"a") == quality._Hashes()["a"]


def test_workers_drop_what_other_operators_keep(spark):
    docs = spark.createDataFrame([(i,) for i in range(40)], "i long").repartition(1)

    def kept():
        return kept_by_worker(("tests", 1), lambda: [0])

    def count(b):
        kept()[0] += 1
        return [pa.array([kept()[0]] * b.num_rows, pa.int32())]

    for keeps, expected in ((("tests",), 2), ((), 1)):
        drop_kept()
        kept()[0] = 1
        drop_kept(*keeps)
        assert count(pa.record_batch([pa.array([1])], ["i"]))[0].to_pylist() == [expected]
    drop_kept()
    plain = with_computed(docs, "n int", lambda: lambda b: [pa.array([len(sys.modules["_tallywise_worker"].__dict__.get("tests", ()))] * b.num_rows, pa.int32())])
    with_computed(docs, "n int", lambda: count, ("tests",)).collect()
    assert {r.n for r in plain.collect()} == {0}
