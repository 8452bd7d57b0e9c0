"""Encodings, extraction, scoring, decontamination and sharding against brute force, libraries or held-out labels."""

import hashlib
import heapq
import os
import pickle
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from texts import twins
from tokenizers import Tokenizer

from strandlake.llm import common, fm_decontam, html_extract, huffman_ids, langid, quality, sentencepiece_viterbi, sharding
from strandlake.llm.common import Workspace, eight, word_hashes

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  ", "\n\n x", "don't we'll I'm  ok\t\tq", "<|endoftext|> hi", "日本語 text", "a_b __c 12a3 ½", "É'S 'S 's", "▁x ▁", "ÿ×÷Ø", "a\r\n b \r", "\x00\x01 z", " 's  's", "é ȷ ɐ", "a \n", "\t\t", "a\t b", "ɏ x", "x  \n  y"]


def noise(n, seed=1):
    r = random.Random(seed)
    letters = ["a", "B", "é", "1", " ", "  ", "\n", "\t", "!", "_", "'", "'s", "日", "×", "\r", " x"]
    return ["".join(r.choices(letters[:13] if k % 2 else letters, k=r.randint(0, 14))) for k in range(n)]


# ---------------------------------------------------------------- ids
def test_added_tokens_are_ids():
    """The plain call of the library: the text of an added token is one id, wherever it stands."""
    e = huffman_ids.Encoder(BYTES)
    texts = ["<|endoftext|>", "a<|endoftext|>b c", "x <|endof", "text|> y", "<|endoftext|><|endoftext|> q <|endoftext", "plain words"]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    tok = Tokenizer.from_file(BYTES)
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [50256]


def test_encoder_is_the_library():
    tok = Tokenizer.from_file(BYTES)
    texts = ODD + noise(1500)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    e = huffman_ids.Encoder(BYTES)
    assert e.encode(texts) == want
    assert e.encode(texts[::-1]) == want[::-1]  # from memory


@pytest.mark.parametrize("limit", [9, 12, 40])
def test_code_lengths(limit):
    r = np.random.default_rng(limit)
    counts = r.integers(0, 1000, 300) ** 2
    counts[::7] = 0
    lengths = huffman_ids.code_lengths(counts, limit)
    used = counts > 0
    assert lengths.max() <= limit and (lengths[used] > 0).all() and (lengths[~used] == 0).all()
    assert (2.0 ** -lengths[used]).sum() <= 1
    if limit == 40:  # no limit: the cost of a Huffman tree
        heap = [int(c) for c in counts[used]]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert (lengths * counts).sum() == cost


@pytest.mark.parametrize("sizes", [[1], [64, 65, 1, 129], [500, 1, 1, 63, 64, 1000]])
def test_blocks_round_trip(sizes):
    r = np.random.default_rng(0)
    counts = r.integers(0, 50, 400)
    code = huffman_ids.Code(huffman_ids.code_lengths(counts, 14))
    n = np.array(sizes)
    ids = r.choice(np.flatnonzero(counts), n.sum())
    data, size, deltas = code.encode(ids, n)
    assert (code.decode(np.frombuffer(data, np.uint8), np.cumsum(size) - size, n, deltas.astype(np.int64)) == ids).all()


def test_files(spark, docs, rows):
    tok = Tokenizer.from_file(BYTES)
    ws = Workspace(spark, "test")
    files, lengths = huffman_ids.write_ids(docs, BYTES, ws)
    got = {r.doc_id: r for r in huffman_ids.read_ids(files, lengths, with_ids=True).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {r.id: r.length for r in spark.read.parquet(ws.path("code")).collect()} == {int(k): int(lengths[k]) for k in np.flatnonzero(lengths)}


def test_files_are_all_that_the_reader_needs(spark, docs, rows, tmp_path):
    out = f"file://{tmp_path}/ids"
    first = huffman_ids.encode_documents(docs, BYTES, out).collect()
    again = huffman_ids.load_ids(spark.newSession(), out, with_ids=True).collect()
    assert sorted(x[:4] for x in map(tuple, again)) == sorted(map(tuple, first)) and len(first) == len(rows)
    assert sorted(os.listdir(tmp_path / "ids")) == ["code", "files"]
    code = "import sys; from pyspark.sql import SparkSession; from strandlake.llm import huffman_ids\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nprint(sum(r.ids_crc32 for r in huffman_ids.load_ids(s, sys.argv[1]).collect()))"
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    other = subprocess.run([sys.executable, "-c", code, out], capture_output=True, text=True, env=env, timeout=150)
    assert other.stdout.split()[-1] == str(sum(r.ids_crc32 for r in first)), other.stderr


def test_files_edges(clash, empty):
    assert huffman_ids.encode_documents(empty, BYTES).count() == 0
    got = huffman_ids.encode_documents(clash, BYTES).orderBy("start").collect()
    assert len(got) == clash.count() and [r.doc_id for r in got[:3]] == [None] * 3
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]


# ---------------------------------------------------------------- pieces
def test_pieces_are_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = sentencepiece_viterbi.Pieces(PIECES)
    texts = [t for t in ODD + noise(1500) if "▁" not in t] + ["a" * n for n in range(1, 50)] + ["hahaha" * 5, "ababab" * 9, "the thing is  that   it"]
    for t, raw in zip(texts, m.encode(texts)):
        assert np.frombuffer(raw, "<i4").tolist() == lib.encode(t), t


def test_pieces_decode():
    for merges in (True, False):
        m = sentencepiece_viterbi.Pieces(PIECES, merges)
        for t in ODD + noise(300):
            assert m.decode(np.frombuffer(m.encode([t])[0], "<i4").tolist()) == t.encode()


def test_best_sum_against_brute_force():
    m = sentencepiece_viterbi.Pieces(PIECES, merges=False)
    words = sorted({w for t in ODD + noise(300) for w in re.findall(r" +[^ \n]*|\n|[^ \n]+", " " + t)} | {" thention", " reathing"})
    got = m.segment(words)
    for w in words:
        best = {0: (0.0, ())}
        for j in range(1, len(w) + 1):
            some = [(best[i][0] + m.scores[w[i:j]][0], -i, (*best[i][1], m.scores[w[i:j]][1])) for i in range(j) if w[i:j] in m.scores]
            if w[j - 1] not in m.scores:
                some.append((best[j - 1][0] + m.unknown, 1 - j, best[j - 1][1] + tuple(m.bytes[b] for b in w[j - 1].encode())))
            top = max(some, key=lambda x: x[:2])
            best[j] = (top[0], top[2])
        assert tuple(np.frombuffer(got[w], "<i4").tolist()) == best[len(w)][1]


def test_pieces_of_documents(docs, clash, empty, rows):
    got = {r.doc_id: r for r in sentencepiece_viterbi.encode_decode(docs, PIECES).collect()}
    for i, t in rows:
        assert got[i].round_trip and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].n_pieces == len(got[i].pieces)
    assert sentencepiece_viterbi.encode(empty, PIECES).count() == 0
    assert sentencepiece_viterbi.encode(clash, PIECES).count() == clash.count()


# ---------------------------------------------------------------- words by their bytes
def weak(load, starts, ends):
    """Hashes of longer words that are nearly all the same."""
    h = word_hashes(load, starts, ends)
    return np.where(ends - starts > 7, h & np.uint64(1), h)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(common, "word_hashes", weak)
    monkeypatch.setattr(fm_decontam, "word_hashes", weak)
    a, b = twins()
    texts = [a, b, f"{a} {b}", "nevertheless notwithstanding", "notwithstanding nevertheless nevertheless", "x" * 300, "x" * 299 + "y", *noise(200, 4)]
    tok = Tokenizer.from_file(BYTES)
    e = huffman_ids.Encoder(BYTES)
    for some in (texts, texts[::-1]):
        assert e.encode(some) == [np.array(x.ids, dtype="<u4").tobytes() for x in tok.encode_batch(some, add_special_tokens=False)]
    m, lib = sentencepiece_viterbi.Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for some in (texts, texts[::-1]):
        for t, raw in zip(some, m.encode(some)):
            assert np.frombuffer(raw, "<i4").tolist() == lib.encode(t) and m.decode(np.frombuffer(raw, "<i4").tolist()) == t.encode()
    col = pa.array(texts)
    buf, offs = common.flat(col)
    starts, ends, _ = common.words(buf, offs, common.SPACE)
    words_ = [buf[i:j].tobytes() for i, j in zip(starts, ends)]
    u, first, back = common.distinct(common.eight(buf), starts, ends)
    assert (np.diff(u.astype(object)) >= 0).all() and [words_[first[k]] for k in back] == words_ and len(first) == len(set(words_))
    w = fm_decontam.Windows(pa.array([1, 2]), pa.array([a, "nevertheless notwithstanding"]))
    assert [x for x in fm_decontam.hits(pa.array([a, b, "notwithstanding nevertheless notwithstanding"]), w)[2]] == [{1}, set(), {2}]
    lang = langid.distinct_words(buf, offs)
    assert [buf[i:j].tobytes() for i, j in zip(lang[0][lang[2]], lang[1][lang[2]])] == words_
    assert quality.variety(back, np.array([0, len(back)]))[0][0] == len(set(words_))


def test_twins(spark):
    a, b = twins()
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{b} {a}")], "doc_id long, text string")
    tok = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in huffman_ids.encode_documents(docs, BYTES).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3)] == [len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in (a, b, f"{b} {a}")]
    assert all(r.round_trip for r in sentencepiece_viterbi.encode_decode(docs, PIECES).collect())
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r.doc_id for r in fm_decontam.contamination(docs, bench).filter("contaminated").collect()} == {1, 3}


# ---------------------------------------------------------------- html
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li>Home</li><li>About</li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div><aside><p>Related long text that goes on and on and on and on and on.</p></aside>
<article><header><h1>Title &amp; more</h1></header><p><b>First   line<br>still first<p>Second&nbsp;block with <a href="x">a link</a> and text.</p><p>Short.</p>
<form><input name="q"><button>Go</button></form><div class="share-buttons">Share me</div><p hidden>unseen</p><ul><li>one</li><li>two</li></ul>
<p>A last long paragraph that has enough text in it to count as content.</p><!-- note --></article>
<section id="comments"><p>Nice post, I liked it very much indeed, thanks a lot.</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    assert html_extract.extract(PAGE) == "Title & more\nFirst line still first\nSecond block with a link and text.\nShort.\none\ntwo\nA last long paragraph that has enough text in it to count as content."


def test_page_without_article():
    page = "<body><div id=menu><a>x</a><a>y</a></div><div class=wrap><div class=text><p>" + "A long paragraph of words. " * 5 + "</p><p>tiny</p><p>" + "Another long paragraph here. " * 5 + "</p></div><div class=sidebar><p>side side side</p></div></div>"
    assert html_extract.extract(page) == "\n".join([("A long paragraph of words. " * 5).strip(), "tiny", ("Another long paragraph here. " * 5).strip()])


def test_heading_blocks_of_articles_stay():
    page = "<div class=page-header><p>Site</p></div><article><div class='entry-header'><h1>Title</h1></div><p>Some text of the article here.</p><div class='comments'><p>No.</p></div></article>"
    assert html_extract.extract(page) == "Title\nSome text of the article here."


def test_slugs_in_articles_are_no_boilerplate():
    parts = ["<h1>Title</h1>", "<section id='discussion'><p>What it means.</p></section>", "<h2 id='related-work'>Related work</h2>", "<section id='social-history'><p>History.</p></section>", "<div class='section' id='comments'><p>Remarks.</p></div>"]
    parts += ["<div id='job-search'><p>Jobs.</p></div>", "<p class='alert'>Take care.</p>", "<div class='alert alert-info' role='alert'>Note.</div>"]
    page = "<article>" + "".join(parts) + "<div id='comments'><p>No.</p></div><div class='ad'>No.</div><ul class='related-posts'><li>No.</li></ul></article>"
    want = "Title\nWhat it means.\nRelated work\nHistory.\nRemarks.\nJobs.\nTake care.\nNote."
    assert html_extract.extract(page) == want
    assert html_extract.extract(page.replace("article>", "main>")) == want
    assert html_extract.extract("<body><section id='discussion'><p>What it means.</p></section></body>") == "What it means."
    assert all(html_extract.BOILER.search(w) for w in html_extract.CLEAR)


def test_forms_that_hold_the_text_stay():
    form = "<form action='x'><p>Your name</p><input name='n'><button>Send</button></form>"
    article = f"<article><h1>Title</h1><p>Some text of the article here.</p>{form}</article>"
    want = "Title\nSome text of the article here."
    assert html_extract.extract(f"<body>{article}</body>") == want
    assert html_extract.extract(f"<body><form id='aspnetForm'><div class='nav'>x</div>{article}</form></body>") == want
    text = "A long paragraph of words. " * 5
    assert html_extract.extract(f"<body><form><div><p>{text}</p><p>{text}</p></div></form><p>x</p></body>").count("A long") == 10


def test_all_sections_of_pages_without_article():
    def p(k, n):
        return (f"word{k} " * n)[: n - 1] + "."

    a, b, c = p(1, 800), p(2, 800), p(3, 300)
    story = f"<div class=story><section><p>{a}</p><p>{b}</p></section><section><p>{c}</p></section></div>"
    assert html_extract.extract(f"<html><body>{story}</body></html>") == f"{a}\n{b}\n{c}"
    links = "<div class=top><a href=1>Home page</a> <a href=2>All the news</a></div>"
    rights = "<div class=bottom><p>\u00a9 2020 Somebody. All rights reserved.</p></div>"
    assert html_extract.extract(f"<html><body>{links}{story}{rights}</body></html>") == f"{a}\n{b}\n{c}"
    flat = f"{links}<h1>Title</h1><section><p>{a}</p><p>{b}</p></section><h2>More</h2><section><p>{c}</p></section>{rights}"
    assert html_extract.extract(f"<html><body>{flat}</body></html>") == f"Title\n{a}\n{b}\nMore\n{c}"
    assert html_extract.extract(f"<p>{a}</p><p>{c}</p>") == f"{a}\n{c}"
    assert html_extract.extract("<body><h2 id='related-work'>Related work</h2><section id='discussion'><p>What it means.</p></section></body>") == "Related work\nWhat it means."


def test_sibling_articles():
    a, b = "A long paragraph of words. " * 20, "Another one. "
    want = "\n".join([a.strip(), b.strip()])
    for wrap in ("{}", "<div class=item>{}</div>"):
        page = "<body><div class=feed>" + "".join(wrap.format(f"<article><p>{t}</p></article>") for t in (a, b)) + "<div>Unnamed rest</div></div></body>"
        assert html_extract.extract(page) == want
    assert html_extract.extract(f"<body><article><p>{a}</p></article><article><a href=1>Read this next</a></article></body>") == a.strip()


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<script>x</script>", "<", "<![if x]><p>t</p>", "<p>a<p>b</div></div>", "&#x41;&amp;&nosuch;", "<" * 50])
def test_broken_pages(page):
    assert isinstance(html_extract.extract(page), str)


def test_plain_text_page():
    assert html_extract.extract("&#x41;&amp;B") == "A&B"


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 6), (None, None, None, 7), (2, "v", "<p>é</p>", 8)], "page_id long, url string, html string, text int")
    got = html_extract.html_extract(df).collect()
    assert len(got) == 4 and {(r.page_id, r.text, r.n_chars) for r in got if r.page_id != 1} == {(None, "", 0), (2, "é", 1)}
    assert html_extract.html_extract(df.limit(0)).count() == 0


def test_notes_inside_articles_go_by_name_and_text():
    """Notices, adverts and comments go; what only sounds like them, or holds much of the article, stays."""
    before = "<html><body><article><h1>T</h1><p>" + "A long paragraph of prose that goes on and on. " * 6 + "</p>"
    after = "<p>" + "More of the same prose follows here. " * 5 + "</p></article></body></html>"
    out = ['<div class="notice">We use cookies.</div>', '<div class="comment">Nice post!</div>', '<div id="comment-17"><p>Me too.</p></div>', '<div class="ad-box"><a href=x>Buy now</a></div>', '<div class="promo"><p>Half price today.</p></div>', '<div class="share-me social"><a href=x>Post it</a> <a href=y>Mail it</a></div>']
    stay = ['<section id="discussion"><p>What follows.</p></section>', '<h2 id="related-work">Related work</h2>', '<p class="alert">Take care.</p>', '<div id="job-search"><p>How people look for jobs.</p></div>', '<p class="notice">Prose that is called so.</p>', '<div class="comment"><p>' + "An article that quotes a comment at length. " * 12 + "</p></div>"]
    for mid in out:
        assert len(html_extract.extract(before + mid + after).split("\n")) == 3, mid
    for mid in stay:
        assert len(html_extract.extract(before + mid + after).split("\n")) == 4, mid
    many = html_extract.extract(before + "".join(f'<div id="comment-{k}"><p>Reader {k} says so.</p></div>' for k in range(2000)) + after)
    assert "Reader" not in many and many.endswith("here.")


# ---------------------------------------------------------------- quality
def good_and_bad(n):
    r = random.Random(2)
    rows = []
    for i in range(n):
        w = [r.choice(["the", "thing", "reation", "of", "and", "outher"]) + r.choice(["", "s", "er", "ing"]) for _ in range(r.randrange(20, 200))]
        bad = i % 5 == 0
        rows.append((i, " ".join(x + r.choice(["***", "###", "$$$"]) for x in w) if bad and i % 2 else " ".join(["spam"] * len(w)) if bad else ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)), int(not bad)))
    return rows


def test_quality_held_out(spark):
    rows = good_and_bad(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    y = {i: y for i, _, y in rows}
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if i is not None:
            assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in y if got[i].held_out]
    assert sum(got[i].predicted == y[i] for i in held) >= 0.97 * len(held)
    # labels of held-out rows are never seen
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality(docs, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in got)
    kept = quality.keep_good(docs.withColumn("stats", F.lit(1)), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_quality_edges(docs, clash, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.quality(docs, none).collect()} == {1}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(clash, labels).count() == clash.count()
    assert quality.keep_good(clash, labels).columns == clash.columns


def test_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=300)
    y = (x + r.normal(size=300) > 0).astype(int)
    xs, ys = quality.pool(x, y)
    assert (np.diff(ys) > 0).all() and (np.diff(xs) > 0).all()
    # least squares: block means, and no block can be split upwards
    assert abs(np.interp(x, xs, ys).mean() - y.mean()) < 0.05


# ---------------------------------------------------------------- language
def test_forward_against_brute_force():
    vocab = langid.vocabulary(PIECES)
    lattice = langid.Lattice(vocab)
    number = {p: i for i, p in enumerate(vocab)}
    prob = np.random.default_rng(0).random((len(vocab), 2)) / 100
    m = langid.Model(["a", "b"], np.zeros(2), prob, lattice)
    r = random.Random(3)
    words = ["thntion", "é", "the", "a" * 300, "größe", "日本", "".join(r.choices("thenation", k=250)), "".join(r.choices("thenation", k=langid.APART + 1)), "".join(r.choices("日本語テキスト", k=700))]
    raw = "".join(words).encode()
    sizes = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(sizes)
    got = m.log_words(np.frombuffer(raw, np.uint8), ends - sizes, ends)
    for k, w in enumerate(words):
        b = b" " + w.encode()  # whole, whatever its length
        alpha, shift = [np.ones(2)] + [np.zeros(2)] * len(b), np.zeros(2)
        for j in range(1, len(b) + 1):
            alpha[j] = sum((alpha[i] * prob[number[b[i:j]]] for i in range(max(0, j - lattice.longest), j) if b[i:j] in number), np.zeros(2))
            if alpha[j].min() < 1e-100:
                by = alpha[j]
                shift, alpha[max(0, j - lattice.longest) : j + 1] = shift + np.log(by), [a / by for a in alpha[max(0, j - lattice.longest) : j + 1]]
        assert np.allclose(got[k], np.log(alpha[-1]) + shift)


def test_expected_counts_add_up():
    lattice = langid.Lattice(langid.vocabulary(PIECES))
    raw = b"thethingab"
    s, e = np.array([0, 3, 8]), np.array([3, 8, 10])
    got = langid.expected(lattice, np.frombuffer(raw, np.uint8), s, e, np.array([[1.0, 0], [2.0, 1], [0, 3.0]]))
    sizes = np.array([len(p) for p in langid.vocabulary(PIECES)])
    assert np.allclose(sizes @ got, [4 + 12, 6 + 9])  # every byte and mark is covered once by each word's pieces


def test_expected_counts_of_long_words():
    """A word apart and the same among others: the same posterior counts."""
    lattice = langid.Lattice(langid.vocabulary(PIECES))
    raw = ("thenation" * 9).encode()
    buf, s, e = np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)])
    near = langid.expected(lattice, buf, s, e, np.ones((1, 1)))
    piece, post = langid.expected_word(lattice, np.concatenate([[np.uint8(langid.MARK)], buf]), np.array([langid.PER_BYTE**k / lattice.n for k in range(lattice.longest + 1)]))
    assert len(raw) <= langid.APART and np.allclose(near[:, 0], np.bincount(piece, weights=post, minlength=lattice.n))


def test_long_words_do_not_underflow():
    vocab = langid.vocabulary(PIECES)
    lattice = langid.Lattice(vocab)
    number = {p: i for i, p in enumerate(vocab)}
    words = ["កខគឃងចឆជ" * 8, "ກຂຄງຈ" * 12, "-" * 190, "the", "ກຂຄງຈ" * 900, "thenation" * 40]
    raw = "".join(words).encode()
    sizes = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(sizes)
    buf = np.frombuffer(raw, np.uint8)
    lens = np.array([len(p) for p in vocab])
    for k in range(len(words)):  # every byte and the mark are covered once, in a block alone and among others
        alone = langid.expected(lattice, buf, (ends - sizes)[k : k + 1], ends[k : k + 1], np.ones((1, 1)))
        assert np.allclose(lens @ alone, sizes[k] + 1)
    weight = np.eye(len(words))
    assert np.allclose(lens @ langid.expected(lattice, buf, ends - sizes, ends, weight), sizes + 1)
    prob = np.random.default_rng(1).random((len(vocab), 2)) / 1e6
    got = langid.Model(["a", "b"], np.zeros(2), prob, lattice).log_words(buf, ends - sizes, ends)
    for k, w in enumerate(words):
        b = b" " + w.encode()
        if len(b) > 2000:
            continue
        alpha = [np.zeros(2)]
        for j in range(1, len(b) + 1):
            alpha.append(np.logaddexp.reduce([alpha[i] + np.log(prob[number[b[i:j]]]) for i in range(max(0, j - lattice.longest), j) if b[i:j] in number]))
        assert np.allclose(got[k], alpha[-1])


def test_language_held_out(spark):
    r = random.Random(1)
    words = {"en": "the of and thing reation with".split(), "de": "der und nicht ung sch für".split(), "fr": "le de que ment eau très".split()}
    rows = []
    for i in range(240):
        lang = sorted(words)[i % 3]
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "e", "s"]) for _ in range(r.randrange(3, 40))), lang if i % 7 else None))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "de"), (1003, "日本", None), (None, "the thing", "en")]
    got = {x.doc_id: x for x in langid.language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    want = {i: sorted(words)[i % 3] for i in range(240)}
    assert sum(got[i].lang_pred == want[i] for i in want) >= 0.98 * len(want)
    assert [(got[k].lang_pred, got[k].score) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred in words
    assert all(0 <= x.score <= 1 for x in got.values())


def test_language_edges(docs, empty):
    assert langid.language(empty, PIECES).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language(nothing, PIECES).collect()} == {"und"}


# ---------------------------------------------------------------- contamination
def plain_hits(rows, items, window=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(lower))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            if i is not None:
                windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, t in rows:
        w = word.findall((t or "").translate(lower))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit.update(range(s, s + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [1 << 24, 300])
def test_contamination(spark, docs, rows, part):
    text = dict(rows)
    r = random.Random(4)
    items = [(k, " ".join(text[i].split()[2:20])) for k, i in enumerate((0, 5, 9, 60, 97))]
    items += [(50, "a b c"), (51, "Ha"), (52, None), (53, ""), (54, "!!!"), (5, text[3]), (None, text[4]), (60, "ha " * 14), (61, text[114])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = [(i, t if r.random() < 0.5 else (t or "").upper()) for i, t in rows]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = fm_decontam.contamination(df, bench, part)
    want = plain_hits(some, items)
    assert sorted((tuple(x)[:6] for x in got.collect()), key=repr) == want
    for x in got.collect():
        assert sum(e - s for s, e in zip(x.starts, x.ends)) == x.n_hit and all(a < b for a, b in zip(x.ends, x.starts[1:]))


def test_test_set_in_ten_parts(spark, docs, rows):
    """Items over ten parts: one part on the driver at a time, and the same result as in one."""
    r = random.Random(5)
    items = [(k, " ".join(rows[k % len(rows)][1].split()[r.randrange(3) :][:15])) for k in range(200) if rows[k % len(rows)][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    part = sum(len(t.encode()) for _, t in items) // 10 + 1
    assert fm_decontam.part_count(bench, part) == len(fm_decontam.part_numbers(bench, 10)) == 10
    got = sorted((tuple(x)[:6] for x in fm_decontam.contamination(docs, bench, part).collect()), key=repr)
    assert got == plain_hits(rows, items)


def test_broadcast_of_a_test_set_is_a_few_times_its_text():
    r = random.Random(6)
    vocab = [f"w{k}" for k in range(20000)]
    text = [" ".join(r.choices(vocab, k=60)) for _ in range(4000)]
    size = len(pickle.dumps(fm_decontam.Windows(pa.array(range(len(text))), pa.array(text))))
    assert size <= 12 * sum(map(len, text)), size / sum(map(len, text))


def test_contamination_edges(spark, clash, empty):
    bench = spark.createDataFrame([(1, "only here")], "item_id long, text string")
    assert fm_decontam.contamination(empty, bench).count() == 0
    assert fm_decontam.contamination(clash, bench.limit(0)).filter("contaminated").count() == 0
    kept = fm_decontam.drop_contaminated(clash, bench)
    assert kept.columns == clash.columns and kept.count() == clash.count() - 1


def test_index_finds_every_place():
    r = np.random.default_rng(1)
    text = r.integers(0, 4, 300)
    text[-1] = 0
    index = fm_decontam.FMIndex(text)
    for n in (1, 2, 5):
        patterns = np.unique(r.integers(1, 5, (40, n)), axis=0)
        which, at = index.search(patterns)
        want = [(k, p) for k, x in enumerate(patterns) for p in range(len(text) - n + 1) if (text[p : p + n] == x).all()]
        assert sorted(zip(which.tolist(), at.tolist())) == sorted(want)


# ---------------------------------------------------------------- shards
@pytest.mark.parametrize("shards", [3, 8])
def test_shards(docs, rows, shards):
    got = sharding.shard(docs, shards).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    text = dict(rows)
    by = {}
    for r in got:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    for k, some in by.items():
        assert 0 <= k < shards and sorted(r.slot for r in some) == list(range(len(some)))


def test_shards_are_near_equal(spark):
    r = random.Random(6)
    rows = [(i, "w" * r.randrange(1, 200)) for i in range(4000)] + [(10_000 + i, "hot text " * 5) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [x.s for x in got]
    assert len(sizes) == 8 and max(sizes) <= 1.02 * min(sizes)


def test_shards_keep_groups(spark):
    rows = [(i, f"text {i % 500} " * (1 + i % 7)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text, at = dict(rows), {}
    for x in got:
        at.setdefault(text[x.doc_id], set()).add(x.shard)
    assert all(len(s) == 1 for s in at.values())


@pytest.mark.parametrize("groups, share, cut", [(1, 0.10, 0), (9, 0.10, 1), (1, 0.3, 1)])
def test_shards_cut_only_what_does_not_fit(spark, groups, share, cut):
    r = random.Random(9)
    rows = [(100_000 + 1000 * g + i, f"{g:099d}") for g in range(groups) for i in range(500)]
    rest = int(groups * 50_000 * (1 - groups * share) / (groups * share))
    while rest > 0:
        rows.append((len(rows), f"{len(rows)} " + "w" * r.randrange(1, 190)))
        rest -= len(rows[-1][1]) + 1
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at, sizes = {}, {}
    for x in got:
        sizes[x.shard] = sizes.get(x.shard, 0) + x.size
        if x.doc_id >= 100_000:
            at.setdefault((x.doc_id - 100_000) // 1000, set()).add(x.shard)
    assert len(got) == len(rows) and sum(len(s) > 1 for s in at.values()) == cut
    assert len(sizes) == 8 and max(sizes.values()) <= 1.02 * min(sizes.values())


def plain_pack(vectors, shards):
    """Largest in bytes first, to the shard of the highest dot product with what is left among those where it fits."""
    total = [max(1, sum(v[c] for v in vectors)) for c in range(3)]
    left, out = [[1.0] * 3 for _ in range(shards)], [None] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: -vectors[i][0] / total[0] * shards):
        share = [vectors[i][c] / total[c] * shards for c in range(3)]
        rest = [[a - b for a, b in zip(row, share)] for row in left]
        fit = [k for k in range(shards) if min(rest[k]) >= -1e-9]
        if fit:
            k = max(fit, key=lambda k: (round(sum(a * b for a, b in zip(left[k], share)), 12), -k))
        else:
            k = max(range(shards), key=lambda k: (rest[k][0] + 1e-6 * sum(rest[k]), -k))
        out[i], left[k] = k, rest[k]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_packing_against_a_plain_packer(seed):
    r = random.Random(seed)
    vectors = [(r.randrange(1, 5000), r.randrange(0, 900), r.randrange(1, 9)) for _ in range(r.choice([1, 7, 60, 300]))]
    for shards in (2, 5, 8):
        assert sharding.pack(np.array(vectors, dtype=float), shards).tolist() == plain_pack(vectors, shards)


def test_shards_balance_bytes_tokens_and_rows(spark):
    """All three sums are near equal, and nearer in tokens and rows than by bytes alone; a long text is one row like any."""
    r = random.Random(6)
    rows = [(i, " ".join("x" * r.choice([1, 30]) for _ in range(r.randrange(1, 200)))) for i in range(3000)] + [(5000, " ".join("x" * r.choice([1, 30]) for _ in range(9000)))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    sums = np.zeros((8, 3))
    for x in got:
        sums[x.shard] += (x.size, len(text[x.doc_id].split()), 1)
    share = sums / sums.sum(axis=0) * 8
    assert np.abs(share[:, 0] - 1).max() < 0.02
    assert np.abs(share[:, 1] - 1).max() < 0.15 and np.abs(np.delete(share[:, 2], int(share[:, 2].argmin())) - 1).max() < 0.15


def test_shards_edges(clash, empty):
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(clash).count() == clash.count()


def test_word_hashes_stand_anywhere():
    raw = np.frombuffer(b"abc xabc", np.uint8)
    h = word_hashes(eight(raw), np.array([0, 5, 4]), np.array([3, 8, 8]))
    assert h[0] == h[1] != h[2]
    assert len(word_hashes(eight(np.zeros(0, np.uint8)), np.zeros(0, int), np.zeros(0, int))) == 0 and isinstance(pa.array([1]), pa.Array)
