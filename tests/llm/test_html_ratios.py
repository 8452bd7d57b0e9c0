"""The content region by ratios alone: pages whose tags and names tell nothing, with the article known."""

import random

from texts import prose

from strandlake.llm import html_extract


def sentences(r, key, n):
    w = prose(key, n).split()
    out = []
    while w:
        k = r.randrange(6, 18)
        out.append(" ".join(w[:k]).capitalize() + ".")
        w = w[k:]
    return " ".join(out)


def unnamed_page(k):
    """(html, blocks of the article): links, labels that are no links, short and long paragraphs and rights, all of them
    div, span and p. In every second page the article has no element of its own. It ends with three words."""
    r = random.Random(k)
    links = lambda n: "".join(f"<div><div><a href='/{x}'>{x}</a></div></div>" for x in prose(f"l{k}{n}", n).split())
    labels = lambda n: "".join(f"<div><div><span><b>{prose(f'b{k}/{n}/{i}', 4)}</b></span></div></div>" for i in range(n))
    title = prose(f"t{k}", 6)
    blocks = [title, *[sentences(r, f"p{k}/{i}", r.choice([4, 25, 60, 120])) for i in range(r.randrange(4, 14))], sentences(r, f"e{k}", 90), prose(f"z{k}", 3)]
    body = "".join(f"<p>{b}</p>" if i else f"<h1>{b}</h1>" for i, b in enumerate(blocks))
    before, after = labels(r.randrange(10, 40)), labels(r.randrange(5, 30))
    article = body if k % 2 else f"<div><div>{body}</div></div>"
    return f"<html><body><div>{links(r.randrange(5, 14))}</div><div>{before}</div>{article}<div>{after}</div><div>{links(r.randrange(4, 9))}<p>Copyright {k}. All rights reserved.</p></div></body></html>", blocks


def found(extract, pages):
    """Recall and precision over the blocks of all pages."""
    hit = want = got = 0
    for html, blocks in pages:
        lines = extract(html).split("\n")
        hit += len(set(lines) & set(blocks))
        want += len(set(blocks))
        got += len(set(lines))
    return hit / want, hit / max(got, 1)


PAGES = [unnamed_page(k) for k in range(200)]


def right(pages=PAGES):
    return sum(html_extract.extract(h) == "\n".join(b) for h, b in pages)


def test_articles_without_names():
    recall, precision = found(html_extract.extract, PAGES)
    assert recall >= 0.99 and precision >= 0.99 and right() >= 0.95 * len(PAGES)


def test_ratios_and_smoothing_decide(monkeypatch):
    """With one ratio for all lines no page comes out right; without smoothing the articles of every second page lose
    their end."""
    with monkeypatch.context() as m:
        m.setattr(html_extract, "smoothed", lambda ratios, sigma=0: [1.0] * len(ratios))
        assert right() == 0
    with monkeypatch.context() as m:
        m.setattr(html_extract, "smoothed", lambda ratios, sigma=0: list(ratios))
        assert right() <= 0.6 * len(PAGES)


def test_a_small_article_element_is_no_region():
    """An article element that holds little of the content isn't the page's article; one that holds much is."""
    long = "".join(f"<p>{sentences(random.Random(i), f'b{i}', 80)}</p>" for i in range(8))
    teaser = "<article><h3>Elsewhere</h3><p>Read it.</p></article>"
    got = html_extract.extract(f"<body><div class='story'>{long}</div>{teaser}</body>")
    assert got.startswith(sentences(random.Random(0), "b0", 80)) and got.count("\n") >= 7
    got = html_extract.extract(f"<body><article>{long}</article><div><p>{sentences(random.Random(99), 'other', 60)}</p></div></body>")
    assert got.count("\n") == 7
