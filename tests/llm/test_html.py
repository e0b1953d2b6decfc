"""Main text: marks, alignment against a plain definition, and template that only several pages tell."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text as H

PAGES = [
    ('<div class="has-sidebar"><article>Hello</article></div>', "Hello"),
    ('<article class="post no-comments">X y</article>', "X y"),
    ('<section id="search-for-life"><p>Life</p></section>', "Life"),
    ("<main><p>Intro</p><article>A1</article></main>", "Intro\nA1"),
    ('<script>var x = "<!--";</script><article><p>Hello</p></article></body></html>', "Hello"),
    ("<script>// don't\n</script><article><p>Hello</p></article><p>it's", "Hello"),
    ('<p>one <span class="ad">buy</span>two</p>', "one two"),
    ('<article><p>a</p><div class="comments"><article>no</article></div></article>', "a"),
    ("<form><article>in form</article></form>", "in form"),
    ('<div class="widget">only</div>', "only"),
    ("<ul><li><a>x</a> <a>y</a></ul><p>text", "text"),
    ('<div id="user-comments"><p>Nice</p></div><p hidden>h</p><div class="cookie-notice">c</div><p>body', "body"),
    ("<p>" + "<b>" * 3000 + "deep", "deep"),
    ('<article><header class="post-header"><h1>Title</h1></header><p>b</p></article>', "Title\nb"),
    ('<article><div class="article-header"><h1>Title</h1></div><p>b</p></article>', "Title\nb"),
    ('<article><h1 class="header">Title</h1><p>b</p></article>', "Title\nb"),
    ('<article><p>a</p><section id="search"><p>b</p></section><section id="navigation"><p>c</p></section></article>', "a\nb\nc"),
    ('<article><p>a</p><p class="social">b</p></article>', "a\nb"),
    ('<form><div class="sidebar">side</div><div>Hello there</div></form>', "Hello there"),
    ('<article><p>a</p><div class="social">no</div><p class="ad">no</p><section id="comments"><p>no</p></section></article>', "a"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_marks(page, text):
    assert H.extract(page) == text


def naive(s, a, b):
    if s.tag[a] != s.tag[b]:
        return 0
    if s.tag[a] is None:
        return int(a == b)
    x, y = s.kids[a], s.kids[b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            w = naive(s, x[i], y[j])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    return 1 + best[-1][-1]


@pytest.mark.parametrize("cells", [16_000_000, 2])
def test_matching_is_largest(cells, monkeypatch):
    monkeypatch.setattr(H, "CELLS", cells)
    r = random.Random(1)

    def tree(depth, count):
        kids = []
        for _ in range(r.randint(1, 4)):
            if not depth or r.random() < 0.4:
                kids.append(count[0])
                count[0] += 1
            else:
                kids.append(tree(depth - 1, count))
        return [r.choice("ab"), *kids]

    for _ in range(400):
        s, both, kinds = H.Shapes(), [], []
        for _ in range(2):
            count = [0]
            t = ["", *tree(3, count)[1:]]
            kinds.append([r.choice([0, 0, 1, 2]) for _ in range(count[0])])
            both.append(s.add(t, kinds[-1]))
        leaves, blocks = s.matched(*both)
        pairs = sorted(leaves)
        assert s.score(*both) == naive(s, *both)
        assert all(kinds[0][i] == kinds[1][k] for i, k in pairs)
        assert len({k for _, k in blocks}) == len(blocks) and len(blocks) + len(pairs) == s.score(*both)
        assert len({k for _, k in pairs}) == len(pairs) and [k for _, k in pairs] == sorted(k for _, k in pairs)


def test_long_flat_pages():
    side = lambda name, step: H.outline(H.parse("<body>" + "".join(f"<p>{'a' if i % 3 == step else name}{i}</p>" for i in range(5000))))
    (t, x), (u, y) = side("b", 0), side("c", 0)
    h, k = [H.run_hash(r.text) for r in x], [H.run_hash(r.text) for r in y]
    assert sum(h[i] == k[j] for i, j in H.align(t, h, [u, k], {*h} & {*k})[0]) == 1667


def words(i):
    r = random.Random(i)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30))


def test_template_within_and_without_articles(spark):
    """Unmarked constants go, wherever they stand; varying slots stay; near and exact copies are no witnesses."""
    art = lambda i: f"<body><div>Site name</div><article><h1>T {i}</h1><p>{words(i)}</p>{'<p>' + words(i + 50) + '</p>' if i % 2 else ''}<p>Share this story</p></article>"
    soup = lambda i: f"<body><div>Welcome to us</div><div><p>{words(100 + i)}</p><p>Filed under {i}</p></div><div>All rights reserved</div>"
    same = "<article><p>Only here</p><p>twice told</p></article>"
    pages = [(i, f"http://a.org/{i}", art(i)) for i in range(8)] + [(20 + i, f"http://b.org/{i}", soup(i)) for i in range(6)] + [(40 + i, f"http://c.org/{i}", same) for i in range(9)]
    pages += [(60 + i, f"http://d.org/{i}", f"<article><p>{words(7)}</p><p>Edited {i}</p></article>") for i in range(8)] + [(80, "http://b.org/empty", ""), (81, "http://b.org/null", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refs", F.lit(1)).withColumn("form", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
    for i in range(8):
        assert got[i] == "\n".join([f"T {i}", words(i), *([words(i + 50)] if i % 2 else [])])
        assert got[60 + i] == f"{words(7)}\nEdited {i}"
    assert all(got[20 + i] == f"{words(100 + i)}\nFiled under {i}" for i in range(6))
    assert all(got[40 + i] == "Only here\ntwice told" for i in range(9)) and got[80] == got[81] == ""


def bare(page):
    """The page with every element that names a purpose as div, without attributes."""
    page = re.sub(r"<(/?)(?:article|main|header|footer|nav|aside|section)\b", r"<\1div", page)
    return re.sub(r"<(\w+)\s[^>]*>", r"<\1>", page)


def test_regions_of_unmarked_pages(spark):
    """Slots that vary in side regions go, on pages of nothing but divisions; titles and introductions stay."""
    def page(i):
        r = random.Random(i)
        menu = "".join(f'<li><a href="/{k}">{words(i * 7 + k)[:12]}</a></li>' for k in range(r.randint(2, 6)))
        parts = "".join(f"<p>{words(1000 + 10 * i + k)}</p>" for k in range(r.randint(1, 5)))
        inner = {0: f"<h1>Title {i}</h1>{parts}", 1: f"<header><h1>Title {i}</h1><p>By {i}</p></header><div>{parts}</div>", 2: f"<p>Intro {i}</p><div>{parts}</div>"}[i % 3]
        text = {0: f"Title {i}", 1: f"Title {i}\nBy {i}", 2: f"Intro {i}"}[i % 3] + "\n" + re.sub("</p><p>", "\n", parts)[3:-4]
        return f'<body><nav><ul>{menu}</ul></nav><div class="ad">{words(i + 5000)[:40]}</div><article>{inner}</article><aside><h3>{words(i + 6000)[:20]}</h3><p>{words(i + 7000)[:30]}</p></aside><footer>Host {words(i + 8000)[:9]}</footer></body>', text

    pages = [(i, f"http://h{i % 3}.org/{i}", *page(i)) for i in range(60)]
    for change in (str, bare):
        df = spark.createDataFrame([(i, u, change(h)) for i, u, h, _ in pages], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
        assert got == {i: t for i, _, _, t in pages}
    assert all(H.extract(bare(h)) != t for _, _, h, t in pages)


def test_teasers_and_forms(spark):
    """An article beside shorter ones of another place, and pages wrapped in a form."""
    teaser = lambda i: f"<body><div><article><h1>T {i}</h1><p>{words(i)}</p></article></div><div><article><h2>More {i}</h2><p>{words(i + 300)[:30]}</p></article></div>"
    form = lambda i: f"<body><form><div>{words(i + 500)[:20]} {i}</div><div><h1>F {i}</h1><p>{words(i + 400)}</p></div></form>"
    pages = [(i, "http://a.org/", teaser(i)) for i in range(8)] + [(20 + i, "http://b.org/", form(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T {i}\n{words(i)}" and got[20 + i] == f"F {i}\n{words(400 + i)}" for i in range(8))


def test_references_joined_by_host(spark, monkeypatch):
    """Beyond the broadcast bound the result is the same."""
    pages = [(i, f"http://h{i % 3 and 1}/{i}", f"<body><div>Head line</div><p>{words(i)}</p>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in H.extract_pages(df).collect())
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in H.extract_pages(df).collect()) == want and all("Head" not in r[2] for r in want)
