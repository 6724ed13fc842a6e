import itertools
import random

import pytest

from textloom.llm import html_extract as h

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><ul><li><a>x</a></ul></header>
<div id="cookie-notice">We use cookies</div><div class="post-content"><h1>Real  title</h1><p>First &lt;para&gt; a&nbsp;b<!-- no --></p><div class="ad">Buy now</div>
<ul><li>item <b>one</b><li>item two</ul><script>var x="</p>";</script><p>Short.</p><form><label>Your mail</label><input></form></div>
<aside>side text that is long enough to look like prose, or so it seems to be</aside><section id="comments"><h2>Comments</h2><p>I agree with this a great deal, a very long comment to be dropped.</p></section>
<footer>&copy; foo</footer></body></html>"""


def test_main_text():
    assert h.main_text(PAGE) == "Real title\nFirst <para> a b\nitem one\nitem two\nShort."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<div", ""), ("<nav>menu</nav>", ""), ("<article><p>a<p>b</article>", "a\nb"), ("<article>1 < 2 &amp; 3</article>", "1 < 2 & 3"),
    ('<article><p title="a > b">x</p></article>', "x"), ("<article><h1>T</h1><p><b>A.<br><p>B</p></article><footer>f</footer>", "T\nA.\nB"), ("<main><p>ok</p><script>never closed", "ok"),
])
def test_pages(html, text):
    assert h.main_text(html) == text


@pytest.mark.parametrize("seed", range(80))
def test_cut_is_of_least_cost(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    benefit = [r.choice([-1, 1]) * r.random() * 2 for _ in range(n)]
    edges = [(i, i + 1, r.random()) for i in range(n - 1)] + [(*r.sample(range(n), 2), r.random()) for _ in range(r.randint(0, n)) if n > 1]
    cost = lambda x: -sum(b for b, k in zip(benefit, x, strict=True) if k) + sum(w for a, b, w in edges if x[a] != x[b])
    assert cost(h.cut(benefit, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_table(spark, small):
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c"), (2, "u", "<p>" * 3000 + "x", "c")], "page_id long, url string, html string, text string")
    out = h.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 3
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert h.extract(pages.limit(0)).count() == 0
    for r in h.extract(spark.read.parquet(f"{small}/pages.parquet")).limit(20).collect():
        assert r["text"] and "track(" not in r["text"] and "©" not in r["text"]


@pytest.mark.parametrize(("inner", "text"), [
    ("<p>a <svg width=1 /> b</p><p>c</p>", "a b\nc"), ("<p>a <math/> b</p><p>c</p>", "a b\nc"), ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "so x=2 holds"),
    *[(f"<p>a <{n} src=x> b</p><p>c</p>", "a b\nc") for n in "iframe object video audio canvas select svg noscript template".split()],
    *[(f"<p>a <{n}>in <p>or <b>so</b></p></{n}> b</p><p>c</p>", "a b\nc") for n in "iframe video canvas".split()],
    ("<p>a<svg><title>t</title><style/><svg><text>no</text></svg><text>no</text></svg></p><p>c</p>", "a\nc"), ("<p>a <select><option>x<option>y</select> b</p>", "a b"),
    ("<p>a <object>lost</p><p>c</p><video></video><p>d</object></p>", "a\nc\nd"),
    ('<p><img alt="5" tall"> b</p><p class="x">c</p>', "b\nc"), ("<p><a don't>b</a></p><p title='x>y'>c</p>", "b\nc"), ('<p>a <img alt="5> b</p><p>c</p>', "a b\nc"), ("<p>I </3 you> b</p><p>c</p>", "I b\nc"),
    ('<p title = "1 > 0">a</p>', "a"), ("<p>" + '<i a="' * 3 + ">b</p>", "b"),
])
def test_nothing_else_is_dropped(inner, text):
    assert h.main_text(f"<article>{inner}</article><footer>f</footer>") == text


@pytest.mark.parametrize(("inner", "text"), [
    ('<p title="hidden gems">A</p><p aria-hidden="false">B</p><p data-id="comment-5">C</p>', "A\nB\nC"), ("<p hidden>A</p><p>B</p>", "B"), ("<p data-hidden=1>A</p>", "A"),
    ("<a href=it's>x</a><p>After</p>", "x\nAfter"), ("<p class=o'neil>x</p><p>y</p>", "x\ny"), ("<p>if a <b then c</p><p>more</p>", "if a <b then c\nmore"),
    ("<p>x<y and y>z</p>", "xz"), ("<p>1 <a", "1 <a"), ("<p>" + "word " * 300_000 + "</p>", " ".join(["word"] * 300_000)),
])
def test_attributes_and_stray_signs(inner, text):
    assert h.main_text(f"<article>{inner}</article><footer>f</footer>").startswith(text)


def paragraphs(n, link_at=None):
    prose = [f"This is sentence {i} of an article. It goes on for a while, as prose does, and then it ends." for i in range(n)]
    return prose, "".join(f"<div><a href=x>{t}</a></div>" if i == link_at else f"<div>{t}</div>" for i, t in enumerate(prose))


def test_the_cut_decides():
    """A paragraph that is one link goes with the article around it, and a label in a list of links with the links."""
    prose, html = paragraphs(7, link_at=3)
    menu = "".join(f"<li><a href=y>Topic number {i}</a></li>" if i != 4 else "<li>Topics by name</li>" for i in range(9))
    found = h.blocks(f"<body><div><ul>{menu}</ul></div><div><div><div>{html}</div></div></div></body>")
    alone = [b.benefit() > 0 for b in found]
    assert h.labels(found) == [False] * 9 + [True] * 7 and alone != h.labels(found)
    assert [b.benefit() > 0 for b in found if b.text in (prose[3], "Topics by name")] != [False, True]


def test_pages_where_cut_and_threshold_differ(spark, small):
    """Real pages, with one paragraph of each made a link and elements that say nothing: the cut is right on all, the threshold isn't."""
    import re

    differ = 0
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        want = h.main_text(r["html"]).split("\n")
        if len(want) < 6:
            continue
        menu = "".join(f"<li><a>{w}</a></li>" for w in re.findall(r"\w+", want[0])[:6])
        inner = "".join(f"<div>{'<a>' * (i == 3)}{t.replace('&', '&amp;').replace('<', '&lt;')}</div>" for i, t in enumerate(want))
        found = h.blocks(f"<body><div><ul>{menu}</ul></div><div><div>{inner}</div></div></body>")
        got = h.labels(found)
        assert [b.text for b, k in zip(found, got, strict=True) if k] == want
        differ += got != [b.benefit() > 0 for b in found]
    assert differ > 10


def test_classifier_is_fitted():
    pages = [f"<nav>{''.join(f'<a>topic {i}</a> ' for i in range(9))}</nav><article>{''.join(f'<p>{t}</p>' for t in paragraphs(5)[0])}</article>"] * 5
    w = h.train([e for p in pages for e in h.examples(p)])
    assert len(w) == len(h.DEFAULT) and w[1] > 0 > w[2]
    assert h.train([]) == h.DEFAULT == h.train(h.examples("<nav>x</nav>"))


def test_edges_weaken_with_distance():
    found = h.blocks("<div><p>a</p><p>b</p></div><div><div><div><p>c</p></div></div></div>")
    w = {(i, j): x for i, j, x in h.edges(found)}
    assert w[0, 1] > w[1, 2] > w[0, 2] and h.hops(found[0].element, found[1].element) == 2


def plain_article(html):
    """What an ordinary parser finds inside the article element, block by block."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.raw, self.blocks, self.now = 0, False, [], []

        def flush(self):
            text = " ".join("".join(self.now).split())
            self.blocks += [text] if text else []
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article", "footer"):
                self.flush()
            self.inside += tag == "article"
            self.raw |= tag in ("script", "style")
            if tag == "br":
                self.now.append(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article"):
                self.flush()
            self.inside -= tag == "article"
            self.raw &= tag not in ("script", "style")

        def handle_data(self, data):
            if self.inside and not self.raw:
                self.now.append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.flush()
    return "\n".join(reader.blocks)


def test_query_equals_a_plain_parser(spark, small):
    from textloom.llm.queries import op8_html_extract

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = op8_html_extract(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


LONG = "This is a paragraph of some length, as articles have them. It goes on for a while, and then it ends."


@pytest.mark.parametrize(("html", "text"), [
    ('<article><h2 class="related">Related work</h2><p class="reply">He made a reply.</p></article>', "Related work\nHe made a reply."),
    ('<article><div class="survey-results"><p>Half of them agreed.</p></div></article>', "Half of them agreed."),
    (f'<article><p>{LONG}</p><div class="survey-results"><p>{LONG}</p></div></article>', f"{LONG}\n{LONG}"),
    (f'<article><p>{LONG}</p></article><article class="comment"><p>I agree with all of it. {LONG}</p></article>', LONG),
    (f'<article class="post"><p>{LONG}</p><article class="comment"><p>I agree. {LONG}</p></article></article>', LONG),
    (f'<article class="post has-ads"><p>{LONG}</p></article>', LONG), (f'<main class="main related"><p>{LONG}</p></main>', LONG),
    (f'<article><p>{LONG}</p><div class="ad-slot"><h3>Offer</h3><p>{LONG}</p></div><p>End.</p></article>', f"{LONG}\nEnd."),
    (f'<article><p>{LONG}</p><section id="comments-list"><p>{LONG}</p><p>{LONG}</p><p>Short.</p></section></article>', LONG),
    (f'<article><p>{LONG}</p><div class="newsletter signup"><p>{LONG}</p></div></article>', LONG),
    (f'<article><p class="social">{LONG}</p><p id="survey">Yes.</p></article>', f"{LONG}\nYes."),
])
def test_names(html, text):
    for weights in (h.DEFAULT, h.train([e for _ in range(30) for e in h.examples(f"<nav><ul><li><a>x</a><li><a>More of it</a></ul></nav><article><h1>T</h1><p>{LONG}</p><p>Yes.</p></article>")])):
        assert h.main_text(f"<body>{html}<footer>f</footer></body>", weights) == text


def test_the_weight_of_names_is_learned():
    """In pages whose articles have such names, the names come to say less."""
    page = f'<nav><a>x</a></nav><article>{"".join(f"<div class=related><p>{LONG}</p></div>" for _ in range(6))}</article>'
    usual = f'<nav class=menu><ul class=menu><li><a>x</a></ul></nav><article><p>{LONG}</p></article>'
    odd, plain = (h.train([e for _ in range(20) for e in h.examples(p)]) for p in (page, usual))
    assert odd[-1] > plain[-1] and plain[-1] < -3


def test_articles_without_markup_among_notices(spark, small):
    """The table's articles without an article element, a line of each in a container with a doubtful name: the cut is right on all, the threshold isn't."""
    differ = 0
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        want = [x for x in plain_article(r["html"]).split("\n") if x]
        if len(want) < 6:
            continue
        inner = "".join(f'<div{" class=\'survey results of note\'" * (i == 3)}>{t.replace("&", "&amp;").replace("<", "&lt;")}</div>' for i, t in enumerate([*want[:3], "So it is", *want[3:]]))
        found = h.blocks(f'<body><nav><a>Menu</a></nav><div class="ad">Buy it now. It is cheap.</div><div><div>{inner}</div></div><footer>f</footer></body>')
        got = h.labels(found)
        assert [b.text for b, k in zip(found, got, strict=True) if k] == [*want[:3], "So it is", *want[3:]]
        differ += got != [b.benefit() > 0 for b in found]
    assert differ > 10
