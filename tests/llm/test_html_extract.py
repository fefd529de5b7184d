import html as references
import re

import duckdb
import pytest
from lakelens.llm import html_extract as hx

SCHEMA = "page_id bigint, url string, html string, text string, n_chars int"
FOLDER = "/root/testdata/sf0.01"


def plain(html):
    """The text of a page whose content is one article element without other parts, by splitting its markup."""
    inside = html[html.index("<article>") + 9 : html.index("</article>")]
    blocks = [references.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", inside)]
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def test_all_given_pages(spark):
    got = {r["page_id"]: r for r in hx.extract(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()}
    given = duckdb.sql(f"SELECT page_id, url, html FROM '{FOLDER}/pages.parquet'").fetchall()
    assert len(got) == len(given) > 100
    assert all((got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (u, plain(h), len(plain(h))) for i, u, h in given)


WRITTEN = {
    "blog": (
        """<html><head><title>T</title></head><body class="home"><div id="wrapper"><div class="site-header"><a href="/">My Blog</a><p>Thoughts and more.</p></div>
        <div id="cookieConsent">We use cookies. <a href="/p">More</a> <button>OK</button></div>
        <div class="post-content"><h1>A Title</h1><p>First words of it &amp; more,<br>next line.</p><div class="ad-wrapper">Buy our things today, they are good.</div>
        <p>Of.</p><ul><li>one</li><li><a href="/x">two</a></li></ul><blockquote>Quoted.</blockquote></div>
        <div class="sidebar-right"><h3>Related</h3><ul><li><a href="/1">Other post</a></li></ul></div>
        <div id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I liked reading all of this, thank you so much for it.</p></div></div>
        <div id="footer">&copy; 2024 My Blog. All rights reserved.</div></div></body></html>""",
        "A Title First words of it & more, next line. Of. one two Quoted.",
    ),
    "news": (
        """<body><header><nav><a href=/a>World</a><a href=/b>Sport</a></nav></header><main><article><header><h1>Storm hits</h1></header>
        <p>Rain fell <a href="/r">all night</a> in the north.</p><aside><h4>See also</h4><a href=/z>Old storm</a></aside><figure><img src=x><figcaption>The harbour.</figcaption></figure>
        <form action=/s><label>Mail</label><input><button>Join</button></form><p>More follows<p>later on.</article>
        <section class="reader-comments"><article><p>What a night that was for everybody here.</p></article></section></main><footer><p>Imprint and contact.</p></footer>""",
        "Storm hits Rain fell all night in the north. The harbour. More follows later on.",
    ),
    "unclosed": (
        """<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head</h1><p>Some text here.<p><b>Bold text<br>goes on.<footer>&copy; host &middot; Words of the footer.</footer></body>""",
        "Head Some text here. Bold text goes on.",
    ),
    "bare": ("Just   a line\n of text &lt;3", "Just a line of text <3"),
    "paragraphs": ("<p>One.</p><p>Two &eacute;&#8217;s <i>in</i>line</p>", "One. Two é’s inline"),
    "nothing": ("<html><head><script>var a='<p>x</p>';</script></head><body><nav><a href=/>Home</a></nav></body></html>", ""),
    "broken": ("<article><p>Kept &am < 3 text <!-- gone --> here<p>and <a href='", "Kept &am < 3 text here and"),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_written_pages(name):
    html, want = WRITTEN[name]
    assert hx.default_model().text(hx.parse(html)) == want


def test_held_out_layouts():
    model, wrong, n = hx.default_model(), 0, 0
    for html in hx.labelled_pages(200, seed=5):
        page = hx.parse(html)
        chance, _ = model.beliefs(page)
        told = [i for i in {i for block in page.blocks for i, t in block if t.strip()}]
        wrong, n = wrong + sum((chance[i] >= 0.5) != page.label[i] for i in told), n + len(told)
    assert n > 2000 and wrong <= 0.005 * n


def test_marginals_equal_enumeration():
    page = hx.parse("<article data-main=1><h1>a</h1><div class=ad>b<p>c</div></article><footer>d</footer>")
    model = hx.fit(hx.labelled_pages(20), rounds=1)
    own, pair = model.potentials(page)
    n = len(own)
    import itertools
    import math

    total, each = 0.0, [0.0] * n
    for states in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(u for u, s in zip(own, states, strict=True) if s) + sum(pair[i][2 * states[page.parent[i]] + states[i]] for i in range(1, n)))
        total += w
        each = [e + w * s for e, s in zip(each, states, strict=True)]
    assert n == 6 and all(abs(e / total - q) < 1e-9 for e, q in zip(each, model.beliefs(page)[0], strict=True))


def test_defined_results(spark):
    deep = "<div>" * 30_000 + "<p>low</p>"
    rows = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (None, "u", "<p>a</p>", "x", 1), (3, "v", "<article>" + "<p>word word.</p>" * 20_000 + "</article>", "x", 1), (3, "v", "<p>a</p>", "x", 1), (4, "w", deep, "x", 1), (5, "w", '<a x="' * 20_000 + "<" * 50_000, "x", 1)]
    got = hx.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    by = sorted(((r["page_id"], r["url"], r["text"][:20], r["n_chars"]) for r in got if r["page_id"] not in (4, 5)), key=str)
    assert len(got) == 7
    assert by == sorted([(1, None, "", 0), (2, "u", "", 0), (None, "u", "a", 1), (3, "v", "word word. word word", 220_000 + 20_000 - 20_001), (3, "v", "a", 1)], key=str)
    assert hx.extract(spark.createDataFrame([], SCHEMA)).collect() == []
