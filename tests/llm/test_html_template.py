import random
import time

import pytest

from verdikt.llm import html_template as h

PAGES = "page_id long, url string, html string, host string, main string, texts string"


def page(body):
    return f'<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body>{body}</body></html>'


CASES = [
    (page("<nav><ul><li>Home</li></ul></nav><article><h1>Title &amp; more</h1><p>One\n two&nbsp;<b>bold</b>text<br>next</p><p>Second</article><footer>foot</footer>"), "Title & more\n\nOne two boldtext next\n\nSecond"),
    (page("<article><p>a<p>b<div class='ad'>buy</div><aside>side</aside><form><p>mail</p></form><p>c</p></article>"), "a\n\nb\n\nc"),
    (page("<article><p>text</p><section id='comments'><article><p>reader</p></article></section></article>"), "text"),
    (page("<div class='cookie-notice'>We use cookies</div><main><h2>H</h2><ul><li>x<li>y</ul></main><div id=\"sidebar\">s</div>"), "H\n\nx\n\ny"),
    (page("<article><header><h1>Kept</h1></header><p>3 < 4 &lt;b&gt; &#233;&eacute; a<!-- no <p>no</p> -->b</p><script>no</script></article>"), "Kept\n\n3 < 4 <b> éé ab"),
    (page("<article><table><tr><td>1<td>2<tr><td>3</table><pre>a\n  b</pre>tail"), "1\n\n2\n\n3\n\na b\n\ntail"),
    (page("<header>top</header><p>no article</p><p hidden>gone</p><div role=navigation>menu</div>"), "no article"),
    (page("<article class='post share-enabled'><p>kept</p><div class='alert'>gone</div></article><article class='teaser'><p>other</p></article>"), "kept"),
    ("plain words only", "plain words only"),
    ("<p>open <!-- never closed <p>x", "open"),
    ("<article><p>a<script>never closed", "a"),
    ("<p title='a > b'>quoted</p><p title=\"broken>stray", "quoted\n\nstray"),
    ("", ""),
    ("<html></html>", ""),
    ("<article><p> \n </p></article>", ""),
]


@pytest.mark.parametrize("html, want", CASES)
def test_main_text(html, want):
    assert h.main_text(html, None, set()) == want


def plain(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def template_host(n, host="http://site.example/"):
    """Pages without article elements: a story between texts that repeat."""
    rows = []
    for i in range(n):
        story = "".join(f"<p>Story {i} part {k} with some words of its own.</p>" for k in range(3 + i % 3))
        body = f"<div class=top>Site name</div><div class=wrap><div class=left>Latest: item {i}</div><div class=story>Share this story{story}</div></div><div class=end>Imprint of the site</div>"
        rows.append((i, f"{host}{i}", page(body)))
    return rows


def test_template_of_a_host_is_deduced(spark):
    rows = template_host(12)
    got = {r["_row"]["page_id"]: r["text"] for r in h.extract_text(plain(spark, rows)).collect()}
    for i in range(12):
        assert got[i] == "\n\n".join(f"Story {i} part {k} with some words of its own." for k in range(3 + i % 3))


def test_distributed_template_equals_brute_force(spark):
    """The occurrence vectors as such, instead of their hashes."""
    rows = template_host(9) + [(50 + i, "http://site.example/z", template_host(9)[0][2]) for i in range(30)] + template_host(3, "http://small.example/")
    got = {r["host"]: (r["main"], r["texts"]) for r in h.templates(plain(spark, rows).select(h.host_of(h.col("url")).alias("host"), "html")).collect()}
    pages = sorted({r[2] for r in rows if "site" in r[1]})
    tokens = [h.page_tokens(p) for p in pages]
    vectors = {t: tuple(x.get(t, [0])[0] for x in tokens) for x in tokens for t in x}
    number = {v: i for i, v in enumerate(sorted(set(vectors.values())))}
    frequent = []
    for t, v in vectors.items():
        own = [x[t] for x in tokens if t in x]
        if len(own) >= h.LEAST_PAGES and 2 * len(own) >= len(pages):
            frequent.append((t, number[v], len(own), sum(o[1] for o in own) / len(own), sum(o[2] for o in own)))
    assert got == {"site.example": h.deduce(frequent)}
    assert got["site.example"][0].endswith("div.story") and len(got["site.example"][1]) == 3


def test_article_text_that_repeats_is_kept(spark):
    rows = [(i, "http://a.example/x", page(f"<article><h1>Same head</h1><p>Released under a license.</p><p>own {i}</p></article>")) for i in range(10)]
    got = {r["_row"]["page_id"]: r["text"] for r in h.extract_text(plain(spark, rows)).collect()}
    assert got == {i: f"Same head\n\nReleased under a license.\n\nown {i}" for i in range(10)}


def test_template_decides_on_pages_with_articles(spark):
    """The host's text lies in div.story; its article is a teaser, elsewhere."""
    rows = [(i, url, html.replace("<div class=end>", f"<article><h2>Offer {i}</h2><p>Now cheaper</p></article><div class=end>")) for i, url, html in template_host(12)]
    got = {r["_row"]["page_id"]: r["text"] for r in h.extract_text(plain(spark, rows)).collect()}
    assert got == {i: "\n\n".join(f"Story {i} part {k} with some words of its own." for k in range(3 + i % 3)) for i in range(12)}
    # Around or inside the main container the article gives its bounds.
    body = "/html/body"
    html = page("<article><h1>Head</h1><div class=story><p>Text</p></div></article><article><p>next</p></article><p>end</p>")
    assert h.main_text(html, f"{body}/article/div.story", set()) == "Head\n\nText\n\nnext"
    assert h.main_text(html, body, set()) == "Head\n\nText\n\nnext"
    assert h.main_text(html, f"{body}/div.gone", set()) == "Head\n\nText\n\nnext"


SUBJECTS = [
    ('<section id="related-work"><h2 id="notice">Related</h2><p>Others did</p></section>', "Related\n\nOthers did"),
    ('<h2 id="social-history">Social history</h2><p id="copyright-law">The law</p>', "Social history\n\nThe law"),
    ('<div class="menu-recipes"><p>Soup first</p></div><div class="share-price">12</div>', "Soup first\n\n12"),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", "Let x=1 be"),
]


@pytest.mark.parametrize("html, want", SUBJECTS)
def test_names_of_subjects_in_an_article_are_no_boilerplate(html, want):
    html = page(f"<article><p>a</p>{html}</article>")
    for frames in (None, {"/html/body/article"}):
        assert h.main_text(html, "/html/body/article", set(), frames) == f"a\n\n{want}"


def test_repetition_confirms_boilerplate_in_an_article(spark):
    def story(i):
        once = "<div class=notice><p>On page 3 the ministry gave notice.</p></div><aside>A side remark.</aside>" * (i == 3)
        return f"<article><h1>Story {i}</h1><div class=share>Send {i}</div><div class=social-links><p>Follow us</p></div><p>Own text {i}.</p>{once}<p class=copyright>All rights reserved</p></article>"

    rows = [(i, f"http://a.example/{i}", page(story(i))) for i in range(8)]
    got = {r["_row"]["page_id"]: r["text"] for r in h.extract_text(plain(spark, rows)).collect()}
    assert got == {i: f"Story {i}\n\nOwn text {i}." + "\n\nOn page 3 the ministry gave notice.\n\nA side remark." * (i == 3) for i in range(8)}


def test_awkward_rows_and_empty_table(spark):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "not a url", "<p>x"), (3, "http://u@h.example:80/p", "<p>" + "long words " * 50_000), (4, "http://h.example", "\x00<p>\x00")]
    df = plain(spark, rows)
    x = h.extract_text(df)
    got = sorted(((r["_row"]["page_id"] or 0, len(r["text"])) for r in x.collect()))
    assert got == [(0, 0), (1, 0), (1, 0), (2, 1), (3, 549_999), (4, 4)] and x.select("_row.*").columns == df.columns
    assert h.extract_text(plain(spark, [])).count() == 0


def test_deep_nesting_takes_linear_time_and_bounded_paths():
    n = 30_000
    page = "<html><body>" + '<div class="story">' * n + "deep text" + "</div>" * n + "<div>after</div>" + "</ul>" * n
    began = time.monotonic()
    tokens = h.page_tokens(page)
    assert h.main_text(page, "/html/body", set()) == "deep text\n\nafter"
    assert h.main_text("<div>" * n + "<tr>a</tr></li>" * n, None, set()).count("a") == n
    assert time.monotonic() - began < 30
    # Containers are told apart, two pages alike name them alike, and all lie in those above.
    assert len(tokens) == n + 5 and max(map(len, tokens)) <= h.LONG_PATH + 40
    again = h.page_tokens(page.replace("deep text", "other words"))
    assert len(tokens.keys() & again.keys()) == n + 4
    top = "/html/body" + "/div.story" * 50
    assert all(t.startswith((top, "/html/body/div")) for t in tokens if t.count("/") > 60)


def test_long_classes_are_hashed_and_told_apart():
    page = "".join(f"<div class='{'utility-' * 200}{i}'>text {i}</div>" for i in range(3))
    found = [b for b in h.blocks(page) if not b.text]
    assert len({b.path for b in found}) == 3 and max(len(b.path) for b in found) < 30
    assert h.main_text(page, None, set()) == "text 0\n\ntext 1\n\ntext 2"


def test_main_container_equals_brute_force():
    r = random.Random(5)
    for _ in range(300):
        paths = {"/html"}
        for _ in range(r.randrange(1, 30)):
            paths.add(f"{r.choice(sorted(paths))}/{r.choice(['div', 'div.a', 'p'])}")
        tokens = [(p, 1, 4, 0.0, r.randrange(5) * 10) for p in paths]
        total = sum(t[4] for t in tokens)
        held = {q: sum(t[4] for t in tokens if t[0] == q or t[0].startswith(q + "/")) for q in paths}
        good = [q for q in paths if total and held[q] >= h.MAIN_SHARE * total]
        assert h.main_container(tokens, paths) == max(good, key=lambda q: (q.count("/"), q), default=None)
