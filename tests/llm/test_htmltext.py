import html
import random
import re
import time

from utterlake.llm import htmltext as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy</div>
{body}<aside>More</aside><div id="comments"><p>First!</p></div><form><p>Your mail</p></form><footer>&copy; us</footer></body></html>"""
ARTICLE = "<article><h1>Title {k}</h1><p><b>One &amp; two<br>three<p>four\n  {k}<ul><li>five</ul></article>"
WANT = "Title {k}\n\nOne & two three\n\nfour {k}\n\nfive"


def pages(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "root", "texts", "token", "page"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3, "page_id")


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


NO_TEMPLATE = (set(), set(), set())


def run(spark, rows):
    return {x.page_id: x.text for x in H.extract(pages(spark, rows)).collect()}


def test_pages_with_an_article(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(body=ARTICLE.format(k=k))) for k in range(8)]
    rows += [(200, "http://c.example/", PAGE.format(body=ARTICLE.format(k=9))), (201, None, PAGE.format(body=ARTICLE.format(k=9))), (202, "http://a.example/n", None), (203, "http://a.example/e", ""), (204, "http://a.example/t", "plain & text"), (204, "http://a.example/t", "plain & text"), (None, None, "<p>x")]
    out = [(r.page_id, r.text, r.n_chars) for r in H.extract(pages(spark, rows)).collect()]
    got = {i: t for i, t, _ in out}
    assert len(out) == len(rows) and all(n == len(t) for _, t, n in out)
    assert all(got[k] == WANT.format(k=k) for k in range(8))
    assert got[200] == got[201] == WANT.format(k=9)
    assert got[202] == got[203] == "" and got[204] == "plain & text" and got[None] == "x"


SOUP = """<html><body><div class="{a}"><h1>Daily Site</h1><div>Welcome back</div></div><div class="{b}"><div>{teaser}</div></div>
<div class="{c}"><h1>{title}</h1><div class="{d}">{one}<div class="{e}">Share this with friends</div><p>{two}</p></div><div class="{f}"><a href="/1">{l1}</a> <a href="/2">{l2}</a></div></div><div class="{g}">All rights are with us</div></body></html>"""


def soup(r, rotate):
    names = {k: "".join(r.choice("abcdefghij") for _ in range(6)) if rotate else f"z{k}" for k in "abcdefg"}
    parts = {"title": words(r, 5), "one": words(r, 60), "two": words(r, 40), "teaser": words(r, 6), "l1": words(r, 4), "l2": words(r, 4)}
    return SOUP.format(**names, **parts), parts


def test_div_soup_is_decided_by_the_template(spark):
    r = random.Random(1)
    rows, want = [], {}
    for host in range(4):
        for k in range(12):
            page, parts = soup(r, rotate=host % 2 == 1)
            rows.append((host * 100 + k, f"https://h{host}.example/{k}", page))
            want[host * 100 + k] = f"{parts['title']}\n\n{parts['one']}\n\n{parts['two']}"
    got = run(spark, rows)
    assert got == want
    # the same pages read alone, without their host's template, keep the site's own text
    assert all("Daily Site" in H.slot_text(page, *NO_TEMPLATE) and H.slot_text(page, *NO_TEMPLATE) != want[i] for i, _, page in rows)


def test_two_layouts_of_one_host(spark):
    r = random.Random(2)
    rows, want = [], {}
    for k in range(12):
        page, parts = soup(r, rotate=False)
        rows.append((k, f"https://mixed.example/{k}", page))
        want[k] = f"{parts['title']}\n\n{parts['one']}\n\n{parts['two']}"
        body = words(r, 50)
        rows.append((100 + k, f"https://mixed.example/o{k}", f"<body><div id='top'>{words(r, 3)}</div><div id='story'><h2>{k} news</h2>{body}</div><div id='disclaimer'>No advice</div></body>"))
        want[100 + k] = f"{k} news\n\n{body}"
    assert run(spark, rows) == want


def test_comments_and_copies(spark):
    """Class words count where the template confirms them; a host of copies keeps its text."""
    r = random.Random(3)
    rows, want = [], {}
    for k in range(12):
        body = words(r, 50)
        own = "<section class='comments-explained'><p>About comments</p></section>" if k == 5 else ""
        rows.append((k, f"https://c.example/{k}", f"<body><article><h1>{k} title</h1><p>{body}</p>{own}<section class='reader-comments'><p>{words(r, 9)}</p></section></article></body>"))
        want[k] = f"{k} title\n\n{body}" + ("\n\nAbout comments" if own else "")
    same = words(r, 50)
    for k in range(12):
        rows.append((100 + k, f"https://copies.example/{k}", f"<body><div class='ad'>{words(r, 4)}</div><article><h1>One title</h1><p>{same}</p></article></body>"))
        want[100 + k] = f"One title\n\n{same}"
    assert run(spark, rows) == want


def test_classes_nest_in_slots():
    """A frame without its parent in the template nests nowhere, and a text must stand in a frame of its class."""
    f = lambda token, parent, vector, chars, **k: H.Frame(token, parent, vector, 10, 1, chars, k.get("links", 0), k.get("heads", 0), 1000, 20, k.get("name", "div"), k.get("classed", True), False, False)
    tree = [f(1, 0, 7, 1000, heads=20, name="body"), f(2, 1, 7, 900, heads=20), f(3, 2, 8, 100, links=90), f(4, 1, 8, 60), f(5, 99, 7, 950, heads=20), f(6, 2, 8, 300)]
    t = lambda token, vector, parent: H.Text(token, vector, 50, 0, parent, 0)
    assert H.deduce(tree, [], [t(70, 7, 2), t(80, 6, 2), t(90, 8, 6), t(91, 8, 2)], 10, 10) == ([2], [3], [70, 90])
    assert H.deduce(tree, [], [t(70, 7, 2)], 9, 10)[2] == []


def test_markup_that_is_broken_or_deep():
    read = lambda t: H.slot_text(t, *NO_TEMPLATE)
    assert read("<p title=it's>Hello") == "Hello" and read("<p title='a>b' x=\">\">Hello</p>") == "Hello"
    assert read("<script/>a</script>b") == "b" and read("<!--->a<!-- b") == "a"
    assert read("<math><mi>x</mi></math> y<noscript> z</noscript>") == "x y z"
    assert read("<<<") == "<<<" and read("<p") == ""
    began = time.perf_counter()
    for t in ("<tr><td>x" * 50_000, "<div>" * 50_000 + "x", "<div></ul>" * 50_000, "<p a=\"x" * 50_000, "<li>a" * 50_000):
        H.slot_text(t, *NO_TEMPLATE)
        H.page_tokens(t)
    assert time.perf_counter() - began < 60


def test_boilerplate_inside_and_around_an_article():
    page = """<div class="site-header">Logo</div><p class="ad">Buy</p><main><article><header><h1>Title</h1></header><p>Body
    text</p><p class="advert">Buy more</p><aside>See</aside><section class="reader-comments"><p>First</p></section><footer>Share</footer></article></main><div class="cookie">ok?</div>"""
    assert H.slot_text(page, *NO_TEMPLATE) == "Title\n\nBody text"
    assert H.slot_text("<div class='gdpr'>x</div><p>a<p>b &lt;c&gt;<div>d<script>e</script></div>", *NO_TEMPLATE) == "a\n\nb <c>\n\nd"


def test_templates_that_are_not_broadcast(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(body=ARTICLE.format(k=k))) for k in range(8)]
    got = {x.page_id: x.text for x in H.extract(pages(spark, rows), most_bytes=0, salts=3).collect()}
    assert got == {k: WANT.format(k=k) for k in range(8)}


def test_article_of_every_given_page(spark):
    """Held against a plain reading of these pages: what their one article element holds."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"<h1>|</h1>|<p>|</p>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in want if b)


def test_empty_table(spark):
    assert H.extract(pages(spark, [(1, "u", "x")]).limit(0)).collect() == []
