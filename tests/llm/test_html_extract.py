import duckdb

from fleetspark.llm import html_extract as H
from fleetspark.llm.html_extract import extract, main_text


def test_pages():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/a'>Home, sweet home.</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies, as all do, and so on.</div><div id=main><h2>Title&nbsp;&amp; more</h2><p>First <b>para</b>graph, with   some\ntext; and more of it.<p>Second one, with a <a href=x>link</a>, goes on for a while.</p>"
        "<script>var x = '<p>no</p>';</script><!-- <p>no</p> --><ul><li>A point, made.<li>Another point, made too.</ul></div><aside>Aside, with text that is long enough to matter.</aside>"
        "<div class='comments'><p>I, too, have read this long text, and I liked it a lot.</p></div><form><p>Name, please, and address.</p></form><footer>&copy; me, myself.</footer></body></html>"
    )
    assert main_text(page) == "Title & more First paragraph, with some text; and more of it. Second one, with a link, goes on for a while. A point, made. Another point, made too."
    assert main_text("") == main_text(None) == main_text("<p></p>") == main_text("<!--") == ""
    assert main_text("<") == "<"
    assert main_text("plain &lt;text&gt; &#233;&#x41; &am") == "plain <text> éA &am"
    assert main_text("<article><p>To.</p></article><footer>Much longer text here, and more.</footer>") == "To."
    assert main_text("<p>" * 3000 + "deep") == "deep"
    assert main_text("<div>" * 1500 + "deep, too") == "deep, too"


def test_table(spark):
    rows = [(1, "u", "<p>x y</p>", "k"), (1, "u", "<p>x y</p>", "k"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract(df).collect()) == [("1", "x y", 3), ("1", "x y", 3), ("None", "", 0)]
    assert extract(df.limit(0)).collect() == []


def test_synthetic_pages():
    import os
    import re
    from html import unescape

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        return
    for (html,) in duckdb.sql(f"SELECT html FROM '{path}'").fetchall():
        body = html[html.find("<article>") + 9 :].split("</article>")[0]
        assert main_text(html) == " ".join(unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_short_parts_of_an_article():
    long = "A sentence that goes on, as they do, for long. " * 6
    parts = "<ul><li>twenty plain letters<li>ten more</ul><table><caption>Counts</caption><tr><td>one<td>2</table><pre><code>x = 1</code></pre><figure><figcaption>A dog</figcaption></figure>"
    want = f"{long}twenty plain letters ten more Counts one 2 x = 1 A dog"
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "{}"):
        page = f"<body><div class=top><p>Home</div>{around.format(f'<p>{long}</p>{parts}')}</body>"
        assert main_text(page) == want, around
    assert main_text(f"<article><div class=text><p>{long}</div><div class=data>{parts}</div></article>") == want


def test_ids_of_headings_and_sections():
    long = "A sentence that goes on, as they do, for long. " * 6
    page = f"<article><h2 id=search>Search</h2><p>{long}</p><section id='discussion'><h2 id='legal'>Results</h2><p>{long}</p></section><section id=comments><p>{long}</p></section><div id=related>More</div></article>"
    assert main_text(page) == f"Search {long}Results {long}".strip()


LONG = "A sentence that goes on, as they do, for long. " * 6


def test_ratios_against_brute_force():
    """Values of random pages, from the definition, by an own walk over a page of known structure."""
    import random
    from math import isclose, sqrt

    rng = random.Random(9)
    for _ in range(30):
        page, want = [], {}
        for name in ("alpha", "beta", "gamma"):
            for tag in ("p", "h2", "blockquote"):
                for _ in range(rng.randrange(0, 4)):
                    text = " ".join(rng.choice(("word", "end.", "so,", "x")) for _ in range(rng.randrange(1, 40)))
                    page.append((name, tag, text))
        if not page:
            continue
        html = "".join(f'<div class="{name}">' + "".join(f"<{t}>{x}</{t}>" for n, t, x in page if n == name) + "</div>" for name in ("alpha", "beta", "gamma"))
        size = lambda rows: sum(len(x) for *_, x in rows) / len(rows)
        marks = lambda rows: sum(x.count(".") + x.count(",") for *_, x in rows) / len(rows)
        for name, tag in {(n, t) for n, t, _ in page}:
            own, around = [b for b in page if b[:2] == (name, tag)], [b for b in page if b[0] == name]
            share = sum(len(b[2]) for b in around) / sum(len(b[2]) for b in page)
            want[name, tag] = (size(own) + size(around)) / 2 * (1 + (marks(own) + marks(around)) / 2) * sqrt(share)
        paths, found = H.blocks(html)
        got = H.values(paths, found)
        names = {n: key for key, n in paths.number.items()}
        named = {(names[names[p][0]][1].split(".")[1], names[p][1].split(".")[0]): v for p, v in got.items()}
        assert named.keys() == want.keys() and all(isclose(named[k], want[k]) for k in want)
        best = {n: max(v for (m, _), v in want.items() if m == n) for n, _ in want}
        kept = {n for n in best if best[n] >= 0.3 * max(best.values())}
        assert main_text(html, 0.3) == " ".join(x for name in ("alpha", "beta", "gamma") if name in kept for n, t, x in page if n == name)


def test_ratios_decide_without_names():
    page = f"<body><div><a href=a>Home</a> <a href=b>About, us.</a></div><div class=x>Buy now.</div><div class=y><h1>Title</h1><p>{LONG}</p><ul><li>one<li>two</ul></div><div class=z>Call us.</div></body>"
    want = f"Title {LONG}one two"
    assert main_text(page) == want
    assert len(main_text(page, 0)) > len(want)
    assert main_text(page.replace("class=y", "class=article").replace("class=x", "class=ad").replace("class=z", "class=footer")) == want


def test_names_that_weigh_on_the_whole_page():
    text = LONG.strip()
    assert main_text(f'<div class="post tag-news"><p>{LONG}</p></div>') == text
    assert main_text(f'<div class="has-sidebar"><article><p>{LONG}</p></article><div class=sidebar><p>Short one.</div></div>') == text
    assert main_text(f"<form><div><p>{LONG}</p></div><footer>So, the end.</footer></form>") == text
    assert main_text(f'<article><p>{LONG}</article><article class="comment"><p>I liked it, a lot, and more.</article>') == text
    assert main_text(f"<article><div><h1>Hi</h1></div><p>{LONG}</article>") == f"Hi {text}"


def test_broken_markup_and_long_pages():
    import time

    assert main_text(f'<div class="x><p>{LONG}</p></div>') == LONG.strip()
    assert main_text(f"<div title='a > b' data-x=\"<p>\"><p>{LONG}</p></div>") == LONG.strip()
    began = time.perf_counter()
    for piece in ('<a "', "<div>", "<b x='", "<p><b>t", "</script ", "<!--", "<"):
        main_text(piece * 20_000 + "x")
    assert main_text("<div>" * 5000 + "<nav><p>Menu, long and wide.</nav>" + f"<p>{LONG}" * 200) == " ".join([LONG.strip()] * 200)
    assert time.perf_counter() - began < 30
    assert main_text("<nav><p>Menu, long and wide.</nav>") == ""
