"""Extraction against the text that a generator put into the pages."""

from __future__ import annotations

import html
import random
import time

from rostrum.llm import html_extract

SCHEMA = "page_id long, url string, html string, text string"


def page(rng, i, tag="article", words=60):
    w = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    title, blocks = w(4), [w(rng.randrange(3, words)) + " & <b> “q”" for _ in range(rng.randrange(1, 6))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{html.escape(b)}" + rng.choice(["</p>", ""]) for b in blocks)
    around = f'<div class="cookie-notice">accept {w(3)}</div><aside>{w(9)}</aside><form><p>{w(3)}</p><input></form>'
    source = (
        f'<!DOCTYPE html><html><head><title>{w(3)}</title><style>p{{}}</style><script>var a="</p>{i}";</script></head><body><header>{w(2)}</header><nav><ul>'
        + "".join(f"<li><a href=/{k}>{w(1)}</a>" for k in range(rng.randrange(2, 9)))
        + f'</ul></nav><!-- ad {i} --><div class="ad">{w(5)}</div><{tag}>{body}{around}<section id="comments"><p>{w(8)}</p></section></{tag}>'
        + f"<footer>&copy; {w(4)}</footer>"
        + rng.choice(["</body></html>", ""])
    )
    return source, "\n".join([title, *blocks])


def run(spark, rows):
    got = html_extract.extract(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3))
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    return {r.page_id: r for r in got.collect()}


def test_articles_and_plain_containers(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for i in range(90):
        host = ("a.example", "b.example", "c.example")[0 if i < 60 else 1 + i % 2]
        source, text = page(rng, i, "article" if host != "c.example" else "div")
        rows.append((i, f"https://{host}/{i}", source))
        want[i] = text
    got = run(spark, rows)
    assert {i: got[i].text for i in want} == want
    assert all(got[i].n_chars == len(want[i]) for i in want)


def test_odd_pages(spark):
    long = "word " * 40_000
    rows = [
        (1, None, None),
        (2, "http://x/", ""),
        (3, "not a url", "<p>only &amp; text&nbsp;here\n\n  <b>bold</b>tail<br>next<p>second"),
        (4, "http://x/1", f"<body><article><p>{long}</p></article></body>"),
        (5, "http://x/2", "<article>a</article><article>b</article>"),
        (6, "http://x/3", "<script>x"),
        (7, "http://x/4", "1 < 2 <p"),
        (None, "http://x/5", "<article>null id</article>"),
    ]
    got = run(spark, rows)
    assert [got[i].text for i in (1, 2, 6)] == ["", "", ""]
    assert got[3].text == "only & text here boldtail next\nsecond"
    assert got[4].text == long.strip() and got[5].text == "a\nb" and got[None].text == "null id"
    assert got[7].text.startswith("1 < 2")
    assert run(spark, []) == {}


def test_a_whole_host_of_copies_keeps_its_article(spark):
    source, text = page(random.Random(5), 0)
    got = run(spark, [(i, "http://same/", source) for i in range(20)])
    assert all(r.text == text for r in got.values())


def test_an_empty_and_a_differing_page_leave_the_template(spark):
    rng = random.Random(8)
    w = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows, want = [(900, "http://d/e", ""), (901, "http://d/n", None)], {900: "", 901: ""}
    for i in range(12):
        want[i] = w(60)
        rows.append((i, f"http://d/{i}", f"<html><body><div class=top>{w(3)}</div><div class=mid><p>{want[i]}</p></div><div class=end>{w(3)}</div></body></html>"))
    for i in range(100, 104):  # another layout
        want[i] = w(60)
        rows.append((i, f"http://d/{i}", f"<html><body><div class=strip>{w(3)}</div><main><p>{want[i]}</p></main></body></html>"))
    want[200] = "One of a kind."  # a layout that no other page has
    rows.append((200, "http://d/200", f"<html><body><div class=odd>{w(3)}</div><article>{want[200]}</article></body></html>"))
    got = run(spark, rows)
    assert {i: got[i].text for i in want} == want


def test_nested_classes_of_links_and_of_the_same_words_go(spark):
    rng = random.Random(9)
    w = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        first, second = w(40), w(40)
        menu = "<div class=x1>" + "".join(f"<a href=/{k}>{w(1)}</a> " for k in range(3)) + "</div>"
        own = f"<ul><li><a href=/>{w(2)}</a></ul>" if i == 7 else ""  # one page's own list of links
        some = menu if i % 3 else ""
        rows.append((i, f"http://n/{i}", f"<html><body><article>{menu}<p>{first}</p>{own}<p>Read us <i>daily</i>.</p>{menu}<p>{second}</p><section class=x2>{some}</section></article></body></html>"))
        want[i] = "\n".join([first, *([own.split("/>")[1].split("<")[0]] if own else []), second])
    got = run(spark, rows)
    assert {i: got[i].text for i in want} == want


def test_names_made_from_titles_keep_their_text(spark):
    rng = random.Random(10)
    w = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        a, b, c, d, e = (w(20) for _ in range(5))
        ad = f'<div class="ad">{w(4)}</div><div class="related-posts"><b>{w(1)}</b> ' + "".join(f"<a href=/{k}>{w(2)}</a>" for k in range(4)) + "</div>"
        own = f'<section id="social-impact"><h2 id="share">{a}</h2><p id="ads">{b}</p></section><div id="related-work">{c}</div><div class="promotion-of-growth">{d}</div>'
        rows.append((i, f"http://{'t' if i else 'alone'}/{i}", f"<html><body><nav>{w(3)}</nav><article>{own if i % 4 == 0 else ''}<p>{e}</p>{ad if i else ''}<section id=comments>{w(5) if i else ''}</section></article></body></html>"))
        want[i] = "\n".join([a, b, c, d, e] if i % 4 == 0 else [e])
    got = run(spark, rows)
    assert {i: got[i].text for i in want} == want


def test_values_that_say_hidden_hide_nothing(spark):
    source = '<html><body><article><p title="a hidden cost of x">One.</p><p data-note=\'partly hidden by\'>Two.</p><p hidden>Three.</p><p HIDDEN="">Four.</p><p class="lead related">Five.</p></article></body></html>'
    got = run(spark, [(1, "http://one/", source)])
    assert got[1].text == "One.\nTwo.\nFive."


def test_a_form_around_the_page_and_what_was_left_open(spark):
    text = "The words of the article are here."
    rows = [
        (1, "http://f1/", f'<body><form id="aspnetForm"><nav>menu</nav><article><p>{text}</p></article><footer>end</footer></form></body>'),
        (2, "http://f2/", f"<body><nav><ul><li><a href=/>menu</a></ul><article><p>{text}</p></article></body>"),
        (3, "http://f3/", f"<body><aside>side<main><p>{text}</p></main></body>"),
        (4, "http://f4/", f'<body><form action="/page"><div class=top>x</div><div class=mid><p>{text}</p></div></form></body>'),
        (5, "http://f5/", f"<body><article><p>{text}</p><form><p>your mail</p></form></article></body>"),
        (6, "http://f6/", f"<body><aside><article>teaser</article></aside><main><p>{text}</p></main></body>"),
        (7, "http://f7/", f"<body><header>top<nav>menu</nav><form><input></form><article><p>{text}</p></article></body>"),
    ]
    got = run(spark, rows)
    assert {i: got[i].text for i in (1, 2, 3, 5, 6, 7)} == dict.fromkeys((1, 2, 3, 5, 6, 7), text)
    assert text in got[4].text


def test_time_is_linear_in_the_page():
    """A megabyte of each kind of broken markup, read in seconds."""
    n = 1 << 20
    hostile = ["<a ", "<a<", '<a href="x', "<a href='x", "<a \"'", "<!x ", "</a ", "<script ", "<i>", "<i></b>", "<!--", "<td></td>", "<hr>", "<p>", "</p>", "<li>", '"', "<", "&amp", "<article>", "<form>", "<style>"]
    pages = [x * (n // len(x)) for x in hostile]
    pages += ["<i>" * (n // 8) + "</b>" * (n // 8), "<table><td><table>" + "<i>" * (n // 10) + "<td></td>" * (n // 12), "<i>" * (n // 8) + "<hr>" * (n // 8), '<a b="' + "<a b='" * (n // 8), "<div " + " " * n + "x" * n]
    for source in pages:
        began = time.process_time()
        html_extract._Page(source).text([], set(), set())
        assert time.process_time() - began < 12, source[:20]
