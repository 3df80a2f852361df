from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import pytest

from docloom.llm import html_extract as H

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav><div class='ad'>Buy</div>@<footer>&copy; me</footer></body></html>"


def page(body):
    return PAGE.replace("@", body)


def test_blocks():
    body = "<article><h1>Head &amp;  Line</h1><p><b>One</b><i>!</i> two<br>three<p>un&lt;closed &#233; &amp<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form>f<input></form><div class='x comments'><p>c</div><aside>s</aside></article>"
    assert H.extract_text(page(body)) == "Head & Line One! two three un<closed é & a b c d"


def test_ids_within_an_article_are_no_hints():
    body = "<article><h2 id='ad-hoc-queries'>a</h2><section id='related-work'>b<p id='notice-3' class='menu-card'>c</p></section><div class='related'>x</div><div role='navigation'>y</div></article>"
    assert H.extract_text(page(body)) == "a b c"


def test_broken_markup():
    for n in range(0, 400, 7):
        H.extract_text(page("<article><p>text</p><!-- x --></article>")[:n])
    assert H.extract_text("") == "" and H.extract_text("plain <") == "plain <"
    assert H.extract_text("<p>a</p></div></b><p>b") == "a b"
    assert H.extract_text("<body><div id=main>x<div role=navigation>y</div></div><div class='cookie-banner'>z</div>") == "x"


def test_slots_by_template(spark):
    """Without any article element, the main slot is found by the classes."""
    form = "<html><body><div class='top'><p>Welcome to the site</p></div><div class='content'><h2>{0}</h2><p>{1}</p>{2}</div><div class='end'><p>All rights</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", form.format(f"Title {k}", f"Body number {k} " + "long words here " * 6, "<p>Once more</p>" if k % 2 else "")) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    assert all(got[k] == " ".join(f"Title {k} Body number {k} {'long words here ' * 6} {'Once more' if k % 2 else ''}".split()) for k in range(20))


def test_text_of_every_container_stays(spark):
    """A page's text may lie beside the container that holds most of the host's."""
    form = "<html><body><div class='top'><p>Welcome to the site</p></div><div class='content'><p>{0}</p></div><div class='more'><p>{1}</p></div></body></html>"
    texts = [(f"Body {k} " + "long words here " * 9, f"And more {k} of this") for k in range(19)] + [("Short", "All the rest of this page is here")]
    df = spark.createDataFrame([(k, "http://h.example/", form.format(*t)) for k, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_main_text(df).collect()}
    assert all(got[k] == " ".join(" ".join(t).split()) for k, t in enumerate(texts))


def test_article_text_stays_though_it_recurs(spark):
    rows = [(k, "https://u@h.example:80/a", page("<article><h1>Same</h1><p>Same text</p></article>")) for k in range(15)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in H.extract_main_text(df).collect()} == {"Same Same text"}


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "http://a/", "", "x"), (2, "http://a/", "", "x"), (None, "no url", "<p>p</p>", None), (3, "http://a/", "<p>" + "w " * 200_000, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = H.extract_main_text(df).collect()
    assert len(found) == 5 and {(r.page_id, r.n_chars) for r in found} == {(1, 0), (2, 0), (None, 1), (3, 399_999)}
    assert H.extract_main_text(df.limit(0)).count() == 0


def form(k, art, layout="q7"):
    """A page whose tags and classes say nothing of what they hold."""
    links = "".join(f"<li><a href='/{k}-{i}'>Link number {i} of {k}</a></li>" for i in range(k % 5 + 2))
    return f"<html><body><div class='zz'><ul>{links}</ul></div><div class='kk'>Buy {k} now</div><div class='{layout}'><h1>{art[0]}</h1>{''.join(f'<p>{x}</p>' for x in art[1:])}<p class=u1>Read on at our place</p></div><div class='ww'>Made by site {k * 7}</div></body></html>"


def articles(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    return [[f"Title {word()} {k}", *(" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(rng.randint(2, 9)))] for k in range(n)]


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.extract_main_text(df).collect()}


def test_the_template_decides_where_tags_and_classes_say_nothing(spark):
    """Menus, adverts, footers and constant text go by the deduced template
    alone; without it each page would keep them."""
    arts = articles(40)
    pages = [form(k, a) for k, a in enumerate(arts)]
    got = extracted(spark, [(k, "http://h.example/", h) for k, h in enumerate(pages)])
    assert got == {k: " ".join(a) for k, a in enumerate(arts)}
    assert all(H.extract_text(h) != got[k] for k, h in enumerate(pages))


def test_two_layouts_of_one_host(spark):
    arts = articles(40, 2)
    got = extracted(spark, [(k, "http://h.example/", form(k, a, "left" if k % 2 else "right")) for k, a in enumerate(arts)])
    assert got == {k: " ".join(a) for k, a in enumerate(arts)}


def test_page_ids_play_no_part(spark):
    arts = articles(30, 3)
    df = spark.createDataFrame([(None if k % 2 else 7, "http://h.example/", form(k, a)) for k, a in enumerate(arts)], "page_id long, url string, html string")
    assert sorted(r.text for r in H.extract_main_text(df).collect()) == sorted(" ".join(a) for a in arts)


def test_classes_equal_explicit_occurrence_vectors(spark):
    pages = [form(k, a, "left" if k % 3 else "right") for k, a in enumerate(articles(25, 4))] + [form(3, ["x", "y"])] * 2
    vectors = defaultdict(lambda: [0] * len(pages))
    for i, h in enumerate(pages):
        page = H.parse(h)
        for token, n in (Counter(page.token) + Counter(H.text_token(page.token[e], t) for e, t, _ in page.blocks)).items():
            vectors[token][i] = n
    wanted = defaultdict(set)
    for token, v in vectors.items():
        wanted[tuple(v)].add(token)
    found = defaultdict(set)
    for r in H.token_statistics(spark.createDataFrame([("h", h) for h in pages], "host string, html string")).collect():
        found[r.f1, r.f2].add(r.token)
        assert (r.pages, r.n) == (sum(x > 0 for x in vectors[r.token]), sum(vectors[r.token]))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_classes_nest():
    token = lambda t, around, vector, n=4: H.Token(t, around, H.CONTAINER, vector, 4, n, 9, 0, 9)
    template, _, classes = H.nest([token(0, 0, (1, 1)), token(1, 0, (1, 1)), token(3, 1, (2, 2), 12), token(5, 3, (2, 2), 12), token(9, 8, (2, 2), 12)])
    assert set(template) == {0, 1, 3, 5} and dict(classes) == {(2, 2): {(1, 1)}}


def test_plans_by_joined_hosts(spark, monkeypatch):
    arts = articles(24, 5)
    rows = [(k, f"http://h{k % 2}.example/", form(k, a)) for k, a in enumerate(arts)]
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert extracted(spark, rows) == {k: " ".join(a) for k, a in enumerate(arts)}


DEEP = ["<div>x" * 100_000, "<a 'b" * 50_001, "<a 'b>" * 50_001, "<p><div>" + "<span>" * 50_000 + "<li></li>" * 50_000, "<h1>" * 50_000 + "<p></p>" * 50_000, "<a " + "a" * 300_000 + ">x", "<script " * 50_000, "</div>" * 50_000 + "<div>" * 50_000 + "</span>" * 50_000]


@pytest.mark.parametrize("source", DEEP, ids=range(len(DEEP)))
def test_time_is_linear_in_the_source(source):
    began = time.process_time()
    H.page_tokens(H.parse(source))
    H.extract_text(source)
    assert time.process_time() - began < 10


def test_deep_pages(spark):
    got = extracted(spark, [(k, "http://h.example/", "<div>x" * 20_000 + str(k)) for k in range(3)])
    assert got == {k: f"x{k}" for k in range(3)}  # all else is constant text around the one slot


LAYOUTS = {
    "heading, lead, content": "<h2>{title}</h2><p class='lead'>{lead}</p><div class='content'><p>{a}</p><p>{b}</p></div>",
    "lead in a box": "<h1>{title}</h1><div class='lead'>{lead}</div><div class='content'><p>{a}</p><p>{b}</p></div>",
    "list of links": "<h1>{title}</h1><p>{a}</p><ul class='refs'><li><a href='/x'>{lead}</a></li><li><a href='/y'>{title} two</a></li></ul><p>{b}</p>",
    "line that recurs": "<h1>{title}</h1><div class='content'><p>{a}</p><p>{b}</p></div><p>Thanks for reading this journal.</p>",
}


@pytest.mark.parametrize("around", ["article", "div class='q'"])
@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("pages", [9, 12, 60])
def test_nothing_of_an_article_is_lost(spark, around, layout, pages):
    rng, rows, want = random.Random(layout), [], {}
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    for k in range(pages):
        inner = LAYOUTS[layout].format(title=text(4), lead=text(8), a=text(rng.randint(30, 90)), b=text(rng.randint(30, 90)))
        body = f"<{around}>{inner}</{around.split()[0]}>"
        rows.append((k, "http://h.example/" + str(k), f"<html><body><div class='t'><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div>{body}<div class='z'>Imprint of the site</div></body></html>"))
        want[k] = " ".join(re.sub("<[^>]*>", "\n", inner).split())
    assert {k: v.split() for k, v in extracted(spark, rows).items()} == {k: v.split() for k, v in want.items()}
