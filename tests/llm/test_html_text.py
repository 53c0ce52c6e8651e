import html
import random
import re
import time

import pytest

from threadloom.llm import html_text as h

TREE = h.learn_tree(*h.labelled_table())
LONG = " ".join(["word"] * 40)


def slow(page):
    """Main text of the test pages, whose article has only headings and paragraphs."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", found[1]) if found else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark, data_dir):
    import __spark_entry__ as entry

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()}
    found = entry.queries()["op3_html_text"](spark, data_dir).collect()
    assert {r.page_id: r.text for r in found} == {i: slow(p) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in found)


def test_tree_fits_its_table():
    rows, labels = h.labelled_table()
    assert all(h.decide(TREE, r) == y for r, y in zip(rows, labels)) and len(labels) < 250


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<nav>a</nav>", ""),
    (f"<article><p>{LONG}</article>", LONG),
    ("<article><h1>T&eacute;st &amp; &#233;&nbsp; &copy; &bogus; 1 < 2</h1><p>a<b>b</b>c<br>d\n\t e</article>", "Tést & é © &bogus; 1 < 2\nabc d e"),
    (f"<article><p>{LONG}<div class='comments'><p>{LONG}</div><p>end</article><footer>f</footer>", f"{LONG}\nend"),
    (f"<article><p>{LONG}<form><p>{LONG}</form><aside>{LONG}</aside><script>var a='</p>';</script><style>p{{}}</style></article>", LONG),
    (f"<div id=cookieNotice>{LONG}</div><article><p>x</article><div class='ad-banner'>{LONG}</div>", "x"),
    (f"<article><p>{LONG}<!-- open <p>lost", LONG), (f"<article><p>{LONG}<p class='cut", LONG),
    (f"<ARTICLE><P>{LONG}</P><P HIDDEN>secret</P></ARTICLE>", LONG),
    (f"<h1>Head of it all</h1><p>{LONG}<p>{LONG}<ul><li><a href=x>one two</a><li><a href=x>three four</a></ul>", f"Head of it all\n{LONG}\n{LONG}"),
])
def test_pages(page, text):
    assert h.main_text(page, TREE) == text


def test_odd_tables(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, f"<article><p>{LONG * 300}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.n_chars for r in h.extract(pages).collect())) == [0, 0, len(LONG) * 300]
    assert h.extract(pages.limit(0)).count() == 0


def written_page(rng):
    """A page of one of many layouts with the blocks that are its main text; the tree has seen none of them."""
    marked = rng.random() < 0.5
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(1000)) for _ in range(n))
    main, body = [], []
    if rng.random() < 0.8:
        main.append(words(rng.randint(3, 9)))
        body.append(f"<h1>{main[-1]}</h1>")
    inside = [f"<div class='{rng.choice(['share-buttons comments', 'related-posts', 'ad-slot'])}'><p>{words(rng.randint(8, 40))}</p></div>", f"<form><p>{words(rng.randint(5, 35))}</p></form>", f"<aside>{words(rng.randint(20, 60))}</aside>"]
    for _ in range(rng.randint(2, 9)):
        main.append(words(rng.randint(12, 110)))
        body.append(f"<{rng.choice(['p', 'p', 'div class=header-image', 'blockquote', 'section class=reader-story'])}>{main[-1]}</>")
        tag = body[-1][1:].split(">")[0].split()[0]
        body[-1] = body[-1].replace("</>", f"</{tag}>")
        if rng.random() < 0.2:
            body.append(rng.choice(inside))
    links = "".join(f"<li><a href=/{i}>{words(rng.randint(1, 3))}</a></li>" for i in range(rng.randint(3, 8)))
    top = [f"<nav><ul>{links}</ul></nav>", f"<ul class=main-menu>{links}</ul>", f"<header><p>{words(4)}</p></header>", f"<div id='cookieConsent'><p>{words(rng.randint(10, 40))}</p></div>"]
    bottom = [f"<div id='comments'><p>{words(30)}</p><p>{words(12)}</p></div>", f"<section class='reader-comments'><p>{words(55)}</p></section>", f"<footer><p>{words(rng.randint(5, 40))}</p></footer>", f"<div class='cookie-notice'>{words(30)}</div>", f"<aside class=sidebar><p>{words(40)}</p><ul>{links}</ul></aside>"]
    wrap = rng.choice(["<article class='post has-comments no-sidebar'>{}</article>", "<main>{}</main>", "<div class='entry with-sidebar'>{}</div>"]) if marked else rng.choice(["{}", "<div>{}</div>", "<div class=wrapper><div>{}</div></div>"])
    page = "".join(rng.sample(top, rng.randint(1, 3))) + wrap.format("".join(body)) + "".join(rng.sample(bottom, rng.randint(1, 4)))
    return f"<html><head><title>{words(4)}</title></head><body>{page}</body></html>", main, marked


@pytest.mark.parametrize("marked", [True, False])
def test_held_out_pages(marked):
    rng = random.Random(11)
    right = found = wanted = pages = 0
    while pages < 40:
        page, main, has = written_page(rng)
        if has != marked:
            continue
        pages += 1
        got = h.main_text(page, TREE).split("\n")
        right += len(set(got) & set(main))
        found, wanted = found + len(got), wanted + len(main)
    assert right / found >= 0.95 and right / wanted >= 0.95, (right / found, right / wanted)


@pytest.mark.parametrize("name,says", [("has-comments", 0), ("header-image", 0), ("reader-story", 1), ("site-header", -1), ("reader-comments", -1), ("cookieNotice", -1), ("no-sidebar", 0), ("post", 1), ("comment-list", -1), ("x", 0), ("42", 0)])
def test_names_of_classes(name, says):
    assert h._says(name) == says


def test_content_of_embedded_elements_stays():
    page = f"<article><p>We have <math><mi>x</mi><mo>=</mo><mn>3</mn></math> here</p><p>{LONG}</p><object data=a><p>{LONG} end</p></object></article>"
    assert h.main_text(page, TREE) == f"We have x=3 here\n{LONG}\n{LONG} end"


def test_unmatched_end_tags_cost_no_more_each():
    page = "<div>" * 100_000 + "</x>" * 100_000 + f"<article><p>{LONG}</article>"
    start = time.perf_counter()
    assert h.main_text(page, TREE) == LONG
    assert time.perf_counter() - start < 5
