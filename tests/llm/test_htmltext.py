"""Pages put together from known articles and known surroundings; odd markup by the rules of HTML; time on hostile pages."""

import html
import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline.llm.htmltext import extract, main_texts

AROUND = [
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", "<header><p>The Daily Page</p></header>", "<div class='ad'>Buy now</div>", '<div class="cookie-notice">We use cookies</div>',
    "<aside><p>See also other things</p></aside>", "<div id=site-sidebar><p>Popular today</p></div>", "<form><label>Name</label><input></form>", "<script>var a='<p>no</p>';</script>", "<style>p{}</style>", "<footer>Imprint and rights</footer>",
    "<div class='reader_comments'><p>First! I do not agree at all with this.</p></div>", "<!-- <p>old</p> -->", "<ul class='share-buttons'><li><a href=#>Share</a></li></ul>", "<div style='display: none'>hidden words</div>", "<div role=navigation><a href=x>Next</a></div>",
]
WORDS = "river stone market green slowly the of and carried winter morning people window a under bridge letters twelve".split()


def page(r):
    blocks, body = [], []
    for _ in range(r.randint(1, 9)):
        words = r.choices(WORDS, k=r.randint(3, 60))
        blocks.append(" ".join(words) + r.choice([".", " & more", " 3 < 4", "é"]))
        inner = " ".join(f"<b>{html.escape(w)}</b>" if r.random() < 0.05 else html.escape(w) for w in blocks[-1].split(" "))
        body.append(r.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<div>{}</div>", "<ul><li>{}</ul>"]).format(inner.replace(" ", r.choice([" ", "\n  ", "<br>"]), 1)))
    if r.random() < 0.5:
        body.insert(r.randint(1, len(body)), r.choice(AROUND))
    outer = r.choice(["<article>{}</article>", "<main><div class='layout no-sidebar'>{}</div></main>", "<div class='page has-header'><article id=story>{}</article></div>"])
    around = r.sample(AROUND, 5)
    return f"<html><head><title>t</title></head><body>{''.join(around[:3])}{outer.format(''.join(body))}{''.join(around[3:])}</body></html>", "\n\n".join(blocks)


def test_known_articles_come_back():
    r = random.Random(11)
    for _ in range(400):
        source, want = page(r)
        assert extract(source) == want, source


STORY = " ".join(f"word {i} of the story goes on," for i in range(36))
BESIDE = "Some other text stands beside it here. " * 4


@pytest.mark.parametrize(("source", "want"), [
    ('<div><p class="social-history">Social history of the town.</p><p>More of it.</p></div>', "Social history of the town.\n\nMore of it."),
    ("<article><p>The main text is here.</p><article class=comment><p>I disagree.</p></article><section class=comments>No.</section></article>", "The main text is here."),
    ("<p data-x=it's>kept text</p><p>more 'quoted' text", "kept text\n\nmore 'quoted' text"),
    ('<p title="a > b">one</p><p a=">">two</p><P CLASS=x/y>three', "one\n\ntwo\n\nthree"),
    ("<p>one</p><!-- <p>two</p> --><!-->three<?php x ?></ x>four", "one\n\nthreefour"),
    ("a &lt;b&gt; &amp;amp; &eacute; &#x41; &nosuch; 1 < 2", "a <b> &amp; é A &nosuch; 1 < 2"),
    ("<div class=sidebar><p>" + "all of the page " * 20 + "</p></div>", ("all of the page " * 20).strip()),
    *((x, STORY) for x in (
        f"<body><div>{BESIDE}</div><div class='right-sidebar'><p>{STORY[:400]}</p><p>{STORY[400:]}</p></div></body>".replace(STORY[:400] + "</p><p>", STORY[:400]).replace(f"<div>{BESIDE}</div>", "<footer>Imprint</footer>"),
        f"<body><form action=x><div><p>{STORY}</p></div><input><button>Go</button></form><form><label>Name</label><input></form></body>",
        f"<body><div id=left-column><p>Weather</p></div><div class='main widget-container'><p>{STORY}</p></div></body>".replace("<div id=left-column><p>Weather</p></div>", "<div class=sidebar><p>Weather</p></div>"),
        f"<article><p>{STORY}</p><ol class=commentlist><li>First!</li></ol></article>", f"<article><p>{STORY}</p><div class=comment-body>First!</div><div id=responses>No.</div></article>", f"<article><p>{STORY}</p><article><p>I think so too.</p></article></article>",
        f"<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>{STORY}</p><table><tr><td><a href=z>Older</a><td><a href=w>Newer</a></table>", f"<article class='post has-comments'><p>{STORY}</p></article>", f"<div class=article-commentary><p>{STORY}</p></div>",
        f"<div class='comments-open'><h1></h1><p>{STORY}</p></div>", f"<aside>x</aside><article><p>{STORY}</p></article><div class=sidebar><p>{BESIDE * 9}</p></div>",
    )),
    (f"<p>{STORY}</p><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><p>{STORY}</p>", f"{STORY}\n\none\n\ntwo\n\n{STORY}"),
    ("text <p", "text"), ("", ""), (None, ""), ("<script>x", ""), ("<nav>only a menu</nav>", ""),
])
def test_markup(source, want):
    assert extract(source) == want


def test_time_grows_with_the_page():
    for part in ("<a ", "</b>", "<div>", "<b><div></div>", "<!--", '<a href="', "<ul><li><div>", "<x y='", "&lt;<", "<p><span>"):
        began = time.process_time()
        extract(part * 30_000)
        extract("<div>" * 15_000 + "</b>" * 15_000)
        assert time.process_time() - began < 8, part


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b"), (1, "u", "<p>a b"), (None, None, None), (2, "v", "<p>" + "x " * 200_000)], "page_id long, url string, html string")
    df = df.withColumns({c: F.lit(3) for c in ("text", "n_chars", "tag")})
    got = sorted((str(r["page_id"]), str(r["url"]), len(r["text"]), r["n_chars"]) for r in main_texts(df).collect())
    assert got == [("1", "u", 3, 3), ("1", "u", 3, 3), ("2", "v", 399_999, 399_999), ("None", "None", 0, 0)]
