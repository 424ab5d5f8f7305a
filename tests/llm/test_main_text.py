import html
import random
import re
import time
from html.parser import HTMLParser

import duckdb

from fairlead.llm.catalog import QUERIES
from fairlead.llm.main_text import extract, main_text
from tests.llm.helpers import SF

LONG = "The river runs through the middle of the town, and most of the people who live there have never been to the other side of it."


def naive(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r"<!--.*?-->|</?[b-b]\b[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(h1|p|li|ul|div)\b[^>]*>", "\x01", body)))
    return "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\x01")) if x)


def test_pages_give_their_article(spark):
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    found = {r["page_id"]: r for r in QUERIES["op5_main_text"](spark, SF).collect()}
    for page_id, url, page in pages:
        assert found[page_id]["text"] == naive(page)
        assert (found[page_id]["url"], found[page_id]["n_chars"]) == (url, len(naive(page)))


def test_parts_of_a_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body><!-- <p>{LONG}</p> -->
    <header><p>{LONG} header</p></header><nav><a href=x>Home</a></nav><div class="cookie-notice">{LONG} cookies</div>
    <main><h1>A&nbsp;title &amp; more</h1><p>{LONG}<p>Short.<ul><li>{LONG} item</li></ul><script>var a = "</p>" < 3;</script>
    <form><p>{LONG} form</p></form><aside>{LONG} aside</aside><div class="ad">{LONG} advert</div><p>Last line.</p></main>
    <section id="comments"><article><p>{LONG} comment</p></article></section><footer>{LONG} footer</footer></body></html>"""
    assert main_text(page) == f"A title & more\n\n{LONG}\n\nShort.\n\n{LONG} item\n\nLast line."


def test_without_an_article_density_decides():
    links = " ".join(f'<a href="/{i}">topic number {i}</a>' for i in range(30))
    page = f"<body><div>Menu</div><div>{links}</div><div><h2>Head</h2><p>{LONG}</p><p>So it is.</p><p>{LONG}</p></div><div>{links}</div><div>Imprint</div></body>"
    text = main_text(page)
    assert LONG in text and "So it is." in text and "topic" not in text


def test_broken_and_empty_pages(spark):
    for page in (None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='x>y"):
        assert main_text(page) in ("", "<", "<p", "y", "<a href='x>y")
    assert main_text("<p>" * 3000 + "deep") == "deep"
    assert main_text("<a>" * 5000 + LONG).count("river") <= 1
    assert main_text("plain &lt;b&gt; &#x41;&eacute;&unknown; text") == "plain <b> Aé&unknown; text"
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (2, None, f"<p>{LONG}", "y")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in extract(df).collect()) == [(1, ""), (1, ""), (2, LONG)]
    assert extract(df.limit(0)).count() == 0


def test_articles_that_stand_apart_do_not_hide_the_body():
    body = f"<div><h2>Head</h2><p>{LONG}</p><p>{LONG} again</p></div>"
    for beside in (f'<section id="comments"><article><p>{LONG} comment</p></article></section>', f"<aside><article><p>{LONG} teaser</p></article></aside>"):
        text = main_text(f"<body>{body}{beside}</body>")
        assert LONG in text and f"{LONG} again" in text and "comment" not in text and "teaser" not in text


def test_wrappers_and_page_wide_forms_do_not_hide_the_article():
    for wrapper in ('div class="content-sidebar-wrap"', 'div class="layout has-sidebar"', "form action=x", 'form id="aspnetForm"', 'div id="page-with-sidebar"'):
        for inside in ("main", "article", 'div role="main"'):
            page = f"<body><{wrapper}><{inside}><h1>Title</h1><p>{LONG}</p></{inside.split()[0]}><aside>{LONG} aside</aside></{wrapper.split()[0]}></body>"
            assert main_text(page) == f"Title\n\n{LONG}", page
    assert main_text(f'<div class="sidebar"><main><p>{LONG}</p></main></div>') == LONG
    for hidden in ("div hidden", 'div style="display:none"', "nav", "aside", 'div class="sidebar-wrap"', 'div class="related-content"'):
        assert main_text(f"<{hidden}><article><p>{LONG}</p></article></{hidden.split()[0]}>") == "", hidden


def test_an_article_keeps_link_paragraphs_and_lines_beside_adverts():
    link, menu = '<p><a href="/r">Read the full report here</a></p>', "<ul><li><a href=1>One more thing</a></li><li><a href=2>Another thing</a></li></ul>"
    assert main_text(f"<article>{link}</article>") == "Read the full report here"
    assert main_text(f"<article><p>{LONG}</p>{link}{menu}<p>{LONG}</p></article>") == f"{LONG}\n\nRead the full report here\n\n{LONG}"
    assert main_text(f'<article><p>{LONG}</p><div class="ad">Buy</div><p>Short.</p><p>Shorter.</p><p>{LONG}</p></article>') == f"{LONG}\n\nShort.\n\nShorter.\n\n{LONG}"
    assert main_text(f"<body><p>{LONG}</p>{link}<p>{LONG}</p></body>") == f"{LONG}\n\n{LONG}"


def test_quotes_in_tags():
    assert main_text(f'<article><p title="a > b">{LONG}</p></article>') == LONG
    assert main_text(f'<article><p title="a>{LONG}</p></article>') == LONG  # a quote that stays open ends with the tag
    assert main_text(f"<article><p>{LONG}</p><p>1 < 2 and <b") == f"{LONG}\n\n1 < 2 and <b"


def test_hostile_pages_take_time_in_proportion():
    size = 1_000_000
    for unit in ('<a "', "<a '\"", "<a ", "<a", "<title>", "</title ", "<script></script ", "<b>", '<a ">', "<a '>\"", '<p class="content-advert_', "<", "<!", "<h1><header><b>x", "</b>"):
        for around in ("{}", "<article><p><div>{}", "{}>"):
            page, before = around.format(unit * (size // len(unit))), time.process_time()
            main_text(page)
            assert time.process_time() - before < 20, unit
    for page in ("<p><div>" + "<b>" * 100_000 + "<option>x</option>" * 20_000, f'<div class="{"content-ad-" * 50_000}_">x</div>', f'<div class="content-advert{"_" * size}">x</div>'):
        before = time.process_time()
        main_text(page)
        assert time.process_time() - before < 20, page[:40]


class Walk(HTMLParser):
    """The text of a tree of well-formed elements: blocks between block elements, outside every part that stands apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], ""

    def edge(self):
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        apart = tag in ("nav", "footer", "aside", "form", "script", "style") or dict(attrs).get("class") in ("ad", "comments", "cookie-notice")
        if tag not in ("b", "i", "a", "span"):
            self.edge()
        self.open.append((tag, apart))

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "span"):
            self.edge()
        self.open.pop()

    def handle_data(self, data):
        names = [t for t, _ in self.open]
        if "article" in names and not any(a for _, a in self.open):
            self.now += data


def test_random_trees_equal_a_walk_of_the_tree():
    rng = random.Random(7)

    def words():
        return " ".join(rng.choice(("the", "river", "of", "town", "&amp;", "caf&eacute;", "and\n", "<b>old</b>", "<a href='x'>link</a>")) for _ in range(rng.choice((1, 4, 30))))

    def tree(depth):
        kind = rng.choice(("p", "p", "p", "h2", "div", "section", "blockquote", "aside", "form", "nav", 'div class="ad"', 'div class="cookie-notice"', "script"))
        inner = words() if depth == 0 or kind in ("p", "h2", "script") else "".join(tree(depth - 1) for _ in range(rng.randrange(4)))
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    for _ in range(1500):
        page = f'<body><header>{words()}</header><nav>{words()}</nav><article><h1>Title</h1>{"".join(tree(2) for _ in range(5))}</article><section class="comments"><article><p>{words()}</p></article></section></body>'
        walk = Walk()
        walk.feed(page)
        walk.edge()
        assert main_text(page) == "\n\n".join(walk.blocks), page
