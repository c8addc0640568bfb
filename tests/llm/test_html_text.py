from __future__ import annotations

import html
import itertools
import random
import re
import time
import tracemalloc

import pytest

from campaign_metrics.llm import html_text as H
from campaign_metrics.llm.max_flow import labelling_cost, least_cost_labels
from campaign_metrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
LONG = "The quick brown fox jumps over the lazy dog while many others watch it from the hill. It went on for days."


@pytest.mark.parametrize("seed", range(60))
def test_minimum_cut_is_least_cost(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 9)
    scores = [rng.randint(-6, 6) for _ in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 7)) for _ in range(rng.randint(0, 16))] if n else []
    best = min((labelling_cost(scores, edges, list(x)) for x in itertools.product([False, True], repeat=n)), default=0)
    assert labelling_cost(scores, edges, least_cost_labels(scores, edges)) == best


def test_long_chains_do_not_recurse():
    n = 3000
    scores = [3 if i == 0 else -3 if i == n - 1 else 0 for i in range(n)]
    edges = [(i, i + 1, 5 - (i == 1500)) for i in range(n - 1)]
    labels = least_cost_labels(scores, edges)
    assert labelling_cost(scores, edges, labels) == 3


PAGES = {
    "plain": (f"<p>{LONG}</p><p>{LONG}</p>", f"{LONG} {LONG}"),
    "semantic": (
        f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";x(1)</script></head><body>
        <header><h1>Site name</h1><p>{LONG}</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href=b>{LONG}</a></li></ul></nav>
        <!-- hidden <p>no</p> --><div class="ad">{LONG}</div><div id="cookie-notice">We use cookies. {LONG}</div>
        <article><header><h1>Title</h1></header><p>One<b>two</b> &amp; three&nbsp;four<br>five<p>De.</p><aside>{LONG}</aside>
        <form><label>Mail</label><input><button>Send</button></form><ul><li>item &lt;1&gt;</li><li>item 2</li></ul>
        <div class="comments"><p>{LONG}</p></div><script>no()</script></article>
        <aside class=sidebar><p>{LONG}</p></aside><section class="user-comments"><p>{LONG}</p></section>
        <footer>&copy; x &middot; {LONG}</footer></body>""",
        "Title Onetwo & three four five De. item <1> item 2"),
    "divs": (
        f"""<div><a href=a>Home</a> <a href=b>News</a> <a href=c>Sport</a></div><div><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div></div>
        <div><a href=d>About</a> | <a href=e>Contact</a></div><div>© 2020 Copyright someone</div>""",
        f"{LONG} Short one. {LONG}"),
    "quoted": (f"""<article><p title="a > b">{LONG}</p><p>1 < 2 and <3</p></article>""", f"{LONG} 1 < 2 and <3"),
    "nothing": ("<nav><a href=x>only</a></nav>", ""), "empty": ("", ""), "unclosed": (f"<article><p>{LONG}", LONG),
    "script": ("<script>never closed " + LONG, ""), "bare": (LONG, LONG), "hidden": (f"<article><p hidden>{LONG}</p><p>{LONG} x</p>", f"{LONG} x"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert H.main_text(page) == want


def test_query_is_the_article(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = QUERIES["op3_html_extraction"](spark, SMALL)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert sorted(r.page_id for r in got) == sorted(rows)
    for r in got:
        inside = re.search("<article>(.*?)</article>", rows[r.page_id].html, re.DOTALL)[1]
        text = html.unescape(re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", inside)))
        assert r.text == " ".join(text.split()) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_odd_rows(spark):
    deep = "<div>" * 3000 + LONG
    rows = [(1, "u", None, 0), (2, None, "", 0), (2, None, "", 0), (None, "u", "<p>é😀 " + LONG, 0), (3, "u", deep, 0),
            (4, "u", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>", 0), (5, "u", "<" * 5000 + "&#xZZ;&bogus;", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:4] == [(0, len(LONG) + 3), (1, 0), (2, 0), (2, 0)]
    assert {r.page_id: r.text for r in got}[4] == " ".join([LONG] * 5000)
    assert H.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    (f'<article><p>One <svg viewBox="0 0 1 1"/>two. {LONG}</p><p>{LONG}</p></article>', f"One two. {LONG} {LONG}"),
    (f"<article><p>{LONG}</p><object data=x><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><title-bar>{LONG}</title-bar><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds. {LONG}</p></article>", f"So a=2 holds. {LONG}"),
    (f"<article><p>{LONG} <object data=x>a chart</object></p></article>", f"{LONG} a chart"),
    (f"<article><noscript><p>{LONG}</article>", LONG),
    (f"<article><svg><title>{LONG}</title><text>{LONG}</text></svg><noscript>{LONG}</noscript><p>{LONG} x</p></article>", f"{LONG} x"),
])
def test_raw_elements_end_where_they_end(page, want):
    assert H.main_text(page) == want


def test_many_unclosed_elements_are_searched_once():
    assert len(H.page_blocks("<p>x<svg><template>" * 20_000)) >= 20_000


@pytest.mark.parametrize("opening", [
    '<body class="has-sidebar">', '<html class="no-js search"><body>', '<body class="has-header"><main class="search">',
    '<article class="post share">', '<div data-hidden="false">', '<div title="The hidden valley">', '<div data-class="sidebar" title=hidden>'])
def test_cues_of_the_page_and_of_other_attributes_do_not_count(opening):
    assert H.main_text(f"{opening}<p>{LONG}</p><p>{LONG}</p>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("opening", ["<div hidden>", "<div CLASS = 'x sidebar'>", "<article hidden>", "<div title='a' id=nav>", "<p/hidden>"])
def test_cues_of_an_element_count(opening):
    assert H.main_text(f"{opening}{LONG}") == ""


_ONE_MB = {
    "unclosed elements": "<div>word here" * 70_000, "unclosed inline": "<b>x<p>y" * 120_000, "unclosed lists": "<ul><li>word" * 80_000,
    "unclosed quote": "<a " * 330_000 + '"', "quotes": '<a "' * 250_000, "ends in quotes": "<a " * 100_000 + '">"' * 200_000,
    "both quotes": "<a '" * 120_000 + '">"' * 100_000 + ">", "end tags": "</x>" * 250_000, "deep and end tags": "<div>" * 60_000 + "</x>" * 170_000,
    "unclosed scripts": "<script " * 120_000, "unclosed svg": "<svg>x" * 160_000, "angles": "<" * 1_000_000, "comments": "<!--" * 250_000}


@pytest.mark.parametrize("name", _ONE_MB)
def test_a_megabyte_of_open_ends_takes_linear_time(name):
    started = time.process_time()
    H.main_text(_ONE_MB[name])
    assert time.process_time() - started < 20


@pytest.mark.parametrize("name", ["unclosed elements", "unclosed inline", "quotes", "deep and end tags"])
def test_memory_grows_with_the_page_only(name):
    page = _ONE_MB[name][:240_000]
    tracemalloc.start()
    H.main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_a_tag_without_an_end_is_text():
    assert H.main_text(f'<article><p>{LONG}</p><p>1 <a "b and more</p></article>') == f'{LONG} 1 <a "b and more'


_A = "The river rose slowly through the night, and by morning the lower fields were under water. Nobody had seen it so high in years."
_B = "Old people remembered another flood, long ago, that took the bridge away. They said little about it, but they moved their cattle."
_C = "It stopped raining at noon."
_D = "By evening the water had gone down again, leaving mud, branches and a great silence behind it. Work on the bridge went on."


def _links(*names):
    return " ".join(f'<a href="/{k}">{n}</a>' for k, n in enumerate(names))


# Pages of five layouts, none with a cue word in an attribute or a telling tag.
_TEMPLATES = {
    "columns": (
        f"<div><div>{_links('River News')}</div><ul><li>{_links('Home')}</li><li>{_links('World')}</li></ul></div>"
        f"<div><h1>The flood</h1><p>{_A}</p><p>{_B}</p><p>{_C}</p><p>{_D}</p></div>"
        f"<div><h3>More</h3><ul><li>{_links('A bridge too old')}</li><li>{_links('Ten rivers')}</li></ul></div><div>© 2021 River News</div>",
        f"The flood {_A} {_B} {_C} {_D}"),
    "table": (
        f"<table><tr><td>{_links('Home', 'World', 'Sport')}</td><td><p>{_A}</p><p>{_B}</p><p>{_C}</p><p>{_D}</p></td>"
        f"<td>{_links('Buy boats', 'Rent pumps')}</td></tr></table>", f"{_A} {_B} {_C} {_D}"),
    "rules and breaks": (
        f"{_links('Home')} | {_links('World')}<hr><h2>The flood</h2><p>{_A}<p>{_B}<p>{_C}<p>{_D}<hr>{_links('Back')} | {_links('Imprint')}"
        "<p>Copyright 2021 River News", f"The flood {_A} {_B} {_C} {_D}"),
    "nested divs": (
        f"<div><div><div>{_links('Home', 'World')}</div></div><div><div><div><div>{_A}</div><div>{_B}</div><div>{_C}</div></div><div>"
        f"<div>{_D}</div></div></div></div><div><div>{_links('Imprint', 'Terms')}</div></div></div>", f"{_A} {_B} {_C} {_D}"),
    "sections": (
        f"<div>{_links('Home', 'World')}</div><div><h1>The flood</h1><h2>The night</h2><p>{_A}</p><h2>The day</h2><p>{_B}</p><p>{_C}</p>"
        f"<h2>The evening</h2><p>{_D}</p></div><div><p>{_links('Imprint')}</p><p>{_links('Terms of use')}</p></div>",
        f"The flood The night {_A} The day {_B} {_C} The evening {_D}"),
}


@pytest.mark.parametrize("name", _TEMPLATES)
def test_layouts_without_cue_words(name):
    page, want = _TEMPLATES[name]
    assert H.main_text(page) == want
