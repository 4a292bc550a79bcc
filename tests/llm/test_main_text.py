"""Main text of hand-made pages, with the expected text written out, and of hostile ones in bounded time."""

import time

import pytest

from tabwright.llm import html_extract

STORY = "The council met on Monday to discuss the bridge, which has been closed since March."
MORE = "Repairs will take two years, the mayor said; traffic is to be led through the old town."
END = "Residents were not amused."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer><p>Copyright 2024 The Paper. All rights reserved, of course.</p></footer>"
BODY = f"<h1>The bridge</h1><p>{STORY}</p><p>{MORE}</p>"
TEXT = f"The bridge\n\n{STORY}\n\n{MORE}"
PAGES = {
    "plain article": (f"<html><body>{NAV}<article>{BODY}</article>{FOOT}</body></html>", TEXT),
    "main instead of article": (f"<body>{NAV}<main>{BODY}</main>{FOOT}", TEXT),
    "words of class and id only": (f'<div class="menu"><a href="/">Home</a> <a href="/x">News</a></div><div id="content">{BODY}</div><div class="footer">About us, terms, contact.</div>', TEXT),
    "no markup that helps": (f'<div><a href="/">Home</a> | <a href="/x">News</a></div><div>{BODY}</div><div><a href="/terms">Terms</a></div>', TEXT),
    "legal wrapper inside an article": (f'<article><div class="legal">{BODY}</div></article>', TEXT),
    "search, side and alert inside an article": (f'<article><h1>The bridge</h1><div class="search side"><p>{STORY}</p></div><section class="alert"><p>{MORE}</p></section></article>', TEXT),
    "article named after its sidebar": (f'<article class="post has-sidebar">{BODY}</article>', TEXT),
    "share links inside an article": (f'<article>{BODY}<ul class="share"><li><a href="/f">Share</a></li><li><a href="/t">Tweet</a></li></ul></article>', TEXT),
    "aside inside an article": (f"<article><h1>The bridge</h1><p>{STORY}</p><aside><p>Read also: the tunnel, a long story of many years.</p></aside><p>{MORE}</p></article>", TEXT),
    "card in an aside": (f'<article>{BODY}</article><aside><article class="card"><p>The tunnel is a long story, too; it began many years ago.</p></article></aside>', TEXT),
    "article in a footer": (f"<article>{BODY}</article><footer><article><p>We are a newspaper of the town, founded in 1900.</p></article></footer>", TEXT),
    "article in navigation": (f"<nav><article><p>Our best stories, every day, for you and yours.</p></article></nav><article>{BODY}</article>", TEXT),
    "form around the page": (f'<form id="aspnetForm"><div>{NAV}<article>{BODY}</article></div></form>', TEXT),
    "form inside an article": (f'<article><h1>The bridge</h1><p>{STORY}</p><form><p>Write to us, we read all letters.</p><input name="x"><button>Send</button></form><p>{MORE}</p></article>', TEXT),
    "advert inside an article": (f'<article><h1>The bridge</h1><p>{STORY}</p><div class="ad">Buy a boat, it is cheap; today only!</div><p>{MORE}</p></article>', TEXT),
    "comments below": (f'<article>{BODY}<section id="comments"><article class="comment"><p>I have never liked that bridge, to be honest.</p></article></section></article>', TEXT),
    "cookie notice": (f'<div class="cookie-notice"><p>We use cookies, as everyone does. Please accept them.</p></div><article>{BODY}</article>', TEXT),
    "headers": (f"<header><h2>The Paper, since 1900.</h2></header><article><header><h1>The bridge</h1></header><p>{STORY}</p><p>{MORE}</p></article>", TEXT),
    "hidden parts": (f'<article>{BODY}<div hidden><p>Not to be seen, not to be read.</p></div><p style="display: none">Nor this one, of course.</p></article>', TEXT),
    "scripts and styles": (f"<article><script>var t = '<p>no</p>';</script><style>p {{ margin: 0 }}</style><!-- no -->{BODY}</article>", TEXT),
    "references and white space": ("<article><p>Caf&eacute;  &amp;\n\t&#x42;ar,&nbsp;open&hellip;</p><p>1 &lt; 2, &unknown; stays.</p></article>", "Caf\u00e9 & Bar, open\u2026\n\n1 < 2, &unknown; stays."),
    "inline markup and breaks": (f"<article><p><b>The</b> coun<i>cil</i>,<br>it is <a href=x>said</a>, met.</p><p>{MORE}</p></article>", f"The council, it is said, met.\n\n{MORE}"),
    "ends left out": (f"<article><h1>The bridge</h1><p>{STORY}<p>{MORE}", TEXT),
    "cut inside a tag": (f"<article>{BODY}<p class=", TEXT),
    "lists and tables": (f"<article><p>{STORY}</p><ul><li>First, the deck is lifted.<li>Then, the piers are mended.</ul><table><tr><td>Cost, in all: two million.</td></tr></table></article>", f"{STORY}\n\nFirst, the deck is lifted.\n\nThen, the piers are mended.\n\nCost, in all: two million."),
    "two articles": (f"<article><p>{STORY}</p></article>{NAV}<article><p>{MORE}</p></article>", f"{STORY}\n\n{MORE}"),
    "upper case": (f"<BODY><NAV><A HREF=x>Home</A></NAV><ARTICLE><P>{STORY}</P></ARTICLE></BODY>", STORY),
    "nothing but navigation": (NAV, ""),
    "empty": ("", ""),
}


@pytest.fixture(scope="module")
def weights(spark, sf):
    return html_extract.train(html_extract.count_features(spark.read.parquet(f"{sf}/pages.parquet"), "html"))


@pytest.mark.parametrize("name", PAGES)
def test_hand_made_pages(name, weights):
    page, want = PAGES[name]
    assert html_extract.main_text(page, weights) == want


@pytest.mark.parametrize("name", ["plain article", "form around the page", "legal wrapper inside an article", "card in an aside"])
def test_depth_changes_nothing(name, weights):
    page, want = PAGES[name]
    assert html_extract.main_text("<div>" * 3000 + page + "</div>" * 3000, weights) == want


HOSTILE = {
    "deep with stray ends": "<div>" * 20_000 + "</span>" * 20_000 + "</p>" * 10_000,
    "stray ends behind a block": "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000,
    "links that never end": "<a href=x>" * 30_000,
    "objects that never end": "<object>" * 30_000,
    "options": "<select><option>" * 18_000,
    "quotes": "<p title=\"" * 27_000,
    "comments": "<!--" * 75_000,
    "entities": "&" * 300_000,
    "many blocks": "<p>a</p>" * 37_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(name, weights):
    page = HOSTILE[name]
    start = time.process_time()
    html_extract.main_text(page, weights)
    whole = time.process_time() - start
    start = time.process_time()
    html_extract.main_text(page[: len(page) // 4], weights)
    # Quadratic work would take 16 times as long as on a quarter.
    assert whole < 8 * (time.process_time() - start) + 1.0
