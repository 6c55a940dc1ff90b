from __future__ import annotations

import pytest

from quillspark.llm import html_extract
from quillspark.llm.html_extract import main_text

SF = "/root/testdata/sf0.01"
NAV = '<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav>'
FOOT = "<footer>&copy; example &middot; all of it</footer>"
LONG = "This is a sentence of the article that is long enough to count as a text block of its own. " * 2


def page(body: str) -> str:
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{NAV}{body}{FOOT}</body></html>'


def test_article():
    assert main_text(page("<!-- ad 1 --><div class=\"ad\">Buy now</div><article><h1>Head</h1><p><b>First.<br><p>Short.</p><p>A &amp; B &eacute;\n  c</p></article>")) == "Head\nFirst.\nShort.\nA & B é c"


@pytest.mark.parametrize(
    "noise",
    [
        "<aside>Also read this and that and more of the same</aside>",
        '<div class="sidebar"><p>Side text that is rather long, as side texts are now and then, to be sure</p></div>',
        '<section id="comments"><article class="comment"><p>A reader says something very long about the article and its author here</p></article></section>',
        '<form><label>Name</label><input name="n"><button>Send it now</button></form>',
        '<div class="cookie-notice">We use cookies</div>',
        '<div role="navigation">Home News</div>',
        '<p class="advert">Buy this thing now</p>',
        '<div style="display: none">hidden words</div>',
        "<noscript>Turn scripts on</noscript>",
        "<script>document.write('<p>no</p>')</script>",
        '<ul class="share-buttons"><li>Post</li></ul>',
        '<header class="site">Site name</header>',
    ],
)
def test_noise_goes_in_and_around_articles(noise):
    assert main_text(page(f"{noise}<article><h1>Head</h1><p>One.</p>{noise}<p>Two.</p></article>{noise}")) == "Head\nOne.\nTwo."
    assert main_text(page(f'{noise}<div class="content"><p>One.</p><p>Two.</p></div>{noise}')) == "One.\nTwo."


def test_pages_without_article_use_the_distribution():
    text = page(f'<div class="x"><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>')
    assert main_text(text) == f"{LONG.strip()}\nYes.\n{LONG.strip()}"
    links = "".join(f'<p><a href="/{i}">Link to page {i}</a></p>' for i in range(5))
    assert main_text(page(f"<div>{links}</div><div><p>{LONG}</p></div>")) == LONG.strip()


def test_inline_noise_does_not_split_a_block():
    assert main_text(page('<article><p>One <span class="ad">buy</span><svg><text>x</text></svg> two <button>Go</button><a href="/l">three</a>.</p></article>')) == "One two three."
    assert main_text(page('<div id="content"><h2>Head</h2><ul><li>a</li><li>b <a href="/">c</a></li></ul><table><tr><td>1</td></tr></table><pre>x\n y</pre></div>')) == "Head\na\nb c\n1\nx y"


def test_surges_and_dives():
    plain = lambda w: html_extract.spans_of([float(x) for x in w], [False] * len(w), 3, 80)
    assert plain([0, 0, 100, 5, 100, 0, 0, 0, 0, 90, 0]) == [(0, 5), (7, 10)]
    assert plain([]) == [] and plain([0, 0]) == []
    # in marked containers short first lines belong to the surge behind them
    assert html_extract.spans_of([0, 1, 1, 1, 1, 100, 0, 0, 0], [False] + [True] * 5 + [False] * 3, 3, 80) == [(1, 6)]
    # noise has to pass the whole threshold
    assert html_extract.spans_of([20, 0, 0, 0, 30, 30, 0], [False] * 7, 3, 80, n_text=4) == [(0, 1)]
    assert html_extract.chosen_spans([1000, 0, 0, 0, 99, 0, 0, 0, 101], [False] * 9, 9) == [(0, 1), (6, 9)]


OUTSIDE = "<div><p>A line of the site about itself</p><p>And a second one of that kind</p></div>"
KEPT_WORDS = ['section id="discussion"', 'section id="related-work"', 'p class="commentary"', 'p class="share-price"', 'div class="reply-brief"', 'h2 id="discussion"', 'div class="notice-board-history"']


@pytest.mark.parametrize("element", KEPT_WORDS)
def test_words_of_an_article_are_no_noise(element):
    tag = element.split()[0]
    assert main_text(page(f"<article><h1>Head</h1><p>One.</p><{element}>What it says</{tag}><p>Two.</p></article>")) == "Head\nOne.\nWhat it says\nTwo."


def test_the_distribution_chooses(monkeypatch):
    """Unmarked lines beside an article, and unmarked pages, fail when surges and dives are left out."""
    story = f"<h1>Head</h1><p>Yes.</p><p>{LONG}</p><p>{LONG}</p>"
    want = f"Head\nYes.\n{LONG.strip()}\n{LONG.strip()}"
    links = "".join(f'<li><a href="/{i}">Story number {i}</a></li>' for i in range(9))
    pages = [
        page(f"{OUTSIDE}<article>{story}</article>{OUTSIDE}"),
        f"<body><div>Example Times</div><ul>{links}</ul><div>{story}</div><ul>{links}</ul><div>Contact us</div></body>",
        page(f"{OUTSIDE}<div class='content'>{story}</div>"),
    ]
    assert [main_text(p) for p in pages] == [want] * 3
    monkeypatch.setattr(html_extract, "chosen_spans", lambda w, m, n: [(0, len(w))])
    assert all(main_text(p) != want for p in pages)
    assert main_text(page("<article><p>One.</p></article>")) != "One."  # menu and footer lines are in the distribution


def test_a_story_in_a_form_or_an_aside_stays():
    assert main_text(f"<body><form><div>{''.join(f'<p>{LONG * 9}</p>' for _ in range(5))}</div></form></body>").count("\n") == 4


def test_legal_lines_of_pages_without_article():
    legal = "<p>Copyright 2021 The Example Company. No part of this page may be reproduced without the written consent of its owner.</p>"
    assert main_text(page(f"<div><p>{LONG}</p></div>{legal}")) == LONG.strip()


@pytest.mark.parametrize("bad", [None, "", "<", "<a", "&amp", "<p", "<!--", "<script>", "<div class='", '<a href="x', "</p></p></div>", "<nav><p>x", "<article>"])
def test_broken_pages(bad):
    assert isinstance(main_text(bad), str)


def test_cut_off_page_and_long_page():
    assert main_text("<body><article><h1>H</h1><p>One.</p><footer>f") == "H\nOne."
    big = page("<article>" + "".join(f"<p>word {i}</p>" for i in range(50_000)) + "</article>")
    assert main_text(big).count("\n") == 49_999
    assert main_text("<p>" + "x" * 2_000_000) == "x" * 2_000_000


def test_every_page_gives_its_article(spark):
    """The test pages hold nav, ad, article and footer; the article's text is what is left."""
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b), r.page_id


def test_query_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old"), (2, None, "<article><p>é🎉</p></article>", "old")], "page_id long, url string, html string, text string")
    got = html_extract.digest(df).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "", 0), (1, "", 0), (2, "é🎉", 2)]
    assert html_extract.digest(df.limit(0)).collect() == []


@pytest.mark.parametrize("box", ["related-posts", "promo", "more"])
def test_cards_do_not_replace_the_story(box):
    cards = f'<div class="{box}"><article class="card"><h3>Other</h3><p>Read this too.</p></article></div>'
    assert main_text(page(f'<div class="content"><p>{LONG}</p><p>{LONG}</p></div>{cards}')) == f"{LONG.strip()}\n{LONG.strip()}"


def test_cards_in_a_marked_container_do_not_replace_a_plain_story():
    cards = '<div class="related-posts"><article class="card"><p>Read this too.</p></article></div>'
    assert main_text(page(f"<div><p>{LONG}</p></div>{cards}")) == LONG.strip()


def test_an_article_in_a_page_wrapper_with_a_noise_word_stays():
    assert main_text(page(f'<div class="has-sidebar"><article><p>{LONG}</p></article></div>')) == LONG.strip()


def test_an_article_in_a_larger_container_stays():
    assert main_text(page(f'<div class="content"><article><p>Short story.</p></article><div><p>{LONG}</p></div></div>')) == f"Short story.\n{LONG.strip()}"
