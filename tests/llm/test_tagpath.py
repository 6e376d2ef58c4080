"""Whole main texts of pages of any form."""

from __future__ import annotations

import math
import random
import time

import pytest

from tripflow.llm import tagpath

LONG = "Long, plain text, of a sentence or two, with more than enough to say."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one, two</é>, three.</p>", "one, two, three."),
        ("<p>one, <İstanbul> three.</p>", "one, <İstanbul> three."),
        ("<p>one, <ı", "one, <ı"),
        ("<p>one, two.</p></", "one, two."),
    ],
)
def test_other_letters_after_brackets(html, text):
    assert tagpath.main_text(html) == text


def test_div_page_keeps_its_closing_blocks():
    html = f"<body><div><h1>Head</h1><p>Lead</p><p>{LONG}</p><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div></body>"
    assert tagpath.main_text(html) == f"Head\n\nLead\n\n{LONG}\n\n{LONG}\n\none\n\ntwo"


def test_div_page_keeps_a_small_section():
    parts = "".join(f"<p>{LONG}</p>" for _ in range(9))
    html = f"<body><div><div>{parts}</div><div><p>{LONG}</p></div></div><div class='ad'>Buy, now.</div></body>"
    assert tagpath.main_text(html) == "\n\n".join([LONG] * 10)


BODY = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
TEXT = f"Head\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("name", ["content no-sidebar", "site has-sidebar", "with-header", "share-page", "pageWithSidebar", "menu"])
@pytest.mark.parametrize("tag", ["div", "article", "main"])
def test_layout_names_do_not_hide_the_article(name, tag):
    inner = f"<{tag}>{BODY}</{tag}><div class='site-footer'>End, of page.</div>"
    assert tagpath.main_text(f"<body><div class='{name}'>{inner}</div></body>") == TEXT


def test_signed_parts_stay_out():
    ads, notes = "<div class='ad'>Buy, now.</div>", f"<section id='comments'><article>{LONG * 9}</article></section>"
    assert tagpath.main_text(f"<div class='share-page'><main>{BODY}{ads}{notes}</main></div>") == TEXT
    assert tagpath.main_text(f"<body><div>{BODY}{ads}</div><div id='comments'><p>{LONG * 9}</p></div></body>") == TEXT


def test_other_articles_do_not_hide_the_article():
    notes = f"<section id='comments'><article>{LONG * 9}</article></section>"
    assert tagpath.main_text(f"<body><div class='share-page'><article>{BODY}</article></div>{notes}</body>") == TEXT
    assert tagpath.main_text(f"<body><div>{BODY}</div>{notes}</body>") == TEXT


MORE = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        (f"<div class='elementor-widget'>{MORE}</div>", LONG),
        (f"<div class='wp-block-widget'>{MORE}</div>", LONG),
        (f"<div class='widget'>{MORE}</div>", LONG),
        ("<h2 class='section-header'>Part</h2>", "Part"),
        ("<h2 class='header'>Part</h2>", "Part"),
        ("<div class='side-by-side'>Two, columns.</div>", "Two, columns."),
        ("<section id='related-work'>Others, before.</section>", "Others, before."),
        ("<p class='banner-text'>Some, words.</p>", "Some, words."),
        ("<p class='skip-intro'>Some, words.</p>", "Some, words."),
        ("<h2 id='recommended-dose'>Dose</h2>", "Dose"),
        ("<div id='notice-period'>Three, months.</div>", "Three, months."),
        ("<pre><code>x = 1 <span class='hljs-comment'># one</span></code></pre>", "x = 1 # one"),
        ("<pre><code>y = 2 <span class='token comment'># two</span></code></pre>", "y = 2 # two"),
        ("<p>As <math><mi>a</mi><mo>=</mo><mn>2</mn></math> shows.</p>", "As a=2 shows."),
        ("<p>See <svg><path d='M0'/><text>no</text></svg>here.</p>", "See here."),
        ("<p hidden>Kept, text.</p><p aria-hidden='true'>And, more.</p>", "Kept, text.\n\nAnd, more."),
        ("<div style='display:none'>Folded, part.</div>", "Folded, part."),
        ("<div class='ad'>Buy, now.</div>", ""),
        ("<p class='ad'>Buy, now.</p>", ""),
        (f"<div class='ad-slot'>{MORE}</div>", ""),
        (f"<div id='comments'>{MORE}</div>", ""),
        ("<div class='newsletter-signup'>Write, to us.</div>", ""),
    ],
)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_inside_the_article(tag, inner, text):
    whole = TEXT + ("\n\n" + text if text else "")
    assert tagpath.main_text(f"<body><{tag}>{BODY}{inner}</{tag}></body>") == whole


def test_headline_of_the_article_stays():
    html = f"<body><header><a href='/'>Site</a></header><article><header><h1>Head</h1></header><p>{LONG}</p><p>{LONG}</p></article></body>"
    assert tagpath.main_text(html) == TEXT


@pytest.mark.parametrize(
    "beside",
    [
        "<div class='more-stories'><h3>More</h3><p>Other, story.</p></div>", "<div class='site-footer'>End, of page.</div>",
        "<fieldset><legend>Poll</legend>Yes, or no?</fieldset>", "<label>Your, name.</label>", "<div class='cookie-banner'>We, use them.</div>",
        "<ul><li><a href='/a'>Other</a></li><li><a href='/b'>More</a></li></ul>",
    ],
)
def test_what_stands_beside_on_div_pages(beside):
    assert tagpath.main_text(f"<body><div>{BODY}{beside}</div></body>") == TEXT


def test_menu_before_the_headline():
    menu = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li></ul>"
    assert tagpath.main_text(f"<body><div class='site'>{menu}<h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div></div></body>") == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 40_000 + "x, y." + "</i>" * 40_000, "<b>" * 40_000 + "x, y." + "</div></span>" * 40_000,
        "<p><table>" + "<b>" * 20_000 + "<h2>a, b.</h2>" * 20_000, "<ul><li>" + "<span>" * 20_000 + "<p>c, d.</p>" * 20_000,
        "<p>" * 30_000 + "<td>" * 30_000 + "x, y.",
    ],
)
def test_hostile_nesting_takes_linear_time(page):
    began = time.process_time()
    tagpath.main_text(page)
    assert time.process_time() - began < 5


def _plain_paths(nodes):
    """Content paths by the definition, with plain loops."""
    if not nodes:
        return set()
    by_path = {}
    for path, n, p in nodes:
        by_path.setdefault(path, []).append((n, p))
    text = {k: sum(n for n, _ in v) / len(v) for k, v in by_path.items()}
    marks = {k: sum(p for _, p in v) / len(v) for k, v in by_path.items()}
    weights = [math.exp(-0.5 * (d / tagpath.SIGMA) ** 2) for d in range(-3, 4)]

    def smooth(values, i):
        near = [values[min(max(i + d, 0), len(values) - 1)] for d in range(-3, 4)]
        return sum(w * x for w, x in zip(weights, near, strict=True)) / sum(weights)

    laid, marked = [text[p] for p, _, _ in nodes], [marks[p] for p, _, _ in nodes]
    fused = [smooth(laid, i) * (1 + smooth(marked, i)) for i in range(len(nodes))]
    score = {}
    for k in by_path:
        own = [f for f, (p, _, _) in zip(fused, nodes, strict=True) if p == k]
        score[k] = sum(own) / len(own) if text[k] > 0 else 0.0
    mean = sum(score.values()) / len(score)
    least = min(math.sqrt(sum((x - mean) ** 2 for x in score.values()) / len(score)), max(score.values()))
    # A path at the very threshold may fall either way by rounding.
    sure = {k for k, x in score.items() if x > 0 and x >= least * (1 + 1e-9)}
    return sure, {k for k, x in score.items() if x > 0 and x >= least * (1 - 1e-9)}


def test_content_paths_against_a_plain_version():
    rng = random.Random(2)
    assert tagpath.content_paths([]) == set()
    for _ in range(300):
        paths = rng.randrange(1, 9)
        nodes = [(rng.randrange(paths), rng.choice([0, 0, 5, 40, 200, 900]), rng.randrange(6)) for _ in range(rng.randrange(1, 40))]
        sure, possible = _plain_paths(nodes)
        assert sure <= tagpath.content_paths(nodes) <= possible
