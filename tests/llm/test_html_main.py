import random

import pytest

from pathloom.llm import html_main

LONG = "a long paragraph of many words that goes on and on, " * 8


@pytest.mark.parametrize("inner", ["<div>{}</div>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>"])
def test_page_without_article_keeps_its_short_blocks(inner):
    page = f"<html><body><nav>menu</nav><div><h1>Title</h1>{inner.format(LONG)}<div>short one</div></div><footer>F</footer></body></html>"
    assert html_main.main_text(page) == f"Title\n{LONG.strip()}\nshort one"


@pytest.mark.parametrize("odd", ["<![foo[ x ]]>", "<![ x>", "<![endif]-->", "<![if !IE]>", "<![CDATA[x]]>", "<!ELEMENT br EMPTY>", "<!>", "<?php x ?>"])
def test_odd_declarations_cut_nothing(odd):
    assert html_main.main_text(f"<p>a</p>{odd}<p>b</p><p>c]></p>").replace("-->\n", "") in ("a\nb\nc]>", "a\n b\nc]>")


def test_long_numbers_of_characters():
    assert html_main.main_text(f"<p>a</p><p>&#{'9' * 5000}; &#{'0' * 5000}65;</p><p>b</p>") == "a\n� A\nb"


def test_any_markup_is_read_to_its_end():
    rng = random.Random(8)
    bits = ["<![", "<!", "[", "]", "]]>", ">", "<p>", "</p>", "<div", "&#", "99999999999", "<!--", "-->", "cdata", "if", " ", "'", '"', "x", "<?", "</", "=", "<article>", "<script>", "</script>"]
    for _ in range(3000):
        html_main.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))


def test_text_beside_blocks_stays():
    assert html_main.main_text("<article><p>one two three</p>tail text</article>") == "one two three\ntail text"
    assert html_main.main_text(f"<p>outside</p><article><h1>T</h1>lead text<p>{LONG}</p>end text</article>") == f"T\nlead text\n{LONG.strip()}\nend text"
    assert html_main.main_text("<p>outside</p><article>only bare words of some length that stand here</article>") == "only bare words of some length that stand here"


@pytest.mark.parametrize("name", ["related-work", "responses-analysis", "alert-fatigue", "heading", "shared", "load", "commentary"])
def test_parts_that_only_hint_at_chrome_stay_if_they_hold_text(name):
    assert html_main.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>{LONG}x</p></div></article>').endswith("x")


@pytest.mark.parametrize("name", ["comments", "post-comments", "related-articles", "share-buttons", "ad-slot", "cookie-notice", "sidebar", "responses"])
def test_named_chrome_goes(name):
    assert html_main.main_text(f'<div><p>{LONG}</p></div><div class="{name}"><p>{LONG}x</p></div>') == LONG.strip()


LINKS = "<div>" + "".join(f"<div><a href='/{k}'>a link with words {k}</a></div>" for k in range(8)) + "</div>"
PLAIN = f"<body>{LINKS}<div><h1>Title</h1><p>{LONG}</p><ul><li>short</li></ul><p>{LONG}</p></div>{LINKS}<div><span>x</span><b>y</b><i>z</i></div></body>"


def test_ratios_select_the_region():
    assert html_main.main_text(PLAIN) == f"Title\n{LONG.strip()}\nshort\n{LONG.strip()}"
    flat = PLAIN.replace("<div><h1>", "<h1>").replace(f"</p></div>{LINKS}", f"</p>{LINKS}")
    assert html_main.main_text(flat).startswith(f"Title\n{LONG.strip()}\nshort")


def test_without_ratios_the_region_is_the_page(monkeypatch):
    monkeypatch.setattr(html_main, "smoothed", lambda values, sigma=1.0: [1.0] * len(values))
    assert html_main.main_text(PLAIN) != f"Title\n{LONG.strip()}\nshort\n{LONG.strip()}"


def selected_by_hand(lines, sigma=1.0, share=0.5):
    """Lines over the threshold of ratios smoothed with a dense Gaussian matrix."""
    import numpy as np

    at = np.arange(len(lines))
    w = np.exp(-((at[:, None] - at) ** 2) / (2 * sigma**2)) * (abs(at[:, None] - at) <= 2)
    smooth = (w * lines).sum(1) / w.sum(1)
    return set(np.flatnonzero(smooth >= share * smooth.std()).tolist())


def test_clusters_are_runs_over_the_threshold():
    rng = random.Random(2)
    for _ in range(200):
        lines = [float(rng.choice([0, 1, 5, 40, 200])) for _ in range(rng.randint(1, 30))]
        runs = html_main.clusters(html_main.smoothed(lines), [1] * len(lines), share=0.5, least=0.0)
        assert {i for run in runs for i in run} == selected_by_hand(lines)
        assert all(b[0] - a[-1] > 1 for a, b in zip(runs, runs[1:]))


def test_pages_as_a_table(spark):
    rows = [(1, "u", "<p>a</p>", "old"), (1, "u", "<p>a</p>", "old"), (None, None, None, "old"), (2, "v", "", "old"), (3, "w", "<p>" + "long words " * 40_000, "old")]
    out = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string, Text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id or 0, len(r.text), r.n_chars) for r in out.collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 11 * 40_000 - 1, 11 * 40_000 - 1)]
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
