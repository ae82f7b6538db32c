"""op8: ratios against a plain count over tag paths, time in page size, awkward tables."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from seqlake.llm.htmltext import HINT_WEIGHT, KERNEL, PUNCTUATION, Page, extract, main_text

PAGE = """<html><body><div class="top"><a>Home</a> <a>News</a></div><div class="story"><h1>Title here</h1>
<p>First sentence, with marks. Second one; more, and more.</p><p>Another paragraph, long enough to count. Yes, it is.</p>
<ul><li>point one</li><li>point two, longer</li></ul></div><div><span>tiny</span><span>bits</span></div></body></html>"""


class _Paths(HTMLParser):
    def __init__(self):
        super().__init__()
        self.stack, self.nodes = [], []

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.nodes.append(("/".join(self.stack), len(data), len(PUNCTUATION.findall(data))))


def test_ratios_equal_a_plain_count():
    p = _Paths()
    p.feed(PAGE)
    per = {}
    for path, n, marks in p.nodes:
        t = per.setdefault(path, [0, 0, 0])
        t[0] += n
        t[1] += marks
        t[2] += 1
    fused = [per[path][0] / per[path][2] * (1 + per[path][1] / per[path][2]) for path, _, _ in p.nodes]
    padded = [fused[0]] * 2 + fused + [fused[-1]] * 2
    smooth = np.array([sum(k * v for k, v in zip(KERNEL[::-1], padded[i:i + len(KERNEL)])) for i in range(len(fused))])
    on, hinted = Page(PAGE).content()
    assert not hinted.any() and 0 < HINT_WEIGHT < 1
    assert on.tolist() == (smooth >= min(smooth.std(), smooth.max())).tolist()
    assert any(on) and not all(on)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "text", "<b>" * 30_000 + "</i>" * 30_000 + "x", "<b>x" * 40_000, "<b>" * 15_000 + "<h1>a" * 15_000,
                                  "<svg/>" * 20_000, "<a>" * 40_000 + "</b>y" * 40_000, "<div>" * 20_000 + "z"])
def test_time_is_linear_in_unclosed_tags(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 5


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(empty).count() == 0
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (None, None, None, None), (2, "v", "", "z"), (3, "w", "<p>" + "long word, " * 100_000 + "</p>", "q")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    same = [r.text for r in got if r.page_id == 1]
    assert same[0] == same[1] and "First sentence" in same[0] and [r.text for r in got if r.page_id in (None, 2)] == ["", ""]
