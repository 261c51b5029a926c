"""HTML extraction: broken markup in linear time, any depth, visibility, spans; a plain second reading of the test pages."""

import re
import time
from html.parser import HTMLParser

import duckdb
import pytest

from cohortlens.llm import html_text
from tests.conftest import SF001

PATTERNS = ["<a href='", "<b", '<a b="', "<a '\"", '<a ">"', "<!--", "<a b='x' c", "</a '", "<script", "<![", "&#", "<a '>' ' "]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_broken_markup_is_read_in_linear_time(pattern):
    took = []
    for size in (1 << 19, 1 << 22):
        at = time.perf_counter()
        html_text.extract_text(pattern * (size // len(pattern)))
        took.append(time.perf_counter() - at)
    assert took[1] < 40 or took[1] < 24 * took[0]  # eight times the text; a quadratic reading takes 64 times as long


@pytest.mark.parametrize("pattern", ["<div>x", "<ul><li>", "<b>x</b>", "<br>", "<p>x", "</p>", "<i><b>", "<dl><dd>x", "<h1>x", "<li>x"])
def test_depth_costs_no_more_than_length(pattern):
    took = []
    for n in (4000, 32000):
        at = time.perf_counter()
        html_text.extract_text(pattern * n)
        took.append(time.perf_counter() - at)
    assert took[1] < 3 or took[1] < 24 * took[0]


def test_deep_pages_keep_text_and_visibility():
    deep = "<div>" * 1000
    ends = "</div>" * 1000
    cases = {
        deep + "<textarea>kept</textarea>": "kept", deep + "<p hidden>no</p>yes" + ends: "yes",
        deep + "<details><summary>s</summary>hid</details>" + ends: "s", "<div>" * 30_000 + "bottom": "bottom",
        deep + "<ul><li>a<li>b</ul>": "- a\n- b", deep + "<table><tr><td>a<td>b<tr><td>cc<td>d</table>": "a  | b\ncc | d",
    }
    assert {k: html_text.extract_text(k) for k in cases} == cases
    nested = "<table><tr><td>" * 300 + "in" + "</table>" * 300
    assert html_text.extract_text(nested) == "in"


def test_visibility_is_inherited_and_shown_again():
    cases = {
        "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>": "yes",
        "<div style='display:none'>no<b style='visibility:visible;display:block'>no</b></div>yes": "yes",
        "<div style='visibility:hidden;visibility:visible'>yes</div>": "yes",
        "<p style='VISIBILITY: Collapse !important'>no<p>yes": "yes",
        "<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>": "- yes",
        "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>": " | yes",
        "<body style='visibility:hidden'>no<input value=no><p style='visibility:visible'>yes<input value=yes>": "yesyes",
    }
    assert {k: html_text.extract_text(k) for k in cases} == cases


def test_empty_items_keep_their_lines():
    assert html_text.extract_text("<ol><li>a<li><li>c</ol>") == "1. a\n2.\n3. c"
    assert html_text.extract_text("<ul><li></li><li>b</li></ul>") == "-\n- b"
    assert html_text.extract_text("<ul><li hidden></li><li>b</ul>") == "- b"


def test_spans_reach_as_far_as_they_say():
    rows = "".join(f"<tr><td>r{i}</td></tr>" for i in range(1, 150))
    text = html_text.extract_text(f"<table><tr><td rowspan=150>all<td>r0</tr>{rows}<tr><td>last</table>").split("\n")
    assert text[0] == "all  | r0" and text[149] == "     | r149" and text[150] == "last"
    assert html_text.extract_text("<table><tr><th colspan=900>h<tr><td>a<td>b</table>") == "h\na | b"
    assert html_text.extract_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"


class Plain(HTMLParser):
    """The visible words of a well-formed page, in order, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        style = re.sub(r"\s", "", attrs.get("style") or "").lower()
        hidden = tag in html_text.UNSEEN or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style
        if tag not in html_text.VOID:
            self.open.append((tag, hidden))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.words += data.split()


def test_every_visible_word_of_the_pages_is_kept_in_order():
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF001}/pages.parquet'").fetchall()]
    assert len(pages) > 100
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        got = html_text.extract_text(page)
        flat = re.sub(r"(?m)^\s*(?:[-*]|\d+\.) |\|", " ", got).split()
        want = "".join(w for w in plain.words if w != "|")
        assert "".join(sorted("".join(flat))) == "".join(sorted(want)) or "".join(flat) == want, page[:300]
