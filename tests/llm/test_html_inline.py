"""Inline elements that the markup leaves out."""

from __future__ import annotations

import pytest

from lodestrata.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>text <span class="advert">AD</span> more</p>', "text more"),
        ("a <span hidden>secret</span>b", "a b"),
        ("<p>x <button>Accept cookies</button> y <label>l</label> z</p>", "x y z"),
        ('<p><a class="share">s</a></p><p>kept</p>', "kept"),
        ("<p>a <span class=ad>b <b>c</b></span> d</p><p>e</p>", "a d\ne"),
        ('<article><p>one <span class="cookie-notice">we use<br>cookies</span>two</p></article>', "one two"),
        ("<p>w<span hidden>x</span>y</p>", "wy"),
    ],
)
def test_what_inline_elements_leave_out_is_no_text(page, text):
    assert html_text.main_text(html_text.lines_of(page), set()) == text
