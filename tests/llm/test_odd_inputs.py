"""Broken pages and long texts: linear time, and the same result as well-formed input."""

from __future__ import annotations

import re
import time

import pyarrow as pa
import pytest

from tidemark.llm import html_main, licenses

SIZE = 1_000_000


@pytest.mark.parametrize("tail", ["", ">", '">', "'>"])
@pytest.mark.parametrize("unit", ["<a ", "<!", "<?", "<p x='", '<p x="', "</a ", "<p x='>", "<a x=\"'>", "<!--", "<script", "<a>", "<p class="])
def test_a_broken_page_takes_linear_time(unit, tail):
    began = time.process_time()
    html_main.tokens(unit * (SIZE // len(unit)) + tail)
    assert time.process_time() - began < 10


def test_what_never_ends_is_text():
    def told(page):
        return [(t.name or t.text, t.closing) for t in html_main.tokens(page)]

    assert told("a<b c") == [("a", False), ("<", False), ("b c", False)]
    assert told("<p x='>y</p>") == [("<", False), ("p x='>y", False), ("p", True)]
    assert told("<p x='a>b'>y") == [("p", False), ("y", False)]
    assert told("<p a=\"'\" b>y<q 'z>") == [("p", False), ("y", False), ("<", False), ("q 'z>", False)]
    assert told("x<!y") == [("x", False), ("<", False), ("!y", False)]
    assert told("x<!--y") == [("x", False)] and told("x<!y>z") == [("x", False), ("z", False)]
    assert told("1 < 2 > 1") == [("1 ", False), ("<", False), (" 2 > 1", False)]


def test_licenses_in_a_long_text_beyond_ascii():
    text = "é MIT License ü " * 20_000 + "CC BY"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["id", "text"])
    began = time.process_time()
    out = next(iter(licenses._scan(tuple(licenses.BASE.items()), tuple(licenses.NOTICES.items()))(iter([batch])))).to_pylist()[0]
    assert time.process_time() - began < 20
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    starts = [k for k in range(len(words) - 1) if words[k : k + 2] in (["mit", "license"], ["cc", "by"])]
    assert (out["n_words"], out["n_base"], out["first_word"], out["last_word"]) == (len(words), len(starts), starts[0], starts[-1])
