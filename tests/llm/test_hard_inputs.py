"""Inputs that once took for ever, or lost rows."""

import time

import pytest

from codecat.llm import decontamination, html_extract, pii

LONG = {
    "unclosed tag": "<a " + "b" * 1_000_000 + "<p>end",
    "open divs": "<div>" * 100_000 + "text",
    "stray end tags": "<div>x</b>" * 50_000,
    "no end of tags": "<a <" * 200_000 + ">",
    "named and nested": "<div class=share-price>x" * 20_000,
}


@pytest.mark.parametrize("name", LONG)
def test_pages_are_read_in_linear_time(name):
    start = time.time()
    html_extract.extract(LONG[name], None)
    assert time.time() - start < 10


def test_controls_left_open_end_at_the_next_block():
    page = "<body><article><p>One.</p><button>Press<p>Two.</p><select><option>x<p>Three.</p></article></body>"
    assert html_extract.extract(page, None) == "One.\n\nTwo.\n\nThree."


def test_paths_keep_their_words():
    elements, _ = html_extract.parse("<body><div class='b a'><p>text</p></div></body>")
    deep = elements[-1]
    assert html_extract.path_of(deep) == ">body>div.a.b"
    assert html_extract.path_digest(html_extract.path_of(deep)) == deep.path and len(deep.path) == 24


@pytest.mark.parametrize("text", ["a-" * 500_000 + " 1", "sk-" * 300_000 + "1", "x@y.org " * 100_000])
def test_personal_data_are_found_in_linear_time(text):
    start = time.time()
    found = pii.find(text)
    assert time.time() - start < 10
    assert len(found) == text.count("@")


def test_spans_keep_the_first_to_come():
    spans = pii._Spans()
    for lo, hi, kind in ((5, 9, "a"), (0, 5, "b"), (8, 12, "c"), (9, 12, "d"), (4, 6, "e"), (20, 30, "f"), (15, 31, "g"), (12, 20, "h")):
        spans.add(lo, hi, kind)
    assert spans.all() == [(0, 5, "b"), (5, 9, "a"), (9, 12, "d"), (12, 20, "h"), (20, 30, "f")]


ITEMS = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen alpha beta gamma delta epsilon zeta eta theta iota",
         "one two three four five six seven eight nine ten eleven twelve kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"]
ODD = ["one two three four five six seven eight a b c d e f g", "clean words without any leak at all in them here"]


@pytest.mark.parametrize("ids", [(1, 2), (1, 1), (None, None)])
@pytest.mark.parametrize("shuffled", [False, True])
def test_repeated_and_missing_ids_hide_no_leak(sp, monkeypatch, ids, shuffled):
    if shuffled:
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    items = sp.createDataFrame(list(zip(ids, ITEMS, strict=True)), "item_id long, text string")
    docs = sp.createDataFrame([(7, ITEMS[0]), (7, ITEMS[1]), (None, ITEMS[1] + " more"), (None, ODD[0]), (8, ODD[1]), (7, ITEMS[0])],
                              "doc_id long, text string")
    got = sorted((r.id or 0, r.n_equal) for r in decontamination.overlaps(docs, items).collect())
    # The items have 23 and 25 words and the first twelve in common, which is enough to agree: each text aligns with both.
    assert got == sorted([(7, 23), (7, 12), (7, 12), (7, 25), (0, 12), (0, 25)])
    kept = sorted(r.text for r in decontamination.without_leaks(docs, items).collect())
    assert kept == sorted(ODD)
