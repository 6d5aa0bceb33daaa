import hashlib
import random

import numpy as np
import pytest

from codecat.llm import fill_in_middle as fim

LETTERS = "ab \n\té漢😀<>PSM"


def some_text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def plain_units(text, unit):
    """Start byte of each unit, character by character."""
    starts, at = [], 0
    for i, c in enumerate(text):
        before = text[i - 1] if i else ""
        white = lambda x: x != "" and x in " \t\n\r\v\f"
        new = (unit == "chars" or i == 0 or (unit == "lines" and before == "\n")
               or (unit == "words" and before and not white(before) and white(c) and text[i:].strip(" \t\n\r\v\f")))
        if new:
            starts.append(at)
        at += len(c.encode())
    return starts


@pytest.mark.parametrize("unit", fim.UNITS)
@pytest.mark.parametrize("block", [1, 3, 7, 1024])
def test_every_cut_equals_a_scan(unit, block):
    rng = random.Random(3)
    for _ in range(60):
        text = some_text(rng, rng.randint(0, 50))
        raw = text.encode()
        tree = fim.BlockTree(np.frombuffer(raw, np.uint8), unit, block)
        ends = [*plain_units(text, unit), len(raw)]
        assert tree.n_units == len(ends) - 1
        for u, byte in enumerate(ends):
            assert tree.cut(u) == (byte, len(raw[:byte].decode()))


def test_round_trip_of_every_form(sp):
    rng = random.Random(4)
    rows = [(i, some_text(rng, rng.randint(0, 80))) for i in range(400)] + [(7, "x" * 100_000), (None, "null id"), (401, None), (402, "")]
    docs = sp.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, output string").repartition(5)
    for unit in fim.UNITS:
        got = fim.fill_in_middle(docs, unit=unit, block=16).collect()
        assert len(got) == len(rows)
        assert {r.form for r in got} == {"plain", "psm", "spm"}
        have = sorted((str(r.id), fim.restore(r.output.encode(), r.form).decode()) for r in got)
        assert have == sorted((str(i), t or "") for i, t in rows)


def test_rule_of_the_contract(sp):
    """Plain Python over code points, straight from the draws."""
    rng = random.Random(5)
    rows = [(i, some_text(rng, rng.randint(0, 40))) for i in range(300)]
    docs = sp.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in fim.fill_in_middle(docs, block=8).collect()}
    for i, text in rows:
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k: k + 8], 16) for k in (0, 8, 16, 24))
        n, r = len(text), got[i]
        assert r.n == n
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            assert (r.form, r.prefix_chars, r.middle_chars, r.output) == ("plain", None, None, text)
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        want = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
        assert (r.form, r.output) == want and (r.prefix_chars, r.middle_chars) == (a, b - a)


def test_long_text_and_empty_table(sp):
    raw = ("é漢a " * 400_000).encode()
    data = np.frombuffer(raw, np.uint8)
    tree = fim.BlockTree(data)
    byte, points = tree.cut(1_000_001)
    assert points == 1_000_001 and len(raw[:byte].decode()) == points
    none = sp.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(none, unit="bytes")
