"""Rows that differ in any column stay rows of their own in the mixture."""

from collections import Counter

from codecat.llm import mixing


def test_each_row_keeps_its_own_columns(sp):
    text = "some words that are the same in both rows of the table"
    rows = [(1, "s", text, "en", {"a": 1}), (1, "s", text, "de", {"a": 2}), (1, "s", text, None, None), (2, None, text, "s", None),
            (2, "s", text, None, None), (3, "t", text, "en", None), (3, "t", text, "en", None)]
    docs = sp.createDataFrame(rows, "doc_id long, source string, text string, lang string, more map<string,int>").repartition(3)
    got = mixing.mixture(docs).collect()
    taken = Counter((r.doc_id, r.source, r.lang, tuple(sorted((r.more or {}).items()))) for r in got if r["pass"] == 0)
    want = Counter((i, s, lang, tuple(sorted((m or {}).items()))) for i, s, _, lang, m in rows)
    assert all(taken[k] <= n for k, n in want.items()) and set(taken) <= set(want)
    words = Counter()
    for r in got:
        words[(r.doc_id, r.source, r.lang)] += r.words
    plan = Counter()
    for r in mixing.mix(docs, key_cols=docs.columns).collect():
        plan[(r.id, r.source)] += sum(d.words for d in r.draws)
    assert sum(words.values()) == sum(plan.values())
    # Rows that differ in lang alone are drawn as themselves, not as copies of one of them.
    assert len({k for k in words if k[0] == 1}) == sum(1 for r in mixing.mix(docs, key_cols=docs.columns).collect() if r.id == 1 and r.draws)
