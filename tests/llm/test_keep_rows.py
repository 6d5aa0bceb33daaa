"""Near copies go row by row, also where ids repeat or are missing."""

from codecat.llm import ngram_join

A, B, C, D = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")


def test_rows_are_judged_by_their_own_component(sp):
    rows = [(1, A, "x"), (2, A, "x"), (2, B, "x"), (2, C + " end", "x"), (3, C, "x"), (None, D, "x"), (None, D, "x"), (None, A, "x"), (4, "", "x"),
            (4, "", "x"), (None, None, "x"), (None, None, "x"), (5, B + " end", "y"), (6, D.upper(), "z")]
    got = ngram_join.keep_one(sp.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(5)).collect()
    want = [(1, A, "x"), (2, B, "x"), (2, C + " end", "x"), (4, "", "x"), (6, D.upper(), "z"), (None, None, "x"), (None, None, "x")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_null_ids_alone_keep_one_copy(sp):
    rows = [(None, A), (None, A), (None, A + " end"), (None, B)]
    got = [r["text"] for r in ngram_join.keep_one(sp.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 2 and B in got
