"""Registered queries against their DuckDB equivalents on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from codecat.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(sp, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = QUERIES[name](sp, SF)
    assert sorted(got.columns) == columns
    assert Counter(rounded(r[i] for i in order) for r in want.fetchall()) == Counter(rounded(r) for r in got.select(*columns).collect())


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
