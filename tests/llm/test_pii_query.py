"""The registered PII query: every row, counts per kind that add up."""

from codecat.llm.pii import KINDS, op7_pii

SF = "/root/testdata/sf0.001"


def test_counts_per_kind(spark):
    rows = op7_pii(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.n_entities == sum(r[f"n_{k}"] for k in KINDS) for r in rows)
    assert sum(r.n_entities for r in rows) > 0
    assert sum(any(r[f"n_{k}"] for r in rows) for k in KINDS) > 1
