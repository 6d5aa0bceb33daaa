"""Sources and sinks: catalogue round trip (S5), run-log files (S7, S8), JSON omitempty."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from codecat.operators import summary
from codecat.plans.catalog import read_catalog, write_catalog
from codecat.sources import jsonio


def test_catalog_round_trip_and_prefix_pushdown(spark, fixture_catalog):
    cat, _ = fixture_catalog
    root = tempfile.mkdtemp(prefix="codecat-cat-")
    write_catalog(cat, root)
    back = read_catalog(spark, root)
    assert back.types.count() == cat.types.count() and back.methods.count() == cat.methods.count()
    q = summary.list_packages(back, "example.org/zoo")
    assert {r.import_path for r in q.collect()} == {"example.org/zoo/animals", "example.org/zoo/plants"}
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(package,example.org/zoo)" in plan
    write_catalog(cat, root)  # a second build replaces, never appends
    assert read_catalog(spark, root).types.count() == cat.types.count()


def test_read_run_logs_files(spark):
    d = tempfile.mkdtemp(prefix="codecat-runs-")
    docs = {"a.json": json.dumps({"usage": {"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 10,
                                            "cache_creation_input_tokens": 4},
                                  "total_cost_usd": 0.25, "permission_denials": []}, indent=2),
            "b.json": "", "c.json": "{oops", "d.json": json.dumps({"total_cost_usd": 1.5})}
    for n, t in docs.items():
        with open(os.path.join(d, n), "w") as f:
            f.write(t)
    r = {os.path.basename(x.file): x for x in jsonio.read_run_logs(spark, d).collect()}
    assert (r["a.json"].input, r["a.json"].output, r["a.json"].cache_read, r["a.json"].cache_creation) == (5, 7, 10, 4)
    assert r["a.json"].status == "ok" and r["a.json"].denials == 0
    assert r["b.json"].status == "empty" and r["c.json"].status == "invalid_json"
    assert r["d.json"].status == "ok" and r["d.json"].input == 0 and r["d.json"].cost == 1.5


def test_read_run_logs_in_folders(spark):
    """Empty logs count wherever they lie, whatever characters their names have; a folder of empty logs only is fine."""
    d = tempfile.mkdtemp(prefix="codecat-runs-")
    names = ["x/a.json", "x/y/none.json", "x/y/no ne+1%41.json", "x/z ü/zero.json", "none.json"]
    for n in names:
        os.makedirs(os.path.dirname(os.path.join(d, n)), exist_ok=True)
        with open(os.path.join(d, n), "w") as f:
            f.write('{"total_cost_usd": 2}' if n == "x/a.json" else "")
    r = {x.file: x.status for x in jsonio.read_run_logs(spark, d).collect()}
    assert r == {f"file:{d}/{n}": "ok" if n == "x/a.json" else "empty" for n in names}
    only = jsonio.read_run_logs(spark, os.path.join(d, "x/y")).collect()
    assert [x.status for x in only] == ["empty", "empty"]


def test_to_json_omitempty(spark):
    df = spark.createDataFrame([("New", "p", None, "func New()", "", "/a.go", 3)],
                               "name string, package string, receiver string, signature string, doc string, "
                               "file string, line int")
    out = jsonio.to_json_rows(df, ["name", "package", "receiver", "signature", "doc", "location"],
                              omit={"receiver", "doc"}, nested={"location": ["file", "line"]}).collect()[0].json
    assert out == '{"name":"New","package":"p","signature":"func New()","location":{"file":"/a.go","line":3}}'


def test_result_documents(spark, fixture_catalog):
    from codecat.operators import lookup
    cat, _ = fixture_catalog
    A = "example.org/zoo/animals"
    reqs = spark.createDataFrame([(1, A, "Left"), (2, A, "Cub")], "req_id long, package string, name string")
    docs = {r.req_id: json.loads(r.json) for r in jsonio.type_info_json(lookup.get_type(cat, reqs)).collect()}
    assert docs[1]["kind"] == "struct" and "fields" not in docs[1] and docs[1]["methods"][0]["name"] == "Turn"
    assert "is_promoted" not in docs[1]["methods"][0]
    assert docs[2]["embeds"] == [f"{A}.Otter"] and docs[2]["methods"][0]["is_promoted"] is True
    fr = spark.createDataFrame([(1, A, "Spring")], "req_id long, package string, name string")
    f = json.loads(jsonio.func_info_json(lookup.get_function(cat, fr)).collect()[0].json)
    assert set(f) == {"name", "package", "signature", "doc", "body", "location"}
    assert f["location"]["line"] == 110
