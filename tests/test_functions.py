"""Unit cases for the scalar helpers (FIXTURES §4 and the length gate)."""

from pyspark.sql import functions as F

from codecat.functions import cut_first, dirname, file_matches, is_exported, under_root
from codecat.functions.gate import request_status


def test_under_root(spark):
    cases = [("/srv/go/zoo/otter.go", True), ("/srv/go/zoo", True), ("/srv/go/zoology/otter.go", False), ("/srv/go", False),
             ("/srv/go/zoo/a/b/c/d.go", True), ("/tmp/srv/go/zoo/x.go", False), ("/srv/go/zoo/..x/a.go", False)]
    df = spark.createDataFrame(cases, "path string, want boolean")
    got = df.select("want", under_root(F.col("path"), F.lit("/srv/go/zoo")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_under_root_never_fails(spark):
    df = spark.createDataFrame([("", ""), ("..", "/root"), (None, "/root")], "path string, root string")
    rows = df.select(under_root(F.col("path"), F.col("root")).alias("u")).collect()
    assert [r.u for r in rows] == [True, False, False]


def test_dirname_and_file_matches(spark):
    df = spark.createDataFrame([("/a/b/c.go", "b/c.go"), ("/a/bc.go", "c.go"), ("/a/b/c.go", "/a/b/c.go"),
                                ("/x/c.go", "/a/b/c.go")], "f string, q string")
    r = df.select(dirname(F.col("f")).alias("d"), file_matches(F.col("f"), F.col("q")).alias("m")).collect()
    assert [x.d for x in r] == ["/a/b", "/a", "/a/b", "/x"]
    assert [x.m for x in r] == [True, False, True, False]


def test_exported_and_cut(spark):
    df = spark.createDataFrame([("Otter",), ("heron",), ("ÖreSund",), ("élan",), ("X9",), ("_X",)],
                               "n string")
    assert [r.e for r in df.select(is_exported("n").alias("e")).collect()] == [True, False, True, False, True,
                                                                                False]
    d2 = spark.createDataFrame([("Pen.Gate.Latch",), ("Spring",)], "n string")
    h, t, f = cut_first(F.col("n"))
    assert [tuple(r) for r in d2.select(h, t, f).collect()] == [("Pen", "Gate.Latch", True), ("Spring", None, False)]


def test_length_gate(spark):
    rows = [(1, "hello", None), (2, "x" * 2048, None), (3, "x" * 2049, None), (4, None, None),
            (5, "é" * 1025, None)]
    df = spark.createDataFrame(rows, "req_id long, name string, kind string")
    st = df.select("req_id", request_status(df, []).alias("s")).orderBy("req_id").collect()
    assert [r.s for r in st] == [None, None, "argument_too_long", None, "argument_too_long"]


def test_platform_file_names(spark):
    from codecat.functions.build import build_ignored, platform_ok
    names = [("a/x.go", True), ("a/x_linux.go", True), ("a/x_windows.go", False), ("a/x_amd64.go", True),
             ("a/x_arm64.go", False), ("a/x_linux_arm64.go", False), ("a/linux.go", True),
             ("a/x_windows_test.go", False), ("a/my_util.go", True)]
    df = spark.createDataFrame(names, "f string, want boolean")
    assert all(r.want == r.got for r in df.select("want", platform_ok(F.col("f")).alias("got")).collect())
    src = spark.createDataFrame([("//go:build ignore\n\npackage main\n",), ("package x\n//go:build ignore\n",)],
                                "c string")
    assert [r.b for r in src.select(build_ignored(F.col("c")).alias("b")).collect()] == [True, False]


def test_build_expressions(spark):
    from codecat.functions.build import build_expr_ok
    cases = [("", True), ("ignore", False), ("linux", True), ("!windows", True), ("windows", False),
             ("linux && amd64", True), ("linux && arm64", False), ("darwin || linux", True),
             ("windows || linux && amd64", True), ("(windows || linux) && !arm64", True),
             ("!(linux && amd64)", False), ("unix && go1.21", True), ("cgo && !purego", True),
             ("linux && (arm64 || 386)", False)]
    df = spark.createDataFrame([("//go:build " + e + "\n\npackage p\n" if e else "package p\n", w)
                                for e, w in cases], "c string, want boolean")
    got = [(r.c, r.want, r.got) for r in df.select("c", "want", build_expr_ok(F.col("c")).alias("got")).collect()]
    assert all(w == g for _, w, g in got), [x for x in got if x[1] != x[2]]
