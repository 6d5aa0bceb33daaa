"""Run-log parsing and statistics edge cases (n = 1, denial, zero output, missing key)."""

import json

from pyspark.sql import functions as F

from codecat.operators import runstats as RS


def test_parse_defaults_and_statuses(spark):
    logs = [("a", json.dumps({"usage": {"input_tokens": 10, "output_tokens": 0}, "total_cost_usd": 0.5,
                              "permission_denials": ["x"]})),
            ("b", json.dumps({"usage": {}})), ("c", ""), ("d", "{not json")]
    df = RS.parse_run_logs(spark.createDataFrame(logs, "id string, json string"), "json")
    r = {x.id: x for x in df.collect()}
    assert (r["a"].input, r["a"].output, r["a"].cache_read, r["a"].denials, r["a"].cost) == (10, 0, 0, 1, 0.5)
    assert r["b"].status == "ok" and r["b"].input == 0 and r["b"].cost == 0.0
    assert r["c"].status == "empty" and r["d"].status == "invalid_json"


def test_stats_and_compare(spark):
    runs = spark.createDataFrame([("g", 1, 100, 0.2), ("g", 2, 110, 0.3), ("l", 1, 50, 0.1)],
                                 "arm string, run int, eff long, cost double")
    st = {r.arm: r for r in RS.arm_stats(runs).collect()}
    assert st["l"].sd_eff == 0.0 and st["l"].n == 1          # n = 1 -> sd 0
    assert st["g"].mean_eff == 105.0 and st["g"].sd_eff == 7.1
    cmp = RS.compare_arms(RS.arm_stats(runs), "g", "l").collect()[0]
    assert (cmp.diff, cmp.pct, cmp.winner) == (55, 51, "l")


def test_effective_tokens_and_gate(spark):
    df = spark.createDataFrame([("b1", 3, 5, 10, 4, 0), ("b1", 1, 0, 0, 0, 2), ("b2", 1, 1, 1, 1, 0)],
                               "bench string, input long, output long, cache_read long, cache_creation long, "
                               "denials long")
    e = df.select(RS.effective_tokens("input", "output", "cache_read", "cache_creation").alias("e"),
                  RS.zero_output("output").alias("z")).collect()
    assert [x.e for x in e] == [14, 1, 3] and [x.z for x in e] == [False, True, False]
    g = {r.bench: r.status for r in RS.denial_gate(df, ["bench"]).collect()}
    assert g == {"b1": "invalid", "b2": "valid"}


def test_report_counts_valid_runs_only(spark):
    runs = spark.createDataFrame(
        [("x", "g", "ok", 0, 1), ("x", "g", "invalid_json", 0, 0), ("x", "l", "ok", 0, 2), ("y", "g", "ok", 1, 50), ("y", "l", "ok", 0, 60)],
        "bench string, arm string, status string, denials long, eff long").withColumn("cost", F.lit(0.25))
    st = {r.arm: (r.n, r.mean_eff) for r in RS.arm_stats(RS.valid_runs(runs, ["bench"])).collect()}
    assert st == {"g": (1, 1.0), "l": (1, 2.0)}
    assert {r.arm: r.n for r in RS.arm_stats(runs).collect()} == {"g": 2, "l": 2}


def test_ties_round_to_even(spark):
    runs = spark.createDataFrame([("a", 0, 0.0), ("a", 0, 0.0), ("a", 0, 0.0), ("a", 1, 0.0)], "arm string, eff long, cost double")
    assert RS.arm_stats(runs).first().mean_eff == 0.2
