"""A/B run-log statistics (B1-B8; S7, S8 on the parsing side).

A run log is one JSON document per (arm, run) with token usage, cost and
permission denials.  The report is one aggregate job: parse -> gate ->
effective tokens -> per-arm mean / sd -> arm comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecat.schemas import RUN_LOG

# Effective-token weights for input, output, cache read, cache creation.
W_INPUT, W_OUTPUT, W_CACHE_READ, W_CACHE_CREATION = 1, 1, 0.1, 1.25


def parse_run_logs(df: DataFrame, json_col: str = "json") -> DataFrame:
    """S7 + S8: run-log JSON -> token columns (missing -> 0) and a ``status``.

    ``empty`` for a blank document, ``invalid_json`` for one that does not
    parse, else ``ok``.  Counts are longs, cost a double.
    """
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    p = F.from_json(F.col(json_col), RUN_LOG, opts)
    blank = F.col(json_col).isNull() | (F.trim(F.col(json_col)) == "")
    u = p["usage"]
    return df.select(
        "*",
        F.when(blank, F.lit("empty")).when(p.isNull() | p["_corrupt_record"].isNotNull(), F.lit("invalid_json"))
        .otherwise(F.lit("ok")).alias("status"),
        F.coalesce(u["input_tokens"], F.lit(0)).cast("long").alias("input"),
        F.coalesce(u["output_tokens"], F.lit(0)).cast("long").alias("output"),
        F.coalesce(u["cache_read_input_tokens"], F.lit(0)).cast("long").alias("cache_read"),
        F.coalesce(u["cache_creation_input_tokens"], F.lit(0)).cast("long").alias("cache_creation"),
        F.coalesce(p["total_cost_usd"], F.lit(0.0)).alias("cost"),
        F.coalesce(F.size(p["permission_denials"]), F.lit(0)).cast("long").alias("denials"),
    )


def effective_tokens(input_, output, cache_read, cache_creation) -> Column:
    """B2: weighted sum truncated to an integer (values are non-negative)."""
    c = [F.col(x) if isinstance(x, str) else x for x in (input_, output, cache_read, cache_creation)]
    v = c[0] * W_INPUT + c[1] * W_OUTPUT + c[2] * W_CACHE_READ + c[3] * W_CACHE_CREATION
    return F.floor(v).cast("long")


def zero_output(output="output") -> Column:
    """The session produced no output tokens (a warning, the run is kept)."""
    return (F.col(output) if isinstance(output, str) else output) == 0


def denial_gate(runs: DataFrame, bench_cols: list[str], denials: str = "denials") -> DataFrame:
    """A benchmark with any denied run is invalid as a whole."""
    return (runs.groupBy(*bench_cols)
            .agg(F.count(F.lit(1)).alias("n_runs"),
                 F.count_if(F.col(denials) > 0).alias("n_denied"))
            .withColumn("status", F.when(F.col("n_denied") > 0, F.lit("invalid")).otherwise(F.lit("valid"))))


def valid_runs(runs: DataFrame, bench_cols: list[str], denials: str = "denials") -> DataFrame:
    """The runs that a report may count: parsed ones of benchmarks without any denied run."""
    ok = runs.where(F.col("status") == "ok") if "status" in runs.columns else runs
    gate = denial_gate(ok, bench_cols, denials).where(F.col("status") == "valid").select(*bench_cols)
    return ok.join(gate, bench_cols, "left_semi")


def arm_stats(runs: DataFrame, arm: str = "arm", eff: str = "eff", cost: str = "cost") -> DataFrame:
    """B3 + B8: per arm n, mean and sample sd (0 when n = 1), and the CV.

    Tokens are reported to one decimal and cost to four, ties to even, as the
    report prints them; the CV is sd / mean of the unrounded values.  Logs that
    were empty or did not parse (``status`` other than ok, where there is that
    column) are no runs.
    """
    if "status" in runs.columns:
        runs = runs.where(F.col("status") == "ok")
    sd_e = F.coalesce(F.stddev_samp(eff), F.lit(0.0))
    sd_c = F.coalesce(F.stddev_samp(cost), F.lit(0.0))
    return (runs.groupBy(arm)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.bround(F.avg(eff), 1).alias("mean_eff"), F.bround(sd_e, 1).alias("sd_eff"),
                 F.bround(F.avg(cost), 4).alias("mean_cost"), F.bround(sd_c, 4).alias("sd_cost"),
                 F.bround(sd_e / F.avg(eff), 4).alias("cv_eff")))


def compare_arms(stats: DataFrame, baseline: str, index: str, arm: str = "arm") -> DataFrame:
    """Difference of the (one-decimal) means, truncated; share of the larger side.

    diff = trunc(g - l); pct = trunc(|diff| * 100 / (that side's mean + 1));
    the arm with fewer effective tokens wins, equal integers tie.
    """
    p = stats.groupBy().pivot(arm, [baseline, index]).agg(F.first("mean_eff"))
    g, l = F.col(baseline), F.col(index)
    diff = (g - l).cast("long")  # cast truncates toward zero, like printf %d
    pct = (F.when(diff > 0, (diff * 100 / (g + 1)).cast("long"))
           .when(diff < 0, (-diff * 100 / (l + 1)).cast("long"))
           .otherwise(F.lit(0).cast("long")))
    winner = F.when(diff > 0, F.lit(index)).when(diff < 0, F.lit(baseline)).otherwise(F.lit("tie"))
    return p.select(g.alias("baseline_mean"), l.alias("index_mean"), diff.alias("diff"), pct.alias("pct"),
                    winner.alias("winner"))
