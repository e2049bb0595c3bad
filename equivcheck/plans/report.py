"""Roll-ups of execution status and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Execution status, and the report's counters by what they count.
SUCCESS, FAILED, TIMED_OUT, SKIPPED = "Success", "Failed", "TimedOut", "Skipped"
STATUS_COUNTERS = {
    "success_count": SUCCESS,
    "fail_count": FAILED,
    "timeout_count": TIMED_OUT,
    "skipped_count": SKIPPED,
}
RELATION_COUNTERS = {
    "equal_count": "Equal",
    "reorder_count": "Reordered",
    "diff_count": "Diff",
    "error_count": "Error",
}


def _cases(execs: DataFrame, results: DataFrame) -> DataFrame:
    """Executions and verdicts as rows of one frame, so that one shuffle counts both."""
    nothing = F.lit(None).cast("string")
    done = execs.select("run_id", "strategy", "status", nothing.alias("relation"))
    judged = results.select("run_id", "strategy", nothing.alias("status"), "relation")
    return done.unionAll(judged)


def _counters() -> list[Column]:
    return [
        F.count("status").alias("total_count"),
        *[F.count_if(F.col("status") == s).alias(n) for n, s in STATUS_COUNTERS.items()],
        F.count("relation").alias("total_res_count"),
        *[F.count_if(F.col("relation") == r).alias(n) for n, r in RELATION_COUNTERS.items()],
    ]


def _rates(counted: DataFrame) -> DataFrame:
    """Success rates; NULL where nothing was executed or judged."""
    agreed = F.col("equal_count") + F.col("reorder_count")
    return counted.withColumns(
        {
            "exec_success_rate": F.try_divide(F.col("success_count"), F.col("total_count")),
            "eval_success_rate": F.try_divide(agreed, F.col("total_res_count")),
        }
    )


def summary(execs: DataFrame, results: DataFrame) -> DataFrame:
    """Counters and rates per run and relation.

    ``execs`` has ``run_id, strategy, status`` with the origin counted as a case,
    ``results`` has ``run_id, strategy, relation``.
    """
    return _rates(_cases(execs, results).groupBy("run_id", "strategy").agg(*_counters()))


def _labelled(grouped) -> DataFrame:
    counted = grouped.agg(
        *_counters(),
        F.grouping("run_id").alias("all_runs"),
        F.grouping("strategy").alias("all_strategies"),
    )
    named = counted.withColumn(
        "strategy", F.when(F.col("all_strategies") == 1, "All").otherwise(F.col("strategy"))
    )
    return _rates(named.drop("all_runs", "all_strategies"))


def summary_rollup(execs: DataFrame, results: DataFrame) -> DataFrame:
    """``summary`` with an ``All`` row per run, and one over all runs (``run_id`` NULL)."""
    return _labelled(_cases(execs, results).rollup("run_id", "strategy"))


def summary_totals(execs: DataFrame, results: DataFrame) -> DataFrame:
    """``summary_rollup`` with totals per relation over all runs as well."""
    return _labelled(_cases(execs, results).cube("run_id", "strategy"))


def rate_variance(execs: DataFrame, results: DataFrame) -> DataFrame:
    """Population variance over runs of both success rates, per relation."""
    return (
        summary(execs, results)
        .groupBy("strategy")
        .agg(
            F.var_pop("exec_success_rate").alias("exec_variance"),
            F.var_pop("eval_success_rate").alias("eval_variance"),
        )
    )
