"""Scorecard as a process: python -m terrane.scorecard_cli PAIRS.parquet BASELINE_FOLDER; exit code 0 if accepted and no worse than the stored baseline, else 1."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators import scorecard
from .operators.resolution import ladder
from .session import build_session


def judge(spark: SparkSession, pairs: str, baseline: str, matcher=ladder, keep: str | None = None) -> tuple[int, str]:
    metrics, by_stratum = scorecard.evaluate(spark.read.parquet(pairs), matcher, keep)
    steady = scorecard.no_regression(metrics, spark, baseline)
    text = scorecard.report(metrics, by_stratum) + f"\nno regression: {steady}"
    return (0 if scorecard.accepted(metrics) and steady else 1), text


if __name__ == "__main__":
    code, text = judge(build_session("scorecard"), *sys.argv[1:3])
    print(text)
    sys.exit(code)
