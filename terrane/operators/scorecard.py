"""Scorecard of a matcher against labelled pairs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import newest_json, write_new
from ..sources.zones import union_ragged

SURE, BUDGET = 0.85, 0.01
LEAST = {"precision": 0.92, "recall": 0.85, "false_confidence_rate": 0.05}


def _counts() -> list[Column]:
    p, t = F.col("match"), F.col("label") == "match"
    wrong, sure = p != t, F.col("confidence") >= SURE
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.count_if(sure & wrong).alias("sure_wrong"), F.count_if(sure).alias("sure"), F.count(F.lit(1)).alias("n")]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def labelled(pairs: DataFrame) -> DataFrame:
    """Unclear pairs count nowhere and are not sent to a matcher."""
    return pairs.filter(F.col("label") != "unclear")


def overall(scored: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, F1 and false-confidence rate, rounded to four places."""
    d = scored.agg(*_counts())
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return d.select("n", "tp", "fp", "fn", "tn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f1, 4).alias("f1"), F.bround(_ratio(F.col("sure_wrong"), F.col("sure")), 4).alias("false_confidence_rate"))


def by_stratum(scored: DataFrame) -> DataFrame:
    d = scored.groupBy("stratum").agg(*_counts())
    return d.select("stratum", "n", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def accepted(m: dict) -> bool:
    return m["precision"] >= LEAST["precision"] and m["recall"] >= LEAST["recall"] and m["false_confidence_rate"] <= LEAST["false_confidence_rate"]


def no_regression(m: dict, spark: SparkSession, baseline: str) -> bool:
    """Within the budget of the stored rate; the first run stores its own. baseline is a folder that all may read."""
    _, old = newest_json(spark, baseline)
    if old is None:
        write_new(spark, f"{baseline}/000000000001.json", json.dumps({"false_confidence_rate": m["false_confidence_rate"]}))
        return True
    return m["false_confidence_rate"] - old["false_confidence_rate"] <= BUDGET


def strata(frames: list[DataFrame]) -> DataFrame:
    """Labelled pairs of several strata as one table, by column names."""
    return union_ragged(frames)


def report(m: dict, strata: list[dict]) -> str:
    lines = [f"{k:<24}{m[k]}" for k in ("n", "precision", "recall", "f1", "false_confidence_rate")]
    return "\n".join([*lines, *(f"  {s['stratum']:<22}n={s['n']} precision={s['precision']:.2f} recall={s['recall']:.2f}" for s in strata), f"accepted: {accepted(m)}"])


def evaluate(pairs: DataFrame, matcher, keep: str | None = None) -> tuple[dict, list[dict]]:
    """(metrics, strata in name order); keep: a folder that the evaluated pairs are written to."""
    from .resolution import match_pairs

    scored = match_pairs(labelled(pairs), matcher).persist()
    if keep:
        scored.select("pair_id", "label", F.col("match").alias("predicted_match"), "confidence", "reason", "stratum").write.mode("overwrite").json(keep)
    out = overall(scored).first().asDict(), [r.asDict() for r in by_stratum(scored).orderBy("stratum").collect()]
    scored.unpersist()
    return out
