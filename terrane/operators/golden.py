"""Field survivorship, record confidence and golden records, all as aggregations over the long form.

Long form: (cluster_id, field, value, source_system, pos), one row per candidate; pos is the order of a candidate in
its cluster. Winners are minima and maxima of structs, which combine before the shuffle, so no cluster is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import half_even, present

# Precedence by field, free-text fields, fields that weigh double in the record score.
PRECEDENCE = {
    "email": ("ecommerce", "crm", "pos"),
    "phone": ("crm", "pos", "loyalty"),
    "address": ("crm", "merger_c", "pos"),
    "first_name": ("crm", "pos"),
    "last_name": ("crm", "pos"),
    "loyalty_num": ("loyalty",),
    "birth_date": ("crm", "merger_c"),
}
FREE_TEXT = ("notes", "middle_name")
KEY_FIELDS = ("email", "phone", "first_name", "last_name", "loyalty_num", "birth_date")
HIGH, LOW = 0.85, 0.5


def last_per_source(rows: DataFrame) -> DataFrame:
    """Of several records of one source in a cluster the last counts, in the place of the first; rows need record_id."""
    place = rows.groupBy("cluster_id", "source_system").agg(F.min("pos").alias("__first"), F.max("pos").alias("__last"))
    return rows.join(place, ["cluster_id", "source_system"]).filter("pos = __last").drop("pos", "__last").withColumnRenamed("__first", "pos").distinct()


def _place() -> Column:
    table = F.create_map(*[F.lit(x) for f, s in PRECEDENCE.items() for i, n in enumerate(s) for x in (f"{f}|{n}", i)])
    return F.try_element_at(table, F.concat_ws("|", "field", "source_system"))


def by_precedence(rows: DataFrame) -> DataFrame:
    """Winner by source precedence (1.0 for the first source, 0.8 for others listed), else the first with a value (0.5), else none."""
    place = _place()
    rank = F.struct(F.coalesce(place, F.lit(1_000)).alias("place"), F.col("pos").alias("pos"))
    has = present(F.col("value"))
    pick = F.min_by(F.struct("value", "source_system", place.alias("place")), F.when(has, rank))
    d = rows.groupBy("cluster_id", "field").agg(pick.alias("w"))
    w = F.col("w")
    rule = F.when(w.isNull(), "no_value_").when(w["place"].isNotNull(), "source_precedence_").otherwise("fallback_first_nonnull_")
    conf = F.when(w.isNull(), 0.0).when(w["place"] == 0, 1.0).when(w["place"].isNotNull(), 0.8).otherwise(0.5)
    return d.select("cluster_id", "field", w["value"].alias("value"), F.coalesce(w["source_system"], F.lit("none")).alias("source_system"), F.concat(rule, "field").alias("rule_name"), conf.alias("confidence"))


def by_length(rows: DataFrame) -> DataFrame:
    """The longest text (0.7), the first of equal length; blanks are text, an empty text is none."""
    pick = F.max_by(F.struct("value", "source_system"), F.when(F.coalesce("value", F.lit("")) != "", F.struct(F.length("value"), -F.col("pos"))))
    d = rows.groupBy("cluster_id", "field").agg(pick.alias("w"))
    w = F.col("w")
    return d.select("cluster_id", "field", w["value"].alias("value"), F.coalesce(w["source_system"], F.lit("none")).alias("source_system"), F.concat(F.lit("longest_populated_"), "field").alias("rule_name"), F.when(w.isNull(), 0.0).otherwise(0.7).alias("confidence"))


def by_recency(rows: DataFrame, stamp: str) -> DataFrame:
    """The value with the greatest time text (0.9), the first of equal times; an empty time never wins."""
    usable = (F.coalesce("value", F.lit("")) != "") & (F.coalesce(stamp, F.lit("")) != "")
    pick = F.max_by(F.struct("value", "source_system"), F.when(usable, F.struct(F.col(stamp), -F.col("pos"))))
    d = rows.groupBy("cluster_id", "field").agg(pick.alias("w"))
    w = F.col("w")
    return d.select("cluster_id", "field", w["value"].alias("value"), F.coalesce(w["source_system"], F.lit("none")).alias("source_system"), F.concat(F.lit("most_recent_"), "field").alias("rule_name"), F.when(w.isNull(), 0.0).otherwise(0.9).alias("confidence"))


def merge(rows: DataFrame) -> DataFrame:
    """Every field by its own rule."""
    free = F.col("field").isin(*FREE_TEXT)
    return by_precedence(rows.filter(~free)).unionByName(by_length(rows.filter(free)))


def record_scores(fields: DataFrame) -> DataFrame:
    """(cluster_id, record_confidence, high_confidence, low_fields) from (cluster_id, field, confidence); key fields weigh double.

    Scores are whole tenths, so the mean is exact in whole numbers and rounds half to even.
    """
    weight = F.when(F.col("field").isin(*KEY_FIELDS), 2).otherwise(1)
    tenths = F.round(F.col("confidence") * 10).cast("bigint")
    d = fields.groupBy("cluster_id").agg(F.sum(tenths * weight).alias("num"), F.sum(weight * 10).alias("den"), F.array_sort(F.collect_set(F.when(F.col("confidence") < LOW, F.col("field")))).alias("low"))
    score = half_even(F.col("num"), F.col("den"))
    return d.select("cluster_id", score.alias("record_confidence"), (score >= HIGH).alias("high_confidence"), F.array_join("low", ",").alias("low_fields"))


def golden_records(rows: DataFrame) -> DataFrame:
    """One row per cluster: values, confidences and rules by field as maps, sources, score."""
    fields = merge(rows)
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", c))))
    wide = fields.groupBy("cluster_id").agg(entries("value").alias("fields"), entries("confidence").alias("field_confidence"), entries("rule_name").alias("survivorship_rules"))
    sources = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_set("source_system")).alias("source_systems"))
    return wide.join(record_scores(fields), "cluster_id").join(sources, "cluster_id")
