"""Landing change events: the same projection for a static batch and for a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.change_feed import BucketedTable
from ..operators.lineage import attach, make_lineage


def parse_envelopes(raw: Column) -> Column:
    """A change envelope as text, wrapped in `payload` or bare, as (op, before, after, ts_ms, source_db, topic).

    Defaults: op r, ts_ms 0, source and topic unknown; topic is read from the outer object. Text that is no JSON
    object gives the defaults.
    """
    v = F.try_parse_json(raw)
    inner = F.coalesce(F.try_variant_get(v, "$.payload", "variant"), v)
    get = lambda p, t="string": F.try_variant_get(inner, p, t)
    image = lambda p: F.to_json(F.try_variant_get(inner, p, "variant"))
    return F.struct(
        F.coalesce(get("$.op"), F.lit("r")).alias("op"),
        F.nullif(image("$.before"), F.lit("null")).alias("before"),
        F.nullif(image("$.after"), F.lit("null")).alias("after"),
        F.coalesce(get("$.ts_ms", "bigint"), F.lit(0).cast("bigint")).alias("ts_ms"),
        F.coalesce(get("$.source.db"), F.lit("unknown")).alias("source_db"),
        F.coalesce(F.try_variant_get(v, "$.topic", "string"), F.lit("unknown")).alias("topic"),
    )


def land(events: DataFrame, fields: list[str]) -> DataFrame:
    """Events as landed rows: the fields of the after-image, _cdc_op, _cdc_ts_ms, _cdc_topic, and for `d` a tombstone with the before-image.

    Every event lands, in order of event_no, without deduplication or merge; only a small `d` is a tombstone.
    """
    after = F.from_json("after", "map<string,string>")
    dead = F.coalesce(F.col("op") == "d", F.lit(False))
    return events.select(
        "event_no",
        *[F.try_element_at(after, F.lit(f)).alias(f) for f in fields],
        F.coalesce("op", F.lit("r")).alias("_cdc_op"),
        F.coalesce("ts_ms", F.lit(0).cast("bigint")).alias("_cdc_ts_ms"),
        F.coalesce("topic", F.lit("unknown")).alias("_cdc_topic"),
        dead.alias("_cdc_tombstone"),
        F.when(dead, F.col("before")).alias("_cdc_before"),
    )


def op_counts(events: DataFrame, *by: str) -> DataFrame:
    """Inserts, updates and deletes as counted on landing: small letters i, u, d alone."""
    n = lambda o: F.count_if(F.coalesce(F.col("op") == o, F.lit(False)))
    return events.groupBy(*by).agg(n("i").alias("inserts"), n("u").alias("updates"), n("d").alias("deletes"), F.count(F.lit(1)).alias("landed"))


def land_stream(spark: SparkSession, events: DataFrame, fields: list[str], source: str, bronze: str, checkpoint: str, table: BucketedTable | None = None) -> StreamingQuery:
    """Land all events that are there, batch by batch; run_id is the batch's number, so a repeated batch overwrites itself.

    With a table the same batches are applied to the current state.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = land(df, fields).persist()
        names = [*fields, "_cdc_op", "_cdc_ts_ms", "_cdc_topic"]
        stamp = make_lineage(source, events.sparkSession.conf.get("spark.app.name"), rows.count(), names, f"{number:08d}")
        attach(rows, stamp).drop("run_id").write.mode("overwrite").json(f"{bronze}/{source}/kind=cdc/run_id={number:08d}")
        rows.unpersist()
        if table is not None:
            table.apply(df)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_ops(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Operations per window of event time; on a stream, events later than the watermark are dropped."""
    at = F.timestamp_millis(F.col("ts_ms"))
    d = events.withColumn("at", at).withWatermark("at", late)
    return d.groupBy(F.window("at", width).alias("w"), F.lower("op").alias("op")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "op", "n")
