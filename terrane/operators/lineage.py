"""Lineage stamps and the lookups over them."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import text_of

LINEAGE = ("source_system", "run_id", "ingested_at", "row_count", "schema_fingerprint", "source_file")
FIND_CAP = 50


def fingerprint(columns: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted (column, "string") pairs as JSON text; columns is an array of names."""
    one = lambda c: F.concat(F.lit('["'), c, F.lit('", "string"]'))
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(columns), one), ", "), F.lit("]")), 256), 1, 16)


def make_lineage(source: str, file: str, rows: int, columns: list[str], run_id: str | None = None, now: datetime | None = None) -> dict[str, Column]:
    """The six lineage columns; run id and time are made once, here, and not per row."""
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    return {
        "source_system": F.lit(source),
        "run_id": F.lit(run_id or str(uuid.uuid4())),
        "ingested_at": F.lit((now or datetime.now(timezone.utc)).isoformat()),
        "row_count": F.lit(rows).cast("bigint"),
        "schema_fingerprint": fingerprint(names),
        "source_file": F.lit(file),
    }


def attach(df: DataFrame, lineage: dict[str, Column]) -> DataFrame:
    """Stamp every row; a payload column of a lineage name is overwritten."""
    return df.withColumns(lineage)


def find_record(df: DataFrame, field: str, value: str, order: list[str], cap: int = FIND_CAP) -> DataFrame:
    """Rows whose field prints as value (missing column: empty text, null: `None`), at most cap, with `truncated` once cap are held."""
    shown = text_of(F.col(f"`{field}`")) if field in df.columns else F.lit("")
    hits = df.filter(shown == value).orderBy(*order).limit(cap)
    n = hits.agg((F.count(F.lit(1)) >= cap).alias("truncated"))
    return hits.join(n, how="left", on=F.lit(True))


def preview(df: DataFrame, order: list[str], limit: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(max(limit, 0))


def trace(audit: DataFrame, bronze: DataFrame, field: str, customer_id: str) -> DataFrame:
    """Silver steps of one field of one customer, and the rows of the runs they came from."""
    steps = audit.filter((F.col("customer_id") == customer_id) & (F.col("field") == field))
    silver = steps.select(F.lit("silver").alias("step"), "source_system", "run_id", "rule_name", "value", F.lit(None).cast("bigint").alias("row_id"))
    runs = steps.select("source_system", "run_id").distinct()
    rows = bronze.join(runs, ["source_system", "run_id"]).select(F.lit("bronze").alias("step"), "source_system", "run_id", F.lit(None).cast("string").alias("rule_name"), F.lit(None).cast("string").alias("value"), "row_id")
    return silver.unionByName(rows)


# The registered sources, each with its key and columns.
REGISTRY = {
    "pos": ("customer_id", ["customer_id", "store_id", "person_type", "name_style", "title", "first_name", "middle_name", "last_name", "suffix", "email", "phone", "modified_date", "order_date"]),
    "ecommerce": ("email", ["email_address_id", "business_entity_id", "email", "modified_date"]),
    "crm": ("business_entity_id", ["business_entity_id", "person_type", "first_name", "middle_name", "last_name", "phone", "address_line1", "city", "state", "postal_code"]),
    "loyalty": ("loyalty_num", ["loyalty_num", "store_name", "business_type", "annual_revenue", "modified_date"]),
    "merger_a": ("account_id", ["account_id", "name", "address", "phone", "created_date"]),
    "merger_b": ("cust_code", ["cust_code", "first_name", "last_name", "middle_name", "email", "phone"]),
    "merger_c": ("uuid", ["uuid", "first_name", "last_name", "email", "phone", "address_line1", "city", "state", "postal_code", "created_date"]),
}


def registry(spark) -> DataFrame:
    """(source, key, n_columns, columns, fingerprint) of every registered source."""
    rows = [(s, k, len(c), c) for s, (k, c) in REGISTRY.items()]
    d = spark.createDataFrame(rows, "source string, key string, n_columns bigint, cols array<string>")
    return d.select("source", "key", "n_columns", F.array_join("cols", ",").alias("columns"), fingerprint(F.col("cols")).alias("fingerprint"))


def source_schema(source: str) -> dict:
    """Key and columns of a registered source; an error that lists the sources otherwise."""
    if source not in REGISTRY:
        return {"error": f"unknown source {source!r}", "sources": sorted(REGISTRY)}
    key, columns = REGISTRY[source]
    return {"source": source, "key": key, "columns": columns}
