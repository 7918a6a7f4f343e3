"""Lookup tools over the zones on disk: JSON-like answers for a caller outside Spark. Bounded answers only."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.storage import list_dirs
from ..sources.zones import read_zone
from .lineage import find_record, preview, source_schema, trace


class LineageService:
    """zones: name of a zone -> its root folder, laid out as <root>/<source>/kind=.../run_id=..."""

    def __init__(self, spark: SparkSession, zones: dict[str, str]):
        self.spark, self.zones = spark, zones

    def _sources(self, zone: str) -> list[str]:
        return sorted(d.rstrip("/").rpartition("/")[2] for d in list_dirs(self.spark, self.zones[zone]))

    def _table(self, zone: str, name: str, *kinds: str):
        if zone not in self.zones:
            return {"error": f"unknown zone {zone!r}", "zones": sorted(self.zones)}
        if name not in self._sources(zone):
            return {"error": f"no table {name!r} in {zone}", "tables": self._sources(zone)}
        return read_zone(self.spark, self.zones[zone], name, *kinds).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.monotonically_increasing_id()})

    def preview_table(self, zone: str, table: str, limit: int = 10) -> dict:
        df = self._table(zone, table)
        if isinstance(df, dict):
            return df
        return {"rows": [r.asDict(True) for r in preview(df, ["run_id", "_file", "_row"], limit).drop("_row").collect()], "total_files": df.select("_file").distinct().count()}

    def find_record(self, zone: str, field: str, value: str, table: str) -> dict:
        df = self._table(zone, table)
        if isinstance(df, dict):
            return df
        rows = [r.asDict(True) for r in find_record(df, field, value, ["run_id", "_file", "_row"]).drop("_row").collect()]
        return {"rows": [{k: v for k, v in r.items() if k != "truncated"} for r in rows], "truncated": bool(rows) and rows[0]["truncated"]}

    def trace_lineage(self, audit, zone: str, table: str, field: str, customer_id: str) -> dict:
        """Change events count as Bronze rows, too."""
        df = self._table(zone, table, "data", "cdc")
        if isinstance(df, dict):
            return df
        bronze = df.select("source_system", F.col("run_id").cast("string").alias("run_id"), F.monotonically_increasing_id().alias("row_id"))
        return {"chain": [r.asDict() for r in trace(audit, bronze, field, customer_id).orderBy(F.col("step").desc(), "run_id", "row_id").collect()]}

    def get_source_schema(self, source: str) -> dict:
        return source_schema(source)
