"""Gate as a process: JSON on stdin ({"table": ..., "path": ...} or {"table": ..., "rows": [...]}), exit code 0 to go on, 2 to stop.

A table that isn't named is that of the path, the segment after `gold`; without readable rows there is nothing to stop.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .functions.values import table_of
from .operators.quality import CONTRACTS, check_gold_write, load_contract
from .session import build_session


def _rows(spark: SparkSession, payload: dict):
    if payload.get("path"):
        return spark.read.json(payload["path"])
    rows = [r for r in payload.get("rows") or [] if isinstance(r, dict)]
    if not rows:
        return None
    columns = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {k: "double" if all(isinstance(r.get(k), (int, float, type(None))) for r in rows) and any(r.get(k) is not None for r in rows) else "string" for k in columns}
    data = [[None if r.get(k) is None else float(r[k]) if kinds[k] == "double" else str(r[k]) for k in columns] for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{k}` {kinds[k]}" for k in columns))


def decide(spark: SparkSession, text: str, audit: str | None = None, folder=CONTRACTS) -> tuple[int, str]:
    try:
        payload = json.loads(text)
    except ValueError:
        return 0, "no payload"
    if isinstance(payload, dict) and not payload.get("table") and payload.get("path"):
        payload["table"] = table_of(str(payload["path"]))
    if not isinstance(payload, dict) or not payload.get("table"):
        return 0, "not a Gold write"
    try:
        load_contract(payload["table"], folder)
    except FileNotFoundError as e:
        return 2, str(e)
    df = _rows(spark, payload)
    if df is None:
        return 0, "no readable rows"
    allowed, results = check_gold_write(payload["table"], df, audit, folder)
    return (0, "allowed") if allowed else (2, "; ".join(v for r in results if not r.passed for v in r.violations))


if __name__ == "__main__":
    code, why = decide(build_session("gate"), sys.stdin.read())
    print(why, file=sys.stderr)
    sys.exit(code)
