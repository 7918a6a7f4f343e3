"""Profiles of sources: five scores from 0 to 100, in one pass over each source."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import PII, positive_integer, present
from ..sources.storage import newest_json, write_new
from .lineage import REGISTRY

# Share of each dimension in the health of a source, in percent.
WEIGHTS = {"completeness": 25, "freshness": 20, "key_coverage": 25, "anomaly": 20, "pii": 10}
FRESH_HOURS, STALE_HOURS = 24, 365 * 24


@dataclass(frozen=True)
class Source:
    name: str
    columns: tuple[str, ...]
    key: str
    valid_key: Column
    newest: str | None = None  # column of the newest record's time
    anomalies: tuple[tuple[str, Column], ...] = ()


def profile(df: DataFrame, s: Source, now: datetime) -> DataFrame:
    """One row: the five scores, health (whole number), record_count and the anomalies found. An empty source scores 0."""
    cells = sum((F.count_if(present(F.col(c))) for c in s.columns), F.lit(0))
    seconds = F.lit(int(now.timestamp())) - F.unix_seconds(F.max(F.col(s.newest)).cast("timestamp")) if s.newest else F.lit(STALE_HOURS * 3600)
    flags = [F.when(F.count_if(F.coalesce(t, F.lit(False))) > 0, F.lit(n)) for n, t in s.anomalies] or [F.lit(None).cast("string")]
    # the patterns need an @ or a digit and a separator, so most cells are told by a character
    worth = lambda v: v.contains("@") | v.rlike("[0-9][-. )]")
    personal = [F.max(F.when(F.coalesce(worth(v) & v.rlike("|".join(PII.values())), F.lit(False)), 1).otherwise(0)) for v in (F.col(c).cast("string") for c in s.columns)]
    d = df.agg(F.count(F.lit(1)).alias("n"), cells.alias("cells"), F.count_if(F.coalesce(s.valid_key, F.lit(False))).alias("keys"), seconds.alias("age"), F.array_compact(F.array(*flags)).alias("found"), sum(personal, F.lit(0)).alias("personal"))
    n, span = F.col("n"), (STALE_HOURS - FRESH_HOURS) * 3600
    some = lambda c: F.when(n > 0, F.greatest(F.lit(0), F.least(F.lit(100), c))).otherwise(0).cast("bigint")
    d = d.select(
        F.lit(s.name).alias("source"), F.col("n").alias("record_count"),
        some(F.floor(100 * F.col("cells") / (n * len(s.columns)))).alias("completeness"),
        some(F.floor(100 * (F.lit(STALE_HOURS * 3600) - F.coalesce("age", F.lit(STALE_HOURS * 3600))) / F.lit(span))).alias("freshness"),
        some(F.floor(100 * F.col("keys") / n)).alias("key_coverage"),
        some(100 - 10 * F.size("found")).alias("anomaly"), some(100 - 10 * F.col("personal")).alias("pii"),
        F.array_join("found", ",").alias("issues"),
    )
    health = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    return d.withColumn("health", F.floor(health / 100).cast("bigint"))


SAMPLE, TOP_ISSUES = 5, 3


def top_issues(profile_row: dict) -> list[str]:
    """The three worst things of a source: its weakest dimensions below 100 and its anomalies, the lowest score first."""
    low = [(profile_row[k], f"{k} {profile_row[k]}") for k in WEIGHTS if profile_row[k] < 100]
    odd = [(profile_row["anomaly"], x) for x in profile_row["issues"].split(",") if x]
    return [x for _, x in sorted(low + odd, key=lambda x: x[0])][:TOP_ISSUES]


def sample(df: DataFrame, order: str) -> DataFrame:
    """The first rows of a source, for a profiler outside."""
    return df.orderBy(order).limit(SAMPLE)


def profile_all(tables: dict[str, DataFrame], sources: list[Source], now: datetime) -> DataFrame:
    """All sources, the least healthy first."""
    out = None
    for s in sources:
        p = profile(tables[s.name], s, now)
        out = p if out is None else out.unionByName(p)
    return out.orderBy("health", "source")


Client = Callable[[DataFrame, Source], dict]  # a source and its rows -> the columns of profile() as a dict


def run_swarm(load: Callable[[str], DataFrame], sources: list[Source], now: datetime, client: Client | None = None) -> tuple[list[dict], dict[str, str]]:
    """(profiles with top_issues, the least healthy first; errors by source): one that fails doesn't stop the others.

    The sources' jobs run side by side, so the cluster's scheduler shares its executors between them.
    """

    def one(s: Source) -> dict:
        df = load(s.name)
        r = client(df, s) if client else profile(df, s, now).first().asDict()
        return r | {"top_issues": top_issues(r)}

    done, errors = [], {}
    with ThreadPoolExecutor(max_workers=max(1, len(sources))) as pool:
        for s, job in [(s, pool.submit(one, s)) for s in sources]:
            try:
                done.append(job.result())
            except Exception as e:  # noqa: BLE001
                errors[s.name] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return sorted(done, key=lambda r: (r["health"], r["source"])), errors


def overall(profiles: DataFrame) -> DataFrame:
    """The plain mean of health, to one place; 0.0 without sources."""
    return profiles.agg(F.coalesce(F.bround(F.avg("health"), 1), F.lit(0.0)).alias("overall_health"), F.count(F.lit(1)).alias("sources"))


def dashboard(spark: SparkSession, rows: list[dict], errors: dict[str, str], folder: str, now: datetime) -> dict:
    """Write the dashboard of a few sources as one JSON document, a new one each time, through the session's file system."""
    mean = round(sum(r["health"] for r in rows) / len(rows), 1) if rows else 0.0
    board = {"overall_health_score": mean, "generated_at": now.isoformat(), "sources": rows, "errors": errors}
    number, _ = newest_json(spark, folder)
    write_new(spark, f"{folder}/{number + 1:012d}.json", json.dumps(board, indent=2, default=str))
    return board


def bars(rows: list[dict]) -> str:
    return "\n".join(f"{r['source']:<12}{'█' * (r['health'] // 10):<11}{r['health']}" for r in rows)


def registered(name: str, newest: str | None = None) -> Source:
    """The profile settings of the sources at hand."""
    c = F.col
    if name == "pos":
        cols = tuple("customer_id first_name last_name email phone address order_date total_amount".split())
        odd = (("bad_amount", ~c("total_amount").rlike(r"\A-?[0-9]+(\.[0-9]+)?\z")), ("upper_mail", c("email").rlike("[A-Z]")), ("decorated_key", c("customer_id").isNotNull() & ~positive_integer(c("customer_id"))))
        return Source(name, cols, "customer_id", positive_integer(c("customer_id")), newest, odd)
    if name == "crm":
        cols = tuple("business_entity_id first_name last_name phone address_line1 city state postal_code dob notes".split())
        odd = (("short_zip", F.length("postal_code") < 5), ("odd_dob", c("dob").isNotNull() & (c("dob") != "") & ~c("dob").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")))
        return Source(name, cols, "business_entity_id", positive_integer(c("business_entity_id")), newest, odd)
    if name == "merger_a":
        return Source(name, tuple("account_id name dob address phone".split()), "account_id", positive_integer(c("account_id").cast("string")), newest, (("reversed_name", c("name").contains(",")),))
    if name in ("ecommerce", "loyalty", "merger_b"):
        key, cols = REGISTRY[name]
        valid = {"ecommerce": c(key).contains("@"), "loyalty": c(key).rlike(r"\A[0-9]{12}\z"), "merger_b": present(c(key))}[name]
        odd = {"ecommerce": (("upper_mail", c(key).rlike("[A-Z]")), ("plus_tag", c(key).contains("+"))), "loyalty": (("lost_zeros", F.length(key) < 12),), "merger_b": (("decorated_key", c(key).rlike("[^0-9]")),)}[name]
        return Source(name, tuple(cols), key, valid, newest, odd)
    cols = tuple("uuid first_name last_name email phone address_line1 city state".split())
    return Source(name, cols, "uuid", c("uuid").rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"), newest, (("plus_tag", c("email").contains("+")), ("upper_mail", c("email").rlike("[A-Z]"))))
