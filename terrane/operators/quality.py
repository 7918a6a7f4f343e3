"""Quality rules, their runner, and the gate in front of every Gold write.

A rule is an aggregate expression or a small filtered scan, never a pass of its own: all aggregate rules of a run
are evaluated by one aggregation over one scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from statistics import mean, stdev

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import PII, falsy
from ..sources.storage import file_system, newest_json, write_new
from .lineage import LINEAGE

BREAK, ALERT = "BREAK", "ALERT"


@dataclass(frozen=True)
class Result:
    rule_id: str
    policy: str
    violations: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.violations


@dataclass(frozen=True)
class Rule:
    """aggregate(df): named expressions of the shared aggregation; judge(values): messages; scan(df): messages of a rule that needs rows."""

    rule_id: str
    policy: str
    aggregate: Callable[[DataFrame], dict[str, Column]] = lambda df: {}
    judge: Callable[[dict], list[str]] = lambda values: []
    scan: Callable[[DataFrame], list[str]] | None = None


def missing(df: DataFrame, name: str) -> Column:
    """Falsy values of a column; a column that is not there is falsy in every row."""
    if name not in df.columns:
        return F.count(F.lit(1))
    return F.count_if(falsy(F.col(f"`{name}`"), df.schema[name].dataType))


def null_rate(name: str, threshold: float, policy: str = BREAK) -> Rule:
    """Share of falsy values above (not at) the threshold; empty data passes."""

    def judge(v):
        share = v[f"null_{name}"] / v["n"] if v["n"] else 0.0
        return [f"{name}: {share:.1%} missing, at most {threshold:.1%} allowed"] if share > threshold else []

    return Rule(f"null_rate_{name}", policy, lambda df: {f"null_{name}": missing(df, name)}, judge)


def drift(expected: list[str], columns: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns, lineage columns aside."""
    have = {c for c in columns if c not in LINEAGE}
    return sorted(set(expected) - have), sorted(have - set(expected))


def schema_drift(expected: list[str]) -> Rule:
    """Missing and unexpected columns; empty data passes."""

    def scan(df):
        lost, extra = drift(expected, df.columns)
        if not (lost or extra) or df.isEmpty():
            return []
        return [f"Missing columns: {lost}"] * bool(lost) + [f"Unexpected columns: {extra}"] * bool(extra)

    return Rule("schema_drift", BREAK, scan=scan)


def null_explosion(name: str, baseline: float, most: float = 0.1, policy: str = ALERT) -> Rule:
    """Share of falsy values more than `most` above the share that the column used to have."""
    rule = null_rate(name, baseline + most, policy)
    return Rule(f"null_explosion_{name}", policy, rule.aggregate, rule.judge)


def matcher_regression(rate: float, baseline: float, budget: float = 0.01) -> Rule:
    """The matcher's false-confidence rate against the stored one."""
    return Rule("matcher_regression", BREAK, judge=lambda v: [f"false confidence {rate:.4f}, was {baseline:.4f}"] if rate - baseline > budget else [])


def bounds(counts: list[int], sigma: float = 2.0) -> tuple[float, float]:
    """Inclusive range of usual volumes; a single or no baseline value counts as 10 % spread."""
    m = mean(counts) if counts else 0
    s = stdev(counts) if len(counts) > 1 else 0.1 * m
    return m - sigma * s, m + sigma * s


def volume_anomaly(counts: list[int], sigma: float = 2.0) -> Rule:
    low, high = bounds(counts, sigma)
    return Rule("volume_anomaly", ALERT, judge=lambda v: [] if low <= v["n"] <= high else [f"{v['n']} rows, expected {low:.0f} to {high:.0f}"])


def judge_volume(counts: list[int], sigma: float = 2.0) -> Result:
    """The volume rule for the first of the counts against the up to seven after it, newest first."""
    rule = volume_anomaly(counts[1:8], sigma)
    return Result(rule.rule_id, rule.policy, rule.judge({"n": counts[0] if counts else 0}))


def volume_by_day(counts: DataFrame, day: str, n: str, *keys: str, sigma: float = 2.0) -> DataFrame:
    """Each day's count against those of the seven days before it that have one; days without any baseline are no anomaly."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-7, -1)
    m = F.avg(n).over(w)
    s = F.when(F.count(n).over(w) > 1, F.stddev_samp(n).over(w)).otherwise(0.1 * m)
    d = counts.withColumns({"baseline": m, "spread": s})
    return d.withColumn("anomaly", F.coalesce((F.col(n) < F.col("baseline") - sigma * F.col("spread")) | (F.col(n) > F.col("baseline") + sigma * F.col("spread")), F.lit(False)))


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key is set and names no parent; types are compared strictly, so unlike types are all orphans."""
    rows = child.filter(F.col(fk).isNotNull())
    if dict(child.dtypes)[fk] != dict(parent.dtypes)[key]:
        return rows
    keys = parent.select(F.col(key).alias("__key")).distinct()
    return rows.join(keys, F.col(fk) == F.col("__key"), "left_anti")


def ref_integrity(fk: str, parent: DataFrame, key: str, order: str, cap: int = 10) -> Rule:
    """The first `cap` orphans in row order."""

    def scan(df):
        return [f"row {r[0]}: {fk}={r[1]!r} has no parent" for r in orphans(df, fk, parent, key).orderBy(order).select(order, fk).limit(cap).collect()]

    return Rule(f"ref_integrity_{fk}", BREAK, scan=scan)


def pii_fields(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """Array of `field:kind`, the first kind found per field, in field order; underscored columns are not searched."""
    out = []
    for name, dtype in df.dtypes:
        if name.startswith("_") or name in skip or dtype.startswith(("array", "map", "struct")):
            continue
        c = F.when(falsy(F.col(f"`{name}`"), df.schema[name].dataType), "").otherwise(F.col(f"`{name}`").cast("string"))
        kind = F.when(F.lit(False), "")
        for k, pattern in PII.items():
            kind = kind.when(c.rlike(pattern), f"{name}:{k}")
        out.append(kind)
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def pii(order: str | None = None, most: int = 5) -> Rule:
    """Personal data in Gold: rows are taken in order until at least `most` findings are held, and then a marker is added."""

    def scan(df):
        d = df.select(F.col(order) if order else F.monotonically_increasing_id().alias("_row"), pii_fields(df, (order,) if order else ()).alias("f"))
        out: list[str] = []
        for r in d.filter(F.size("f") > 0).orderBy(d.columns[0]).limit(most).collect():
            out += [f"row {r[0]}: {x.split(':')[1]} in {x.split(':')[0]}" for x in r[1]]
            if len(out) >= most:
                out.append("further findings are left out")
                break
        return out

    return Rule("pii_in_gold", BREAK, scan=scan)


def run_checks(df: DataFrame, rules: list[Rule]) -> list[Result]:
    """Every rule, in order; the aggregate rules share one scan."""
    wanted = {"n": F.count(F.lit(1))}
    for r in rules:
        wanted |= r.aggregate(df)
    values = df.agg(*[x.alias(k) for k, x in wanted.items()]).first().asDict()
    return [Result(r.rule_id, r.policy, r.scan(df) if r.scan else r.judge(values)) for r in rules]


def breaks(results: list[Result]) -> bool:
    return any(r.policy == BREAK and not r.passed for r in results)


CONTRACTS = Path(__file__).resolve().parent.parent / "gold"


def load_contract(name: str, folder: Path = CONTRACTS) -> dict:
    path = folder / f"{name}.json"
    if not path.exists():
        raise FileNotFoundError(f"no schema contract for table {name!r}: register one as {path}")
    return json.loads(path.read_text())


def gold_rules(contract: dict, order: str | None = None) -> list[Rule]:
    """Drift, personal data, then per column: not nullable breaks at the first missing value, a threshold alerts."""
    rules = [schema_drift(list(contract["columns"])), pii(order)]
    for name, c in contract["columns"].items():
        if c.get("nullable") is False:
            rules.append(null_rate(name, 0.0, BREAK))
        elif c.get("null_threshold"):
            rules.append(null_rate(name, c["null_threshold"], ALERT))
    return rules


def check_gold_write(table: str, df: DataFrame, audit: str | None = None, folder: Path = CONTRACTS) -> tuple[bool, list[Result]]:
    """(allowed, results); every evaluation is appended to the audit folder, allowed or not."""
    results = run_checks(df, gold_rules(load_contract(table, folder)))
    allowed = not breaks(results)
    if audit:
        entry = {"ts": datetime.now(timezone.utc).isoformat(), "table": table, "allowed": allowed, "record_count": df.count(), "results": [{"rule_id": r.rule_id, "policy": r.policy, "passed": r.passed, "violations": r.violations} for r in results]}
        write_new(df.sparkSession, f"{audit}/{entry['ts'].replace(':', '')}.json", json.dumps(entry) + "\n")
    return allowed, results


def publish(table: str, df: DataFrame, target: str, audit: str, folder: Path = CONTRACTS) -> bool:
    """Write, audit, publish: the rows are staged, checked as staged, and become the newest version only if nothing breaks.

    Every version has a folder of its own, and a numbered pointer, made whole or not at all, names the one that counts:
    readers never see a gap, a crash leaves the last version, and of two writers of one version the second fails. The
    version before the newest stays for readers that have it open; older ones are deleted.
    """
    spark, staged = df.sparkSession, f"{target}/data/{uuid.uuid4().hex}"
    df.write.parquet(staged)
    allowed, _ = check_gold_write(table, spark.read.parquet(staged), audit, folder)
    if not allowed:
        _delete(spark, staged)
        return False
    number, old = newest_json(spark, f"{target}/versions")
    kept = [x for x in (old or {}).get("kept", []) if x]
    write_new(spark, f"{target}/versions/{number + 1:012d}.json", json.dumps({"data": staged, "kept": [staged, *kept[:1]]}))
    for x in kept[1:]:
        _delete(spark, x)
    return True


def _delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = file_system(spark, path)
    fs.delete(p, True)


def published(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest published version; None before the first."""
    _, version = newest_json(spark, f"{target}/versions")
    return spark.read.parquet(version["data"]) if version else None
