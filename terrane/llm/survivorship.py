"""One surviving record per group of duplicates, chosen by consistent bundles.

Fields that depend on each other (the parts of an address, of a name) form a bundle that is taken from one source
as a whole. Which source gives which bundle is decided per group by branch and bound, maximising trust under
functional dependencies between bundles. With bundles of one field and no dependency this is the project's own
field-by-field survivorship.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..operators.golden import FREE_TEXT as LONGEST
from ..operators.golden import PRECEDENCE

TOP, LISTED, FALLBACK, LONG = 1.0, 0.8, 0.5, 0.7

#: One point of confidence outweighs any place in an order of at most this many candidates.
_SCALE = 1_000_000


@dataclass(frozen=True)
class Rules:
    bundles: tuple[tuple[str, ...], ...] = ()
    #: (a, b): the value of a decides the value of b.
    dependencies: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Candidate:
    source: str
    record_id: int
    values: dict


def present(field: str, value: str | None) -> bool:
    """Whether a value can survive: any text for free-text fields, else any that isn't blank."""
    return bool(value) if field in LONGEST else value is not None and value.strip() != ""


def trusted(field: str, cands: list[Candidate]) -> list[tuple[int, float, str]]:
    """(trust, confidence, rule) of each candidate's value of the field; trust 0 for no value."""
    out = []
    order = PRECEDENCE.get(field, ())
    if field in LONGEST:
        ranks = sorted(range(len(cands)), key=lambda i: (-len(cands[i].values.get(field) or ""), i))
        place = {i: n for n, i in enumerate(ranks)}
    for i, c in enumerate(cands):
        if not present(field, c.values.get(field)):
            out.append((0, 0.0, ""))
        elif field in LONGEST:
            out.append((int(LONG * _SCALE) - place[i], LONG, f"longest_populated_{field}"))
        elif c.source in order:
            conf = TOP if c.source == order[0] else LISTED
            out.append((int(conf * _SCALE) - order.index(c.source), conf, f"source_precedence_{field}"))
        else:
            out.append((int(FALLBACK * _SCALE) - i, FALLBACK, f"fallback_first_nonnull_{field}"))
    return out


def survive(cands: list[Candidate], rules: Rules) -> Iterator[tuple]:
    """(field, value, source, record_id, rule, confidence) of every field any candidate has."""
    fields = sorted({f for c in cands for f in c.values})
    bundled = {f for b in rules.bundles for f in b}
    bundles = [tuple(f for f in b if f in fields) for b in rules.bundles] + [(f,) for f in fields if f not in bundled]
    bundles = [b for b in bundles if b]
    trust = {f: trusted(f, cands) for f in fields}
    options = []
    for b in bundles:
        own = [(sum(trust[f][i][0] for f in b), i) for i in range(len(cands))]
        own = sorted(((t, i) for t, i in own if t), key=lambda x: (-x[0], x[1]))
        options.append(own or [(0, -1)])
    where = {f: k for k, b in enumerate(bundles) for f in b}
    #: value pairs that some record shows together, and the left values that occur with any right value
    seen = {d: {(c.values.get(d[0]), c.values.get(d[1])) for c in cands if present(d[0], c.values.get(d[0])) and present(d[1], c.values.get(d[1]))} for d in rules.dependencies if d[0] in where and d[1] in where and where[d[0]] != where[d[1]]}

    def consistent(choice: list[int], k: int) -> bool:
        for (a, b), pairs in seen.items():
            ka, kb = where[a], where[b]
            if max(ka, kb) != k or choice[ka] < 0 or choice[kb] < 0:
                continue
            va, vb = cands[choice[ka]].values.get(a), cands[choice[kb]].values.get(b)
            if present(a, va) and present(b, vb) and (va, vb) not in pairs and any(x == va for x, _ in pairs):
                return False
        return True

    reach = [0] * (len(bundles) + 1)  # the most trust that bundles k.. can still add
    for k in range(len(bundles) - 1, -1, -1):
        reach[k] = reach[k + 1] + options[k][0][0]
    best: tuple[int, list[int]] = (-1, [])

    def search(k: int, total: int, choice: list[int]) -> None:
        nonlocal best
        if total + reach[k] <= best[0]:
            return
        if k == len(bundles):
            best = (total, choice[:])
            return
        for t, i in [*options[k], (0, -1)] if seen and options[k][0][1] >= 0 else options[k]:
            choice.append(i)
            if consistent(choice, k):
                search(k + 1, total + t, choice)
            choice.pop()

    search(0, 0, [])
    for b, i in zip(bundles, best[1]):
        for f in b:
            t, conf, rule = trust[f][i] if i >= 0 else (0, 0.0, "")
            if t:
                yield f, cands[i].values[f], cands[i].source, cands[i].record_id, rule, conf
            else:
                yield f, None, "none", None, f"longest_populated_{f}" if f in LONGEST else f"no_value_{f}", 0.0


def surviving_fields(long: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Golden records of all clusters of two or more records, one row per cluster and field of any of its sources.

    long: (cluster_id, record_id, member_pos, source_system, field_name, value, updated_at). Of several records of
    one source the last in member_pos counts, as a whole, in the place of the first. Repeated rows count once; where
    one record gives a field twice, the later updated_at counts, then the greater value. Rows without cluster, record
    or field name belong to no golden record and are left out; a field without a value comes out with source `none`.

    Aggregations reduce per record, then per (cluster, source) with map-side combine, so a cluster with a third of
    all rows arrives as one row per source.
    """
    rows = long.filter("cluster_id is not null and record_id is not null and field_name is not null")
    source = F.coalesce("source_system", F.lit("unknown")).alias("source")
    cell = F.struct("field_name", F.col("updated_at").cast("string").alias("at"), "value")
    records = rows.groupBy("cluster_id", source, "record_id", "member_pos").agg(F.collect_set(cell).alias("cells"))
    last = F.max(F.struct("member_pos", "record_id")).alias("last")
    by_source = records.groupBy("cluster_id", "source").agg(last, F.max_by("cells", F.struct("member_pos", "record_id")).alias("cells"), F.min("member_pos").alias("first"), F.count(F.lit(1)).alias("n"))
    clusters = by_source.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "source", F.col("last.record_id").alias("record_id"), "cells"))).alias("members")).filter("n >= 2").drop("n")

    def one(cluster_id, members):
        cands = []
        for m in members:
            values = {}
            for c in sorted(m["cells"], key=lambda c: (c["at"] or "", c["value"] is not None, c["value"] or "")):
                values[c["field_name"]] = c["value"]
            cands.append(Candidate(m["source"], m["record_id"], values))
        return ((cluster_id, *x) for x in survive(cands, rules))

    return map_rows(clusters, one, "cluster_id string, field_name string, value string, source_system string, record_id bigint, rule_name string, confidence double")
