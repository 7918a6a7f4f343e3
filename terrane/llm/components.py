"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponential shift; clusters grow from the vertices whose shifted start comes first, and a
vertex joins the cluster that reaches it first. Clusters contract to super-vertices, the edges left between
clusters are decomposed again, and the assignments of all levels are composed. Links, components and vertices stay
distributed; each level is written to the shared folder, so nothing is recomputed when an executor is lost. The last
levels, of few edges, would be nothing but scheduling; they run in one task, by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_lists
from ..session import Scratch

#: Edges that the last levels are finished with in one task: 16 bytes each, so under 1 MB.
TAIL = 50_000
#: Share of the members from which a group is joined by broadcast: at most 1,000 groups can have it.
HEAVY = 0.001
#: Growth rounds of one level; shifts are truncated to it, so the growth has ended when the rounds have.
ROUNDS = 8
#: Rate of the exponential shifts: larger means smaller clusters.
BETA = 0.25


def _start(vertex: Column, level: int) -> Column:
    """When a vertex begins a cluster of its own: ROUNDS less its exponential shift, truncated at 0."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 40)).cast("double") + 1.0) / F.lit(float(1 << 40) + 1)
    return F.greatest(F.lit(0.0), F.lit(float(ROUNDS)) + F.log(u) / F.lit(BETA))


def _grow(edges: DataFrame, level: int) -> DataFrame:
    """(id, centre) of every vertex, after the shifted growth along symmetric edges (src, dst) with a loop at every vertex.

    The loops carry a vertex's own arrival over to the next round, so each round is one join and one minimum.
    """
    step = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(1.0)
    offer = lambda at, centre: F.struct((at + step).alias("at"), centre.alias("centre")).alias("best")
    label = edges.select(F.col("dst").alias("id"), offer(_start(F.col("src"), level), F.col("src"))).groupBy("id").agg(F.min("best").alias("best"))
    for _ in range(ROUNDS - 1):
        reached = edges.join(label.hint("merge"), edges.src == label.id).select(F.col("dst").alias("id"), offer(F.col("best.at"), F.col("best.centre")))
        label = reached.groupBy("id").agg(F.min("best").alias("best"))
    return label.select("id", F.col("best.centre").alias("centre"))


def _finish(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """(id, centre) of all vertices of a few edges, by the same levels in one task: grow, contract, compose."""
    rows = [(np.asarray(b["src"], np.int64), np.asarray(b["dst"], np.int64)) for b in batches]
    if not rows:
        return
    ends = [np.concatenate(x) for x in zip(*rows)]
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    src, dst = at[: len(ends[0])], at[len(ends[0]) :]
    top, rng = np.arange(len(ids)), np.random.default_rng(len(ids))
    while (src != dst).any():
        began = np.maximum(0.0, ROUNDS - rng.exponential(1 / BETA, len(ids)))
        centre = np.arange(len(ids))
        for _ in range(ROUNDS):
            offer = began[src] + (src != dst)
            order = np.lexsort((centre[src], offer, dst))
            first = order[np.unique(dst[order], return_index=True)[1]]
            began[dst[first]], centre[dst[first]] = offer[first], centre[src[first]]
        top = centre[top]
        edge = np.unique(np.stack([centre[src], centre[dst]]), axis=1)
        loops = np.unique(edge)
        src, dst = np.concatenate([edge[0], loops]), np.concatenate([edge[1], loops])
    yield {"id": ids.tolist(), "centre": ids[top].tolist()}


def _with_loops(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (src, dst) of edges given both ways, and a loop at each of their vertices."""
    pair = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(a).alias("src"), F.col(a).alias("dst"))))
    return edges.select(pair.alias("e")).select("e.*").distinct()


def group_ids(links: DataFrame, a: str, b: str) -> DataFrame:
    """(record_id, group_id) of every record linked to another one; group_id is the least record id of the group.

    links has one row per link; repeated and reversed links count once, a link of a record with itself links nothing
    and rows with a null id are ignored. No links give no rows. Order of ids is that of their UTF-8 bytes.
    """
    pair = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    pair = pair.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    scratch = Scratch(links.sparkSession, "groups")
    pair = scratch.put(pair)
    names = pair.select(F.explode(F.array("x", "y")).alias("record_id")).distinct()
    names = scratch.put(names.withColumn("id", F.monotonically_increasing_id()))
    one = names.select(F.col("record_id").alias("x"), F.col("id").alias("src"))
    two = names.select(F.col("record_id").alias("y"), F.col("id").alias("dst"))
    half = pair.join(one, "x").join(two, "y").select("src", "dst")
    edges = scratch.put(_with_loops(half.union(half.select("dst", "src")), "src", "dst"))
    total, levels = names.count(), []
    while (left := edges.count()) > TAIL:
        at = scratch.n
        grown = scratch.put(_grow(edges, len(levels)))
        levels.append(grown)
        c1 = grown.select(F.col("id").alias("src"), F.col("centre").alias("s"))
        c2 = grown.select(F.col("id").alias("dst"), F.col("centre").alias("d"))
        # a super-vertex with very many edges is reduced before the second join
        moved = edges.filter("src <> dst").join(c1, "src").select("s", "dst").distinct().join(c2, "dst").filter("s <> d")
        edges = scratch.put(_with_loops(moved, "s", "d"))
        scratch.drop(at)
    if not levels and not left:
        return names.select("record_id", F.col("record_id").alias("group_id")).limit(0)
    upper = scratch.put(map_lists(edges.coalesce(1), _finish, "id bigint, centre bigint"))
    for lower in reversed(levels):
        up = upper.select(F.col("id").alias("centre"), F.col("centre").alias("top"))
        upper = scratch.put(lower.join(up, "centre", "left").select("id", F.coalesce("top", "centre").alias("centre")))
    member = scratch.put(names.join(upper, "id").select("record_id", "centre"))
    least = scratch.put(member.groupBy("centre").agg(F.min("record_id").alias("group_id"), F.count(F.lit(1)).alias("n")))
    # a giant group would meet in one task: groups of a set share of all members are few, and their rows stay where they are
    heavy = F.broadcast(least.filter(F.col("n") >= max(2, total * HEAVY)).select("centre", F.col("group_id").alias("heavy")))
    split = member.join(heavy, "centre", "left")
    rest = split.filter("heavy is null").select("record_id", "centre").join(least.select("centre", "group_id").hint("merge"), "centre")
    out = split.filter("heavy is not null").select("record_id", F.col("heavy").alias("group_id")).union(rest.select("record_id", "group_id"))
    return scratch.result(out)


def match_links(results: DataFrame) -> DataFrame:
    """The rows of match_result that link: match is true and both ids name a record."""
    named = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "unknown")
    return results.filter(F.col("match") & named("record_a_id") & named("record_b_id")).select("record_a_id", "record_b_id")
