"""Filling containers of fixed capacity with texts, planned on the histogram of lengths.

Best fit runs over counts of equal lengths, not over texts: a step places as many equal texts as there are equal
openings. The plan names, for each length, which rank goes into which container; texts take their slots by joining
on rank within length. Only a text longer than a container is cut, into full containers and one rest.
"""

from __future__ import annotations

import base64
import bisect
import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..session import Scratch

_WORD = re.compile(r"\w+|[^\w\s]+")
#: Slots that one row of the plan is expanded to at most, and texts that are ranked in one part of a length, on average.
CHUNK, PART = 100_000, 100_000


@lru_cache(4)
def _bpe(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_spans(text: str) -> list[tuple[int, int]]:
    """Places of the word-and-punctuation tokens."""
    return [m.span() for m in _WORD.finditer(text)]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: str | None = None, vocabulary: str | None = None, pattern: str = r"\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+|\s+") -> DataFrame:
    """(doc_id, n): tokens of every text.

    Without a vocabulary tokens are words and punctuation runs (`\\w+|[^\\w\\s]+`), and where the column `known`
    already has their number that is trusted and the text isn't counted. vocabulary is the path of a byte-pair file of public
    ranks, readable on every executor. A null text has no token.
    """

    def count(i, t):
        if t is None:
            return ((i, 0),)
        return ((i, len(_bpe(vocabulary, pattern).encode_ordinary(t)) if vocabulary else len(_WORD.findall(t))),)

    if not known or vocabulary:
        return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), count, "doc_id bigint, n bigint")
    had = docs.filter(F.col(known).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(known).cast("bigint").alias("n"))
    rest = docs.filter(F.col(known).isNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return had.unionByName(map_rows(rest, count, "doc_id bigint, n bigint"))


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(runs, containers) of best fit over a histogram {length: count}, longest first.

    A run (length, first rank, count, first container) puts texts of the ranks first, first + 1, ... into containers
    of consecutive numbers, one each.
    """
    rooms: dict[int, list[list[int]]] = {}  # free tokens: ranges [first container, count]
    free: list[int] = []  # the keys of rooms, in order
    runs, containers = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room == 0:
            return
        if room not in rooms:
            rooms[room] = []
            bisect.insort(free, room)
        rooms[room].append([first, count])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                # no opening: as many new containers as best fit would fill with this length alone
                n = -(-left // (capacity // length))
                put(capacity, containers, n)
                containers += n
                continue
            room = free[at]
            first, count = rooms[room][-1]
            k = min(left, count)
            if k == count:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    free.pop(at)
            else:
                rooms[room][-1] = [first + k, count - k]
            runs.append((length, rank, k, first))
            put(room - length, first, k)
            rank, left = rank + k, left - k
    return runs, containers


def pack(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind_name, container, doc_id, piece, first_token, n_tokens): every token of every text once per kind of container.

    counts: (doc_id, n); kinds: (kind_name, capacity_tokens), a short fixed list. Containers are named `full:<doc_id>:
    <piece>` if one text fills them, else `mixed:<number>`. Texts without tokens need no container; kinds without a
    name or a positive capacity are left out. Equal lengths are told apart by rank, repeated rows are packed as often
    as they come. The histogram, at most one number per token of capacity, is all that the driver sees, and the plan
    that it sends back has at most one row per length and room, whatever the number of texts, but for pieces of CHUNK.
    The counts are written first, so whatever they are made of is read once.
    """
    spark = counts.sparkSession
    counts = Scratch(spark, "tokens").put(counts)
    salt = max(8, counts.count() // PART + 1)
    sizes = {r.kind_name: int(r.capacity_tokens) for r in kinds.select("kind_name", "capacity_tokens").distinct().collect() if r.kind_name is not None and (r.capacity_tokens or 0) > 0}
    schema = "kind_name string, container string, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint"
    if not sizes:
        return spark.createDataFrame([], schema)
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind_name"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(sizes.items())])).alias("k")
    each = counts.filter("n > 0").select("doc_id", "n", kind).select("doc_id", "n", "k.*").withColumns({"full": F.expr("n div capacity"), "length": F.col("n") % F.col("capacity")})
    whole = each.filter("full > 0").select("kind_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("kind_name", F.concat(F.lit("full:"), "doc_id", F.lit(":"), "piece").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"))
    rest = each.filter("length > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int"))

    parts = rest.groupBy("kind_name", "length", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("kind_name", "length").orderBy("part")
    offsets = parts.withColumn("before", F.sum("c").over(before) - F.col("c")).select("kind_name", "length", "part", "before")
    histogram: dict[str, dict[int, int]] = {k: {} for k in sizes}
    for r in parts.groupBy("kind_name", "length").agg(F.sum("c").alias("c")).collect():  # at most one row per token of capacity
        histogram[r.kind_name][r.length] = r.c
    plan = []
    for name, h in histogram.items():
        for length, rank, count, first in best_fit(h, sizes[name])[0]:
            plan.extend((name, length, rank + s, min(CHUNK, count - s), first + s) for s in range(0, count, CHUNK))
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("i")
    slots = spark.createDataFrame(plan, "kind_name string, length bigint, rank bigint, c bigint, first bigint").select("kind_name", "length", "rank", "first", step)
    slots = slots.select("kind_name", "length", (F.col("rank") + F.col("i")).alias("rank"), (F.col("first") + F.col("i")).alias("bin"))

    local = F.row_number().over(Window.partitionBy("kind_name", "length", "part").orderBy("doc_id")) - 1
    ranked = rest.withColumn("local", local).join(offsets, ["kind_name", "length", "part"]).withColumn("rank", F.col("local") + F.col("before"))
    mixed = ranked.join(slots, ["kind_name", "length", "rank"]).select("kind_name", F.concat(F.lit("mixed:"), "bin").alias("container"), "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("first_token"), F.col("length").alias("n_tokens"))
    return whole.unionByName(mixed)


def fill(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind_name, capacity_tokens, containers, least_possible, tokens, fill): how full the containers are."""
    used = packed.groupBy("kind_name", "container").agg(F.sum("n_tokens").alias("t")).groupBy("kind_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("most"))
    cap = F.col("capacity_tokens")
    return used.join(kinds.select("kind_name", "capacity_tokens").distinct(), "kind_name").select("kind_name", "capacity_tokens", "containers", F.ceil(F.col("tokens") / cap).alias("least_possible"), "tokens", "most", (F.col("tokens") / (F.col("containers") * cap)).alias("fill"))
