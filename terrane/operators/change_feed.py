"""Applying a feed of inserts, updates and deletes to a table kept as bucketed files with a manifest.

The table is copy-on-write: rows live in buckets by hash of the key, a manifest names the files of every bucket.
A batch of changes is deduplicated and routed to buckets; the rows of the touched buckets are merged in key order with
the changes that decide, and the replacement files become visible when the next manifest is committed. Beside the rows
every bucket keeps a log of its changes. It is read only for keys with an event that lands late, not after the newest
known millisecond: those keys are decided again from their whole history, so the rows don't depend on how the feed was
cut into batches. Deleted keys stay as tombstones with their time.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import map_lists
from ..functions.columns import stage
from ..session import Scratch
from ..sources.storage import list_dirs, list_files, newest_json, write_new

ROW = "key string, live boolean, image string, event_no bigint, ts_ms bigint"
LOG = "key string, ts_ms bigint, op string, moved boolean, before string, after string, event_no bigint"
_OUT = ("bucket", "key", "live", "image", "event_no", "ts_ms")
_SAME = ("key", "ts_ms", "op", "moved", "before", "after")


def keyed_changes(events: DataFrame, key: str) -> DataFrame:
    """The columns of LOG: one row per key that a change touches, equal changes once, with their lowest event_no.

    Images are JSON objects as text with keys in order; null for null, an empty object, or anything that is no JSON
    object. Changes are equal in op (any case), ts_ms, before and after. A change of key is a delete under the old key
    and an insert under the new one (moved). Changes without any key are left out, as they name no row; so are changes
    other than deletes without an after-image, as they say nothing.
    """
    v = stage(events.select("event_no", F.lower("op").alias("op"), "ts_ms", F.try_parse_json("before").alias("b"), F.try_parse_json("after").alias("a")), {
        f"{side}_{what}": x for side in "ba" for what, x in (("text", F.to_json(side)), ("key", F.try_variant_get(side, f"$.{key}", "string")))
    })
    image = lambda side: F.when(F.col(f"{side}_text").startswith("{") & (F.col(f"{side}_text") != "{}"), F.col(f"{side}_text"))
    d = v.select("event_no", F.coalesce("op", F.lit("r")).alias("op"), F.coalesce("ts_ms", F.lit(0).cast("bigint")).alias("ts_ms"), image("b").alias("before"), image("a").alias("after"), "b_key", "a_key")
    none, no = F.lit(None).cast("string"), F.lit(False)
    b, a = F.when(F.col("before").isNotNull(), F.col("b_key")), F.when(F.col("after").isNotNull(), F.col("a_key"))
    moved = (F.col("op") != "d") & b.isNotNull() & a.isNotNull() & (b != a)
    part = lambda k, op, mv, before, after: F.struct(k.alias("key"), op.alias("op"), mv.alias("moved"), before.alias("before"), after.alias("after"))
    out = (
        F.when(F.col("op") == "d", F.array(part(F.coalesce(b, a), F.lit("d"), no, F.col("before"), none)))
        .when(F.col("after").isNull(), F.array().cast("array<struct<key:string,op:string,moved:boolean,before:string,after:string>>"))
        .when(moved, F.array(part(b, F.lit("d"), F.lit(True), F.col("before"), none), part(a, F.lit("i"), F.lit(True), none, F.col("after"))))
        .otherwise(F.array(part(F.coalesce(a, b), F.col("op"), no, F.col("before"), F.col("after"))))
    )
    rows = d.select("ts_ms", "event_no", F.explode(out).alias("c")).select("c.*", "ts_ms", "event_no").filter("key is not null")
    return rows.groupBy(*_SAME).agg(F.min("event_no").alias("event_no"))


def deciding_changes(changes: DataFrame) -> DataFrame:
    """Of each key only the changes that can decide its state: the last one that is alone in its millisecond, and later ones.

    An after-image replaces the whole row, so nothing before the last lone change matters. Which one that is comes from
    counts by (key, millisecond) and a maximum by key, both combined before the shuffle and without images; a key with a
    third of all changes is one row of the join's small side, and AQE splits its other side.
    """
    lone = changes.groupBy("key", "ts_ms").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").groupBy("key").agg(F.max("ts_ms").alias("lone"))
    return changes.join(lone, "key", "left").filter("lone is null or ts_ms >= lone").drop("lone")


ABSENT, END = ("absent",), ("end",)


def _plain(v) -> str | None:
    """Values of images as they are compared: a number and its text are one."""
    return None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True)


def _sources(events: list[tuple], here) -> list[list]:
    """For each event (event_no, op, before, after) the states that it can follow: one or more images or ABSENT; [] for any image."""
    images = dict.fromkeys([] if here is ABSENT else [here])
    images.update(dict.fromkeys(e[3] for e in events if e[1] != "d"))
    parsed: dict[str, dict] = {}
    index: dict[tuple, dict[tuple, list]] = {}
    out = []
    for _, op, before, after in events:
        if op in ("i", "c"):
            out.append([ABSENT])
        elif op == "r":
            out.append([after])
        elif before is None:
            out.append([])
        elif before in images:
            out.append([before])
        else:  # a short form of some images, found by their values under its names
            part = json.loads(before)
            names = tuple(part)
            if names not in index:
                index[names] = defaultdict(list)
                for i in images:
                    whole = parsed.setdefault(i, json.loads(i))
                    if all(n in whole for n in names):
                        index[names][tuple(_plain(whole[n]) for n in names)].append(i)
            out.append(index[names].get(tuple(_plain(part[n]) for n in names)) or [before])
    return out


class _Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up.setdefault(y, y)
            x = y
        return x


def order_slot(events: list[tuple], live: bool, image: str | None) -> list[tuple]:
    """The order of the changes (event_no, op, before, after) of one key and millisecond in which images and existence fit.

    States are images and absence, a change is a step from the state it needs to the state it leaves, and the order is a
    walk over all steps from the state before that breaks as seldom as can be: a Euler walk in which the breaks are
    steps of their own. Among equal walks the one with the lowest event numbers first counts. A change whose before-image
    is short or missing follows the first state that lacks a next step and fits, the state before first; an `r` leaves
    the state as it was. Time and memory grow with the number of changes, whatever it is.
    """
    events = sorted(events)
    here = image if live and image is not None else ABSENT
    target = [ABSENT if op == "d" else after for _, op, _, after in events]
    options = _sources(events, here)
    spare: dict = defaultdict(int)  # steps into a state less steps out of it
    spare[here] += 1
    first_in: dict = {here: -1}
    for k, t in enumerate(target):
        spare[t] += 1
        first_in.setdefault(t, k)
    same = _Union()
    source: list = [o[0] if len(o) == 1 else None for o in options]
    for s, t in zip(source, target):
        if s is not None:
            spare[s] -= 1
            same.up[same.find(s)] = same.find(t)
    waiting: dict[int, list] = {}  # open states by the list of options
    anything = sorted((n for n in first_in if n is not ABSENT), key=first_in.__getitem__)
    for k, o in enumerate(options):
        if source[k] is not None:
            continue
        ranked = sorted(o, key=lambda n: first_in.get(n, len(events))) if o and id(o) not in waiting else []
        pool = waiting.setdefault(id(o) if o else 0, ranked if o else list(anything))
        while pool and spare[pool[0]] <= 0:
            pool.pop(0)
        own = same.find(target[k])
        root = same.find(here)
        s = next((n for n in pool if spare[n] > 0 and (same.find(n) != own or own == root and n != target[k])), None)
        if s is None and here is ABSENT and spare[ABSENT] > 0 and events[k][1] != "d":
            s = ABSENT  # it makes the row, which breaks less than a ring that nothing leads into
        if s is None:
            s = next((n for n in pool if spare[n] > 0), o[0] if o else ABSENT)
        source[k] = s
        spare[s] -= 1
        same.up[same.find(s)] = own
    steps: dict = defaultdict(list)  # state -> [(event, next state)], lowest event first; breaks (event -1) last
    for k in range(len(events)):
        steps[source[k]].append((k, target[k]))
    root = same.find(here)
    entries, open_parts = [], {root}
    for n, v in list(spare.items()):
        if v < 0:
            entries += [(steps[n][0][0], n)] * -v
            open_parts.add(same.find(n))
    for n in sorted(steps, key=lambda n: steps[n][0][0]):  # rings that nothing leads into
        if same.find(n) not in open_parts:
            open_parts.add(same.find(n))
            entries.append((steps[n][0][0], n))
            spare[n] += 1
    for n, v in spare.items():
        steps[n] += [(-1, END)] * max(v, 0)
    steps[END] = [(-1, n) for _, n in sorted(entries, key=lambda x: x[0])]
    for own in steps.values():
        own.reverse()
    path, walk = [], [(-1, here)]
    while walk:
        own = steps[walk[-1][1]]
        if own:
            walk.append(own.pop())
        else:
            path.append(walk.pop()[0])
    return [events[k] for k in reversed(path) if k >= 0]


def _merge(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Rows sorted by bucket, key, time, base first, become one row per key."""

    def rows():
        for b in batches:
            yield from zip(b["bucket"], b["key"], b["base"], b["ts_ms"], b["event_no"], b["op"], b["before"], b["after"])

    out: list[tuple] = []
    for (bucket, key), own in groupby(rows(), key=lambda r: r[:2]):
        live, image, no, at = False, None, None, None
        for at, slot in groupby(own, key=lambda r: r[3]):
            events = []
            for r in slot:
                if r[2] == 0:
                    live, image, no = r[5] != "d", r[7], r[4]
                else:
                    events.append(r[4:])
            for n, op, _, after in events if len(events) < 2 else order_slot(events, live, image):
                live, image, no = op != "d", None if op == "d" else after, n
        out.append((bucket, key, live, image, no, at))
        if len(out) >= 20_000:
            yield dict(zip(_OUT, zip(*out)))
            out = []
    if out:
        yield dict(zip(_OUT, zip(*out)))


class BucketedTable:
    """Current rows of a keyed table under `path`: data and log files by bucket, and manifests, of which the highest readable one counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int | None = None):
        self.spark, self.path, self.key = spark, path, key
        self.version, m = newest_json(spark, f"{path}/manifest")
        numbered = lambda files: {int(k): v for k, v in files.items()}
        self.buckets = m["buckets"] if m else buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.files, self.log = (numbered(m["files"]), numbered(m["log"])) if m else ({}, {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, files: dict[int, list[str]], schema: str) -> DataFrame:
        paths = [p for own in files.values() for p in own]
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df.select("*", self._bucket())

    def _written(self, df: DataFrame, kind: str) -> dict[int, list[str]]:
        """Write rows by bucket; the new files of each."""
        folder = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.write.partitionBy("bucket").parquet(folder)
        return {int(d.rpartition("bucket=")[2]): [f for f in list_files(self.spark, d) if f.endswith(".parquet")] for d in list_dirs(self.spark, folder) if "bucket=" in d}

    def _commit(self, files: dict[int, list[str]], log: dict[int, list[str]]) -> int:
        version = self.version + 1
        write_new(self.spark, f"{self.path}/manifest/{version:012d}.json", json.dumps({"version": version, "buckets": self.buckets, "files": files, "log": log}))
        self.version, self.files, self.log = version, files, log
        return version

    def state(self) -> DataFrame:
        """Live rows: key, image (canonical JSON), event_no, ts_ms."""
        return self._read(self.files, ROW).filter("live").select("key", "image", "event_no", "ts_ms")

    def apply(self, events: DataFrame) -> int:
        """Apply a batch of change events (event_no, op, ts_ms, before, after); gives the new version.

        Null op counts as r, null ts_ms as 0; repeated events change nothing; an empty batch commits nothing. Columns
        of other names are ignored. Any cut of the same events into batches, in any order, gives the same rows.
        """
        spark = self.spark
        batch = keyed_changes(events.select("event_no", "op", "ts_ms", "before", "after"), self.key)
        # rebalanced: small buckets share a file, a bucket with a hot key is written by several tasks
        new = self._written(batch.select("*", self._bucket()).hint("rebalance", "bucket"), "log")
        if not new:
            return self.version
        changes = self._read(new, LOG)
        touched = {b: self.files[b] for b in new if b in self.files}
        rows = deciding_changes(changes.drop("bucket"))
        scratch = None
        if touched:
            base = self._read(touched, ROW)
            known = base.select("key", F.col("ts_ms").alias("known"))
            scratch = Scratch(spark, "late")
            earliest = changes.groupBy("key").agg(F.min("ts_ms").alias("ts_ms"))
            late = scratch.put(earliest.join(known, "key").filter("ts_ms <= known").select("key"))
            again = {r.bucket for r in late.select(self._bucket()).distinct().collect()}  # at most one number per bucket
            if again:
                past = self._read({b: f for b, f in self.log.items() if b in again}, LOG).drop("bucket").join(late, "key", "left_semi")
                both = changes.drop("bucket").unionByName(past)
                rows = deciding_changes(both.groupBy(*_SAME).agg(F.min("event_no").alias("event_no")))
                base = base.join(late, "key", "left_anti")
        fields = lambda n: (F.lit(n).alias("base"), "ts_ms", "event_no", "op", "before", "after")
        routed = rows.select(self._bucket(), "key", *fields(1))
        if touched:
            old = base.select("bucket", "key", "ts_ms", "event_no", F.when(F.col("live"), "r").otherwise("d").alias("op"), F.lit(None).cast("string").alias("before"), F.col("image").alias("after"))
            routed = routed.unionByName(old.select("bucket", "key", *fields(0)))
        routed = routed.repartitionById(self.buckets, "bucket").sortWithinPartitions("bucket", "key", "ts_ms", "base", "event_no")
        files = self._written(map_lists(routed, _merge, f"bucket int, {ROW}"), "data")
        if scratch:
            scratch.drop(1)
        log = {b: self.log.get(b, []) + new.get(b, []) for b in self.log.keys() | new.keys()}
        return self._commit(self.files | files, log)

    def rebucket(self, buckets: int) -> int:
        """Rewrite rows and logs with another number of buckets, for a table that has outgrown its own; also joins small log files."""
        rows, log = self._read(self.files, ROW).drop("bucket"), self._read(self.log, LOG).drop("bucket")
        self.buckets = buckets
        sorted_rows = rows.select("*", self._bucket()).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "key")
        return self._commit(self._written(sorted_rows, "data"), self._written(log.select("*", self._bucket()).hint("rebalance", "bucket"), "log"))
