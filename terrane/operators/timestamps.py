"""Mixed timestamp notations and zones, brought to one instant in UTC.

An ordered cascade of anchored patterns rewrites each value into one canonical piece list; the first pattern that
matches the whole value decides. Everything stays in JVM expressions: no Python per row, no shuffle beyond the
zone lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stage

# Month names and zone abbreviations with the zones that use them (hours east of UTC, times 60).
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
DAYS = "SunMonTueWedThuFriSat"
US = {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600}
EUROPE = {"WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180}
BY_ZONE = {
    "Europe/London": {"BST": 60},
    "Europe/Dublin": {"IST": 60},
    "Asia/Kolkata": {"IST": 330},
    "Asia/Jerusalem": {"IST": 120, "IDT": 180},
    "Asia/Tokyo": {"JST": 540},
    "Asia/Seoul": {"KST": 540},
    "Asia/Shanghai": {"CST": 480},
    "Asia/Manila": {"PST": 480},
    "Australia/Sydney": {"AEST": 600, "AEDT": 660},
    "Australia/Melbourne": {"AEST": 600, "AEDT": 660},
    "Australia/Hobart": {"AEST": 600, "AEDT": 660},
    "Australia/Brisbane": {"AEST": 600},
    "Australia/Adelaide": {"ACST": 570, "ACDT": 630},
    "Australia/Darwin": {"ACST": 570},
    "Australia/Perth": {"AWST": 480},
    "Pacific/Auckland": {"NZST": 720, "NZDT": 780},
    "Europe/Moscow": {"MSK": 180},
}

_DAY_US = 86_400_000_000
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_TAIL = r"\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})?(?:\[([A-Za-z0-9_+/-]+)\])?"
_AMPM = r"(?: ?([AaPp][Mm]))?"
_DOW = r"(?:(Sun|Mon|Tue|Wed|Thu|Fri|Sat), )?"
_MON = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"

# name, pattern, template of: year|month|day|hour|minute|second|fraction|am/pm|offset or abbreviation|zone|weekday
PATTERNS: list[tuple[str, str, str]] = [
    ("iso", rf"\A(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME}{_TAIL}\z", "$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
    ("ymd_slash", rf"\A(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[T ]{_TIME}{_AMPM}{_TAIL}\z", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|"),
    ("day_dot", rf"\A(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_TIME}{_AMPM}{_TAIL}\z", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|"),
    ("slash", rf"\A(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_TIME}{_AMPM}{_TAIL}\z", "$3|#$1|#$2|$4|$5|$6|$7|$8|$9|$10|"),
    ("month_first", rf"\A{_MON} (\d{{1,2}}), (\d{{4}}),? {_TIME}{_AMPM}{_TAIL}\z", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|"),
    ("day_first", rf"\A{_DOW}(\d{{1,2}}) {_MON} (\d{{4}}) {_TIME}{_AMPM}{_TAIL}\z", "$4|$3|$2|$5|$6|$7|$8|$9|$10|$11|$1"),
    ("compact", rf"\A(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_TAIL}\z", "$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
]


def civil_micros(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Micros of a wall time read as UTC; null for anything that is no real date and time of day."""
    real = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    ts = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    return F.when(real, F.unix_micros(ts) + (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000)


def _offset(micros: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone)) - micros


def _abbreviation_minutes(abbr: Column, zone: Column) -> Column:
    """Minutes east of UTC of an abbreviation as used in the zone; UTC and GMT hold anywhere."""
    known = {f"|{a}": 0 for a in ("Z", "UTC", "GMT")}
    known |= {f"{z}|{a}": m for z, own in BY_ZONE.items() for a, m in own.items()}
    known |= {f"America|{a}": m for a, m in US.items()} | {f"Europe|{a}": m for a, m in EUROPE.items()}
    table = F.expr("map(" + ", ".join(f"'{k}', {m}" for k, m in known.items()) + ")")
    region = F.when(zone.rlike(r"\A(America/|US/|Canada/|Pacific/Honolulu)"), "America").when(zone.startswith("Europe/"), "Europe")
    look = lambda k: F.try_element_at(table, F.concat(k, F.lit("|"), abbr))
    return F.coalesce(look(F.lit("")), look(zone), look(region))


def normalize_timestamps(df: DataFrame, value: str, zone: str | None = None, order: str | None = None, prefix: str = "ts") -> DataFrame:
    """Add {prefix}_us (micros since 1970 UTC), {prefix}_form (the pattern that matched) and {prefix}_status.

    value: the text column; zone: column with the IANA zone of a wall time without zone; order: column with the
    reading order (mdy, dmy) of all-number slash dates. Status is one of ok, empty, unreadable (no pattern, or no real
    date or time), no_zone, ambiguous (the zone had that wall time twice), skipped (the zone never had it). Only ok has
    {prefix}_us. Policy: an offset in the value beats a zone name in it, which beats an abbreviation, which beats the
    default zone; nothing is guessed for ambiguous or skipped wall times. Nulls and blank texts give `empty`. Every
    input row comes out once, other columns untouched; existing columns of the output names are replaced.
    """
    jvm = df.sparkSession._jvm
    zones = ", ".join(f"'{z}'" for z in jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))
    known = lambda name: F.expr(f"CASE WHEN `{name}` IN ({zones}) THEN `{name}` END")
    v = F.regexp_replace(F.col(f"`{value}`"), r"\A +| +\z", "")
    own = known(zone) if zone else F.lit(None).cast("string")
    way = F.col(f"`{order}`") if order else F.lit(None).cast("string")
    cols = df.columns
    names = {k: f"__{prefix}_{k}" for k in ("v", "own", "way", "form", "p", "num", "wall", "off", "zone", "a", "b", "y", "mo", "d", "h", "mi", "s", "fr", "fa", "fb", "named")}
    c = lambda k: F.col(names[k])
    d = df.select(*[F.col(f"`{x}`") for x in cols], v.alias(names["v"]), own.alias(names["own"]), way.alias(names["way"]))
    v = c("v")
    form, pieces = F.when(v.rlike(r"\A\d+(\.\d+)?\z"), F.lit("number")), F.when(F.lit(False), "")
    for name, pattern, template in PATTERNS:
        form = form.when(v.rlike(pattern), name)
        pieces = pieces.when(c("form") == name, F.regexp_replace(v, pattern, template))
    d = stage(d.withColumn(names["form"], form), {names["p"]: F.split(pieces, r"\|")})

    n = F.when(c("form") == "number", v.try_cast("decimal(38,9)"))
    start, end = 946_684_800, 4_102_444_800  # 2000-01-01 and 2100-01-01
    num = F.when(F.lit(False), F.lit(0).cast("long"))
    for per in (1, 1_000, 1_000_000, 1_000_000_000):
        num = num.when(n.between(F.lit(start * per).cast("decimal(38,0)"), F.lit(end * per - 1).cast("decimal(38,0)")), F.floor(n * F.lit(1_000_000).cast("decimal(10,0)") / F.lit(per).cast("decimal(10,0)")).cast("long"))

    part = lambda i: F.when(F.size(c("p")) > i, c("p")[i])
    whole = lambda x: F.nullif(x, F.lit("")).try_cast("int")
    slash = c("form") == "slash"
    first, second = F.regexp_replace(part(1), "#", ""), F.regexp_replace(part(2), "#", "")
    letters = F.expr(f"(locate(`{names['p']}`[1], '{MONTHS}') + 2) div 3").cast("int")
    month = F.when(slash & (c("way") == "mdy"), whole(first)).when(slash & (c("way") == "dmy"), whole(second)).when(slash, None)
    month = month.when(part(1).rlike(r"\A[A-Z]"), letters).otherwise(whole(part(1)))
    day = F.when(slash & (c("way") == "mdy"), whole(second)).when(slash & (c("way") == "dmy"), whole(first)).when(slash, None).otherwise(whole(part(2)))
    ap, h = F.lower(part(7)), whole(part(3))
    hour = F.when(ap == "", h).when(h.between(1, 12), h % 12 + F.when(ap == "pm", 12).otherwise(0))
    frac = F.coalesce(F.rpad(F.nullif(part(6), F.lit("")), 6, "0").try_cast("int"), F.lit(0))
    d = stage(d, {names["num"]: num, names["y"]: whole(part(0)), names["mo"]: month, names["d"]: day, names["h"]: hour, names["mi"]: whole(part(4)), names["s"]: F.coalesce(whole(part(5)), F.lit(0)), names["fr"]: frac})
    d = d.withColumn(names["wall"], civil_micros(*[c(k) for k in ("y", "mo", "d", "h", "mi", "s")]) + c("fr"))
    told = F.expr(f"(locate(`{names['p']}`[10], '{DAYS}') + 2) div 3")
    right_day = (part(10) == "") | (told == F.dayofweek(F.date_from_unix_date(F.floor(c("wall") / _DAY_US).cast("int"))))
    d = d.withColumn(names["wall"], F.when(right_day, c("wall")))

    z = part(8)
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(z, "[^0-9]", "")
    minutes = F.when(z.rlike(r"\A[+-]") & (F.substring(digits, 3, 2).try_cast("int") >= 60), None).when(
        z.rlike(r"\A[+-]"), sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
    )
    d = d.withColumn(names["named"], F.nullif(part(9), F.lit("")))
    named = c("named")
    off = F.when(z.rlike(r"\A[+-]"), minutes).when(named.isNull() | (z == "Z"), _abbreviation_minutes(z, c("own")))
    d = d.withColumn(names["off"], F.when(z != "", off)).withColumn(names["zone"], F.when(named.isNotNull(), known(names["named"])).when(z == "", c("own")))

    # A wall time has the offset of the day before or of the day after, unless the zone skipped it.
    a, b = (c("wall") - _offset(c("wall") + F.lit(k * _DAY_US), c("zone")) for k in (-1, 1))
    d = stage(d, {names["a"]: a, names["b"]: b})
    fits = lambda x: x + _offset(x, c("zone")) == c("wall")
    d = d.withColumn(names["fa"], fits(c("a"))).withColumn(names["fb"], fits(c("b")))
    fa, fb = c("fa"), c("fb")
    us = (
        F.when(c("form") == "number", c("num"))
        .when(c("off").isNotNull(), c("wall") - c("off") * F.lit(60_000_000).cast("long"))
        .when(fa & fb & (c("a") != c("b")), None)
        .when(fa, c("a"))
        .when(fb, c("b"))
    )
    status = (
        F.when(v.isNull() | (v == ""), "empty")
        .when((c("form") == "number") & c("num").isNotNull(), "ok")
        .when(slash & (part(0) != "") & (F.coalesce(c("way"), F.lit("")).isin("mdy", "dmy") == F.lit(False)) & c("own").isNull(), "no_zone")
        .when(c("wall").isNull(), "unreadable")
        .when(c("off").isNotNull(), "ok")
        .when(c("zone").isNull(), "no_zone")
        .when(fa & fb & (c("a") != c("b")), "ambiguous")
        .when(fa | fb, "ok")
        .otherwise("skipped")
    )
    outs = {f"{prefix}_us": us, f"{prefix}_form": c("form"), f"{prefix}_status": status}
    return d.select(*[F.col(f"`{x}`") for x in cols if x not in outs], F.inline(F.array(F.struct(*[x.alias(k) for k, x in outs.items()]))))


def store_zones(zones: DataFrame) -> DataFrame:
    """One row per store; a store listed with contradicting zones or orders has none."""
    one = lambda x: F.when(F.min(x) == F.max(x), F.min(x))
    return zones.groupBy("store_id").agg(one("time_zone").alias("__zone"), one("date_order").alias("__order"))


def order_instants(pos: DataFrame, zones: DataFrame, prefix: str = "ts") -> DataFrame:
    """normalize_timestamps of pos.order_date with the zone and reading order of the row's store."""
    joined = pos.join(store_zones(zones), "store_id", "left")
    return normalize_timestamps(joined, "order_date", "__zone", "__order", prefix).drop("__zone", "__order")
