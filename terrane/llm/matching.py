"""Matching entities across sources without common keys.

Each record is a document of attribute terms, searched by BM25 among the records of the other tables through an
inverted index. The best partners are found exactly: terms are ordered from rare to common with an upper bound of what
each can add to any score, so a pair that reaches the least score shares a term within both records' prefixes; no other
pair is scored. Pairs that are nearest to each other stay, and a logistic model fitted on labelled pairs turns score,
score gap and the agreement of the attributes into a confidence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..functions.columns import stage
from ..operators.resolution import STREET as STREETS
from ..session import Scratch
from .mojibake import Repairer, shipped_pairs

# Short forms of given names, unit words, letters that don't decompose.
NICKNAMES = {
    "alexander": "alex sandy lex", "abigail": "abby gail", "anthony": "tony", "benjamin": "ben benny", "beatrix": "bea trixie", "camilla": "cam millie", "catherine": "cathy kate",
    "christopher": "chris kit", "daniel": "dan danny", "deborah": "deb debbie", "dorothea": "dory dot dora thea dottie", "edward": "ed ted ned eddie", "elizabeth": "liz beth eliza betty lizzie bess",
    "frederick": "fred freddie", "gregory": "greg", "harvey": "harv", "james": "jim jimmy", "jennifer": "jen jenny", "josephine": "jo josie", "katherine": "kathryn kathy kate katie",
    "lawrence": "larry laurie", "margaret": "peg meg maggie peggy marge", "michael": "mike mick", "nicholas": "nick nicky", "penelope": "penny pen", "patricia": "pat trish patty tricia", "percival": "percy", "quentin": "quent",
    "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich rickie", "robert": "bob rob bobby", "rosalind": "roz ros", "samantha": "sam sammie", "samuel": "sam", "stephen": "steve",
    "theodora": "theo dora", "theodore": "theo ted", "thomas": "tom tommy", "victoria": "vicky tori vic", "walter": "walt", "wallace": "wally", "william": "will bill billy liam", "winston": "win", "yvette": "evie",
}
UNITS = ("apt", "unit", "apartment", "suite", "ste")
PLAIN = {"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "þ": "th", "đ": "d", "ð": "d", "ı": "i", "œ": "oe", "ς": "σ"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

#: BM25: saturation of term counts, share of the length normalisation.
K1, B = 1.2, 0.75
#: Scores under this multiple of the log of the number of records are not searched: about two terms that are nearly unique, or one and many common ones.
LEAST = 2.3
#: Rows of labelled pairs that the calibration is fitted on, at most.
LABELLED_ROWS = 10_000

FIELDS = "first string, last string, phone string, dob string, house string, street string, unit string, city string, state string, zip string"
_SHORT = {s: full for full, shorts in reversed(NICKNAMES.items()) for s in shorts.split()}


@lru_cache(200_000)
def plain(text: str | None) -> str:
    t = unicodedata.normalize("NFKD", (text or "").casefold())
    t = "".join(PLAIN.get(c, c) for c in t if not unicodedata.combining(c))
    return " ".join(re.findall(r"\w+", re.sub(r"\b[dl]['’ʼ](?=\w)|['’ʼ]", "", t)))


def person(name: str | None) -> tuple[str, str]:
    """(first, last) of a whole name, `Last, First` or `First Last`; one-letter parts are initials."""
    name = name or ""
    if "," in name:
        last, _, first = name.partition(",")
        return plain(first), plain(last)
    first, _, last = name.strip().partition(" ")
    return plain(first), plain(last)


def given(first: str) -> str:
    """The full form of a given name; initials beside it are left out."""
    parts = [p for p in first.split() if len(p) > 1] or first.split()
    return _SHORT.get(parts[0], parts[0]) if parts else ""


def family(last: str) -> str:
    parts = [p for p in last.split() if len(p) > 1 or ord(p[0]) > 0x2E7F] or last.split()
    return " ".join(p for p in parts if p not in ("jr", "sr", "ii", "iii"))


def phone(text: str | None) -> str:
    d = re.sub(r"[^0-9]", "", text or "")
    return d[-10:] if len(d) == 10 or (len(d) == 11 and d[0] == "1") else ""


def born(text: str | None) -> str:
    t = (text or "").strip().lower()
    if m := re.fullmatch(r"(\d{4})-?(\d{2})-?(\d{2})", t):
        return "".join(m.groups())
    if m := re.fullmatch(r"(\d{1,2}) ([a-z]{3})[a-z]* (\d{4})", t):
        return f"{m[3]}{MONTHS.index(m[2]) + 1:02d}{int(m[1]):02d}" if m[2] in MONTHS else ""
    if m := re.fullmatch(r"(\d{1,2})[./](\d{1,2})[./](\d{4})", t):
        return f"{m[3]}{int(m[1]):02d}{int(m[2]):02d}" if "/" in t else f"{m[3]}{int(m[2]):02d}{int(m[1]):02d}"
    return ""


def line(text: str | None) -> tuple[str, str, str]:
    """(house number, street, unit) of a street line."""
    words = [STREETS.get(w, w) for w in plain((text or "").replace("#", " unit ")).split()]
    unit = ""
    for i, w in enumerate(words):
        if w in UNITS and i:
            unit, words = "".join(words[i + 1 : i + 2]), words[:i]
            break
    if len(words) > 2 and words[-1].isdigit():
        unit, words = words[-1], words[:-1]
    house = words[0] if words and words[0].isdigit() else ""
    street = [w for w in words[bool(house) :] if w not in STREETS.values()]
    return house, " ".join(street), unit


def whole_address(text: str | None) -> tuple[str, str, str, str, str, str]:
    """(house, street, unit, city, state, zip) of a one-column address."""
    parts = [p.strip() for p in (text or "").split(",") if p.strip()]
    if not parts:
        return "", "", "", "", "", ""
    m = re.fullmatch(r"(.*?)\s*(?:\b([A-Za-z]{2}))?\s*(\d{4,5})?", parts[-1]) if len(parts) > 1 else None
    city, state, code = (m[1] or "", (m[2] or "").upper(), m[3] or "") if m else ("", "", "")
    return *line(" ".join(parts[:-1]) if len(parts) > 1 else parts[0]), plain(city), state, code.zfill(5) if code else ""


def _row(first, last, tel, dob, house, street, unit, city, state, code) -> tuple:
    return given(first), family(last), phone(tel), born(dob), house, street, unit, city, state, code


def _people(crm: DataFrame, merger_a: DataFrame, merger_c: DataFrame) -> DataFrame:
    """(rid, source, fields) of every landed row with a key."""
    schema = f"rid string, source string, {FIELDS}"
    shared = shipped_pairs(crm, ["first_name", "last_name"])
    kept: dict = {}  # per worker

    def fix(v):
        if v is None or v.isascii():
            return v
        if not kept:
            kept["repair"] = lru_cache(50_000)(Repairer(shared.value).repair)
        return kept["repair"](v)[1] or v

    def from_crm(key, f, l, tel, addr, city, state, code, dob):
        code = (code or "").strip()
        yield f"crm:{key}", "crm", *_row(plain(fix(f)), plain(fix(l)), tel, dob, *line(addr), plain(city), (state or "").strip().upper(), code.zfill(5) if code else "")

    def from_a(key, name, dob, addr, tel):
        yield f"merger_a:{key}", "merger_a", *_row(*person(name), tel, dob, *whole_address(addr))

    def from_c(key, f, l, tel, addr, city, state):
        yield f"merger_c:{key}", "merger_c", *_row(plain(f), plain(l), tel, None, *line(addr), plain(city), (state or "").strip().upper(), "")

    parts = [
        map_rows(crm.filter("business_entity_id is not null").select("business_entity_id", "first_name", "last_name", "phone", "address_line1", "city", "state", "postal_code", "dob"), from_crm, schema),
        map_rows(merger_a.filter("account_id is not null").select("account_id", "name", "dob", "address", "phone"), from_a, schema),
        map_rows(merger_c.filter("uuid is not null").select("uuid", "first_name", "last_name", "phone", "address_line1", "city", "state"), from_c, schema),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _labelled(golden: DataFrame) -> DataFrame:
    """The records of labelled pairs (match, non_match) like rows of two further tables: (rid, source, fields); rid ends with pair and label."""
    rows = golden.filter(F.col("label").isin("match", "non_match")).select("pair_id", "record_a", "record_b", "label").orderBy("pair_id").limit(LABELLED_ROWS)

    def both(pair, a, b, label):
        for source, m in (("label_a", dict(a or {})), ("label_b", dict(b or {}))):
            yield f"{source}:{pair}:{label}", source, *_row(*person(m.get("name")), m.get("phone"), m.get("dob"), *whole_address(m.get("address")))

    return map_rows(rows, both, f"rid string, source string, {FIELDS}")


_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _merged(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the tables, never broadcast: arrays and generators are far larger than the planner's estimate from file sizes, so the driver would hold hundreds of MB."""
    return df.hint("merge")


def _terms(v: Column) -> Column:
    """The terms of one row, hashed: attributes alone, which are common, and joined, which are rare."""

    def both(tag, *cols):
        return F.when(F.array_min(F.array(*[F.length(v[x]) for x in cols])) > 0, F.xxhash64(F.lit(tag), *[v[x] for x in cols]))

    initial = F.when((F.length(v["first"]) > 0) & (F.length(v["phone"]) > 0), F.xxhash64(F.lit("ip"), F.substring(v["first"], 1, 1), v["phone"]))
    return F.array_compact(
        F.array(
            both("f", "first"), both("l", "last"), both("c", "city"), both("s", "state"), both("z", "zip"), both("d", "dob"), both("p", "phone"), both("ld", "last", "dob"), both("fd", "first", "dob"),
            both("hs", "house", "street"), both("hc", "house", "city"), both("flh", "first", "last", "house"), both("fls", "first", "last", "state"), both("flc", "first", "last", "city"), both("fp", "first", "phone"), both("lp", "last", "phone"), initial,
        )
    )


def records(rows: DataFrame) -> DataFrame:
    """(rid, source, v, terms, size): one row per key with all variants of its landed rows, each distinct one once; a term stands as often as variants have it."""
    d = rows.groupBy("rid", "source").agg(F.array_sort(F.collect_set(F.struct(*_NAMES))).alias("v"))
    return stage(d, {"terms": F.flatten(F.transform("v", _terms))}).withColumn("size", F.size("terms"))


def index(docs: DataFrame, n: int, mean: float, least: float, scratch: Scratch) -> DataFrame:
    """docs with t, their terms as (h, idf, imp) from rare to common, and the prefix that a partner of the least score must share.

    imp is the BM25 factor of a term in this record, from its count and the record's length; a pair's score is the sum
    of idf * imp over shared terms. Only terms that occur in two tables count. bound is idf times the greatest imp
    of a term anywhere: where the bounds from a term on sum up to less than least, no partner can reach it by these
    terms alone, so the prefix ends there. Order and bounds are the same for all records, so of two that reach the
    least score both prefixes hold their rarest shared term.
    """
    count = lambda h: F.size(F.filter("terms", lambda x: x == h)).cast("double")
    norm = K1 * (1 - B + B * F.col("size") / F.lit(max(mean, 1.0)))
    each = docs.select("rid", "source", F.explode(F.transform(F.array_distinct("terms"), lambda h: F.struct(h.alias("h"), (count(h) * (K1 + 1) / (count(h) + norm)).alias("imp")))).alias("x")).select("rid", "source", "x.*")
    df = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.max("imp").alias("most"), F.min("source").alias("s"), F.max("source").alias("z")).filter("s < z")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select("h", idf.alias("idf"), (idf * F.col("most")).alias("bound"))
    own = each.join(_merged(weights), "h").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("o"), "h", "imp", "bound"))).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + x["bound"])
    cut = F.aggregate(
        "t", F.struct(total.alias("rest"), F.array().cast("array<bigint>").alias("prefix")),
        lambda s, x: F.when(s["rest"] >= least, F.struct((s["rest"] - x["bound"]).alias("rest"), F.array_append(s["prefix"], x["h"]).alias("prefix"))).otherwise(s), lambda s: s["prefix"],
    )
    found = own.select("rid", F.transform("t", lambda x: F.struct(x["h"].alias("h"), (-x["o"]).alias("idf"), x["imp"].alias("imp"))).alias("t"), cut.alias("prefix"))
    return scratch.put(docs.select("rid", "source", "v").join(_merged(found), "rid", "left").select("rid", "source", "v", "t", "prefix"))


def candidates(docs: DataFrame) -> DataFrame:
    """(a, b) of every two records of different tables, a before b, that share a term within both prefixes: all others score under the least score."""
    posts = docs.select("rid", "source", F.explode("prefix").alias("h"))
    x, y = (posts.select(F.col("rid").alias(k), F.col("source").alias(f"{k}s"), "h") for k in ("a", "b"))
    real = ~(F.col("as").startswith("label_") & F.col("bs").startswith("label_"))
    return x.join(_merged(y), "h").filter((F.col("as") < F.col("bs")) & real).select("a", "b").distinct()


def _alike(a: Column, b: Column) -> Column:
    """0 to 2: nothing alike, a slip apart or one the start of the other, equal."""
    slip = F.levenshtein(a, b) <= F.when(F.least(F.length(a), F.length(b)) >= 5, 2).otherwise(F.when(F.least(F.length(a), F.length(b)) >= 3, 1).otherwise(0))
    part = (F.length(a) > 0) & (F.length(b) > 0) & (a.startswith(b) | b.startswith(a))
    swapped = (F.length(a) >= 3) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(a == b, 2).when(slip | part | swapped, 1).otherwise(0)


FEATURES = ("first_slip", "first_other", "last_slip", "last_other", "phone_same", "phone_slip", "phone_other", "dob_same", "dob_other", "street_same", "street_slip", "street_other", "place_same", "place_other")


def compare(pairs: DataFrame) -> DataFrame:
    """Add the FEATURES, each 0 or 1, to rows with variants xv and yv.

    An attribute agrees if any variants agree, slips if any do so but for a slip, and contradicts if both sides have it
    and no variants agree even so; a missing value does none of these.
    """

    def values(side, *names):
        one = (lambda v: v[names[0]]) if len(names) == 1 else (lambda v: F.struct(*[v[n].alias(n) for n in names]))
        return F.array_distinct(F.transform(F.filter(side, lambda v: F.array_min(F.array(*[F.length(v[n]) for n in names if n != "unit"])) > 0), one))

    cols = [c for c in pairs.columns if c not in ("xv", "yv")]
    parts = {"first": ("first",), "last": ("last",), "phone": ("phone",), "dob": ("dob",), "street": ("house", "street", "unit"), "place": ("state", "city"), "names": ("first", "last")}
    d = stage(pairs, {f"{side[0]}_{k}": values(side, *v) for side in ("xv", "yv") for k, v in parts.items()})
    have = lambda k: (F.size(f"x_{k}") > 0) & (F.size(f"y_{k}") > 0)
    best = lambda k, fn: F.coalesce(F.array_max(F.flatten(F.transform(f"x_{k}", lambda a: F.transform(f"y_{k}", lambda b: fn(a, b))))), F.lit(0))

    def street(a, b):
        alike = _alike(a["street"], b["street"])
        same = (alike > 0) & ((a["house"] == b["house"]) | ((F.levenshtein(a["house"], b["house"]) <= 1) & (a["street"] == b["street"])))
        other_unit = (F.length(a["unit"]) > 0) & (F.length(b["unit"]) > 0) & (a["unit"] != b["unit"])
        return F.when(~same | other_unit, 0).when((alike == 2) & (a["house"] == b["house"]), 2).otherwise(1)

    swapped = best("names", lambda a, b: F.when((a["first"] == b["last"]) & (a["last"] == b["first"]), 2).otherwise(0))
    tests = {
        "first": F.greatest(best("first", _alike), swapped), "last": F.greatest(best("last", _alike), swapped), "dob": best("dob", lambda a, b: F.when(a == b, 2).otherwise(0)),
        "phone": best("phone", lambda a, b: F.when(a == b, 2).when(F.levenshtein(a, b) == 1, 1).otherwise(0)), "street": best("street", street),
        "place": best("place", lambda a, b: F.when((a["state"] == b["state"]) & (_alike(a["city"], b["city"]) > 0), 2).otherwise(0)),
    }
    told = stage(d, {f"__{k}": v for k, v in tests.items()})
    flag = lambda name: F.when(have(name.rpartition("_")[0]) & (F.col("__" + name.rpartition("_")[0]) == {"same": 2, "slip": 1, "other": 0}[name.rpartition("_")[2]]), 1.0).otherwise(0.0)
    return told.select(*cols, *[flag(f).alias(f) for f in FEATURES])


def judged(pairs: DataFrame, docs: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b) of pairs that reach the least score in a direction, with the BM25 score of b for a as query (ab) and of a for b (ba), the FEATURES, and hashes of what makes two keys of one table one person (a1, a2, b1, b2)."""
    whole = lambda names: F.transform(F.filter("v", lambda v: F.array_min(F.array(*[F.length(v[n]) for n in names])) > 0), lambda v: F.xxhash64(*[v[n] for n in names]))
    one = docs.select("rid", "v", F.coalesce("t", F.array().cast("array<struct<h:bigint,idf:double,imp:double>>")).alias("t"), F.array_min(whole(("first", "last", "phone"))).alias("g1"), F.array_min(whole(("first", "last", "house", "street", "dob"))).alias("g2"))
    side = lambda k, s: one.select(F.col("rid").alias(k), F.col("v").alias(f"{s}v"), F.col("t").alias(f"{k}t"), F.col("g1").alias(f"{k}1"), F.col("g2").alias(f"{k}2"))
    d = pairs.join(_merged(side("a", "x")), "a").join(_merged(side("b", "y")), "b")
    hs = lambda t: F.transform(t, lambda x: x["h"])
    common = F.array_intersect(hs("at"), hs("bt"))
    score = lambda t: F.aggregate(F.filter(t, lambda x: F.array_contains("common", x["h"])), F.lit(0.0), lambda s, x: s + x["idf"] * x["imp"])
    d = stage(d, {"common": common}).withColumns({"ab": score("bt"), "ba": score("at")}).drop("common", "at", "bt")
    return compare(stage(d, {"ab": F.col("ab"), "ba": F.col("ba")}).filter((F.col("ab") >= least) | (F.col("ba") >= least)))


def _table(rid: str) -> Column:
    return F.substring_index(rid, ":", 1)


def mutual(scored: DataFrame, least: float) -> DataFrame:
    """(a, b, score, gap) of pairs that are nearest to each other, each among the records of the other's table.

    Nearest is the best partner, any of the same score, and other keys of that same person: equal names with equal
    phones, or with equal streets and birth dates. gap is the score less that of the best partner who is not nearest, or
    less the least score searched; of both directions the smaller one counts. Neither has a cap on partners.
    """
    way = lambda q, d, s: F.struct(F.col(q).alias("q"), F.col(d).alias("d"), F.col(s).alias("score"), F.col(f"{d}1").alias("g1"), F.col(f"{d}2").alias("g2"))
    long = scored.select(F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("w")).select("w.*", _table("w.d").alias("of")).filter(F.col("score") >= least)
    all_of = Window.partitionBy("q", "of")
    d = long.withColumn("top", F.max(F.struct("score", "d", "g1", "g2")).over(all_of))
    same = lambda g: F.coalesce(F.col(g) == F.col(f"top.{g}"), F.lit(False))
    d = d.withColumn("near", (F.col("score") >= F.col("top.score") - 1e-9) | same("g1") | same("g2"))
    d = d.withColumn("other", F.coalesce(F.max(F.when(~F.col("near"), F.col("score"))).over(all_of), F.lit(least))).filter("near")
    both = d.groupBy(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.min(F.col("score") - F.col("other")).alias("gap")).filter("n = 2").drop("n")


#: What the calibration believes before it has seen labels: weights per log N of score and gap, and of each feature. Few labels show every contradiction.
PRIOR = {"score": 1.0, "gap": 1.0, "first_slip": 0.5, "last_slip": 0.5, "phone_slip": 1.0, "street_slip": 1.0, "first_other": -4.0, "last_other": -4.0, "phone_other": -1.0, "dob_other": -4.0, "street_other": -1.0, "place_other": -1.0}
TOLD = ("score", "gap", *FEATURES)


def calibrate(rows: list[tuple[list[float], bool]], ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model (intercept, then TOLD) of labelled pairs, by Newton's method with a ridge penalty around PRIOR. Without labels all weights are zero."""
    mean = np.array([0.0, *[PRIOR.get(k, 0.0) for k in TOLD]])
    if not rows:
        return np.zeros(len(mean))
    x = np.array([[1.0, *f] for f, _ in rows])
    y = np.array([m for _, m in rows], float)
    w, penalty = mean.copy(), np.diag([1e-3, *[ridge] * len(TOLD)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ (w - mean))
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def match_people(crm: DataFrame, merger_a: DataFrame, merger_c: DataFrame, golden: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """(record_a_id, record_b_id, confidence) of pairs of records of one person, the smaller id first.

    Every record queries the records of the other tables by BM25 over its attributes; the best ones are found exactly,
    and pairs stay that are nearest in both directions. Confidence is logistic in the score, its gap to the next best
    partner and the agreement of the attributes, fitted on the labelled pairs, whose records are searched like those of
    two further tables. An exact check follows: names and birth dates must not contradict, and something beyond the
    name must agree. Key numbers are no evidence. Null keys name no record; missing attributes neither agree nor
    contradict; repeated rows of a key are one record with all variants; empty tables give no pairs.
    """
    scratch = Scratch(crm.sparkSession, "people")
    docs = scratch.put(records(_people(crm, merger_a, merger_c).unionByName(_labelled(golden))))
    n, mean = docs.agg(F.count(F.lit(1)), F.avg("size")).first()
    log = math.log(max(n, 2))
    docs = index(docs, n, mean or 1.0, LEAST * log, scratch)
    scored = scratch.put(judged(candidates(docs), docs, LEAST * log))
    label = F.col("a").startswith("label_") | F.col("b").startswith("label_")

    # labelled pairs, found by the search or not, with the best other partner of either record
    mine = docs.filter(F.col("source").startswith("label_"))  # at most 2 * LABELLED_ROWS
    ids = mine.filter(F.col("source") == "label_a").select(F.col("rid").alias("a"), F.regexp_replace("rid", "^label_a", "label_b").alias("b"))
    way = lambda q, s: F.struct(F.col(q).alias("q"), F.col(s).alias("s"))
    others = scored.filter(label).select(F.explode(F.array(way("a", "ab"), way("b", "ba"))).alias("w")).groupBy("w.q").agg(F.max("w.s").alias("s"))
    best = lambda k: others.select(F.col("q").alias(k), F.col("s").alias(f"{k}o"))
    known = judged(ids, mine).join(best("a"), "a", "left").join(best("b"), "b", "left")
    gap = F.least(F.col("ab") - F.coalesce("ao", F.lit(LEAST * log)), F.col("ba") - F.coalesce("bo", F.lit(LEAST * log)))
    rows = known.select("a", ((F.col("ab") + F.col("ba")) / (2 * log)).alias("score"), (gap / log).alias("gap"), *FEATURES).collect()  # at most LABELLED_ROWS
    w = [float(v) for v in calibrate([([r[k] for k in TOLD], r.a.endswith(":match")) for r in rows])]

    near = mutual(scored.filter(~label), LEAST * log)
    told = near.join(_merged(scored.select("a", "b", *FEATURES)), ["a", "b"]).withColumns({"score": F.col("score") / log, "gap": F.col("gap") / log})
    logit = F.lit(w[0]) + sum((F.col(k) * F.lit(v) for k, v in zip(TOLD, w[1:])), F.lit(0.0))
    evidence = F.col("phone_same") + F.col("phone_slip") + F.col("dob_same") + F.col("street_same") + F.col("street_slip")
    agree = (F.col("phone_same") + F.col("street_same") + F.col("street_slip")) >= 2
    sound = (F.col("first_other") == 0) & (F.col("last_other") == 0) & (evidence > 0) & ((F.col("dob_other") == 0) | agree)
    found = told.withColumn("confidence", F.round(1 / (1 + F.exp(-logit)), 6)).filter(sound & (F.col("confidence") >= least_confidence))
    return scratch.result(found.select(F.col("a").alias("record_a_id"), F.col("b").alias("record_b_id"), "confidence", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"), *FEATURES))
