"""Resolving records into persons: normalised attributes, blocking, a deterministic matcher, star-shaped clusters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stage
from ..functions.values import email_norm, phone_digits, strip

# Short given names, street endings, letters without a decomposition.
SHORT = {
    "bob": "robert", "rob": "robert", "jen": "jennifer", "mike": "michael", "chris": "christopher", "kathryn": "katherine", "kate": "katherine", "bill": "william", "will": "william", "dick": "richard", "rick": "richard",
    "becky": "rebecca", "vicky": "victoria", "tori": "victoria", "fred": "frederick", "maggie": "margaret", "peg": "margaret", "trish": "patricia", "pat": "patricia", "tom": "thomas", "tony": "anthony", "ted": "edward",
    "ed": "edward", "liz": "elizabeth", "beth": "elizabeth", "nick": "nicholas", "ray": "raymond", "sam": "samantha", "ben": "benjamin", "deb": "deborah", "larry": "lawrence", "jo": "josephine", "josie": "josephine", "abby": "abigail",
}
_PLAIN = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xE0, 0x180)) if unicodedata.decomposition(c) and c.islower()} | {"ø": "o", "ł": "l", "đ": "d", "ı": "i"}
STREET = {"lane": "ln", "street": "st", "drive": "dr", "avenue": "ave", "road": "rd", "court": "ct", "place": "pl", "boulevard": "blvd"}
REVIEW, SURE = 0.5, 0.85

Matcher = Callable[[DataFrame], DataFrame]  # rows with a and b (maps) -> the same rows with match, confidence, reason


def _get(m: Column, key: str) -> Column:
    return F.coalesce(strip(F.try_element_at(m, F.lit(key))), F.lit(""))


def attributes(m: Column, p: str) -> dict[str, Column]:
    """The comparable attributes of a record given as a map of texts."""
    name = F.translate(F.lower(F.regexp_replace(_get(m, "name"), r"[.,'’]", "")), "".join(_PLAIN), "".join(_PLAIN.values()))
    first = F.substring_index(name, " ", 1)
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    street = F.lower(F.regexp_replace(F.substring_index(_get(m, "address"), ",", 1), r"[.#]", ""))
    for full, abbr in STREET.items():
        street = F.regexp_replace(street, rf"\b{full}\b", abbr)
    state = F.upper(F.regexp_extract(F.regexp_replace(_get(m, "address"), r"\s*\d{5}(-\d{4})?\s*\z", ""), r"([A-Za-z]{2})\s*\z", 1))
    unit = F.regexp_extract(street, r"\b(?:apt|unit|suite|ste)\s*(\w+)", 1)
    return {
        f"{p}first": F.coalesce(F.try_element_at(short, first), first),
        f"{p}last": F.when(name.contains(" "), F.substring_index(name, " ", -1)).otherwise(""),
        f"{p}email": F.coalesce(email_norm(_get(m, "email")), F.lit("")),
        f"{p}phone": F.coalesce(phone_digits(_get(m, "phone")), F.lit("")),
        f"{p}street": F.regexp_replace(F.regexp_replace(street, r"\b(?:apt|unit|suite|ste)\s*\w+", ""), r"\s+", " "),
        f"{p}unit": unit,
        f"{p}state": state,
        f"{p}dob": _get(m, "dob"),
    }


def ladder(pairs: DataFrame) -> DataFrame:
    """The default matcher: the first rung that holds decides. Key numbers are never evidence; missing values decide nothing."""
    d = stage(pairs, {**attributes(F.col("record_a"), "__a"), **attributes(F.col("record_b"), "__b")})
    a, b = (lambda n: F.col(f"__a{n}")), (lambda n: F.col(f"__b{n}"))
    both = lambda n: (a(n) != "") & (b(n) != "")
    same = lambda n: both(n) & (a(n) == b(n))
    differ = lambda n: both(n) & (a(n) != b(n))
    initial = lambda x, y: (F.length(x) == 1) & y.startswith(x)
    slip = lambda n: (F.least(F.length(a(n)), F.length(b(n))) >= 4) & (F.levenshtein(a(n), b(n)) <= 2)
    first_ok = (a("first") == b("first")) | initial(a("first"), b("first")) | initial(b("first"), a("first")) | slip("first")
    names = first_ok & ((a("last") == b("last")) | ~both("last") | slip("last"))
    address = same("street") & ~differ("state") & ~differ("unit")
    second = same("phone") | address | names
    rungs = [
        (differ("dob"), False, 0.91, "birth dates differ"),
        (same("street") & (differ("state") | differ("unit")), False, 0.90, "same street, other state or unit"),
        (same("email") & second, True, 0.97, "same mail and more"),
        (same("email"), True, 0.93, "same mail"),
        (address & ~first_ok, False, 0.90, "same address, other given name"),
        (same("phone") & names, True, 0.93, "same phone and close name"),
        (names & address & differ("phone"), False, 0.40, "phones conflict"),
        (names & address, True, 0.90, "same name and address"),
        (differ("email"), False, 0.90, "mails differ, nothing shared"),
    ]
    match, conf, reason = F.lit(False), F.lit(0.60), F.lit("nothing comparable")
    for test, m, c, r in reversed(rungs):
        match, conf, reason = F.when(test, m).otherwise(match), F.when(test, c).otherwise(conf), F.when(test, r).otherwise(reason)
    return d.select(*[F.col(f"`{c}`") for c in pairs.columns], match.alias("match"), conf.alias("confidence"), reason.alias("reason"))


def record_ids(a: Column, b: Column) -> tuple[Column, Column]:
    """Ids of the two sides: customer_id, else business_entity_id on the left and account_id on the right, else unknown."""
    pick = lambda m, other: F.coalesce(F.nullif(_get(m, "customer_id"), F.lit("")), F.nullif(_get(m, other), F.lit("")), F.lit("unknown"))
    return pick(a, "business_entity_id"), pick(b, "account_id")


def match_pairs(pairs: DataFrame, matcher: Matcher = ladder) -> DataFrame:
    """Match results of (record_a, record_b) maps: match, confidence, reason, record_a_id, record_b_id."""
    d = matcher(pairs)
    a, b = record_ids(F.col("record_a"), F.col("record_b"))
    return d.withColumns({"record_a_id": a, "record_b_id": b})


def blocked_pairs(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """Candidate pairs that share any blocking key, each once, with the keys they share; empty and null keys block nothing."""
    out = None
    for name, (a, b) in keys.items():
        x = left.select(F.col(left_id).alias("a_id"), a.alias("k")).filter("k is not null and k <> ''").distinct()
        y = right.select(F.col(right_id).alias("b_id"), b.alias("k")).filter("k is not null and k <> ''").distinct()
        part = x.join(y, "k").select("a_id", "b_id", F.lit(name).alias("block"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("a_id", "b_id").agg(F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"))


def resolve_stars(scored: DataFrame, anchor: str, member: str) -> DataFrame:
    """Clusters of an anchor with its members: status `review` if any confidence is below one half, whatever its verdict.

    Otherwise `resolved`, with the confirmed members; members that don't match are counted, not kept. Null
    confidences are below.
    """
    doubt = F.bool_or(F.coalesce("confidence", F.lit(0.0)) < REVIEW)
    yes = F.coalesce("match", F.lit(False))
    d = scored.groupBy(anchor).agg(doubt.alias("doubt"), F.count_if(yes).alias("n_match"), F.count_if(~yes).alias("n_other"), F.count(F.lit(1)).alias("n_pairs"))
    return d.select(F.col(anchor).alias("anchor_id"), F.when(F.col("doubt"), "review").otherwise("resolved").alias("status"), F.when(F.col("doubt"), 0).otherwise(F.col("n_match")).cast("bigint").alias("members"), F.col("n_other").alias("non_matches"), "n_pairs")


def resolve_clusters(members: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(golden, review, dropped): golden records of clusters, clusters for a person to look at, members that were not confirmed.

    members: (cluster_id, member_pos, source_system, field, value); the member of the least position is the anchor.
    verdicts: (cluster_id, member_pos, match, confidence), the matcher's answers for the anchor and that member. Any
    confidence below one half, or missing, sends the whole cluster to review, whatever the verdict. Else the anchor and
    the confirmed members make the golden record; of several of one source the last counts. A cluster of one member is
    golden as it is, with record_confidence null: nothing was matched.
    """
    from .golden import golden_records, last_per_source

    doubt = verdicts.groupBy("cluster_id").agg(F.bool_or(F.coalesce("confidence", F.lit(0.0)) < REVIEW).alias("doubt"))
    review = doubt.filter("doubt").select("cluster_id", F.lit("low confidence").alias("reason"))
    sizes = members.groupBy("cluster_id").agg(F.min("member_pos").alias("anchor"), (F.min("member_pos") == F.max("member_pos")).alias("alone"))
    d = members.join(sizes, "cluster_id").join(doubt, "cluster_id", "left").filter(~F.coalesce("doubt", F.lit(False)))
    yes = verdicts.filter("match").select("cluster_id", "member_pos").distinct().withColumn("yes", F.lit(True))
    d = d.join(yes, ["cluster_id", "member_pos"], "left").withColumn("in", (F.col("member_pos") == F.col("anchor")) | F.coalesce("yes", F.lit(False)))
    kept = d.filter("in").select("cluster_id", "field", "value", "source_system", F.col("member_pos").alias("pos"), "alone")
    golden = golden_records(last_per_source(kept.drop("alone")))
    alone = sizes.filter("alone").select("cluster_id", "alone")
    score = F.when(F.coalesce("alone", F.lit(False)), F.lit(None).cast("double")).otherwise(F.col("record_confidence"))
    golden = golden.join(alone, "cluster_id", "left").withColumn("record_confidence", score).drop("alone")
    return golden, review, d.filter(~F.col("in")).select("cluster_id", "member_pos", "source_system").distinct()


def write_review(review: DataFrame, folder: str, run_id: str) -> None:
    """Append the clusters of a run to the review queue."""
    review.write.mode("overwrite").json(f"{folder}/run_id={run_id}")


def parse_reply(text: str) -> tuple[bool, float, str]:
    """(match, confidence, reason) from a matcher's free text: the JSON from the first brace to the last. Without it a ValueError."""
    import json

    d = json.loads(text[text.find("{") : text.rfind("}") + 1])
    try:
        return bool(d["match"]), float(d["confidence"]), str(d.get("reason", ""))
    except (KeyError, TypeError) as e:
        raise ValueError(f"a reply without match or confidence: {text[:80]!r}") from e


def reply_matcher(ask: Callable[[dict, dict], str]) -> Matcher:
    """A matcher that asks an external one for every pair, in Arrow batches; ask gets both records and answers in free text.

    Pairs need pair_id. A reply that can't be read is no match at confidence 0, so it goes to review.
    """
    from ..functions.arrow import map_rows

    def matcher(pairs: DataFrame) -> DataFrame:
        def one(i, a, b):
            try:
                yield i, *parse_reply(ask(dict(a or {}), dict(b or {})))
            except ValueError as e:
                yield i, False, 0.0, f"no answer: {e}"

        answers = map_rows(pairs.select("pair_id", "record_a", "record_b"), one, "pair_id string, match boolean, confidence double, reason string")
        return pairs.join(answers, "pair_id")

    return matcher
