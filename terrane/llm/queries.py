"""Queries of the training-data problems, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .components import group_ids, match_links
from .leakage import clean, leaks
from .matching import match_people
from .mojibake import garbled_values
from .packing import fill, pack, token_counts
from .sentences import sentence_places, sentences
from .survivorship import Rules, surviving_fields


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_restored(spark, sf).select("crm_row", "field_name")


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Every garbled name with the restored spelling; null where bytes were lost."""
    return garbled_values(table(spark, sf, "crm"), "crm_row", ["first_name", "last_name"]).withColumnRenamed("id", "crm_row")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return surviving_fields(table(spark, sf, "survived_field")).filter("record_id is not null").select("cluster_id", "field_name", "record_id")


def p4_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Golden records field by field, fields without a value included."""
    return surviving_fields(table(spark, sf, "survived_field"))


def p4_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Golden records with names and places taken whole, and the address deciding the city."""
    rules = Rules((("first_name", "last_name"), ("address", "city")), (("phone", "email"),))
    return surviving_fields(table(spark, sf, "survived_field"), rules)


P4_CTE = """
WITH f AS (SELECT DISTINCT cluster_id, record_id, member_pos, source_system, field_name, value FROM survived_field),
k AS (SELECT cluster_id FROM f GROUP BY cluster_id HAVING count(DISTINCT record_id) >= 2),
s AS (SELECT cluster_id, source_system, min(member_pos) AS pos, max(member_pos) AS last FROM f SEMI JOIN k USING (cluster_id) GROUP BY ALL),
c AS (SELECT f.cluster_id, f.field_name, f.record_id, f.source_system, f.value, s.pos FROM f JOIN s ON f.cluster_id = s.cluster_id AND f.source_system = s.source_system AND f.member_pos = s.last),
p AS (SELECT * FROM (VALUES ('email','ecommerce',0),('email','crm',1),('email','pos',2),('phone','crm',0),('phone','pos',1),('phone','loyalty',2),('address','crm',0),('address','merger_c',1),('address','pos',2),
 ('first_name','crm',0),('first_name','pos',1),('last_name','crm',0),('last_name','pos',1),('loyalty_num','loyalty',0),('birth_date','crm',0),('birth_date','merger_c',1)) t(field_name, source_system, place)),
v AS (SELECT c.*, p.place, c.field_name IN ('notes','middle_name') AS long,
 CASE WHEN c.field_name IN ('notes','middle_name') THEN coalesce(c.value, '') <> '' ELSE regexp_replace(coalesce(c.value, ''), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{b}]', '', 'g') <> '' END AS ok
 FROM c LEFT JOIN p ON c.field_name = p.field_name AND c.source_system = p.source_system),
w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY ok DESC, CASE WHEN long THEN -length(value) ELSE coalesce(place, 99) END, pos) AS rn FROM v)
"""
P4_FOUND_SQL = P4_CTE + "SELECT cluster_id, field_name, record_id FROM w WHERE rn = 1 AND ok"
P4_GOLDEN_SQL = P4_CTE + """SELECT cluster_id, field_name, CASE WHEN ok THEN value END AS value, CASE WHEN ok THEN source_system ELSE 'none' END AS source_system, CASE WHEN ok THEN record_id END AS record_id,
 CASE WHEN long THEN 'longest_populated_' WHEN NOT ok THEN 'no_value_' WHEN place IS NOT NULL THEN 'source_precedence_' ELSE 'fallback_first_nonnull_' END || field_name AS rule_name,
 CASE WHEN NOT ok THEN 0.0 WHEN long THEN 0.7 WHEN place = 0 THEN 1.0 WHEN place > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM w WHERE rn = 1"""


#: A bundle or single field of a cluster takes the member with the most trust in it; phone and email decide together, as a phone that some record
#: shows with an e-mail address rules out others. Members come in the order of their sources, as in p4_found.
P4_BUNDLES_SQL = P4_CTE + """,
cand AS (SELECT DISTINCT f.cluster_id, f.record_id, f.source_system, s.pos FROM f JOIN s ON f.cluster_id = s.cluster_id AND f.source_system = s.source_system AND f.member_pos = s.last),
i AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) - 1 AS i FROM cand),
fl AS (SELECT DISTINCT cluster_id, field_name FROM v),
b AS (SELECT *, CASE WHEN field_name IN ('first_name', 'last_name') THEN 'name' WHEN field_name IN ('address', 'city') THEN 'place' ELSE field_name END AS bundle, field_name IN ('notes', 'middle_name') AS long FROM fl),
g AS (SELECT b.*, i.i, i.record_id, i.source_system, v.value, coalesce(v.ok, false) AS ok, v.place FROM b JOIN i USING (cluster_id) LEFT JOIN v ON v.cluster_id = b.cluster_id AND v.field_name = b.field_name AND v.record_id = i.record_id),
tr AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN long THEN 700000 - (row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY -length(coalesce(value, '')), i) - 1) WHEN place = 0 THEN 1000000 WHEN place > 0 THEN 800000 - place ELSE 500000 - i END AS trust FROM g),
o AS (SELECT cluster_id, bundle, i, sum(trust) AS trust FROM tr GROUP BY ALL HAVING sum(trust) > 0),
single AS (SELECT cluster_id, bundle, arg_min(i, -trust * 1000 + i) AS i FROM o WHERE bundle NOT IN ('phone', 'email') GROUP BY ALL),
nothing AS (SELECT DISTINCT cluster_id FROM fl),
e AS (SELECT cluster_id, i, trust FROM o WHERE bundle = 'email' UNION ALL SELECT cluster_id, -1, 0 FROM nothing),
ph AS (SELECT cluster_id, i, trust FROM o WHERE bundle = 'phone' UNION ALL SELECT cluster_id, -1, 0 FROM nothing),
val AS (SELECT cluster_id, i, max(CASE WHEN field_name = 'phone' AND ok THEN value END) AS phone, max(CASE WHEN field_name = 'email' AND ok THEN value END) AS email FROM tr GROUP BY ALL),
duo AS (SELECT e.cluster_id, e.i AS ei, ph.i AS pi, e.trust AS et, ph.trust AS pt, ve.email, vp.phone FROM e JOIN ph USING (cluster_id) LEFT JOIN val ve ON ve.cluster_id = e.cluster_id AND ve.i = e.i LEFT JOIN val vp ON vp.cluster_id = e.cluster_id AND vp.i = ph.i),
fine AS (SELECT * FROM duo WHERE email IS NULL OR phone IS NULL OR NOT EXISTS (SELECT 1 FROM val x WHERE x.cluster_id = duo.cluster_id AND x.phone = duo.phone AND x.email IS NOT NULL)
 OR EXISTS (SELECT 1 FROM val x WHERE x.cluster_id = duo.cluster_id AND x.phone = duo.phone AND x.email = duo.email)),
pair AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY et + pt DESC, et DESC, ei, pt DESC, pi) AS rn FROM fine) WHERE rn = 1),
pick AS (SELECT cluster_id, bundle, i FROM single UNION ALL SELECT cluster_id, 'email', ei FROM pair WHERE ei >= 0 UNION ALL SELECT cluster_id, 'phone', pi FROM pair WHERE pi >= 0)
SELECT b.cluster_id, b.field_name, CASE WHEN tr.ok THEN tr.value END AS value, CASE WHEN tr.ok THEN tr.source_system ELSE 'none' END AS source_system, CASE WHEN tr.ok THEN tr.record_id END AS record_id,
 CASE WHEN b.long THEN 'longest_populated_' WHEN NOT coalesce(tr.ok, false) THEN 'no_value_' WHEN tr.place IS NOT NULL THEN 'source_precedence_' ELSE 'fallback_first_nonnull_' END || b.field_name AS rule_name,
 CASE WHEN NOT coalesce(tr.ok, false) THEN 0.0 WHEN b.long THEN 0.7 WHEN tr.place = 0 THEN 1.0 WHEN tr.place > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence
FROM b LEFT JOIN pick ON pick.cluster_id = b.cluster_id AND pick.bundle = b.bundle LEFT JOIN tr ON tr.cluster_id = b.cluster_id AND tr.field_name = b.field_name AND tr.i = pick.i"""


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return group_ids(match_links(table(spark, sf, "match_result")), "record_a_id", "record_b_id")


def p5_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return p5_found(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_records"))


P5_SQL = """WITH RECURSIVE l AS (SELECT record_a_id AS a, record_b_id AS b FROM match_result WHERE "match" AND record_a_id NOT IN ('', 'unknown') AND record_b_id NOT IN ('', 'unknown') AND record_a_id <> record_b_id),
s AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c AS (SELECT a, b FROM s UNION SELECT c.a, s.b FROM c JOIN s ON c.b = s.a),
g AS (SELECT a AS record_id, min(b) AS group_id FROM c GROUP BY a)
"""


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matched pairs with confidence, score and the agreement of each attribute."""
    return match_people(*[table(spark, sf, t) for t in ("crm", "merger_a", "merger_c", "golden_pair")])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_matches(spark, sf).select("record_a_id", "record_b_id")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Which tokens of which document go into which container, for each kind; all texts are counted, n_tokens isn't read."""
    counts = token_counts(table(spark, sf, "documents").select("doc_id", "text"))
    return pack(counts, table(spark, sf, "container_kind"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers needed by kind, against the least possible number."""
    return fill(p8_containers(spark, sf), table(spark, sf, "container_kind"))


def p8_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind the tokens and documents that were packed, and whether no container is over its capacity."""
    kinds = table(spark, sf, "container_kind")
    packed = p8_containers(spark, sf)
    full = fill(packed, kinds).select("kind_name", "tokens", (F.col("most") <= F.col("capacity_tokens")).alias("within"), (F.col("containers") >= F.col("least_possible")).alias("enough"))
    return full.join(packed.groupBy("kind_name").agg(F.count_distinct("doc_id").alias("documents")), "kind_name")


P8_TOTALS_SQL = """WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}\\x{b}\\x{1c}-\\x{1f}\\x{85}]+')) AS n FROM documents)
SELECT kind_name, CAST(sum(n) AS BIGINT) AS tokens, true AS within, true AS enough, count(DISTINCT doc_id) AS documents FROM d, container_kind WHERE n > 0 GROUP BY kind_name"""


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_item")).select("doc_id", "item_id")


def p9_longest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaking documents with the longest run of words of each item."""
    return leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_item"))


def p9_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Leaking documents with the leaking spans cut out."""
    return clean(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_item"))


P9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_item),
dg AS (SELECT doc_id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
ig AS (SELECT item_id, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_places(table(spark, sf, "documents").filter("file_kind = 'prose'").select("doc_id", "text"))


def p10_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every document, whatever its kind, with its place and text."""
    return sentences(table(spark, sf, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p4_found, p4_golden, p4_bundles, p5_found, p5_group_sizes, p7_found, p7_matches, p8_containers, p8_fill, p8_totals, p9_found, p9_longest, p9_cleaned, p10_found, p10_sentences)}
SQL = {"p4_found": P4_FOUND_SQL, "p4_golden": P4_GOLDEN_SQL, "p9_found": P9_SQL, "p4_bundles": P4_BUNDLES_SQL, "p5_found": P5_SQL + "SELECT * FROM g", "p5_group_sizes": P5_SQL + "SELECT group_id, count(*) AS n_records FROM g GROUP BY group_id", "p8_totals": P8_TOTALS_SQL}
