"""One query per operator of the medallion pipeline over whole tables, with its SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import PII, customer_code, email_masked, email_norm, phone_digits, positive_integer, without_zone, zfill
from ..operators import golden, ingest, lineage, profile, quality, resolution, scorecard
from ..session import table, work_dir
from ..sources.api import ingest_api
from ..sources.zones import counts_by_prefix, file_stats, read_strict, read_tolerant, read_zone
from ..streaming import cdc

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
RUN = "run-fixed"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Landing -----------------------------------------------------------------------------------------------------------

_STRIP = "regexp_replace(regexp_replace({c}, '^[\\s\\x{{b}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ''), '[\\s\\x{{b}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+$', '')"
_CHECKED = f"""
WITH s AS (SELECT pos_row, run_id, {_STRIP.format(c="customer_id")} AS id, {_STRIP.format(c="order_date")} AS od FROM pos),
v AS (SELECT *, coalesce(regexp_full_match(id, '[0-9]+') AND regexp_matches(id, '[1-9]'), false) AS ok, coalesce(od, '') <> '' AS dated, regexp_replace(coalesce(id, ''), '[^0-9]', '', 'g') AS dg FROM s),
r AS (SELECT *, CASE WHEN ok THEN id WHEN dg = '' THEN id ELSE coalesce(nullif(ltrim(dg, '0'), ''), '0') END AS fixed FROM v),
c AS (SELECT *, coalesce(regexp_full_match(fixed, '[0-9]+') AND regexp_matches(fixed, '[1-9]'), false) AS ok2 FROM r),
k AS (SELECT pos_row, run_id, CASE WHEN ok AND dated THEN id ELSE fixed END AS customer_id, od, CASE WHEN ok AND dated THEN 0 WHEN ok2 AND dated THEN 1 ELSE 3 END AS retry_count, NOT ok2 AS bad_id, NOT dated AS bad_date FROM c)
"""


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.validate_retry(table(spark, sf, "pos"), ingest.POS, "pos")


@query(_CHECKED + "SELECT pos_row, customer_id, retry_count, CAST(bad_id AS INT) + CAST(bad_date AS INT) AS n_errors FROM k")
def bronze_validate_retry(spark, sf):
    return _checked(spark, sf).select("pos_row", "customer_id", "retry_count", F.size("errors").alias("n_errors"))


@query(
    _CHECKED
    + "SELECT pos_row AS row_index, 'customer_id' AS field, 'must be positive integer' AS error, coalesce(customer_id, 'None') AS raw_value, retry_count FROM k WHERE bad_id UNION ALL SELECT pos_row, 'order_date', 'missing required field', coalesce(od, 'None'), retry_count FROM k WHERE bad_date"
)
def bronze_dead_letters(spark, sf):
    return ingest.dead_letters(_checked(spark, sf), "pos_row")


@query(_CHECKED + "SELECT run_id, count(*) FILTER (NOT bad_id AND NOT bad_date) AS records_landed, CAST(sum(CAST(bad_id AS INT) + CAST(bad_date AS INT)) AS BIGINT) AS errors, CAST(sum(retry_count) AS BIGINT) AS total_retries FROM k GROUP BY run_id")
def bronze_ingest_summary(spark, sf):
    return ingest.summary(_checked(spark, sf), "run_id")


@query("SELECT run_id, count(*) FILTER (coalesce(trim(business_entity_id), '') <> '') AS records_landed, count(*) FILTER (coalesce(trim(business_entity_id), '') = '') AS errors, 3 * count(*) FILTER (coalesce(trim(business_entity_id), '') = '') AS total_retries FROM crm GROUP BY run_id")
def bronze_crm_summary(spark, sf):
    return ingest.summary(ingest.validate_retry(table(spark, sf, "crm"), ingest.CRM, "crm"), "run_id")


@query(
    """SELECT n_nationkey, n_name, n_regionkey, 'tpch' AS source_system, 'run-fixed' AS run_id, '2026-01-01T00:00:00+00:00' AS ingested_at, 25::BIGINT AS row_count,
 substr(sha256('[["n_name", "string"], ["n_nationkey", "string"], ["n_regionkey", "string"]]'), 1, 16) AS schema_fingerprint, 'nation.parquet' AS source_file FROM nation"""
)
def bronze_lineage(spark, sf):
    d = table(spark, sf, "nation")
    return lineage.attach(d, lineage.make_lineage("tpch", "nation.parquet", d.count(), d.columns, RUN, NOW))


@query(
    """SELECT * EXCLUDE (run_id, ingested_at), 'pos' AS source_system, 'run-fixed' AS run_id, '2026-01-01T00:00:00+00:00' AS ingested_at, (SELECT count(*) FROM pos) AS row_count,
 substr(sha256('[["address", "string"], ["customer_id", "string"], ["email", "string"], ["first_name", "string"], ["ingested_at", "string"], ["last_name", "string"], ["order_date", "string"], ["phone", "string"], ["pos_row", "string"], ["run_id", "string"], ["store_id", "string"], ["total_amount", "string"]]'), 1, 16) AS schema_fingerprint, 'pos.parquet' AS source_file FROM pos"""
)
def bronze_lineage_pos(spark, sf):
    """The stamp on landed rows of a table that grows; it replaces the run and time that they came with."""
    d = table(spark, sf, "pos")
    return lineage.attach(d, lineage.make_lineage("pos", "pos.parquet", d.count(), d.columns, RUN, NOW))


@query("SELECT split_part(source_file, '_', 1) AS prefix, count(*) AS n FROM raw_record GROUP BY 1")
def bronze_counts_by_prefix(spark, sf):
    return counts_by_prefix(table(spark, sf, "raw_record"), "source_file")


_FIELDS = ["customer_id", "first_name", "last_name", "email", "phone", "address", "order_date", "total_amount"]


def _landed_zone(spark: SparkSession, sf: str) -> str:
    """The pos rows as CSV files, landed: the root of the zone."""
    root = work_dir(spark, "zone")
    keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf, "pos").select("pos_row", *_FIELDS).write.csv(f"{root}/in", **keep)
    ingest.ingest_csv(spark, f"{root}/in", "pos", ingest.POS, f"{root}/bronze", RUN, NOW)
    return f"{root}/bronze"


@query(_CHECKED + "SELECT pos_row::VARCHAR AS pos_row, customer_id, od AS order_date, 'pos' AS source_system, 'run-fixed' AS run_id, (SELECT count(*) FROM k WHERE NOT bad_id AND NOT bad_date) AS row_count, 'data' AS kind FROM k WHERE NOT bad_id AND NOT bad_date")
def landing_csv(spark, sf):
    """Rows read back from the zone after landing CSV files."""
    d = read_zone(spark, _landed_zone(spark, sf), "pos")
    return d.select("pos_row", "customer_id", "order_date", "source_system", "run_id", F.col("row_count").cast("bigint").alias("row_count"), "kind")


@query(
    _CHECKED
    + "SELECT field, error, raw_value, retry_count, count(*) AS n FROM (SELECT 'customer_id' AS field, 'must be positive integer' AS error, coalesce(nullif(customer_id, ''), 'None') AS raw_value, retry_count FROM k WHERE bad_id UNION ALL SELECT 'order_date', 'missing required field', coalesce(nullif(od, ''), 'None'), retry_count FROM k WHERE bad_date) GROUP BY ALL"
)
def landing_dead_letters(spark, sf):
    """Dead letters read back strictly."""
    d = read_strict(spark, "row_index bigint, field string, error string, raw_value string, retry_count int", f"{_landed_zone(spark, sf)}/pos/kind=error")
    shown = F.coalesce(F.nullif("raw_value", F.lit("")), F.lit("None"))  # a CSV cell without text is read as none
    return d.groupBy("field", "error", shown.alias("raw_value"), "retry_count").agg(F.count(F.lit(1)).alias("n"))


@query(_CHECKED + "SELECT 'data' AS kind, count(*) FILTER (NOT bad_id AND NOT bad_date) AS n, count(*) FILTER (NOT bad_id AND NOT bad_date) AS readable FROM k UNION ALL SELECT 'error', (count(*) FILTER (bad_id) + count(*) FILTER (bad_date)), (count(*) FILTER (bad_id) + count(*) FILTER (bad_date)) FROM k")
def landing_file_rows(spark, sf):
    """Lines of the landed files by kind, and those of them that are JSON."""
    zone, out = _landed_zone(spark, sf), None
    for kind in ("data", "error"):
        path = f"{zone}/pos/kind={kind}"
        lines = file_stats(spark, path).agg(F.sum("rows").alias("n"))
        part = lines.join(read_tolerant(spark, path).agg(F.count(F.lit(1)).alias("readable"))).select(F.lit(kind).alias("kind"), "n", "readable")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT store_id, store_name, time_zone, 'stores' AS source_system, 3::BIGINT AS calls, (SELECT count(*) FROM store_zone) AS landed FROM store_zone")
def landing_api(spark, sf):
    """Rows of an API that fails twice before it answers."""
    rows, calls, root = [r.asDict() for r in table(spark, sf, "store_zone").select("store_id", "store_name", "time_zone").collect()], [], work_dir(spark, "api")

    def fetch(endpoint):
        calls.append(endpoint)
        if len(calls) < 3:
            raise ConnectionError("no answer")
        return rows

    r = ingest_api(spark, "/stores", "stores", fetch, root, sleep=lambda s: None)
    return read_zone(spark, root, "stores").select("store_id", "store_name", "time_zone", "source_system", F.lit(len(calls)).cast("bigint").alias("calls"), F.lit(r.landed).cast("bigint").alias("landed"))


@query("SELECT source_file, count(*) AS rows, count(*) FILTER (coalesce(trim(raw_line, ' '), '') <> '') AS non_blank FROM raw_record GROUP BY 1")
def bronze_file_counts(spark, sf):
    return table(spark, sf, "raw_record").groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.trim("raw_line"), F.lit("")) != "").alias("non_blank"))


# Change events -------------------------------------------------------------------------------------------------------

_PERSON = ["business_entity_id", "first_name", "last_name", "phone", "city", "state"]


@query(
    "SELECT event_no, "
    + ", ".join(f"json_extract_string(\"after\", '$.{c}') AS {c}" for c in _PERSON)
    + """, coalesce(op, 'r') AS _cdc_op, coalesce(ts_ms, 0) AS _cdc_ts_ms, coalesce(topic, 'unknown') AS _cdc_topic, coalesce(op = 'd', false) AS _cdc_tombstone, CASE WHEN op = 'd' THEN "before" END AS _cdc_before FROM cdc_event"""
)
def cdc_landing(spark, sf):
    return cdc.land(table(spark, sf, "cdc_event"), _PERSON)


@query("SELECT topic, count(*) FILTER (op = 'i') AS inserts, count(*) FILTER (op = 'u') AS updates, count(*) FILTER (op = 'd') AS deletes, count(*) AS landed FROM cdc_event GROUP BY topic")
def cdc_op_counts(spark, sf):
    return cdc.op_counts(table(spark, sf, "cdc_event"), "topic")


@query("SELECT time_bucket(INTERVAL 1 HOUR, make_timestamp(ts_ms * 1000)) AS start, lower(op) AS op, count(*) AS n FROM cdc_event GROUP BY ALL")
def cdc_windowed_ops(spark, sf):
    return cdc.windowed_ops(table(spark, sf, "cdc_event"))


@query(
    """SELECT event_no, lower(op) AS op, ts_ms, json_extract_string("after", '$.business_entity_id') AS after_id, json_extract_string("before", '$.business_entity_id') AS before_id, 'unknown' AS source_db, coalesce(topic, 'unknown') AS topic FROM cdc_event"""
)
def cdc_parse_envelope(spark, sf):
    e = table(spark, sf, "cdc_event")
    raw = F.to_json(F.struct("topic", F.struct(F.lower("op").alias("op"), "ts_ms", F.parse_json("before").alias("before"), F.parse_json("after").alias("after")).alias("payload")))
    d = e.select("event_no", cdc.parse_envelopes(raw).alias("e"))
    key = lambda c: F.get_json_object(f"e.{c}", "$.business_entity_id")
    return d.select("event_no", "e.op", "e.ts_ms", key("after").alias("after_id"), key("before").alias("before_id"), "e.source_db", "e.topic")


# Quality -------------------------------------------------------------------------------------------------------------

_NULLS = ["phone", "dob", "notes", "postal_code", "first_name"]


_LIMITS = {"phone": 0.05, "dob": 0.9, "notes": 0.5, "postal_code": 0.0, "first_name": 0.02}
_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS field, {x} AS most, count(*) FILTER ({c} IS NULL OR {c} = '') AS missing, count(*) AS n FROM crm" for c, x in _LIMITS.items())


@query(f"SELECT 'null_rate_' || field AS rule_id, missing <= most * n AS passed, CASE WHEN missing > most * n THEN field || ': ' || format('{{:.1f}}', round_even(missing * 100.0 / n, 1)) || '% missing' ELSE '' END AS finding FROM ({_MISSING})")
def quality_null_rate(spark, sf):
    """The null-rate rules of a run, in one aggregation."""
    results = quality.run_checks(table(spark, sf, "crm"), [quality.null_rate(c, x) for c, x in _LIMITS.items()])
    return spark.createDataFrame([(r.rule_id, r.passed, r.violations[0].split(",")[0] if r.violations else "") for r in results], "rule_id string, passed boolean, finding string")


@query(f"SELECT field, missing, n, missing / n AS rate FROM ({_MISSING})")
def quality_null_shares(spark, sf):
    d = table(spark, sf, "crm")
    one = d.agg(F.count(F.lit(1)).alias("n"), *[quality.missing(d, c).alias(c) for c in _NULLS])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in _NULLS])).alias("x"))
    return long.select("x.field", "x.missing", "n", (F.col("missing") / F.col("n")).alias("rate"))


_EXPECTED = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_comment"]


@query(f"WITH e AS (SELECT unnest({_EXPECTED}) AS field), h AS (SELECT column_name AS field FROM (DESCRIBE SELECT * FROM orders)) SELECT 'missing' AS kind, field FROM e ANTI JOIN h USING (field) UNION ALL SELECT 'unexpected', field FROM h ANTI JOIN e USING (field)")
def quality_schema_drift(spark, sf):
    lost, extra = quality.drift(_EXPECTED, table(spark, sf, "orders").columns)
    return spark.createDataFrame([("missing", c) for c in lost] + [("unexpected", c) for c in extra], "kind string, field string")


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT n, row_number() OVER (ORDER BY day DESC) AS r FROM d),
b AS (SELECT avg(n) AS m, stddev_samp(n) AS s FROM w WHERE r BETWEEN 2 AND 8) SELECT 'volume_anomaly' AS rule_id, 'ALERT' AS policy, (SELECT n FROM w WHERE r = 1) BETWEEN m - 2 * s AND m + 2 * s AS passed FROM b"""
)
def quality_volume_rule(spark, sf):
    """The volume rule on the last day against the seven days before it that have rows."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(8).collect()
    r = quality.judge_volume([d.n for d in days])
    return spark.createDataFrame([(r.rule_id, r.policy, r.passed)], "rule_id string, policy string, passed boolean")


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT *, avg(n) OVER x AS baseline, CASE WHEN count(n) OVER x > 1 THEN stddev_samp(n) OVER x ELSE 0.1 * avg(n) OVER x END AS spread FROM d WINDOW x AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT day, event_type, n, baseline, spread, coalesce(n < baseline - 2 * spread OR n > baseline + 2 * spread, false) AS anomaly FROM w"""
)
def quality_volume_anomaly(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return quality.volume_by_day(d, "day", "n", "event_type")


@query("SELECT pos_row, customer_id FROM pos WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT business_entity_id FROM crm WHERE business_entity_id IS NOT NULL)")
def quality_orphans(spark, sf):
    return quality.orphans(table(spark, sf, "pos"), "customer_id", table(spark, sf, "crm"), "business_entity_id").select("pos_row", "customer_id")


@query("SELECT pos_row, store_id FROM pos ANTI JOIN (SELECT store_id FROM store_zone WHERE date_order = 'mdy') z USING (store_id) WHERE store_id IS NOT NULL ORDER BY pos_row LIMIT 10")
def quality_ref_integrity(spark, sf):
    parents = table(spark, sf, "store_zone").filter("date_order = 'mdy'")
    return quality.orphans(table(spark, sf, "pos"), "store_id", parents, "store_id").select("pos_row", "store_id").orderBy("pos_row").limit(10)


_PII_SQL = {k: p.replace("(?U)", "").replace("\\\\", "\\") for k, p in PII.items()}


@query(
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(text, '{p}') THEN 'text:{k}'" for k, p in _PII_SQL.items())
    + " END AS found FROM documents WHERE text IS NOT NULL AND ("
    + " OR ".join(f"regexp_matches(text, '{p}')" for p in _PII_SQL.values())
    + ")"
)
def quality_pii_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", quality.pii_fields(d, ("doc_id",)).alias("f")).filter(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("found"))


@query(SQL["quality_pii_rows"] + " ORDER BY doc_id LIMIT 5")
def quality_pii_first5(spark, sf):
    return quality_pii_rows(spark, sf).orderBy("doc_id").limit(5)


def _gold_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Gold rows with a masked address from merger_c: one per key."""
    d = table(spark, sf, "merger_c")
    stamp = F.concat("created_date", F.lit("T00:00:00Z"))
    rows = d.select(F.col("uuid").alias("customer_id"), "first_name", "last_name", email_masked(email_norm(F.col("email"))).alias("email_masked"), F.lit(None).cast("string").alias("loyalty_segment"), F.lit(0.9).alias("record_confidence"), F.lit("merger_c").alias("source_systems"), stamp.alias("created_at_utc"), stamp.alias("updated_at_utc"))
    return rows


@query("SELECT uuid AS customer_id, CASE WHEN contains(e, '@') THEN substr(e, 1, 2) || '**@' || split_part(e, '@', -1) END AS email_masked FROM (SELECT uuid, regexp_replace(lower(trim(email)), '\\+[^@]*@', '@', 'g') AS e FROM merger_c)")
def gold_email_masked(spark, sf):
    return _gold_customers(spark, sf).select("customer_id", "email_masked")


@query(
    """WITH r(rule_id, policy, bad, ord) AS (VALUES ('schema_drift', 'BREAK', 0, 0), ('pii_in_gold', 'BREAK', 0, 1)),
n AS (SELECT 'null_rate_' || f AS rule_id, 'BREAK' AS policy, b AS bad, o AS ord FROM (SELECT 'customer_id' AS f, count(*) FILTER (coalesce(uuid, '') = '') AS b, 2 AS o FROM merger_c UNION ALL SELECT 'first_name', count(*) FILTER (coalesce(first_name, '') = ''), 3 FROM merger_c
 UNION ALL SELECT 'last_name', count(*) FILTER (coalesce(last_name, '') = ''), 4 FROM merger_c UNION ALL SELECT 'record_confidence', 0, 5 UNION ALL SELECT 'source_systems', 0, 6 UNION ALL SELECT 'created_at_utc', count(*) FILTER (created_date IS NULL), 7 FROM merger_c UNION ALL SELECT 'updated_at_utc', count(*) FILTER (created_date IS NULL), 8 FROM merger_c))
SELECT ord AS position, rule_id, policy, bad = 0 AS passed FROM (SELECT * FROM r UNION ALL SELECT * FROM n)"""
)
def gold_gate_results(spark, sf):
    results = quality.run_checks(_gold_customers(spark, sf), quality.gold_rules(quality.load_contract("customer"), "customer_id"))
    return spark.createDataFrame([(i, r.rule_id, r.policy, r.passed) for i, r in enumerate(results)], "position int, rule_id string, policy string, passed boolean")


# Resolution ----------------------------------------------------------------------------------------------------------

_DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"
_TEN = "CASE WHEN length({d}) >= 10 THEN right({d}, 10) END"
_TEN_OF = lambda c: _TEN.format(d=_DIGITS.format(c=c))


@query(
    f"""WITH c AS (SELECT DISTINCT business_entity_id AS a_id, {_TEN_OF("phone")} AS p, lower(trim(last_name)) || '|' || split_part(trim(address_line1), ' ', 1) AS h FROM crm),
m AS (SELECT DISTINCT uuid AS b_id, {_TEN_OF("phone")} AS p, lower(trim(last_name)) || '|' || split_part(trim(address_line1), ' ', 1) AS h FROM merger_c),
k AS (SELECT DISTINCT a_id, b_id, 'phone' AS b FROM c JOIN m USING (p) UNION SELECT DISTINCT a_id, b_id, 'name_house' FROM c JOIN m USING (h))
SELECT a_id, b_id, string_agg(b, ',' ORDER BY b) AS blocks FROM k GROUP BY ALL"""
)
def er_blocking_pairs(spark, sf):
    house = lambda: F.concat(F.lower(F.trim("last_name")), F.lit("|"), F.substring_index(F.trim("address_line1"), " ", 1))
    keys = {"phone": (phone_digits(F.col("phone")), phone_digits(F.col("phone"))), "name_house": (house(), house())}
    return resolution.blocked_pairs(table(spark, sf, "crm"), table(spark, sf, "merger_c"), keys, "business_entity_id", "uuid")


@query()
def er_match_scores(spark, sf):
    d = resolution.match_pairs(table(spark, sf, "golden_pair"))
    return d.select("pair_id", "label", "match", "confidence", "reason", "record_a_id", "record_b_id")


@query(
    """SELECT record_a_id AS anchor_id, CASE WHEN bool_or(coalesce(confidence, 0) < 0.5) THEN 'review' ELSE 'resolved' END AS status, CASE WHEN bool_or(coalesce(confidence, 0) < 0.5) THEN 0 ELSE count(*) FILTER (coalesce("match", false)) END AS members,
 count(*) FILTER (NOT coalesce("match", false)) AS non_matches, count(*) AS n_pairs FROM match_result GROUP BY record_a_id"""
)
def er_cluster_resolution(spark, sf):
    return resolution.resolve_stars(table(spark, sf, "match_result"), "record_a_id", "record_b_id")


_LONG = """WITH f AS (SELECT DISTINCT cluster_id, source_system, member_pos, field_name AS field, value, CAST(updated_at AS VARCHAR) AS upd FROM survived_field),
s AS (SELECT cluster_id, source_system, min(member_pos) AS pos, max(member_pos) AS last FROM f GROUP BY ALL),
c AS (SELECT f.cluster_id, f.source_system, f.field, f.value, f.upd, s.pos FROM f JOIN s ON f.cluster_id = s.cluster_id AND f.source_system = s.source_system AND f.member_pos = s.last)
"""
_PLACES = ", ".join(f"('{f}', '{n}', {i})" for f, s in golden.PRECEDENCE.items() for i, n in enumerate(s))
_HAS = "regexp_replace(coalesce(value, ''), '[\\s\\x{b}\\x{85}\\x{a0}]', '', 'g') <> ''"
_PREC = f"""p AS (SELECT * FROM (VALUES {_PLACES}) t(field, source_system, place)),
w AS (SELECT c.cluster_id, c.field, c.value, c.source_system, p.place, {_HAS} AS has, row_number() OVER (PARTITION BY c.cluster_id, c.field ORDER BY {_HAS} DESC, coalesce(p.place, 1000), c.pos) AS rn
 FROM c LEFT JOIN p ON c.field = p.field AND c.source_system = p.source_system WHERE c.field NOT IN ('notes', 'middle_name')),
prec AS (SELECT cluster_id, field, CASE WHEN has THEN value END AS value, CASE WHEN has THEN source_system ELSE 'none' END AS source_system,
 CASE WHEN NOT has THEN 'no_value_' WHEN place IS NOT NULL THEN 'source_precedence_' ELSE 'fallback_first_nonnull_' END || field AS rule_name, CASE WHEN NOT has THEN 0.0 WHEN place = 0 THEN 1.0 WHEN place IS NOT NULL THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM w WHERE rn = 1)"""
_LEN = """l AS (SELECT *, coalesce(value, '') <> '' AS has, row_number() OVER (PARTITION BY cluster_id, field ORDER BY coalesce(value, '') <> '' DESC, length(value) DESC, pos) AS rn FROM c WHERE field IN ('notes', 'middle_name')),
len AS (SELECT cluster_id, field, CASE WHEN has THEN value END AS value, CASE WHEN has THEN source_system ELSE 'none' END AS source_system, 'longest_populated_' || field AS rule_name, CASE WHEN has THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM l WHERE rn = 1)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "survived_field").select("cluster_id", F.col("field_name").alias("field"), "value", "source_system", F.col("member_pos").alias("pos"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return golden.last_per_source(d)


@query(f"{_LONG}, {_PREC} SELECT * FROM prec")
def survivorship_precedence(spark, sf):
    return golden.by_precedence(_candidates(spark, sf).filter(~F.col("field").isin(*golden.FREE_TEXT)))


@query(f"{_LONG}, {_LEN} SELECT * FROM len")
def survivorship_longest(spark, sf):
    return golden.by_length(_candidates(spark, sf).filter(F.col("field").isin(*golden.FREE_TEXT)))


@query(
    _LONG
    + """, r AS (SELECT *, coalesce(value, '') <> '' AND coalesce(upd, '') <> '' AS has, row_number() OVER (PARTITION BY cluster_id, field ORDER BY coalesce(value, '') <> '' AND coalesce(upd, '') <> '' DESC, upd DESC, pos) AS rn FROM c)
SELECT cluster_id, field, CASE WHEN has THEN value END AS value, CASE WHEN has THEN source_system ELSE 'none' END AS source_system, 'most_recent_' || field AS rule_name, CASE WHEN has THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM r WHERE rn = 1"""
)
def survivorship_most_recent(spark, sf):
    return golden.by_recency(_candidates(spark, sf), "at")


_SCORE = f"""{_LONG}, {_PREC}, {_LEN}, a AS (SELECT * FROM prec UNION ALL SELECT * FROM len),
g AS (SELECT cluster_id, sum(CAST(round(confidence * 10) AS BIGINT) * k)::BIGINT * 10000 AS num, sum(k * 10)::BIGINT AS den, string_agg(field, ',' ORDER BY field) FILTER (confidence < 0.5) AS low FROM (SELECT *, CASE WHEN field IN ('email','phone','first_name','last_name','loyalty_num','birth_date') THEN 2 ELSE 1 END AS k FROM a) GROUP BY cluster_id),
q AS (SELECT cluster_id, low, (num // den + CASE WHEN 2 * (num % den) > den OR (2 * (num % den) = den AND (num // den) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0 AS score FROM g)
"""


@query(_SCORE + "SELECT cluster_id, score AS record_confidence, score >= 0.85 AS high_confidence, coalesce(low, '') AS low_fields FROM q")
def golden_record_confidence(spark, sf):
    return golden.record_scores(golden.merge(_candidates(spark, sf)))


@query(
    _SCORE
    + """, e AS (SELECT cluster_id, string_agg(field || '=' || coalesce(value, '') || '|' || rule_name, ';' ORDER BY field) AS entries FROM a GROUP BY cluster_id), o AS (SELECT cluster_id, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS source_systems FROM c GROUP BY cluster_id)
SELECT cluster_id, entries, source_systems, score AS record_confidence FROM q JOIN e USING (cluster_id) JOIN o USING (cluster_id)"""
)
def golden_records(spark, sf):
    d = golden.golden_records(_candidates(spark, sf))
    pairs = F.transform(F.map_keys("fields"), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at("fields", k), F.lit("")), F.lit("|"), F.try_element_at("survivorship_rules", k)))
    return d.select("cluster_id", F.array_join(pairs, ";").alias("entries"), F.array_join("source_systems", ",").alias("source_systems"), "record_confidence")


@query(f"SELECT cluster_id, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS source_systems, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM ({_SCORE} SELECT q.cluster_id, q.score, c.source_system FROM q JOIN c USING (cluster_id)) GROUP BY cluster_id, score")
def gold_source_systems(spark, sf):
    d = golden.golden_records(_candidates(spark, sf))
    band = F.when(F.col("record_confidence") >= 0.85, "high").when(F.col("record_confidence") >= 0.5, "medium").otherwise("low")
    return d.select("cluster_id", F.array_join("source_systems", ",").alias("source_systems"), band.alias("band"))


_SAME_PHONE = f"regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g')"
_CLUSTERS = f"""WITH m AS (SELECT DISTINCT cluster_id, member_pos, source_system, field_name AS field, value FROM survived_field),
z AS (SELECT cluster_id, min(member_pos) AS anchor, min(member_pos) = max(member_pos) AS alone FROM m GROUP BY 1),
ph AS (SELECT cluster_id, member_pos, max(right({_SAME_PHONE}, 10)) AS p FROM m WHERE field = 'phone' AND length({_SAME_PHONE}) >= 10 GROUP BY ALL),
mp AS (SELECT DISTINCT cluster_id, member_pos FROM m),
vd AS (SELECT mp.cluster_id, mp.member_pos, coalesce(a.p = b.p, false) AS ok, CASE WHEN a.p = b.p THEN 0.93 WHEN a.p IS NULL THEN 0.4 WHEN b.p IS NULL THEN 0.6 ELSE 0.9 END AS conf
 FROM mp JOIN z USING (cluster_id) LEFT JOIN ph a ON a.cluster_id = z.cluster_id AND a.member_pos = z.anchor LEFT JOIN ph b ON b.cluster_id = mp.cluster_id AND b.member_pos = mp.member_pos WHERE mp.member_pos <> z.anchor),
rv AS (SELECT cluster_id FROM vd GROUP BY 1 HAVING bool_or(conf < 0.5)),
"""


def _verdicts(members: DataFrame) -> DataFrame:
    """A plain matcher for clusters: equal phones match at 0.93; without the anchor's phone nobody can tell (0.4)."""
    phone = F.max(F.when(F.col("field") == "phone", phone_digits(F.col("value")))).alias("p")
    d = members.groupBy("cluster_id", "member_pos").agg(phone)
    first = d.groupBy("cluster_id").agg(F.min_by("p", "member_pos").alias("a"), F.min("member_pos").alias("anchor"))
    d = d.join(first, "cluster_id").filter("member_pos <> anchor")
    same = F.coalesce(F.col("a") == F.col("p"), F.lit(False))
    return d.select("cluster_id", "member_pos", same.alias("match"), F.when(same, 0.93).when(F.col("a").isNull(), 0.4).when(F.col("p").isNull(), 0.6).otherwise(0.9).alias("confidence"))


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    members = table(spark, sf, "survived_field").select("cluster_id", "member_pos", "source_system", F.col("field_name").alias("field"), "value")
    return resolution.resolve_clusters(members, _verdicts(members))


@query(
    _CLUSTERS
    + f"""kept AS (SELECT m.* FROM m JOIN z USING (cluster_id) LEFT JOIN vd ON vd.cluster_id = m.cluster_id AND vd.member_pos = m.member_pos WHERE (m.member_pos = z.anchor OR coalesce(vd.ok, false)) AND m.cluster_id NOT IN (SELECT cluster_id FROM rv)),
s AS (SELECT cluster_id, source_system, min(member_pos) AS pos, max(member_pos) AS last FROM kept GROUP BY ALL),
c AS (SELECT k.cluster_id, k.source_system, k.field, k.value, s.pos FROM kept k JOIN s ON k.cluster_id = s.cluster_id AND k.source_system = s.source_system AND k.member_pos = s.last),
{_PREC}, {_LEN}, a AS (SELECT * FROM prec UNION ALL SELECT * FROM len)
SELECT a.cluster_id, string_agg(field || '=' || coalesce(value, '') || '|' || rule_name, ';' ORDER BY field) AS entries, any_value(z.alone) AS unscored FROM a JOIN z USING (cluster_id) GROUP BY a.cluster_id"""
)
def er_golden(spark, sf):
    """Golden records out of clusters: the anchor and its confirmed members."""
    d = _resolved(spark, sf)[0]
    pairs = F.transform(F.map_keys("fields"), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at("fields", k), F.lit("")), F.lit("|"), F.try_element_at("survivorship_rules", k)))
    return d.select("cluster_id", F.array_join(pairs, ";").alias("entries"), F.col("record_confidence").isNull().alias("unscored"))


@query(_CLUSTERS.rstrip().rstrip(",") + " SELECT cluster_id, 'low confidence' AS reason FROM rv")
def er_review_queue(spark, sf):
    """The review queue as written and read back."""
    folder = work_dir(spark, "review")
    resolution.write_review(_resolved(spark, sf)[1], folder, RUN)
    return spark.read.schema("cluster_id string, reason string").json(folder).select("cluster_id", "reason")


@query(_CLUSTERS.rstrip().rstrip(",") + " SELECT vd.cluster_id, vd.member_pos, m.source_system FROM vd JOIN (SELECT DISTINCT cluster_id, member_pos, source_system FROM m) m ON m.cluster_id = vd.cluster_id AND m.member_pos = vd.member_pos WHERE NOT ok AND vd.cluster_id NOT IN (SELECT cluster_id FROM rv)")
def er_non_matches(spark, sf):
    """Members that were not confirmed, of clusters that were resolved."""
    return _resolved(spark, sf)[2]


_SOURCED = ("email", "phone", "address", "first_name", "last_name", "birth_date")


@query(f"{_LONG}, {_PREC} SELECT cluster_id, " + ", ".join(f"max(CASE WHEN field = '{f}' THEN source_system END) AS {f}_source" for f in _SOURCED) + " FROM prec GROUP BY cluster_id")
def gold_field_sources(spark, sf):
    """The source that each field of a golden record came from."""
    d = golden.by_precedence(_candidates(spark, sf).filter(~F.col("field").isin(*golden.FREE_TEXT)))
    return d.groupBy("cluster_id").agg(*[F.max(F.when(F.col("field") == f, F.col("source_system"))).alias(f"{f}_source") for f in _SOURCED])


# Scorecard -----------------------------------------------------------------------------------------------------------


def phone_matcher(pairs: DataFrame) -> DataFrame:
    """A plain matcher that plugs into the scorecard: equal phones match at 0.93, others don't, at 0.6 if one is missing."""
    a, b = (phone_digits(F.try_element_at(c, F.lit("phone"))) for c in ("record_a", "record_b"))
    same = F.coalesce(a == b, F.lit(False))
    return pairs.withColumns({"match": same, "confidence": F.when(same, 0.93).when(a.isNull() | b.isNull(), 0.6).otherwise(0.9), "reason": F.lit("phone")})


_EVAL = f"""WITH e AS (SELECT pair_id, label, stratum, {_TEN_OF("record_a['phone']")} AS a, {_TEN_OF("record_b['phone']")} AS b FROM golden_pair WHERE label <> 'unclear'),
s AS (SELECT stratum, label = 'match' AS t, coalesce(a = b, false) AS m, CASE WHEN coalesce(a = b, false) THEN 0.93 WHEN a IS NULL OR b IS NULL THEN 0.6 ELSE 0.9 END AS conf FROM e),
g AS (SELECT {{by}} count(*) AS n, count(*) FILTER (m AND t) AS tp, count(*) FILTER (m AND NOT t) AS fp, count(*) FILTER (NOT m AND t) AS fn, count(*) FILTER (NOT m AND NOT t) AS tn, count(*) FILTER (conf >= 0.85) AS sure, count(*) FILTER (conf >= 0.85 AND m <> t) AS wrong FROM s {{group}}),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rc FROM g)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.match_pairs(scorecard.labelled(table(spark, sf, "golden_pair")), phone_matcher)


@query(_EVAL.format(by="", group="") + "SELECT n, tp, fp, fn, tn, round_even(p, 4) AS precision, round_even(rc, 4) AS recall, round_even(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 4) AS f1, round_even(coalesce(wrong / nullif(sure, 0), 0), 4) AS false_confidence_rate FROM r")
def scorecard_overall(spark, sf):
    return scorecard.overall(_scored(spark, sf))


@query(_EVAL.format(by="stratum,", group="GROUP BY stratum") + "SELECT stratum, n, p AS precision, rc AS recall FROM r")
def scorecard_by_stratum(spark, sf):
    return scorecard.by_stratum(_scored(spark, sf))


@query(
    _EVAL.format(by="", group="")
    + "SELECT round_even(p, 4) >= 0.92 AND round_even(rc, 4) >= 0.85 AND round_even(coalesce(wrong / nullif(sure, 0), 0), 4) <= 0.05 AS accepted, true AS first_run, true AS same_again, round_even(coalesce(wrong / nullif(sure, 0), 0), 4) - (round_even(coalesce(wrong / nullif(sure, 0), 0), 4) - 0.02) <= 0.01 AS two_points_worse FROM r"
)
def scorecard_regression(spark, sf):
    """Acceptance, and the stored baseline: the first run stores it, the same rate passes, one two points above it doesn't."""
    m, folder = scorecard.overall(_scored(spark, sf)).first().asDict(), work_dir(spark, "baseline")
    first, again = (scorecard.no_regression(m, spark, folder) for _ in range(2))
    worse = scorecard.no_regression(m | {"false_confidence_rate": m["false_confidence_rate"] + 0.02}, spark, folder)
    return spark.createDataFrame([(scorecard.accepted(m), first, again, worse)], "accepted boolean, first_run boolean, same_again boolean, two_points_worse boolean")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.match_pairs(scorecard.labelled(table(spark, sf, "golden_pair")))


@query()
def scorecard_default(spark, sf):
    """The scorecard of the default matcher."""
    return scorecard.overall(_judged(spark, sf))


@query()
def scorecard_default_by_stratum(spark, sf):
    return scorecard.by_stratum(_judged(spark, sf))


@query("SELECT stratum, count(*) AS n FROM golden_pair WHERE stratum IS NOT NULL GROUP BY stratum")
def scorecard_stratum_counts(spark, sf):
    pairs = table(spark, sf, "golden_pair")
    every = scorecard.strata([pairs.filter(F.col("stratum") == s) for s in ("easy", "medium", "hard", "boundary", "negative_case")])
    return every.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


# Lookups -------------------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 50) SELECT *, (SELECT count(*) FROM h) >= 50 AS truncated FROM h")
def lineage_find(spark, sf):
    return lineage.find_record(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_type", "error", ["event_id"])


@query("SELECT * FROM (SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 10)")
def lineage_preview(spark, sf):
    return lineage.preview(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["doc_id"])


@query(
    """WITH a AS (SELECT business_entity_id AS customer_id, 'phone' AS field, 'crm' AS source_system, run_id, 'source_precedence_phone' AS rule_name, phone AS value FROM crm),
x AS (SELECT * FROM a WHERE customer_id = (SELECT min(business_entity_id) FROM crm))
SELECT 'silver' AS step, source_system, run_id, rule_name, value, NULL::BIGINT AS row_id FROM x UNION ALL SELECT 'bronze', 'crm', run_id, NULL, NULL, crm_row FROM crm WHERE run_id IN (SELECT run_id FROM x)"""
)
def lineage_trace(spark, sf):
    crm = table(spark, sf, "crm")
    audit = crm.select(F.col("business_entity_id").alias("customer_id"), F.lit("phone").alias("field"), F.lit("crm").alias("source_system"), "run_id", F.lit("source_precedence_phone").alias("rule_name"), F.col("phone").alias("value"))
    bronze = crm.select(F.lit("crm").alias("source_system"), "run_id", F.col("crm_row").alias("row_id"))
    first = crm.agg(F.min("business_entity_id")).first()[0]
    return lineage.trace(audit, bronze, "phone", first or "")


_REGISTERED = [
    ("pos", "customer_id", "customer_id,store_id,person_type,name_style,title,first_name,middle_name,last_name,suffix,email,phone,modified_date,order_date"),
    ("ecommerce", "email", "email_address_id,business_entity_id,email,modified_date"),
    ("crm", "business_entity_id", "business_entity_id,person_type,first_name,middle_name,last_name,phone,address_line1,city,state,postal_code"),
    ("loyalty", "loyalty_num", "loyalty_num,store_name,business_type,annual_revenue,modified_date"),
    ("merger_a", "account_id", "account_id,name,address,phone,created_date"),
    ("merger_b", "cust_code", "cust_code,first_name,last_name,middle_name,email,phone"),
    ("merger_c", "uuid", "uuid,first_name,last_name,email,phone,address_line1,city,state,postal_code,created_date"),
]


@query(
    f"""SELECT source, "key", len(string_split(cols, ',')) AS n_columns, cols AS columns, substr(sha256('[' || array_to_string(list_transform(list_sort(string_split(cols, ',')), lambda c: '["' || c || '", "string"]'), ', ') || ']'), 1, 16) AS fingerprint
FROM (VALUES {', '.join(map(str, _REGISTERED))}) t(source, "key", cols)"""
)
def source_registry(spark, sf):
    return lineage.registry(spark)


# Profiles ------------------------------------------------------------------------------------------------------------

_NAMES = ("pos", "crm", "merger_a", "merger_c")


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    sources = [profile.registered(n, "ingested_at" if n in ("pos", "crm") else None) for n in _NAMES]
    return profile.profile_all({n: table(spark, sf, n) for n in _NAMES}, sources, NOW)


_TEXT = "CAST({c} AS VARCHAR)"
_FILLED = "regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[\\s\\x{{b}}\\x{{85}}\\x{{a0}}]', '', 'g') <> ''"
_INTEGER = "regexp_full_match(CAST({c} AS VARCHAR), '[0-9]+') AND regexp_matches(CAST({c} AS VARCHAR), '[1-9]')"
_PROFILED = {
    "pos": ("customer_id first_name last_name email phone address order_date total_amount", _INTEGER.format(c="customer_id"), "ingested_at",
            {"bad_amount": "NOT regexp_full_match(total_amount, '-?[0-9]+(\\.[0-9]+)?')", "upper_mail": "regexp_matches(email, '[A-Z]')", "decorated_key": f"customer_id IS NOT NULL AND NOT ({_INTEGER.format(c='customer_id')})"}),
    "crm": ("business_entity_id first_name last_name phone address_line1 city state postal_code dob notes", _INTEGER.format(c="business_entity_id"), "ingested_at",
            {"short_zip": "length(postal_code) < 5", "odd_dob": "dob <> '' AND NOT regexp_full_match(dob, '[0-9]{4}-[0-9]{2}-[0-9]{2}')"}),
    "merger_a": ("account_id name dob address phone", _INTEGER.format(c="account_id"), None, {"reversed_name": "contains(name, ',')"}),
    "merger_c": ("uuid first_name last_name email phone address_line1 city state", "regexp_full_match(uuid, '[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}')", None, {"plus_tag": "contains(email, '+')", "upper_mail": "regexp_matches(email, '[A-Z]')"}),
}


def _profile_sql(name: str) -> str:
    columns, key, newest, odd = _PROFILED[name]
    cols = columns.split()
    cells = " + ".join(f"count(*) FILTER ({_FILLED.format(c=c)})" for c in cols)
    found = " || ".join(f"CASE WHEN bool_or(coalesce({x}, false)) THEN ',{k}' ELSE '' END" for k, x in odd.items())
    personal = " + ".join("CAST(coalesce(bool_or(" + " OR ".join(f"regexp_matches({_TEXT.format(c=c)}, '{p}')" for p in _PII_SQL.values()) + "), false) AS INT)" for c in cols)
    age = f"{int(NOW.timestamp())} - CAST(floor(epoch(max({newest}))) AS BIGINT)" if newest else str(profile.STALE_HOURS * 3600)
    return f"SELECT '{name}' AS source, count(*) AS n, {len(cols)} AS width, {cells} AS cells, count(*) FILTER ({key}) AS keys, {age} AS age, substr({found}, 2) AS issues, {personal} AS personal FROM {name}"


_PROFILE_SQL = f"""WITH s AS ({" UNION ALL ".join(map(_profile_sql, _PROFILED))}),
d AS (SELECT source, n AS record_count, 100 * cells // (n * width) AS completeness, greatest(0, least(100, floor(100 * ({profile.STALE_HOURS * 3600} - age) / {(profile.STALE_HOURS - profile.FRESH_HOURS) * 3600})))::BIGINT AS freshness, 100 * keys // n AS key_coverage,
 100 - 10 * CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END AS anomaly, 100 - 10 * personal AS pii, issues FROM s),
h AS (SELECT *, (25 * completeness + 20 * freshness + 25 * key_coverage + 20 * anomaly + 10 * pii)::BIGINT // 100 AS health FROM d) """


@query(_PROFILE_SQL + "SELECT * REPLACE (completeness::BIGINT AS completeness, key_coverage::BIGINT AS key_coverage, anomaly::BIGINT AS anomaly, pii::BIGINT AS pii) FROM h")
def profile_dimensions(spark, sf):
    return _profiles(spark, sf)


@query(_PROFILE_SQL + "SELECT round_even(avg(health), 1) AS overall_health, count(*) AS sources FROM h")
def profile_dashboard(spark, sf):
    """The overall health of the dashboard's profiles, run side by side."""
    sources = [profile.registered(n, "ingested_at" if n in ("pos", "crm") else None) for n in _NAMES]
    rows, errors = profile.run_swarm(lambda n: table(spark, sf, n), sources, NOW)
    board = profile.dashboard(spark, rows, errors, work_dir(spark, "dashboard"), NOW)
    return spark.createDataFrame([(board["overall_health_score"], len(board["sources"]))], "overall_health double, sources bigint")


@query(
    "SELECT "
    + ", ".join(f"count(*) FILTER (regexp_replace(coalesce({c}, ''), '[\\s\\x{{b}}\\x{{85}}\\x{{a0}}]', '', 'g') <> '') AS {c}" for c in ("customer_id", "email", "phone", "address"))
    + ", count(*) FILTER (regexp_full_match(customer_id, '[0-9]+') AND regexp_matches(customer_id, '[1-9]')) AS valid_keys, count(*) AS n FROM pos"
)
def profile_completeness(spark, sf):
    from ..functions.values import present

    d = table(spark, sf, "pos")
    return d.agg(*[F.count_if(present(F.col(c))).alias(c) for c in ("customer_id", "email", "phone", "address")], F.count_if(positive_integer(F.col("customer_id"))).alias("valid_keys"), F.count(F.lit(1)).alias("n"))


# Normalisers ---------------------------------------------------------------------------------------------------------


@query(
    f"SELECT pos_row, regexp_replace(lower({_STRIP.format(c='email')}), '\\+[^@]*@', '@', 'g') AS email, {_TEN_OF('phone')} AS phone, CASE WHEN dg <> '' THEN coalesce(nullif(ltrim(dg, '0'), ''), '0') END AS code FROM (SELECT *, regexp_replace(regexp_replace(upper({_STRIP.format(c='customer_id')}), '^[A-Z]+[-_ ]?', ''), '[^0-9]', '', 'g') AS dg FROM pos)"
)
def normalise_contacts(spark, sf):
    return table(spark, sf, "pos").select("pos_row", email_norm(F.col("email")).alias("email"), phone_digits(F.col("phone")).alias("phone"), customer_code(F.col("customer_id")).alias("code"))


@query("SELECT pos_row, CASE WHEN customer_id ~ '^[+-]' THEN left(customer_id, 1) || lpad(substr(customer_id, 2), greatest(11, length(customer_id) - 1)::INT, '0') ELSE lpad(customer_id, greatest(12, length(customer_id))::INT, '0') END AS padded, regexp_replace(regexp_replace(order_date, '(?:Z|[+-]00:?00)$', ''), '\\.[0-9]+$', '') AS wall FROM pos")
def normalise_padded(spark, sf):
    """Codes with their leading zeros, and times without zone and fraction."""
    return table(spark, sf, "pos").select("pos_row", zfill(F.col("customer_id"), 12).alias("padded"), without_zone(F.col("order_date")).alias("wall"))
