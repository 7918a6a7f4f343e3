"""Queries of the general data problems: change feed, rows that fail to parse, mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.change_feed import BucketedTable
from ..operators.timestamps import order_instants
from ..session import table, work_dir
from ..sources.csv_grammar import COLUMNS, error_rows, parse_joined, parse_records, valid_rows


def _current(spark: SparkSession, sf: str, batches: int = 2) -> DataFrame:
    """The person table after the feed has landed in so many batches, the first onto nothing and the others onto what is there.

    Batches are equal ranges of event_no, so together they are all events.
    """
    persons, events = BucketedTable(spark, work_dir(spark, "crm-person"), "business_entity_id"), table(spark, sf, "cdc_event")
    low, high = events.agg(F.min("event_no"), F.max("event_no")).first()
    width = ((high or 0) - (low or 0)) // batches + 1
    number = F.coalesce(F.expr(f"(event_no - {low or 0}) div {width}"), F.lit(0))
    for n in range(batches):
        persons.apply(events.filter(number == n))
    return persons.state()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _current(spark, sf).select(F.col("key").alias("business_entity_id"), "event_no")


def p2_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows when the feed lands in four batches."""
    return _current(spark, sf, 4).select(F.col("key").alias("business_entity_id"), "event_no")


def p2_current_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rebuilt crm person table itself."""
    image = F.from_json("image", "first_name string, last_name string, phone string, city string, state string")
    return _current(spark, sf).select(F.col("key").alias("business_entity_id"), image.alias("i"), "event_no", "ts_ms").select("business_entity_id", "i.*", "event_no", "ts_ms")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return error_rows(parse_records(table(spark, sf, "raw_record"))).select("raw_id", "field_name", "reason").distinct()


def p3_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every error with its message and raw value."""
    return error_rows(parse_records(table(spark, sf, "raw_record")))


def p3_valid_pos(spark: SparkSession, sf: str) -> DataFrame:
    return valid_rows(parse_records(table(spark, sf, "raw_record")), "pos")


def p3_valid_crm(spark: SparkSession, sf: str) -> DataFrame:
    return valid_rows(parse_records(table(spark, sf, "raw_record")), "crm")


def p3_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The records of whole texts, the lines of a file joined, with recovery at validated record starts."""
    return parse_joined(table(spark, sf, "raw_record"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    d = order_instants(table(spark, sf, "pos").select("pos_row", "order_date", "store_id"), table(spark, sf, "store_zone"))
    return d.filter("ts_status = 'ok'").select("pos_row", F.floor(F.col("ts_us") / 1000).cast("bigint").alias("order_ms"))


def p6_not_determinable(spark: SparkSession, sf: str) -> DataFrame:
    d = order_instants(table(spark, sf, "pos").select("pos_row", "order_date", "store_id"), table(spark, sf, "store_zone"))
    return d.filter("ts_status <> 'ok'").select("pos_row", "order_date", F.col("ts_status").alias("status"))


QUERIES = {f.__name__: f for f in (p2_found, p2_incremental, p2_current_rows, p3_found, p3_errors, p3_valid_pos, p3_valid_crm, p3_texts, p6_found, p6_not_determinable)}

# One record by RFC 4180 as to double quotes: bare fields hold none, quoted ones are closed right before a comma or the end.
_FIELD = """("([^"]|"")*"|[^",]*)"""
_KEY_BAD = "NOT (regexp_full_match({v}, '[0-9]+') AND regexp_matches({v}, '[1-9]'))"
_STAMP_BAD = "NOT (regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND left({v}, 4) <> '0000' AND try_cast(left({v}, 10) AS DATE) IS NOT NULL)"
_AMOUNT_BAD = "NOT regexp_full_match({v}, '-?[0-9]+(\\.[0-9]+)?')"
_DATE_BAD = "NOT ({v} = '' OR (regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND left({v}, 4) <> '0000' AND try_cast({v} AS DATE) IS NOT NULL))"


def _bad(source: str, index: int, name: str, rule: str) -> str:
    v = f"trim(f[{index}], ' ')"
    return f"SELECT raw_id, '{name}' AS field_name, 'invalid_value' AS reason FROM whole WHERE source_system = '{source}' AND {rule.format(v=v)}"


P3_SQL = f"""
WITH r AS (SELECT raw_id, source_system, coalesce(raw_line, '') AS line FROM raw_record),
s AS (SELECT *, regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS ok FROM r),
c AS (SELECT *, regexp_extract_all(',' || line, ',{_FIELD}', 0, 's') AS parts, CASE source_system WHEN 'pos' THEN 8 WHEN 'crm' THEN 10 END AS want FROM s WHERE ok),
whole AS (SELECT raw_id, source_system, list_transform(parts, lambda p: CASE WHEN p[2] = '"' THEN replace(p[3:-2], '""', '"') ELSE p[2:] END) AS f FROM c WHERE len(parts) = want)
SELECT raw_id, 'row' AS field_name, 'quoting' AS reason FROM s WHERE NOT ok
UNION ALL SELECT raw_id, 'row', 'column_count' FROM c WHERE want IS NULL OR len(parts) <> want
UNION ALL {_bad("pos", 1, "customer_id", _KEY_BAD)}
UNION ALL {_bad("pos", 7, "order_date", _STAMP_BAD)}
UNION ALL {_bad("pos", 8, "total_amount", _AMOUNT_BAD)}
UNION ALL {_bad("crm", 1, "business_entity_id", _KEY_BAD)}
UNION ALL {_bad("crm", 9, "dob", _DATE_BAD)}
"""

_VALID = P3_SQL[: P3_SQL.index("SELECT raw_id, 'row'")] + "SELECT raw_id, {cols} FROM whole WHERE source_system = '{source}' AND NOT ({bad})"


def _valid_sql(source: str, rules: dict[int, str], typed: dict[int, str]) -> str:
    bad = " OR ".join("(" + rule.format(v=f"trim(f[{i}], ' ')") + ")" for i, rule in rules.items())
    cols = ", ".join(typed.get(i, "f[{i}]").format(i=i) + f" AS {n}" for i, n in enumerate(COLUMNS[source], 1))
    return _VALID.format(cols=cols, source=source, bad=bad)


P3_POS_SQL = _valid_sql("pos", {1: _KEY_BAD, 7: _STAMP_BAD, 8: _AMOUNT_BAD}, {1: "trim(f[{i}], ' ')", 7: "try_cast(trim(f[{i}], ' ') AS TIMESTAMP)", 8: "try_cast(trim(f[{i}], ' ') AS DECIMAL(18, 2))"})
P3_CRM_SQL = _valid_sql("crm", {1: _KEY_BAD, 9: _DATE_BAD}, {1: "trim(f[{i}], ' ')", 9: "try_cast(trim(f[{i}], ' ') AS DATE)"})

SQL = {"p3_found": P3_SQL, "p3_valid_pos": P3_POS_SQL, "p3_valid_crm": P3_CRM_SQL}
