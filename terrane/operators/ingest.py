"""Batch landing: validation, one closed-form remediation, dead letters, summary.

Remediation is idempotent, so the retry loop of a row has a closed form: 0 retries if valid, 1 if the repaired row is
valid, else all of them. Validate, repair and validate again are one projection without Python and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import integer_text, positive_integer, strip, text_of, zfill
from ..session import Scratch

MAX_RETRIES = 3
Rules = list[tuple[str, Callable[[Column], Column], str]]  # field, passes, message

POS: Rules = [
    ("customer_id", positive_integer, "must be positive integer"),
    ("order_date", lambda c: F.coalesce(c, F.lit("")) != "", "missing required field"),
]
CRM: Rules = [("business_entity_id", lambda c: F.coalesce(c, F.lit("")) != "", "missing required field")]
LOYALTY: Rules = [("loyalty_num", lambda c: F.coalesce(c.rlike(r"\A[0-9]{12}\z"), F.lit(False)), "must be 12 digits")]
ECOMMERCE: Rules = [("email", lambda c: F.coalesce(c.rlike(r"\A[^A-Z\s]+@[^A-Z\s]+\z"), F.lit(False)), "must be a lower-case address")]

#: field -> (source it is limited to or None, repair)
REPAIRS: dict[str, tuple[str | None, Callable[[Column], Column]]] = {
    "customer_id": (None, lambda c: F.coalesce(integer_text(c), c)),
    "loyalty_num": ("loyalty", lambda c: zfill(c, 12)),
    "email": ("ecommerce", lambda c: F.lower(strip(c))),
}


def clean_text(df: DataFrame) -> DataFrame:
    """Header names in lower case without outer blanks, text values without outer blanks; of equal names the last wins."""
    last = {c.strip().lower(): i for i, c in enumerate(df.columns)}
    d = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    types = [t for _, t in df.dtypes]
    return d.select(*[(strip(F.col(f"c{i}")) if types[i] == "string" else F.col(f"c{i}")).alias(n) for n, i in last.items()])


def _errors(rules: Rules, value: Callable[[str], Column]) -> Column:
    found = [F.when(~passes(value(f)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("error"), text_of(value(f)).alias("raw_value"))) for f, passes, m in rules]
    return F.array_compact(F.array(*found))


def validate_retry(df: DataFrame, rules: Rules, source: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Rows with repaired fields, plus `errors` (array of field, error, raw_value; empty for a row that lands) and `retry_count`.

    A field that the table lacks counts as missing. With max_retries 0 nothing is repaired.
    """
    d = clean_text(df)
    have = set(d.columns)
    col = lambda f: F.col(f"`{f}`").cast("string") if f in have else F.lit(None).cast("string")
    fields = [f for f, _, _ in rules]
    repaired = {f: REPAIRS[f][1](col(f)) for f in fields if f in have and f in REPAIRS and REPAIRS[f][0] in (None, source)}
    d = d.withColumn("__first", _errors(rules, col))
    failed = F.size("__first") > 0
    hit = lambda f: F.array_contains(F.transform("__first", lambda e: e["field"]), f)
    if max_retries > 0 and repaired:
        d = d.withColumns({f"__r_{f}": F.when(hit(f), r).otherwise(col(f)) for f, r in repaired.items()})
        again = lambda f: F.col(f"__r_{f}") if f in repaired else col(f)
        d = d.withColumn("errors", F.when(failed, _errors(rules, again)).otherwise(F.col("__first")))
        d = d.withColumns({f: F.col(f"__r_{f}") for f in repaired})
    else:
        d = d.withColumn("errors", F.col("__first"))
    retries = F.when(F.size("__first") == 0, 0).when(F.size("errors") == 0, 1).otherwise(max_retries)
    return d.withColumn("retry_count", retries).drop("__first", *[f"__r_{f}" for f in repaired])


def with_validator(df: DataFrame, validator: Callable[[dict, int], list[tuple[str, str, str]]], row_index: str) -> DataFrame:
    """Errors of a Python validator (row, index) -> [(field, error, raw_value)], in Arrow batches; the slow path for rules no expression can say."""
    from pyspark.sql.types import StructType

    from ..functions.arrow import map_lists

    errors = StructType.fromDDL("errors array<struct<field:string,error:string,raw_value:string>>")
    schema = StructType([*df.schema.fields, *errors.fields])
    names = df.columns

    def run(batches):
        for b in batches:
            rows = [dict(zip(names, r)) for r in zip(*(b[n] for n in names))]
            yield b | {"errors": [[dict(zip(("field", "error", "raw_value"), e)) for e in validator(r, r[row_index])] for r in rows]}

    return map_lists(df, run, schema)


def landed(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def dead_letters(checked: DataFrame, row_index: str) -> DataFrame:
    """One row per remaining error of a row that does not land."""
    return checked.select(F.col(row_index).alias("row_index"), F.explode("errors").alias("e"), "retry_count").select("row_index", "e.field", "e.error", "e.raw_value", "retry_count")


def summary(checked: DataFrame, *by: str) -> DataFrame:
    """Landed rows, error entries and retries."""
    return checked.groupBy(*by).agg(F.count_if(F.size("errors") == 0).alias("records_landed"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("errors"), F.coalesce(F.sum("retry_count"), F.lit(0)).cast("bigint").alias("total_retries"))


def with_row_index(df: DataFrame, file: str = "_file", index: str = "_row_index") -> DataFrame:
    """Add the name of the file that a scanned row comes from, and its place in it from 0.

    Row ids are consecutive within a task; the first one of each file and task, one row per split of a file, is joined back.
    """
    d = df.select("*", F.col("_metadata.file_path").alias(file), F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().alias("__id"))
    parts = d.groupBy(file, "__task").agg(F.min("__id").alias("__least"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(file).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(file, "__task", "__least", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return d.join(parts, [file, "__task"]).withColumn(index, F.col("__id") - F.col("__least") + F.col("__before")).select(*df.columns, file, index)


def ingest_csv(spark, path: str, source: str, rules: Rules, bronze: str, run_id: str, now=None, multi_line: bool = False) -> dict:
    """Read CSV files with a header, land rows and dead letters as JSON lines under bronze/<source>, give the summary.

    Bytes that are no UTF-8 become U+FFFD. Files are split between tasks; only multi_line, for line breaks inside of
    quotes, makes a file one task. The checked rows are written once, to the shared folder, and read for each output.
    """
    from .lineage import attach, make_lineage

    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"')
    scratch = Scratch(spark, "ingest")
    checked = scratch.put(validate_retry(with_row_index(raw), rules, source))
    total = summary(checked).first()
    columns = [c for c in checked.columns if c not in ("_row_index", "_file", "errors", "retry_count")]
    stamp = make_lineage(source, path, total.records_landed, columns, run_id, now)
    attach(landed(checked).drop("_row_index", "_file", "retry_count"), stamp).drop("run_id").write.mode("append").json(f"{bronze}/{source}/kind=data/run_id={run_id}")
    if total.errors:
        attach(dead_letters(checked, "_row_index"), stamp).drop("run_id").write.mode("append").json(f"{bronze}/{source}/kind=error/run_id={run_id}")
    scratch.drop(1)
    return {"run_id": run_id, "source_system": source, **total.asDict(), "output_file": f"{bronze}/{source}/kind=data/run_id={run_id}"}


#: The sources that are landed together, with their rules.
SOURCES: dict[str, Rules] = {"pos": POS, "ecommerce": ECOMMERCE, "crm": CRM, "loyalty": LOYALTY, "merger_a": [], "merger_c": []}


def ingest_all(spark, folder: str, bronze: str, run_id: str, now=None) -> list[dict]:
    """Land <folder>/<source>.csv of every one of SOURCES; a source without a file or with one that fails gives its error instead of counts."""
    out = []
    for source, rules in SOURCES.items():
        try:
            out.append(ingest_csv(spark, f"{folder}/{source}.csv", source, rules, bronze, run_id, now))
        except Exception as e:  # noqa: BLE001
            out.append({"run_id": run_id, "source_system": source, "error": str(e).splitlines()[0]})
    return out


def read_xml(spark, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of XML files by Spark's own reader, all columns as the schema says; malformed rows come with nulls."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
