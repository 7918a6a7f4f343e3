"""CSV by an error-recovering recursive-descent grammar.

    file    := record (line-end record)*
    record  := field ("," field)*
    field   := quoted | bare
    quoted  := '"' (any char but '"' | '""')* '"'      followed by "," or the end of the record
    bare    := (any char but '"', ",", line end)*

Where a rule fails the error keeps its place, and in texts of many records parsing resumes at the next validated
record start: a line that parses on its own into the expected number of columns and whose first field has the
form of a key.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..operators.timestamps import civil_micros

# The columns of a raw record, in order, by source.
COLUMNS = {
    "pos": ["customer_id", "first_name", "last_name", "email", "phone", "address", "order_date", "total_amount"],
    "crm": ["business_entity_id", "first_name", "last_name", "phone", "address_line1", "city", "state", "postal_code", "dob", "notes"],
}
RULES = {"customer_id": "key", "business_entity_id": "key", "order_date": "datetime", "total_amount": "amount", "dob": "date"}
MESSAGES = {"key": "must be positive integer", "datetime": "must be a real yyyy-MM-ddTHH:mm:ss", "amount": "must be a plain decimal number", "date": "must be empty or a real yyyy-MM-dd"}

_BARE = re.compile(r'[^",\r\n]*')
_BARE_ONE = re.compile(r'[^",]*')
_INSIDE = re.compile(r'[^"]*')


@dataclass
class Parsed:
    fields: list[str]
    start: int
    end: int
    error_at: int = -1
    error: str = ""
    raw: str = field(default="", repr=False)


class Grammar:
    def __init__(self, text: str, single: bool):
        self.text, self.single, self.at = text, single, 0
        self.bare = _BARE_ONE if single else _BARE

    def ends(self, i: int) -> bool:
        return i >= len(self.text) or (not self.single and self.text[i] in "\r\n")

    def quoted(self) -> str:
        parts, t = [], self.text
        self.at += 1
        while True:
            m = _INSIDE.match(t, self.at)
            parts.append(m.group())
            self.at = m.end()
            if self.at >= len(t):
                raise SyntaxError("quote never closed")
            if t.startswith('""', self.at):
                parts.append('"')
                self.at += 2
                continue
            self.at += 1
            if self.ends(self.at) or t[self.at] == ",":
                return "".join(parts)
            raise SyntaxError("text after a closing quote")

    def field(self) -> str:
        if self.text.startswith('"', self.at):
            return self.quoted()
        m = self.bare.match(self.text, self.at)
        self.at = m.end()
        if self.text.startswith('"', self.at):
            raise SyntaxError("quote inside a bare field")
        return m.group()

    def record(self) -> Parsed:
        start, out = self.at, []
        try:
            out.append(self.field())
            while self.text.startswith(",", self.at):
                self.at += 1
                out.append(self.field())
        except SyntaxError as e:
            return Parsed(out, start, self.at, self.at, str(e))
        return Parsed(out, start, self.at)

    def line_end(self) -> None:
        if self.text.startswith("\r\n", self.at):
            self.at += 2
        elif self.at < len(self.text):
            self.at += 1


def parse_record(text: str) -> Parsed:
    """The whole text is one record; line breaks outside quotes belong to their field."""
    if '"' not in text:
        return Parsed(text.split(","), 0, len(text))
    return Grammar(text, True).record()


def parse_text(text: str, columns: int, key: str = r"\s*\d+\s*") -> Iterator[Parsed]:
    """All records of a text. After a syntax error parsing resumes at the next validated record start.

    A start is validated by a key and either a whole record of the right size, over as many lines as it takes, or a
    line with the commas of one, which may be broken itself: every broken record is an error of its own. A record over
    several lines with another number of columns may have swallowed others between two stray quotes, so parsing resumes
    at the first validated start inside of it, if there is one.
    """
    g, is_key = Grammar(text, False), re.compile(rf'"?(?:{key})"?(?:,|$)')
    starts = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]

    def begins(at: int) -> bool:
        if is_key.match(text, at) is None:
            return False
        k = bisect_right(starts, at)
        if text.count(",", at, starts[k] if k < len(starts) else len(text)) >= columns - 1:
            return True
        probe = Grammar(text, False)
        probe.at = at
        return not (p := probe.record()).error and len(p.fields) == columns

    while g.at < len(text):
        r = g.record()
        if r.error or len(r.fields) != columns:
            last = len(text) if r.error else r.end
            anchor = next((x for x in starts[bisect_right(starts, r.start) : bisect_right(starts, last)] if begins(x)), None)
            if anchor is not None and not r.error:
                r.error_at, r.error = anchor, "quoted field runs over a record start"
            if r.error:
                g.at = len(text) if anchor is None else anchor
                r.raw = text[r.start : g.at].rstrip("\r\n")
                yield r
                continue
        r.raw = text[r.start : g.at]
        g.line_end()
        yield r


#: Rows of one source_file that are parsed as one text, at most.
TEXT_ROWS = 2_000


def parse_joined(df: DataFrame) -> DataFrame:
    """(source_system, source_file, raw_id, fields, syntax_at, syntax_error, raw_text) of the records that stand in the lines of each source_file, joined in row_index order.

    raw_id is the line in which a record starts and syntax_at counts from the record's start. Lines are joined in
    blocks of TEXT_ROWS row numbers, across which no record runs. Sources without known columns are left out.
    """
    d = df.filter(F.col("source_system").isin(*COLUMNS))
    line = F.struct("row_index", "raw_id", F.coalesce("raw_line", F.lit("")).alias("raw_line"))
    blocks = d.groupBy("source_system", "source_file", F.floor(F.coalesce("row_index", "raw_id") / TEXT_ROWS).alias("block")).agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def one(source, name, lines):
        ends, n = [], 0
        for x in lines:
            n += len(x["raw_line"]) + 1
            ends.append(n)
        for r in parse_text("".join(x["raw_line"] + "\n" for x in lines), len(COLUMNS[source])):
            at = r.error_at - r.start if r.error else None
            yield source, name, lines[bisect_right(ends, r.start)]["raw_id"], r.fields, at, r.error or None, r.raw

    return map_rows(blocks.select("source_system", "source_file", "lines"), one, "source_system string, source_file string, raw_id bigint, fields array<string>, syntax_at int, syntax_error string, raw_text string")


def _checks(name: str, value: Column) -> Column:
    """True where the value breaks the rule of its column; spaces at both ends are ignored."""
    v, rule = F.trim(value), RULES[name]
    num = lambda a, n: F.substring(v, a, n).try_cast("int")
    zero = F.lit(0)
    if rule == "key":
        return ~(v.rlike(r"\A[0-9]+\z") & v.rlike("[1-9]"))
    if rule == "amount":
        return ~v.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z")
    if rule == "date":
        real = v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & civil_micros(num(1, 4), num(6, 2), num(9, 2), zero, zero, zero).isNotNull()
        return ~((v == "") | real)
    real = civil_micros(num(1, 4), num(6, 2), num(9, 2), num(12, 2), num(15, 2), num(18, 2)).isNotNull()
    return ~(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z") & real)


def parse_records(df: DataFrame, id_col: str = "raw_id", line: str = "raw_line", source: str = "source_system") -> DataFrame:
    """One row per record with fields (array of text), syntax_at, syntax_error and errors (array of field, reason, message, raw_value).

    errors is empty for a record that loads. Reasons: quoting (located in the message), column_count, invalid_value.
    A null line counts as an empty one: one empty column, so column_count. A null or unknown source has no known
    number of columns: column_count with the source as raw_value. Repeated rows come out as often as they come in;
    other columns of the input are left out, so none can clash.
    """
    base = df.select(F.col(id_col).alias("raw_id"), F.col(source).alias("source_system"), F.col(line).alias("raw_line"))

    def one(i, src, text):
        r = parse_record(text or "")
        return ((i, src, text, r.fields, r.error_at if r.error else None, r.error or None),)

    p = map_rows(base, one, "raw_id bigint, source_system string, raw_line string, fields array<string>, syntax_at int, syntax_error string")
    entry = lambda f, reason, message, raw: F.struct(f.alias("field"), F.lit(reason).alias("reason"), message.alias("message"), raw.alias("raw_value"))
    size = F.size("fields")
    want = F.lit(None).cast("int")
    bad = F.array().cast("array<struct<field:string,reason:string,message:string,raw_value:string>>")
    for src, cols in COLUMNS.items():
        mine = F.col("source_system") == src
        want = F.when(mine, len(cols)).otherwise(want)
        found = [F.when(_checks(n, F.get(F.col("fields"), F.lit(i))), entry(F.lit(n), "invalid_value", F.lit(MESSAGES[RULES[n]]), F.get(F.col("fields"), F.lit(i)))) for i, n in enumerate(cols) if n in RULES]
        bad = F.when(mine, F.array_compact(F.array(*found))).otherwise(bad)
    syntax = F.concat(F.col("syntax_error"), F.lit(" at "), F.col("syntax_at"))
    counted = F.concat(F.lit("expected "), F.coalesce(want.cast("string"), F.lit("a known source")), F.lit(" columns, found "), size)
    errors = (
        F.when(F.col("syntax_error").isNotNull(), F.array(entry(F.lit("row"), "quoting", syntax, F.coalesce("raw_line", F.lit("")))))
        .when(want.isNull() | (size != want), F.array(entry(F.lit("row"), "column_count", counted, F.coalesce("raw_line", F.lit("")))))
        .otherwise(bad)
    )
    return p.withColumn("errors", errors)


def valid_rows(parsed: DataFrame, source: str) -> DataFrame:
    """The records of one source that load, as typed columns; keys and contacts stay text."""
    cols = [F.get(F.col("fields"), F.lit(i)).alias(n) for i, n in enumerate(COLUMNS[source])]
    d = parsed.filter((F.col("source_system") == source) & (F.size("errors") == 0)).select("raw_id", *cols)
    if source == "pos":
        stamp = F.try_to_timestamp(F.trim("order_date"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
        return d.withColumns({"customer_id": F.trim("customer_id"), "order_date": stamp, "total_amount": F.trim("total_amount").try_cast("decimal(18,2)")})
    return d.withColumns({"business_entity_id": F.trim("business_entity_id"), "dob": F.trim("dob").try_cast("date")})


def error_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("raw_id", F.explode("errors").alias("e")).select("raw_id", F.col("e.field").alias("field_name"), F.col("e.reason").alias("reason"), F.col("e.message").alias("message"), F.col("e.raw_value").alias("raw_value"))


def read_csv_texts(spark, path: str, source: str) -> DataFrame:
    """Whole CSV files of one source, header line dropped, as (source_file, row_index, fields, syntax_at, syntax_error, raw_line).

    A file is one task, so broken quotes are recovered within it; land files of bounded size.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value"))
    n = len(COLUMNS[source])

    def rows(name, text):
        for i, r in enumerate(parse_text(text.removeprefix("﻿"), n)):
            if i or r.error or [x.strip().lower() for x in r.fields] != COLUMNS[source]:
                yield (name, i, r.fields, r.error_at if r.error else None, r.error or None, r.raw)

    return map_rows(files, rows, "source_file string, row_index bigint, fields array<string>, syntax_at int, syntax_error string, raw_line string")
