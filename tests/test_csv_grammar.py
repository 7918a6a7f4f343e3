import csv
import io

from hypothesis import given
from hypothesis import strategies as st

from terrane.sources.csv_grammar import error_rows, parse_record, parse_records, parse_text, read_csv_texts, valid_rows

GOOD = "1001,Ann,Lee,a@x.test,1,\"1 Elm St, Town\",2024-02-03T10:00:00,12.50"


def errors(spark, rows):
    df = spark.createDataFrame(rows, "raw_id bigint, source_system string, raw_line string, errors string")
    return sorted((r.raw_id, r.field_name, r.reason) for r in error_rows(parse_records(df)).collect())


def test_reasons(spark):
    crm = "7,A,B,1,x,y,CA,1,{},n"
    lines = {
        1: ("pos", GOOD),
        2: ("pos", 'x"y' + GOOD),
        3: ("pos", '"open,' + GOOD),
        4: ("pos", GOOD + ",more"),
        5: ("pos", GOOD.replace("1001", "0").replace("12.50", ".5").replace("02-03", "02-30")),
        6: ("crm", crm.format("")),
        7: ("crm", crm.format("1999-02-29")),
        8: ("crm", crm.format(" 2000-02-29 ").replace("7,", " 07 ,")),
        9: ("pos", None),
        10: ("pos", ""),
        11: ("moon", GOOD),
        12: ("pos", GOOD.replace("1001", "١٢")),
        13: ("crm", '7,"A ""x""\nB",B,1,x,y,CA,1,,"n"'),
        14: ("pos", "9" * 200_000),
    }
    got = errors(spark, [(i, s, t, "clash") for i, (s, t) in lines.items()])
    assert got == [
        (2, "row", "quoting"), (3, "row", "quoting"), (4, "row", "column_count"),
        (5, "customer_id", "invalid_value"), (5, "order_date", "invalid_value"), (5, "total_amount", "invalid_value"),
        (7, "dob", "invalid_value"), (9, "row", "column_count"), (10, "row", "column_count"), (11, "row", "column_count"),
        (12, "customer_id", "invalid_value"), (14, "row", "column_count"),
    ]


def test_empty_and_valid(spark):
    assert errors(spark, []) == []
    df = spark.createDataFrame([(1, "pos", GOOD), (1, "pos", GOOD)], "raw_id bigint, source_system string, raw_line string")
    rows = valid_rows(parse_records(df), "pos").collect()
    assert len(rows) == 2 and rows[0].address == "1 Elm St, Town" and str(rows[0].total_amount) == "12.50" and rows[0].order_date.hour == 10


@given(st.lists(st.text(max_size=8), min_size=1, max_size=6))
def test_round_trip(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerow(fields)
    r = parse_record(out.getvalue().removesuffix("\r\n"))
    assert not r.error and r.fields == fields


@given(st.text(alphabet='ab,"\n', max_size=12))
def test_against_definition(text):
    """A record is well formed if and only if quoted and bare fields cover it."""
    import re

    well = re.fullmatch(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', text) is not None
    assert (not parse_record(text).error) == well


def test_recovery_at_record_starts(spark, tmp_path):
    text = "customer_id,first_name,last_name,email,phone,address,order_date,total_amount\r\n" + GOOD + '\r\n1002,"broken,x\r\nstill broken\r\n' + GOOD.replace("1001", "1003") + "\n" + GOOD.replace("1001", "1004")
    kinds = [(bool(r.error), r.fields[0] if r.fields else "") for r in parse_text(text, 8)]
    assert kinds == [(False, "customer_id"), (False, "1001"), (True, "1002"), (False, "1003"), (False, "1004")]
    (tmp_path / "f.csv").write_text(text)
    rows = read_csv_texts(spark, str(tmp_path / "f.csv"), "pos").orderBy("row_index").collect()
    assert [r.syntax_error is not None for r in rows] == [False, True, False, False] and rows[1].raw_line.startswith("1002")


BARE = GOOD.replace('"1 Elm St, Town"', "1 Elm St")
SWALLOWED = [GOOD, '1002,"stray,b,c,d,e,f,1', BARE.replace("1001", "1003"), '1004,stray",b,c', "", GOOD.replace("1001", "1005")]


def test_rows_between_stray_quotes_are_not_swallowed():
    got = [(bool(r.error), r.fields[0], len(r.fields)) for r in parse_text("\n".join(SWALLOWED), 8)]
    assert got[0] == (False, "1001", 8) and (False, "1003", 8) in got and got[-1] == (False, "1005", 8)
    wide = '7,"a\nb",c\n' + GOOD
    assert [len(r.fields) for r in parse_text(wide, 8)] == [3, 8]


def test_joined_lines(spark, monkeypatch):
    import __spark_entry__ as entry
    from terrane.sources import csv_grammar

    df = spark.createDataFrame([(10 + i, "pos", "f.csv", i, t) for i, t in reversed(list(enumerate(SWALLOWED)))] + [(99, "moon", "m", 0, "x"), (98, "crm", None, None, None)], "raw_id bigint, source_system string, source_file string, row_index bigint, raw_line string")
    want = {(10, None, 8), (12, None, 8), (15, None, 8)}
    for rows in (2_000, 3):
        monkeypatch.setattr(csv_grammar, "TEXT_ROWS", rows)
        got = {(r.raw_id, r.syntax_error, len(r.fields)) for r in csv_grammar.parse_joined(df).collect()}
        assert want <= got and (98, None, 1) in got and not any(i == 99 for i, _, _ in got)
    assert "p3_texts" in entry.queries()


def test_every_broken_record_is_an_error_of_its_own():
    """Also thousands in a row, in time that grows with the text."""
    import time

    bad, good = '{},a,b,c,d,"e,2024-01-01T00:00:00,1', "{},a,b,c,d,e,2024-01-01T00:00:00,1"
    lines = [(bad if n % 3 else good).format(n + 1) for n in range(6000)]
    began = time.process_time()
    got = [(r.fields[0], bool(r.error)) for r in parse_text("\n".join(lines), 8)]
    assert got == [(str(n + 1), n % 3 > 0) for n in range(6000)] and time.process_time() - began < 20
