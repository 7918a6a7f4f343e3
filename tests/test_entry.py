import io

import __spark_entry__ as entry
import duckdb
import pytest
from terrane.console import Console

SF = "/root/testdata/sf0.001"
TABLES = "nation orders events documents pos crm merger_a merger_c cdc_event match_result survived_field golden_pair raw_record store_zone eval_item container_kind".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("p1_", "p4_", "p5_", "p8_", "p9_"))])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(x[0] for x in want.description)
    order = [[x[0] for x in want.description].index(c) for c in columns]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    shown = lambda v: f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns


def test_console(spark):
    out = io.StringIO()
    c = Console(SF, spark, stdout=out)
    for line in ("ingest", "quality", "gold", "scorecard", "profile", "catalog", "bronze", "status", 'hook {"table": "moon"}'):
        c.onecmd(line)
    assert c.onecmd("quit") and "accepted" in out.getvalue() and "pii_in_gold" in out.getvalue()
