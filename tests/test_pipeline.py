import json
from datetime import datetime, timezone

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import values as V
from terrane.operators import golden, ingest, lineage, profile, quality, resolution, scorecard
from terrane.operators.change_feed import BucketedTable
from terrane.session import work_dir
from terrane.sources import api, zones
from terrane.streaming import cdc

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("value, kind, want", [(None, "string", True), ("", "string", True), (" ", "string", False), ("0", "string", False), (0, "bigint", True), (float("nan"), "double", False), (False, "boolean", True), ([], "array<string>", True), ({"a": "b"}, "map<string,string>", False)])
def test_falsy(spark, value, kind, want):
    d = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", T._parse_datatype_string(kind))]))
    assert d.select(V.falsy(F.col("v"), d.schema["v"].dataType)).first()[0] is want


def test_values(spark):
    assert one(spark, V.strip, " \t\xa0a b　\n") == "a b"
    assert [one(spark, V.positive_integer, x) for x in ("1", "01", "0", "-5", "²", "", None)] == [True, True, False, False, False, False, False]
    assert [one(spark, V.integer_text, x) for x in ("POS-7", "1.0", "007x", "-5", "abc", "000")] == ["7", "10", "7", "5", None, "0"]
    assert [one(spark, lambda c: V.zfill(c, 5), x) for x in ("42", "-42", "1234567", "")] == ["00042", "-0042", "1234567", "00000"]
    assert one(spark, V.email_norm, " A.B+x@C.test ") == "a.b@c.test" and one(spark, V.email_masked, "ab@c.d") == "ab**@c.d"
    assert [one(spark, V.customer_code, x) for x in ("ADV-1001", "adv1001", "1001")] == ["1001"] * 3
    half = spark.range(1).select(V.half_even(F.lit(25), F.lit(32)).alias("a"), V.half_even(F.lit(1), F.lit(0)).alias("b"), V.half_even(F.lit(41), F.lit(50)).alias("c")).first()
    assert (half.a, half.b, half.c) == (0.7812, 0.0, 0.82)


def test_personal_data(spark):
    texts = {"123-45-6789": "ssn", "(303) 555-0147": "phone", "303-555-0147": "phone", "+1 303.555.0147": "phone", "555-0192": "", "3035550147": "", "(303)555-0147": "", "a@b.c|d": "email", "km**@gmail.com": "", "": "", "x" * 50_000: ""}
    d = spark.createDataFrame([(k, k) for k in texts], "t string, _u string")
    got = {r.t: r.f for r in d.select("t", F.array_join(quality.pii_fields(d), ",").alias("f")).collect()}
    assert got == {k: f"t:{v}" if v else "" for k, v in texts.items()}


VECTORS = [("1001", "d", "1001", 0, 0), (" 1001 ", "d", "1001", 0, 0), ("POS-7", "d", "7", 1, 0), ("-5", "d", "5", 1, 0), ("1.0", "d", "10", 1, 0), ("0", "d", "0", 3, 1), ("", "d", "", 3, 1), ("abc", "", "abc", 3, 2), ("POS-7", "", "7", 3, 1), ("²", "d", "²", 3, 1), ("--5", "d", "5", 1, 0), (None, None, None, 3, 2)]


def test_validate_retry(spark):
    d = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(VECTORS)], "i bigint, Customer_ID string, order_date string")
    rows = {r.i: r for r in ingest.validate_retry(d, ingest.POS, "pos").collect()}
    for i, (_, _, fixed, retries, n) in enumerate(VECTORS):
        assert (rows[i].customer_id, rows[i].retry_count, len(rows[i].errors)) == (fixed, retries, n), VECTORS[i]
    none = ingest.validate_retry(d, ingest.POS, "pos", 0)
    assert none.filter("size(errors) = 0").count() == 2
    missing = ingest.dead_letters(ingest.validate_retry(spark.createDataFrame([(1, "x")], "i bigint, name string"), ingest.POS, "pos"), "i")
    assert [(r.field, r.raw_value) for r in missing.collect()] == [("customer_id", "None"), ("order_date", "None")]
    loyal = ingest.validate_retry(spark.createDataFrame([("42",)], "loyalty_num string"), ingest.LOYALTY, "loyalty").first()
    assert loyal.loyalty_num == "000000000042" and loyal.retry_count == 1
    assert ingest.summary(ingest.validate_retry(d.limit(0), ingest.POS, "pos")).first().asDict() == {"records_landed": 0, "errors": 0, "total_retries": 0}


def test_ingest_csv_and_zones(spark, tmp_path):
    (tmp_path / "pos.csv").write_text('customer_id,address,order_date\nPOS-7,"1 Elm, X",2024\n0,y,2024\n')
    s = ingest.ingest_csv(spark, str(tmp_path / "pos.csv"), "pos", ingest.POS, str(tmp_path / "bronze"), "r1", NOW)
    assert (s["records_landed"], s["errors"], s["total_retries"]) == (1, 1, 4)
    data = zones.read_zone(spark, str(tmp_path / "bronze"), "pos").first()
    assert data.customer_id == "7" and data.schema_fingerprint and data.run_id == "r1"
    assert zones.read_zone(spark, str(tmp_path / "bronze"), "pos", "error").first().field == "customer_id"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nno json\n5\n')
    assert zones.read_tolerant(spark, str(tmp_path / "x.jsonl")).count() == 2
    assert zones.file_stats(spark, str(tmp_path / "x.jsonl")).first().rows == 3
    with pytest.raises(Exception):
        zones.read_strict(spark, "a int", str(tmp_path / "x.jsonl")).collect()


FILES = {
    "pos": "customer_id first_name last_name email phone address order_date total_amount",
    "ecommerce": "email_address_id business_entity_id email modified_date",
    "crm": "business_entity_id first_name last_name phone address_line1 city state postal_code dob notes",
    "loyalty": "loyalty_num store_name business_type annual_revenue",
    "merger_c": "uuid first_name last_name email phone address_line1 city state created_date",
}
FINGERPRINTS = {"pos": "964b344877368ac7", "ecommerce": "52d0d395de2dc24f", "crm": "fdd3ed0283a551b2", "loyalty": "b5e0482eb240809f", "merger_c": "875648d211017ac4"}


def test_lineage(spark):
    got = {k: spark.range(1).select(lineage.fingerprint(F.array(*[F.lit(c) for c in v.split()]))).first()[0] for k, v in FILES.items()}
    assert got == FINGERPRINTS
    assert lineage.registry(spark).count() == 7 and lineage.source_schema("merger_a")["columns"] == ["account_id", "name", "address", "phone", "created_date"]
    d = spark.createDataFrame([(1, None, "mine"), (2, "x", "mine")], "i bigint, f string, run_id string")
    assert {r.run_id for r in lineage.attach(d, lineage.make_lineage("s", "f", 2, [], "r")).collect()} == {"r"}
    assert lineage.make_lineage("s", "f", 0, []) and spark.range(1).select(lineage.fingerprint(F.array().cast("array<string>"))).first()[0] == "4f53cda18c2baa0c"
    assert lineage.find_record(d, "f", "None", ["i"]).collect()[0].i == 1 and lineage.find_record(d, "absent", "", ["i"]).count() == 2
    many = spark.range(60).withColumn("f", F.lit("x"))
    assert [r.truncated for r in lineage.find_record(many, "f", "x", ["id"]).collect()] == [True] * 50
    assert lineage.preview(many, ["id"], -1).count() == 0 and "error" in lineage.source_schema("moon")


def gold(spark, **kw):
    row = {"customer_id": "u1", "first_name": "K", "last_name": "M", "email_masked": "km**@gmail.com", "loyalty_segment": "x", "record_confidence": 0.97, "source_systems": "pos,crm", "created_at_utc": "2024", "updated_at_utc": "2024"} | kw
    row = {k: v for k, v in row.items() if v is not ...}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))


def test_gate(spark, tmp_path):
    audit = str(tmp_path / "audit")
    ok, results = quality.check_gold_write("customer", gold(spark), audit)
    assert ok and len(results) == 9 and len(list((tmp_path / "audit").glob("*.json"))) == 1
    failed = lambda d: [r.rule_id for r in quality.check_gold_write("customer", d)[1] if not r.passed]
    assert failed(gold(spark, email_masked="katherine@gmail.com")) == ["pii_in_gold"]
    assert failed(gold(spark, loyalty_segment=...)) == ["schema_drift"]
    assert failed(gold(spark, record_confidence=0.0)) == ["null_rate_record_confidence"]
    assert failed(gold(spark).limit(0)) == []
    with pytest.raises(FileNotFoundError):
        quality.load_contract("moon")
    target = str(tmp_path / "gold")
    assert quality.published(spark, target) is None
    assert quality.publish("customer", gold(spark), target, audit) and quality.published(spark, target).count() == 1
    assert not quality.publish("customer", gold(spark, email_masked="a.b@c.de"), target, audit) and quality.published(spark, target).first().email_masked == "km**@gmail.com"
    for n in range(3):
        assert quality.publish("customer", gold(spark, last_name=f"M{n}"), target, audit) and quality.published(spark, target).first().last_name == f"M{n}"
    assert len(list((tmp_path / "gold/data").iterdir())) == 2
    (tmp_path / "gold/versions/000000000099.json").write_text('{"data": ')  # a head that was cut short
    assert quality.published(spark, target).first().last_name == "M2" and quality.publish("customer", gold(spark), target, audit) and (tmp_path / "gold/versions/000000000100.json").exists()


def test_rules(spark):
    d = spark.createDataFrame([(i, f"p{i}@x.test", "303-555-0147", None if i % 2 else 5, "a@b.cd") for i in range(6)], "i bigint, email string, phone string, fk bigint, _x string")
    found = quality.pii("i").scan(d)
    assert len(found) == 7 and found[-1].startswith("further") and found[0] == "row 0: email in email"
    assert quality.run_checks(d, [quality.null_rate("fk", 0.5), quality.null_rate("gone", 0.5)])[0].passed
    assert not quality.run_checks(d, [quality.null_rate("gone", 0.5)])[0].passed
    assert quality.bounds([4] * 7) == (4, 4) and quality.bounds([]) == (0, 0) and quality.bounds([10]) == (8, 12)
    assert not quality.run_checks(d, [quality.volume_anomaly([4] * 7)])[0].passed
    parent = spark.createDataFrame([(5,)], "k bigint")
    assert quality.ref_integrity("fk", parent, "k", "i").scan(d) == [] and len(quality.ref_integrity("fk", parent.select(F.col("k").cast("string")), "k", "i").scan(d)) == 3


def test_survivorship(spark):
    rows = [
        ("A", "email", "a", "pos", 0), ("A", "email", "b", "crm", 1), ("A", "email", None, "ecommerce", 2),
        ("B", "email", "z", "loyalty", 0), ("B", "city", " ", "pos", 1), ("B", "city", "Denver", "crm", 2), ("B", "phone", "", "crm", 2),
        ("C", "notes", "ab", "pos", 0), ("C", "notes", "xyz", "crm", 1), ("C", "notes", "abc", "ecommerce", 2), ("C", "middle_name", "", "pos", 0),
        ("A", "email", "b", "crm", 1),
    ]
    d = spark.createDataFrame(rows, "cluster_id string, field string, value string, source_system string, pos int")
    got = {(r.cluster_id, r.field): (r.value, r.source_system, r.rule_name, r.confidence) for r in golden.merge(golden.last_per_source(d)).collect()}
    assert got == {
        ("A", "email"): ("b", "crm", "source_precedence_email", 0.8),
        ("B", "email"): ("z", "loyalty", "fallback_first_nonnull_email", 0.5),
        ("B", "city"): ("Denver", "crm", "fallback_first_nonnull_city", 0.5),
        ("B", "phone"): (None, "none", "no_value_phone", 0.0),
        ("C", "notes"): ("xyz", "crm", "longest_populated_notes", 0.7),
        ("C", "middle_name"): (None, "none", "longest_populated_middle_name", 0.0),
    }
    timed = spark.createDataFrame([("A", "f", "a", "p", 0, "2024-01"), ("A", "f", "b", "q", 1, "2024-02"), ("A", "f", "c", "r", 2, "2024-02"), ("A", "f", "d", "s", 3, None)], "cluster_id string, field string, value string, source_system string, pos int, at string")
    assert golden.by_recency(timed, "at").first().value == "b"
    scores = spark.createDataFrame([("A", "email", 1.0), ("A", "phone", 0.8), ("A", "city", 0.5)], "cluster_id string, field string, confidence double")
    assert golden.record_scores(scores).first().asDict() == {"cluster_id": "A", "record_confidence": 0.82, "high_confidence": False, "low_fields": ""}
    assert golden.golden_records(golden.last_per_source(d.limit(0))).count() == 0


def pair(spark, a, b, label="match", stratum="easy"):
    return spark.createDataFrame([("P", a, b, label, stratum)], "pair_id string, record_a map<string,string>, record_b map<string,string>, label string, stratum string")


@pytest.mark.parametrize(
    "a, b, want",
    [
        ({"name": "Jim Wu", "dob": "1978-04-12", "address": "8 Cedar Ave, X TX"}, {"name": "Jim Wu", "dob": "1965-11-03", "address": "8 Cedar Ave, X TX"}, (False, 0.91)),
        ({"name": "Sue Lark", "address": "123 Oak St, Portland OR"}, {"name": "Sue Lark", "address": "123 Oak Street, Portland ME 04101"}, (False, 0.90)),
        ({"name": "Kathryn Moe", "email": "K+x@g.test", "phone": "303-555-0147"}, {"name": "Katherine Moe", "email": "k@g.test", "phone": "(303) 555-0147"}, (True, 0.97)),
        ({"name": "Bob Ray", "phone": "3035550147"}, {"name": "Robert Ray", "phone": "1-303-555-0147"}, (True, 0.93)),
        ({"name": "A B", "address": "1 Elm Ln, Q OH"}, {"name": "C B", "address": "1 Elm Lane, Q OH 44444"}, (False, 0.90)),
        ({"name": "A B", "address": "1 Elm Ln, Q OH", "phone": "3035550147"}, {"name": "A B", "address": "1 Elm Ln, Q OH", "phone": "3035550148"}, (False, 0.40)),
        ({"customer_id": "5"}, {"account_id": "5"}, (False, 0.60)),
        (None, {}, (False, 0.60)),
    ],
)
def test_ladder(spark, a, b, want):
    r = resolution.match_pairs(pair(spark, a, b)).first()
    assert (r.match, r.confidence) == want


def test_stars_and_blocks(spark):
    d = spark.createDataFrame([("a", "b", True, 0.9), ("a", "c", False, 0.8), ("x", "y", True, 0.9), ("x", "z", False, 0.4), ("n", "m", True, None)], "p string, q string, match boolean, confidence double")
    assert {(r.anchor_id, r.status, r.members, r.non_matches) for r in resolution.resolve_stars(d, "p", "q").collect()} == {("a", "resolved", 1, 1), ("x", "review", 0, 1), ("n", "review", 0, 0)}
    left = spark.createDataFrame([("1", "k"), ("1", "k"), ("2", None), ("3", "")], "i string, k string")
    assert [(r.a_id, r.b_id, r.blocks) for r in resolution.blocked_pairs(left, left, {"k": (F.col("k"), F.col("k"))}, "i", "i").collect()] == [("1", "1", "k")]


def test_clusters(spark):
    """Confirmed members and the anchor make the record; a low confidence sends all to review; one member alone is unscored."""
    rows = [("A", 0, "pos", "email", "a@x.y"), ("A", 1, "crm", "email", "b@x.y"), ("A", 2, "ecommerce", "email", "c@x.y"), ("B", 0, "pos", "phone", "1"), ("B", 1, "crm", "phone", "2"), ("C", 3, "pos", "city", "X"), ("D", 0, "pos", "city", None), ("D", 1, "pos", "city", "Y")]
    verdicts = [("A", 1, True, 0.9), ("A", 2, False, 0.9), ("B", 1, False, 0.4), ("D", 1, True, 0.5), ("D", 1, True, 0.5)]
    golden_, review, dropped = resolution.resolve_clusters(spark.createDataFrame(rows, "cluster_id string, member_pos int, source_system string, field string, value string"), spark.createDataFrame(verdicts, "cluster_id string, member_pos int, match boolean, confidence double"))
    got = {r.cluster_id: (r.fields, r.record_confidence) for r in golden_.collect()}
    assert got == {"A": ({"email": "b@x.y"}, 0.8), "C": ({"city": "X"}, None), "D": ({"city": "Y"}, 0.5)}
    assert [r.cluster_id for r in review.collect()] == ["B"] and [(r.cluster_id, r.member_pos) for r in dropped.collect()] == [("A", 2)]


def test_replies_of_an_outside_matcher(spark):
    assert resolution.parse_reply('So: {"match": true, "confidence": "0.8", "reason": "same"} - done') == (True, 0.8, "same")
    for bad in ("no braces", "{}", "}{", '{"match": 1}'):
        with pytest.raises(ValueError):
            resolution.parse_reply(bad)
    answers = lambda a, b: '{"match": true, "confidence": 0.9}' if a == b else "I can't tell"
    pairs = pair(spark, {"name": "x"}, {"name": "x"}).unionByName(pair(spark, {"name": "x"}, None).withColumn("pair_id", F.lit("Q")))
    assert {(r.pair_id, r.match, r.confidence) for r in resolution.match_pairs(pairs, resolution.reply_matcher(answers)).collect()} == {("P", True, 0.9), ("Q", False, 0.0)}


def test_landing_of_all_sources(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "pos.csv").write_bytes(b"customer_id,first_name,order_date\n1,Jos\xe9,2024\nx,B,2024\n3,C,2024\n")
    (d / "loyalty.csv").write_text("loyalty_num,store_name\n42,s\n")
    out = {r["source_system"]: r for r in ingest.ingest_all(spark, str(d), str(tmp_path / "bronze"), "r", NOW)}
    assert set(out) == set(ingest.SOURCES) and out["pos"]["records_landed"] == 2 and out["loyalty"]["total_retries"] == 1 and "error" in out["crm"]
    assert {r.first_name for r in zones.read_zone(spark, str(tmp_path / "bronze"), "pos").collect()} == {"Jos\ufffd", "C"}
    assert zones.read_zone(spark, str(tmp_path / "bronze"), "pos", "error").first().row_index == 1
    (d / "x.xml").write_text("<r><p><a>1</a><b>x</b></p><p><a>2</a></p></r>")
    assert [tuple(r) for r in ingest.read_xml(spark, str(d / "x.xml"), "p", "a int, b string").collect()] == [(1, "x"), (2, None)]


def test_row_index(spark, tmp_path):
    """Places in the file, over several splits and files."""
    for n in (1, 2):
        (tmp_path / f"f{n}.csv").write_text("v\n" + "".join(f"{n}-{i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = ingest.with_row_index(spark.read.csv(str(tmp_path), header=True)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000 and all(r.v.endswith(f"-{r._row_index}") for r in rows)


def test_scorecard_process(spark, tmp_path):
    from terrane.scorecard_cli import judge

    same = {"phone": "3035550147", "name": "A B"}
    pair(spark, same, same).write.parquet(str(tmp_path / "p"))
    code, text = judge(spark, str(tmp_path / "p"), str(tmp_path / "base"))
    assert code == 0 and "no regression: True" in text
    wrong = lambda d: d.withColumns({"match": F.lit(False), "confidence": F.lit(0.99), "reason": F.lit("")})
    assert judge(spark, str(tmp_path / "p"), str(tmp_path / "base"), wrong)[0] == 1


def test_more_rules(spark):
    d = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "v string")
    assert [r.passed for r in quality.run_checks(d, [quality.null_explosion("v", 0.4), quality.null_explosion("v", 0.39), quality.matcher_regression(0.02, 0.01), quality.matcher_regression(0.03, 0.01)])] == [True, False, True, False]
    assert quality.judge_volume([]).passed and not quality.judge_volume([9, 4, 4, 4]).passed and quality.drift(["a", "b"], ["b", "c", "run_id"]) == (["a"], ["c"])
    days = spark.createDataFrame([("2024-01-01", 10), ("2024-01-02", 10), ("2024-01-20", 99), ("2024-01-21", 99)], "day string, n int").withColumn("day", F.to_date("day"))
    assert [r.anomaly for r in quality.volume_by_day(days, "day", "n").orderBy("day").collect()] == [False, False, False, False]
    assert V.table_of("lake/gold/customer.parquet/part-0") == "customer" and V.table_of("gold") is None and one(spark, V.without_zone, "2024-01-01T00:00:00.123+00:00") == "2024-01-01T00:00:00"


def test_entry_without_a_package_of_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    from terrane.session import shared_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]"))
    with pytest.raises(RuntimeError):
        shared_dir(fake)


def test_scorecard(spark, tmp_path):
    d = spark.createDataFrame([("match", True, 0.9, "e"), ("match", False, 0.6, "e"), ("non_match", True, 0.9, "n"), ("non_match", False, 0.9, "n")], "label string, match boolean, confidence double, stratum string")
    m = scorecard.overall(d).first().asDict()
    assert (m["precision"], m["recall"], m["f1"], m["false_confidence_rate"]) == (0.5, 0.5, 0.5, 0.3333) and not scorecard.accepted(m)
    assert {r.stratum: (r.precision, r.recall) for r in scorecard.by_stratum(d).collect()} == {"e": (1.0, 0.5), "n": (0.0, 0.0)}
    base = str(tmp_path / "b")
    assert scorecard.no_regression(m, spark, base) and scorecard.no_regression(m, spark, base) and not scorecard.no_regression(m | {"false_confidence_rate": 0.35}, spark, base)
    assert scorecard.overall(d.limit(0)).first().precision == 0.0
    metrics, strata = scorecard.evaluate(pair(spark, {"phone": "3035550147", "name": "A B"}, {"phone": "3035550147", "name": "A B"}).unionByName(pair(spark, {}, {}, "unclear")), resolution.ladder, str(tmp_path / "run"))
    assert metrics["n"] == 1 and "accepted: True" in scorecard.report(metrics, strata) and spark.read.json(str(tmp_path / "run")).count() == 1


def test_profile(spark, tmp_path):
    d = spark.createDataFrame([("1", "A", "303-555-0147", "x"), ("x", None, "", "y")], "account_id string, name string, phone string, dob string").withColumn("address", F.lit("z"))
    p = profile.profile_all({"merger_a": d}, [profile.registered("merger_a")], NOW)
    r = p.first()
    assert (r.completeness, r.key_coverage, r.pii, r.freshness, r.record_count) == (80, 50, 90, 0, 2)
    assert profile.profile_all({"merger_a": d.limit(0)}, [profile.registered("merger_a")], NOW).first().health == 0
    tables = {"merger_a": d, "loyalty": spark.createDataFrame([("12", "s", None, None, None)], "loyalty_num string, store_name string, business_type string, annual_revenue string, modified_date string")}
    sources = [profile.registered(n) for n in lineage.REGISTRY]
    rows, errors = profile.run_swarm(tables.__getitem__, sources, NOW)
    assert [x["source"] for x in rows] == ["loyalty", "merger_a"] and set(errors) == set(lineage.REGISTRY) - set(tables)
    assert rows[0]["issues"] == "lost_zeros" and rows[0]["top_issues"] == ["freshness 0", "key_coverage 0", "completeness 40"]
    board = profile.dashboard(spark, rows, errors, str(tmp_path / "board"), NOW)
    assert board["overall_health_score"] == round(sum(x["health"] for x in rows) / 2, 1) and json.loads((tmp_path / "board/000000000001.json").read_text())["errors"]
    assert profile.run_swarm(tables.__getitem__, sources[4:5], NOW, lambda df, s: rows[0] | {"source": s.name, "record_count": df.count()})[0][0]["record_count"] == 2
    assert profile.sample(spark.range(9), "id").count() == 5 and profile.dashboard(spark, [], {}, str(tmp_path / "board"), NOW)["overall_health_score"] == 0.0


def test_api(spark, tmp_path):
    waits, calls = [], []

    def flaky(_):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return [{"a": 1, "b": None}, {"c": "x"}]

    kw = {"sleep": waits.append, "jitter": lambda: 0.0}
    out = api.ingest_api(spark, "/x", "s", flaky, str(tmp_path), **kw)
    assert out.landed == 2 and waits == [1.0, 2.0]
    down = lambda _: (_ for _ in ()).throw(ValueError("down"))
    assert api.ingest_api(spark, "/x", "t", down, str(tmp_path), **kw).dead_letters[0]["type"] == "permanent_failure"
    assert api.ingest_api(spark, "/x", "t", down, str(tmp_path), breaker=api.CircuitBreaker(2), **kw).dead_letters[0]["type"] == "circuit_break"
    assert zones.read_zone(spark, str(tmp_path), "t", "dead_letter").count() == 2
    now = [0.0]
    b = api.CircuitBreaker(1, 10, clock=lambda: now[0])
    with pytest.raises(ValueError):
        b.call(lambda: down(0))
    with pytest.raises(api.CircuitOpen):
        b.call(lambda: 1)
    now[0] = 11.0
    assert b.call(lambda: 1) == 1 and b.state == api.CLOSED and api.with_backoff(lambda: 1, 0) is None


def test_cdc(spark, tmp_path):
    raw = [('{"payload": {"op": "i", "after": {"id": 1}, "ts_ms": 5, "source": {"db": "m"}}, "topic": "t"}',), ("{}",), ('{"op": "d", "before": {"id": 1}, "after": null}',), ("no json",)]
    e = spark.createDataFrame(raw, "v string").select(cdc.parse_envelopes(F.col("v")).alias("e")).select("e.*").collect()
    assert [tuple(x) for x in e] == [("i", None, '{"id":1}', 5, "m", "t"), ("r", None, None, 0, "unknown", "unknown"), ("d", '{"id":1}', None, 0, "unknown", "unknown"), ("r", None, None, 0, "unknown", "unknown")]
    rows = [(1, "i", 1, None, '{"id": "1"}', "t"), (2, "D", 2, '{"id": "1"}', None, "t"), (3, "d", 3, '{"id": "1"}', None, None)]
    schema = "event_no bigint, op string, ts_ms bigint, before string, after string, topic string"
    d = spark.createDataFrame(rows, schema)
    assert [(r._cdc_op, r._cdc_tombstone, r._cdc_before) for r in cdc.land(d, ["id"]).orderBy("event_no").collect()] == [("i", False, None), ("D", False, None), ("d", True, '{"id": "1"}')]
    assert cdc.op_counts(d).first().asDict() == {"inserts": 1, "updates": 0, "deletes": 1, "landed": 3}
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    t = BucketedTable(spark, work_dir(spark, "s"), "id", 2)
    for _ in range(2):  # the second run finds nothing new
        q = cdc.land_stream(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["id"], "crm", str(tmp_path / "b"), str(tmp_path / "cp"), t)
        assert q.awaitTermination(60) and q.exception() is None
    assert spark.read.json(str(tmp_path / "b/crm")).count() == 3 and t.state().count() == 0


def test_gate_process_and_service(spark, tmp_path):
    from terrane.gate_cli import decide
    from terrane.operators.service import LineageService

    row = gold(spark).first().asDict()
    assert decide(spark, json.dumps({"table": "customer", "rows": [row]}))[0] == 0
    assert decide(spark, json.dumps({"table": "customer", "rows": [row | {"email_masked": "a.b@c.de"}]}))[0] == 2
    assert decide(spark, json.dumps({"table": "moon", "rows": [row]}))[0] == 2
    assert decide(spark, "no json")[0] == 0 and decide(spark, json.dumps({"table": "customer"}))[0] == 0
    (tmp_path / "pos.csv").write_text("customer_id,order_date\n1,2024\n2,2024\n")
    ingest.ingest_csv(spark, str(tmp_path / "pos.csv"), "pos", ingest.POS, str(tmp_path / "bronze"), "r1", NOW)
    s = LineageService(spark, {"bronze": "file://" + str(tmp_path / "bronze")})
    assert len(s.preview_table("bronze", "pos")["rows"]) == 2 and "error" in s.preview_table("moon", "pos") and "error" in s.preview_table("bronze", "x")
    assert [r["customer_id"] for r in s.find_record("bronze", "customer_id", "2", "pos")["rows"]] == ["2"]
    audit = spark.createDataFrame([("1", "phone", "pos", "r1", "rule", "v")], "customer_id string, field string, source_system string, run_id string, rule_name string, value string")
    assert [x["step"] for x in s.trace_lineage(audit, "bronze", "pos", "phone", "1")["chain"]] == ["silver", "bronze", "bronze"]


def test_python_validator(spark):
    d = spark.createDataFrame([(0, "a"), (1, None)], "i bigint, v string")
    out = ingest.with_validator(d, lambda row, i: [] if row["v"] else [("v", "missing", "None")], "i")
    assert [(r.i, len(r.errors)) for r in out.orderBy("i").collect()] == [(0, 0), (1, 1)] and ingest.landed(out).count() == 1


def test_scorecard_of_the_default_matcher(spark, tmp_path):
    """A match that is found, a non-match, a match that nothing tells, and an unclear pair."""
    one, other = {"phone": "3035550147", "name": "Ann Bell"}, {"phone": "4155550199", "name": "Zed Quill"}
    rows = [("1", one, one, "match", "s"), ("2", one, other, "non_match", "s"), ("3", other, one, "match", "t"), ("4", one, one, "unclear", "t")]
    spark.createDataFrame(rows, "pair_id string, record_a map<string,string>, record_b map<string,string>, label string, stratum string").write.parquet(str(tmp_path / "golden_pair.parquet"))
    m = entry.queries()["scorecard_default"](spark, str(tmp_path)).first()
    assert (m.n, m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == (3, 1, 0, 1, 1, 1.0, 0.5)
    got = {r.stratum: (r.n, r.precision, r.recall) for r in entry.queries()["scorecard_default_by_stratum"](spark, str(tmp_path)).collect()}
    assert got == {"s": (2, 1.0, 1.0), "t": (1, 0.0, 0.0)}
