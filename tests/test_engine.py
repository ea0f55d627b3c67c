"""Checks, keys, profiles and reports on small frames."""

from __future__ import annotations

import json
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tablewarden.contract import parse_contract
from tablewarden.functions.formats import bad_format
from tablewarden.functions.keys import key_hash, key_hash_of
from tablewarden.functions.typed import as_text, parse_text
from tablewarden.operators.draft import draft_contract
from tablewarden.operators.execute import run_check
from tablewarden.operators.keys import collect_key_set
from tablewarden.operators.profile import profile_frame
from tablewarden.plans.planner import NestedColumnError
from tablewarden.report import html, human, json_text, junit, openlineage

SIGNUPS = """apiVersion: v1
dataset: signups
columns:
  user_id: { type: string, required: true, checks: [unique] }
  email: { type: string, required: true, checks: [{ format: email }] }
  age: { type: int, checks: [{ min: 18 }, { max: 120 }] }
  country: { type: string, checks: [{ length: 2 }, { regex: "^[A-Z]{2}$" }] }
  plan: { type: string, checks: [{ enum: [free, pro] }] }
  at: { type: datetime, required: true }
dataset_checks:
  - row_count_min: 1
  - freshness: { column: at, max_age: 48h, severity: warn }
  - null_ratio_max: { column: age, ratio: 0.4 }
"""
ROWS = [
    ("u1", "a@x.org", "34", "US", "free", "2026-07-08T09:15:00Z"),
    ("u2", "b@@x", "17", "DE", "pro", "2026-07-08 10:15:00"),
    ("u1", "c@x.org", None, "usa", "free", "2026-07-08"),
    ("u4", "d@x.org", "130", "FR", "gold", "2026-07-08T10:15"),
    ("u5", "e@x.org", "x", "G\n", "pro", "2026-07-08T10:15:00+02:00"),
]


@pytest.fixture
def signups(spark):
    return spark.createDataFrame(ROWS, "user_id string, email string, age string, country string, plan string, at string").coalesce(1)


def by_id(result):
    return {c.id: c for c in result.checks}


def test_text_source(signups):
    r = run_check(parse_contract(SIGNUPS), signups, typed=False, now="2026-07-10T00:00:00Z")
    assert [c.id for c in r.checks][:3] == ["dataset.columns", "user_id.type", "user_id.required"] and len(r.checks) == 20
    failed = {c.id: [s["row"] for s in c.samples] for c in r.checks if c.status == "failed"}
    assert failed == {"user_id.unique": [3], "email.format.email": [2], "age.type": [5], "age.min": [2], "age.max": [4], "country.length": [3], "country.regex": [3, 5], "plan.enum": [4]}
    assert by_id(r)["age.min"].outcome.observed["min_observed"] == 17
    assert r.summary == {"checks_total": 20, "passed": 12, "failed_error": 8, "failed_warn": 0}
    late = run_check(parse_contract(SIGNUPS), signups, typed=False, now="2026-07-11T00:00:00Z", profile=False, redact=True)
    assert by_id(late)["dataset.freshness.at"].status == "failed" and late.summary["failed_warn"] == 1
    assert {s["value"] for c in late.checks for s in c.samples} == {"<redacted>"}


def test_reports(signups):
    r = run_check(parse_contract(SIGNUPS), signups, typed=False, now="2026-07-11T00:00:00Z").to_dict()
    assert json.loads(json_text(r))["result_schema_version"] == 1
    suite = ET.fromstring(junit(r))
    assert (suite.get("tests"), suite.get("failures"), suite.get("skipped")) == ("20", "8", "1")
    assert "8 failed, 1 warnings" in human(r) and html(r).count("<tr>") > 20
    event = openlineage(r)
    assert event["eventType"] == "FAIL" and len(event["inputs"][0]["facets"]["dataQualityAssertions"]["assertions"]) == 20


def test_keys_references_and_asserts(spark):
    orders = spark.createDataFrame([("eu", 1, "c1", 10.0), ("eu", 1, "c9", 20.0), ("us", None, None, 30.5), ("us", 2, "c2", 0.0)], "region string, id int, customer string, amount double").coalesce(1)
    customers = collect_key_set(spark.createDataFrame([("c1",), ("c2",), (None,), ("c1",)], "id string"), ["id"])
    text = """apiVersion: v1
dataset: orders
columns: { region: { type: string }, id: { type: int }, customer: { type: string }, amount: { type: float } }
primary_key: [region, id]
dataset_checks:
  - references: { columns: [customer], dataset: customers, to: [id] }
  - references: { columns: [customer], dataset: unknown }
  - assert: "SUM(amount) = 60.5"
  - assert: { expr: "COUNT(*) > 10", severity: warn }
  - assert: "amount > 1"
  - assert: "SUM(amount)"
  - assert: "MAX(nothing) > 1"
  - custom_expr: "amount >= 10"
  - custom_expr: "nothing > 1"
  - custom_expr: "raise_error('x') IS NULL"
"""
    r = run_check(parse_contract(text), orders, references={"customers": customers})
    key = by_id(r)["dataset.primary_key"]
    assert key.outcome.observed == {"fail_ratio": 0.5, "distinct_keys": 2, "duplicate_rows": 1, "null_key_rows": 1}
    assert [s["value"] for s in key.samples] == ["region=eu, id=1", "region=us, id=(null)"]
    ref = by_id(r)["dataset.references.customers"]
    assert (ref.outcome.rows_evaluated, ref.outcome.rows_failed, ref.outcome.observed["referenced_keys"]) == (3, 1, 2)
    assert ref.samples == [{"row": 2, "value": "customer=c9"}]
    assert by_id(r)["dataset.references.unknown"].status == "failed"
    assert [c.status for c in r.checks if c.kind == "assert"] == ["passed", "failed", "failed", "failed", "failed"]
    assert [(c.status, c.outcome.rows_failed) for c in r.checks if c.kind == "custom_expr"] == [("failed", 1), ("failed", None), ("failed", None)]


def test_native_types(spark):
    frame = spark.createDataFrame([(1, 2.0, "x"), (None, 0.5, "")], "a int, b double, c string").withColumn("d", F.lit("2026-01-01").cast("timestamp_ntz"))
    c = parse_contract("apiVersion: v1\ndataset: d\ncolumns: { a: { type: float, checks: [{ enum: [1.0] }] }, b: { type: int }, c: { type: string, checks: [not_empty_string] }, d: { type: datetime } , e: { type: int } }\nsettings: { allow_extra_columns: false }")
    r = by_id(run_check(c, frame))
    assert r["a.type"].status == "passed" and r["a.enum"].status == "passed" and r["d.type"].status == "passed"
    assert r["b.type"].status == "failed" and r["b.type"].outcome.rows_failed is None
    assert r["c.not_empty_string"].outcome.rows_failed == 1 and r["e.present"].status == "failed"


def test_sample_rows_over_many_partitions(spark, tmp_path):
    """Row numbers follow the file, whatever the partitions: only failing rows are numbered."""
    spark.createDataFrame([(i, "bad" if i in (3, 700, 701, 999) else "ok", i // 2 if i > 990 else i) for i in range(1000)], "k int, v string, u int").coalesce(1).sortWithinPartitions("k").write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t").repartitionByRange(7, "k").sortWithinPartitions("k")
    contract = parse_contract("apiVersion: v1\ndataset: t\ncolumns:\n  k: { type: int }\n  v: { type: string, checks: [{ enum: [ok] }] }\n  u: { type: int, checks: [unique] }\n")
    got = {c.id: c.samples for c in run_check(contract, frame, sample_failures=3).checks if c.samples}
    assert got["v.enum"] == [{"row": 4, "value": "bad"}, {"row": 701, "value": "bad"}, {"row": 702, "value": "bad"}]
    assert [s["row"] for s in got["u.unique"]] == [992, 993, 994]


def test_nested_and_empty(spark):
    c = parse_contract("apiVersion: v1\ndataset: d\ncolumns: { a: { type: string, required: true, checks: [unique, { unique_ratio_min: 0.9 }, { null_ratio_max: 0 }] } }\nprimary_key: [a]\ndataset_checks: [{ row_count_min: 1 }, { assert: 'COUNT(*) = 0' }]")
    with pytest.raises(NestedColumnError):
        run_check(c, spark.createDataFrame([(["x"],)], "a array<string>"))
    r = run_check(c, spark.createDataFrame([], "a string"))
    assert [x.id for x in r.checks if x.status == "failed"] == ["dataset.row_count_min"]


FORMS = {
    "email": (["a@b.co", "x.y+z@mail.example.org"], ["a@b", "bob@@example", "a b@c.de", "a@b.co\n"]),
    "uuid": (["123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000"], ["123e4567e89b12d3a456426614174000", "g23e4567-e89b-12d3-a456-426614174000"]),
    "iso_date": (["2026-07-09", "2024-02-29"], ["2026-7-9", "2026-02-30", "2026-07-09T00:00:00"]),
    "iso_datetime": (["2026-07-09T10:11:12Z", "2026-07-09T10:11:12.25+02:00", "2026-07-09T10:11:12", "2026-07-09 10:11:12"], ["2026-07-09", "2026-07-09T10:11", "2026-07-09T25:00:00Z", "2026-02-30T10:11:12Z"]),
    "url": (["https://example.com", "ftp://x/y?z", "http://exa_mple.com/"], ["example.com", "not a url", "http:// x", "/path"]),
    "country_code_iso2": (["US", "GB", "ZW"], ["us", "XX", "USA", ""]),
}


@pytest.mark.parametrize("name", FORMS)
def test_formats(spark, name):
    good, bad = FORMS[name]
    rows = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", bad_format(F.col("v"), name).alias("bad")).collect()
    assert [r.v for r in rows if not r.bad] == good


def test_parsing(spark):
    cases = {
        "int": ([" 12 ", "+5", "-0", "\u00a07"], ["1.0", "1e3", "9223372036854775808", "", "x"]),
        "float": (["1", "-2.5e3", ".5", "5."], ["NaN", "inf", "1e400", "1d", "0x1p3"]),
        "bool": (["Yes", "0", " T "], ["2", "on"]),
        "date": (["2026-07-09", "2026-7-9"], ["2026", "2026-02-30", "2026-07-09T10"]),
        "datetime": (["2026-07-09T10:11:12Z", "2026-07-09 10:11:12.5", "2026-07-09T10:11", "2026-07-09"], ["10:11:12", "2026", "2026-07-09T25:00:00Z"]),
    }
    for kind, (good, bad) in cases.items():
        rows = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", parse_text(F.col("v"), kind).isNotNull().alias("ok")).collect()
        assert [r.v for r in rows if r.ok] == good, kind


def test_double_text(spark):
    frame = spark.createDataFrame([(1e7,), (0.1,), (12345678.9,), (0.0,), (-2.0,), (1e25,)], "v double")
    assert [r.t for r in frame.select(as_text(F.col("v"), frame.schema["v"].dataType).alias("t")).collect()] == ["10000000", "0.1", "12345678.9", "0", "-2", "1.0E25"]


def test_key_hash(spark):
    assert key_hash_of(["42"]) == 17346295814714295889
    frame = spark.createDataFrame([("42", "é"), ("a" * 300, "")], "a string, b string")
    rows = frame.select("a", "b", key_hash([F.col("a"), F.col("b")]).alias("two"), key_hash([F.col("a")]).alias("one")).collect()
    assert rows[0].one == "17346295814714295889"
    assert all(int(r.two) == key_hash_of([r.a, r.b]) for r in rows)


def test_profile_and_draft(spark):
    rows = [(str(i), "x" if i % 2 else "y", "", f"u{i}@x.org", f"2026-01-0{i % 9 + 1}T00:00:00Z", "true") for i in range(1, 1001)]
    frame = spark.createDataFrame(rows, "n string, c string, e string, m string, t string, b string")
    p = {x.name: x for x in profile_frame(frame)}
    assert (p["n"].inferred_type, p["n"].mean, round(p["n"].std, 3), p["n"].min, p["n"].max) == ("int", 500.5, 288.819, "1", "1000")
    assert p["c"].values == ["x", "y"] and p["e"].null_count == 1000 and p["m"].inferred_format == "email"
    assert (p["t"].inferred_type, p["b"].inferred_type) == ("datetime", "bool")
    text = draft_contract(list(p.values()), "d")
    assert run_check(parse_contract(text), frame, typed=False, profile=False).status == "passed"


def test_streaming(spark, tmp_path):
    from tablewarden.streaming import check_batches, check_on_write

    c = parse_contract("apiVersion: v1\ndataset: d\ncolumns: { a: { type: int, checks: [{ min: 2 }] } }\ndataset_checks: [{ row_count_min: 1 }]")
    frame = spark.range(5).select(F.col("id").cast("int").alias("a"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("a int").parquet(str(tmp_path / "in"))
    query = check_batches(c, stream, lambda n, r: seen.append(r.summary["failed_error"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [1]
    observed, outcomes = check_on_write(c, frame)
    observed.write.parquet(str(tmp_path / "out"))
    assert {x.id: x.status for x in outcomes()} == {"dataset.columns": "passed", "a.type": "passed", "a.min": "failed", "dataset.row_count_min": "passed"}
