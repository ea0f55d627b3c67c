"""Contracts: parsing, forms, lint, diff, exports and round trips. No Spark job."""

from __future__ import annotations

import json
import random

import pytest

from tablewarden.contract import ContractError, dump_contract, parse_contract
from tablewarden.contract.diff import diff
from tablewarden.contract.json_schema import json_schema
from tablewarden.contract.lint import lint
from tablewarden.contract.model import format_duration, parse_duration, suggestion
from tablewarden.export.dbt import generic_tests, schema_yml
from tablewarden.export.expectations import dlt_python, dlt_sql
from tablewarden.export.odcs import export_odcs, import_odcs, is_odcs
from tablewarden.functions.patterns import RegexError, java_pattern

HEAD = "apiVersion: v1\ndataset: d\n"


def contract(columns: str = "{ a: { type: int } }", rest: str = ""):
    return parse_contract(f"{HEAD}columns: {columns}\n{rest}")


def test_forms_and_severity():
    c = contract("{ a: { type: string, checks: [unique, { unique: { approx: true } }, { min: 1, severity: warn }, { length: { max: 3 } }, { enum: [yes, 1, 2.5, true] }] } }", "dataset_checks:\n  - freshness: { column: a, max_age: 1d 12h, severity: warn }\n  - assert: { expr: 'COUNT(*) > 1' }\n  - row_count_min: { count: 3 }")
    kinds = [(k.kind, k.severity) for k in c.columns["a"].checks]
    assert kinds == [("unique", "error"), ("unique", "error"), ("min", "warn"), ("length", "error"), ("enum", "error")]
    assert c.columns["a"].checks[4]["enum"] == ["yes", 1, 2.5, True]
    assert c.dataset_checks[0]["max_age"] == 129600 and c.dataset_checks[0].severity == "warn"
    assert [k.params for k in c.dataset_checks[1:]] == [{"expr": "COUNT(*) > 1"}, {"count": 3}]


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("", "empty"),
        ("apiVersion: v2\ndataset: d", "must be v1"),
        (HEAD + "colums: {}", "did you mean `columns`"),
        (HEAD + "columns: { a: { type: int }, a: { type: int } }", "second time"),
        (HEAD + "columns: { a: { type: integer } }", "cannot be `integer`"),
        (HEAD + "columns: { a: { } }", "needs `type`"),
        (HEAD + "columns: { a: { type: int, checks: [{ mim: 3 }] } }", "did you mean `min`"),
        (HEAD + "columns: { a: { type: int, checks: [{ min: 3, max: 4 }] } }", "exactly one kind"),
        (HEAD + "columns: { a: { type: int, checks: [min] } }", "needs a parameter"),
        (HEAD + "dataset_checks: [{ freshness: { column: a, max_age: soon } }]", "not a duration"),
        (HEAD + "dataset_checks: [{ row_count_min: { count: 1, severity: warn }, severity: warn }]", "given twice"),
        (HEAD + "dataset_checks: [{ references: { columns: [a, b], dataset: x, to: [c] } }]", "pairs 2 columns with 1"),
        (HEAD + "columns: [", "not valid YAML"),
    ],
)
def test_diagnostics(text, part):
    with pytest.raises(ContractError, match=part.replace("[", r"\[")):
        parse_contract(text)


def test_error_lines():
    with pytest.raises(ContractError) as e:
        parse_contract(HEAD + "columns:\n  a:\n    type: int\n    cheks: []\n")
    assert e.value.line == 6


def test_durations_and_suggestions():
    assert parse_duration("48h") == 172800 and parse_duration("1h 30m") == 5400 and parse_duration("2weeks") == 1209600
    assert format_duration(172800) == "2days"
    assert suggestion("colums", ("columns", "owner")) == "columns" and suggestion("zzzzzz", ("columns",)) is None


@pytest.mark.parametrize(
    ("columns", "rest", "part", "severity"),
    [
        ("{}", "", "no columns", "error"),
        ("{ a: { type: string, checks: [{ min: 1 }] } }", "", "no meaning", "error"),
        ("{ a: { type: int, checks: [{ min: 5 }, { max: 4 }] } }", "", "above max", "error"),
        ("{ a: { type: int, checks: [{ min: 5 }, { min: 6 }] } }", "", "only once", "error"),
        ("{ a: { type: int, checks: [{ format: email }] } }", "", "applies to text", "error"),
        ("{ a: { type: string, checks: [{ regex: '(' }] } }", "", "not closed", "error"),
        ("{ a: { type: string, checks: [{ regex: '(?=a)' }] } }", "", "look-around", "error"),
        ("{ a: { type: string, checks: [{ enum: [] }] } }", "", "empty list", "error"),
        ("{ a: { type: string, checks: [{ length: { min: 3, max: 2 } }] } }", "", "above max", "error"),
        ("{ a: { type: int, checks: [{ null_ratio_max: 1.5 }] } }", "", "between 0 and 1", "error"),
        ("{ a: { type: int, sunset: 2026-02-30 } }", "", "not a date", "error"),
        ("{ a: { type: int, stability: deprecated } }", "", "no sunset", "warning"),
        ("{ a: { type: int } }", "primary_key: [b]", "not a declared column", "error"),
        ("{ a: { type: int } }", "dataset_checks: [{ freshness: { column: a, max_age: 1h } }]", "needs a date", "error"),
        ("{ a: { type: int } }", "dataset_checks: [{ references: { columns: [a], dataset: d } }]", "by itself", "warning"),
        ("{ a: { type: int } }", "consumers: [{ name: x, reads: [b, a, a], tier: 9 }]", "listed twice", "warning"),
        ("{ a: { type: int } }", "settings: { input: { format: csv, sheet: x } }", "does not apply", "error"),
        ("{ a: { type: int } }", "settings: { input: { format: fixed_width, fixed_width: [{ name: a, start: 1, end: 4 }, { name: b, start: 3, width: 2 }] } }", "overlap", "error"),
        ("{ a: { type: int } }", "migration: { window_ends: 2026-01-01 }", "what readers should do", "warning"),
    ],
)
def test_lint(columns, rest, part, severity):
    assert any(part in f.message and f.severity == severity for f in lint(contract(columns, rest)))


A = "{ a: { type: int%s } }"


@pytest.mark.parametrize(
    ("old", "new", "impact"),
    [
        (A % "", "{ a: { type: string } }", "breaking"),
        (A % "", A % ", required: true", "breaking"),
        (A % ", required: true", A % "", "non_breaking"),
        (A % "", "{ a: { type: int }, b: { type: int } }", "non_breaking"),
        (A % "", "{ a: { type: int }, b: { type: int, required: true } }", "breaking"),
        ("{ a: { type: int }, b: { type: int } }", A % "", "breaking"),
        (A % ", description: x", A % ", description: y", "semantic"),
        (A % "", A % ", description: y", "cosmetic"),
        (A % "", A % ", pii: email", "semantic"),
        (A % "", A % ", pii: none", "cosmetic"),
        (A % "", A % ", stability: beta", "semantic"),
        (A % ", stability: deprecated", A % "", "non_breaking"),
        (A % ", sunset: 2026-05-01", A % ", sunset: 2026-04-01", "breaking"),
        (A % ", sunset: 2026-05-01", A % ", sunset: 2026-06-01", "non_breaking"),
        (A % ", checks: [{ min: 1 }]", A % ", checks: [{ min: 2 }]", "breaking"),
        (A % ", checks: [{ min: 2 }]", A % ", checks: [{ min: 1 }]", "non_breaking"),
        (A % ", checks: [{ max: 2 }]", A % ", checks: [{ max: 1, severity: warn }]", "non_breaking"),
        (A % ", checks: [{ min: 1, severity: warn }]", A % ", checks: [{ min: 1 }]", "breaking"),
        (A % "", A % ", checks: [{ min: 1, severity: warn }]", "non_breaking"),
        (A % "", A % ", checks: [unique]", "breaking"),
        (A % ", checks: [{ unique: { approx: true } }]", A % ", checks: [unique]", "breaking"),
        (A % ", checks: [{ enum: [1, 2] }]", A % ", checks: [{ enum: [1, 2, 3] }]", "non_breaking"),
        (A % ", checks: [{ enum: [1, 2] }]", A % ", checks: [{ enum: [1, 3] }]", "breaking"),
        (A % ", checks: [{ length: 3 }]", A % ", checks: [{ length: { min: 1, max: 5 } }]", "non_breaking"),
    ],
)
def test_diff_columns(old, new, impact):
    assert [c.impact for c in diff(contract(old), contract(new))] == [impact]


@pytest.mark.parametrize(
    ("old", "new", "impact"),
    [
        ("", "primary_key: [a]", "breaking"),
        ("primary_key: [a]", "", "non_breaking"),
        ("", "owner: x", "cosmetic"),
        ("", "consumers: [{ name: x }]", "cosmetic"),
        ("", "migration: { window_ends: 2026-01-01, note: x }", "non_breaking"),
        ("migration: { window_ends: 2026-02-01 }", "migration: { window_ends: 2026-01-01 }", "breaking"),
        ("dataset_checks: [{ row_count_min: 1 }]", "dataset_checks: [{ row_count_min: 2 }]", "breaking"),
        ("dataset_checks: [{ freshness: { column: a, max_age: 1h } }]", "dataset_checks: [{ freshness: { column: a, max_age: 2h } }]", "non_breaking"),
        ("", "settings: { columns_exact: true }", "breaking"),
        ("", "settings: { allow_extra_columns: false }", "breaking"),
        ("", "settings: { on_type_mismatch: warn }", "non_breaking"),
        ("", "settings: { input: { skip_rows: 1 } }", "non_breaking"),
    ],
)
def test_diff_dataset(old, new, impact):
    assert [c.impact for c in diff(contract(rest=old), contract(rest=new))] == [impact]


def test_repeated_kinds_are_removed_and_added():
    old = contract("{ a: { type: string, checks: [{ regex: a }, { regex: b }] } }")
    new = contract("{ a: { type: string, checks: [{ regex: a }, { regex: c }] } }")
    assert [c.impact for c in diff(old, new)] == ["non_breaking", "breaking"]


def random_contract(r: random.Random):
    checks = ["unique", "not_empty_string", "{ unique: { approx: true } }", "{ min: 3, severity: warn }", "{ max: 2.5 }", "{ regex: '^[a-z]$' }", "{ enum: [a, 'yes', 3, '7'] }", "{ length: { min: 1 } }", "{ format: uuid }", "{ null_ratio_max: 0.25 }", "{ custom_expr: 'a > 1' }"]
    columns = {f"c{i}": f"{{ type: {r.choice(('string', 'int', 'float', 'date', 'datetime', 'bool'))}, required: {r.choice(('true', 'false'))}, checks: [{', '.join(r.sample(checks, r.randint(0, 4)))}]{r.choice(('', ', pii: email', ', sunset: 2026-01-02'))} }}" for i in range(r.randint(1, 5))}
    dataset = ["{ row_count_min: 1 }", "{ freshness: { column: c0, max_age: 49h } }", "{ references: { columns: [c0], dataset: x, to: [y] }, severity: warn }", "{ assert: 'COUNT(*) > 0' }", "{ unique_ratio_min: { column: c0, ratio: 0.5 } }"]
    rest = f"primary_key: [c0]\ndataset_checks: [{', '.join(r.sample(dataset, r.randint(0, 5)))}]\nversion: '2024-11'\nsettings: {{ input: {{ format: csv, delimiter: ';' }} }}"
    return contract("{ " + ", ".join(f"{k}: {v}" for k, v in columns.items()) + " }", rest)


def test_round_trips():
    r = random.Random(5)
    for _ in range(60):
        c = random_contract(r)
        assert parse_contract(dump_contract(c)) == c
        assert diff(c, c) == []
        back, notes = import_odcs(export_odcs(c))
        assert back == c and not notes
        assert is_odcs(export_odcs(c))


def test_foreign_odcs():
    text = "apiVersion: v3.0.0\nkind: DataContract\nid: x\nversion: 1.0.0\nservers: [{}]\nschema:\n- name: t\n  quality: [{ rule: rowCount, mustBeGreaterThan: 10 }, { type: text }]\n  properties:\n  - { name: a, logicalType: integer, unique: true, primaryKey: true, logicalTypeOptions: { minimum: 3 } }\n  - { name: b, logicalType: object, quality: [{ rule: nullCount, mustBe: 0, severity: warning }] }\n"
    c, notes = import_odcs(text)
    assert [k.kind for k in c.columns["a"].checks] == ["unique", "min"] and c.primary_key == ("a",)
    assert c.dataset_checks[0].params == {"count": 11} and c.columns["b"].checks[0].severity == "warn"
    assert len(notes) == 3


def test_exports_cover_every_check():
    c = random_contract(random.Random(1))
    assert "CONSTRAINT" in dlt_sql(contract(A % ", required: true, checks: [{ min: 1 }]"))
    compile(dlt_python(c), "dlt", "exec")
    assert "models:" in schema_yml(c) and len(generic_tests()) == 14
    schema = json_schema()
    assert set(schema["properties"]) >= {"apiVersion", "columns", "settings"} and json.dumps(schema)


@pytest.mark.parametrize(("pattern", "java"), [
        ("^a$", r"^a\z"), (r"a\$", r"a\$"), ("[$]", "[$]"), ("[[:alpha:]]", "[A-Za-z]"), ("[^[:^digit:]x]", "[^[^0-9]x]"), ("(?P<x>a)", "(?<x>a)"), ("(?<x>a)", "(?<x>a)"), (r"\v", r"\x0B"),
        (r"\x{1F600}\u00e9\U0001F600\x41", r"\x{1F600}\x{00e9}\x{0001F600}\x{41}"), ("a+?b*?c{2,}?", "a+?b*?c{2,}?"), ("(?i)a(?s:.)", "(?i)a(?s:.)"), ("a{,2}", "a{,2}"), ("[a-z&&[^x]]", "[a-z&&[^x]]"),
    ])
def test_patterns(pattern, java):
    assert java_pattern(pattern) == "(?Ud)" + java


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?<!a)b", "(", "[a", "a)", "a++", "a*+", "a{2}+", "a?+", r"\Qa\E", r"\R", r"\X", r"\h", r"\G", r"\Z", r"\k<x>", r"\cA", r"\N", "[a-z--x]", "(?U)a", "(?d)a", r"\x{}", r"\xg1", r"\u12", r"\b{start}a"])
def test_refused_patterns(pattern):
    with pytest.raises(RegexError):
        java_pattern(pattern)


def test_consumers():
    c = contract("{ a: { type: string }, b: { type: string } }", "consumers: [{ name: all, reads: [] }, { name: some, reads: [b], kind: ai_agent, tier: 1 }, plain]")
    assert [x.name for x in c.consumers_of("a")] == ["all", "plain"] and [x.name for x in c.consumers_of("b")] == ["all", "some", "plain"]
    assert c.consumers[0].reads_whole_dataset and not c.consumers[1].reads_whole_dataset and c.consumers[1].kind == "ai_agent"
    with pytest.raises(Exception, match="kind"):
        contract("{ a: { type: string } }", "consumers: [{ name: x, kind: nobody }]")


COL = "{ a: { type: int%s } }"
CHECKS = "{ a: { type: %s, checks: [%s] } }"
INPUT = "settings: { input: { %s } }"
LAYOUT = "settings: { input: { format: fixed_width, fixed_width: [%s] } }"
DATED = "{ a: { type: int }, t: { type: datetime } }"


@pytest.mark.parametrize(
    ("columns", "rest", "found"),
    [
        ("{}", "", ["error columns"]),
        (COL % "", "migration: { window_ends: soon, note: '  ' }", ["error migration.window_ends", "warning migration.note"]),
        (COL % "", "settings: { columns_exact: true, allow_extra_columns: true }", ["warning settings.columns_exact"]),
        (COL % "", INPUT % "delimiter: ';;'", ["error settings.input.delimiter"]),
        (COL % "", INPUT % "format: tsv, delimiter: ';'", []),
        (COL % "", INPUT % "format: json, delimiter: ';'", ["error settings.input.delimiter"]),
        (COL % "", INPUT % "format: csv, json_path: x", ["error settings.input.json_path"]),
        (COL % "", INPUT % "format: csv, sheet: x", ["error settings.input.sheet"]),
        (COL % "", INPUT % "format: csv, xml_record: x", ["error settings.input.xml_record"]),
        (COL % "", INPUT % "format: json, has_header: true", ["error settings.input.has_header"]),
        (COL % "", INPUT % "format: parquet, skip_rows: 0", ["error settings.input.skip_rows"]),
        (COL % "", INPUT % "sheet: x, json_path: y, xml_record: z", []),
        (COL % "", INPUT % "format: csv, fixed_width: [{ name: a, width: 2 }]", ["error settings.input.fixed_width"]),
        (COL % "", INPUT % "format: csv, fixed_width: []", []),
        (COL % "", INPUT % "format: fixed_width", ["error settings.input.fixed_width"]),
        (COL % "", LAYOUT % "{ name: ' ', width: 1 }, { name: a, width: 1 }", ["error settings.input.fixed_width[0].name"]),
        (COL % "", LAYOUT % "{ name: a, width: 1 }, { name: a, width: 1 }", ["error settings.input.fixed_width[1].name"]),
        (COL % "", LAYOUT % "{ name: a, start: 0, end: 3 }", ["error settings.input.fixed_width[0].start"] * 2),
        (COL % "", LAYOUT % "{ name: a, start: 5, end: 8 }, { name: b, start: 1, end: 3 }", ["error settings.input.fixed_width[1].start"]),
        (COL % "", LAYOUT % "{ name: a, start: 1, end: 8 }, { name: b, start: 8, width: 1 }", ["error settings.input.fixed_width[1].start"]),
        (COL % "", LAYOUT % "{ name: a, end: 3, width: 3 }, { name: b, width: 0 }", ["error settings.input.fixed_width[0].width", "error settings.input.fixed_width[1].width"]),
        (COL % "", LAYOUT % "{ name: a }", ["error settings.input.fixed_width[0]"]),
        (COL % "", LAYOUT % "{ name: a, start: 5, end: 4 }, { name: b, start: 5, end: 6 }", ["error settings.input.fixed_width[0].end", "error settings.input.fixed_width[1].start"]),
        (COL % "", LAYOUT % "{ name: b, width: 2 }", ["warning columns.a"]),
        (COL % "", "consumers: [{ name: ' ', tier: 4 }]", ["error consumers[0].name", "error consumers[0].tier"]),
        (COL % "", "consumers: [{ name: x, tier: 3, reads: [b, a, b, a, a] }]", ["error consumers[0].reads[0]", "warning consumers[0].reads[2]", "warning consumers[0].reads[3]", "warning consumers[0].reads[4]"]),
        (COL % ", stability: deprecated, sunset: 2026-13-01", "", ["error columns.a.sunset"]),
        (COL % ", sunset: 2026-12-01", "", ["warning columns.a.stability"]),
        (COL % ", stability: deprecated, required: true", "", ["warning columns.a.sunset", "warning columns.a.required"]),
        (CHECKS % ("string", "unique, unique, { regex: a }, { regex: b }, unique"), "", ["error columns.a.checks[1]", "error columns.a.checks[4]"]),
        (CHECKS % ("string", "{ regex: 'a(' }"), "", ["error columns.a.checks[0]"]),
        (CHECKS % ("string", "{ enum: [] }"), "", ["error columns.a.checks[0]"]),
        (CHECKS % ("string", "{ length: {} }"), "", ["error columns.a.checks[0]"]),
        (CHECKS % ("string", "{ length: { min: 4, max: 3 } }"), "", ["error columns.a.checks[0]"]),
        (CHECKS % ("int", "{ null_ratio_max: -0.1 }, { unique_ratio_min: 1.1 }"), "", ["error columns.a.checks[0]", "error columns.a.checks[1]"]),
        (CHECKS % ("int", "{ null_ratio_max: 0 }, { unique_ratio_min: 1 }"), "", []),
        (CHECKS % ("int", "{ min: .inf }, { max: .nan }"), "", ["error columns.a.checks[0]", "error columns.a.checks[1]"]),
        (CHECKS % ("bool", "{ min: 1 }, { max: 2 }"), "", ["error columns.a.checks[0]", "error columns.a.checks[1]"]),
        (CHECKS % ("date", "{ format: uuid }"), "", ["error columns.a.checks[0]"]),
        (CHECKS % ("int", "{ max: 2 }, unique, { min: 3 }"), "", ["error columns.a.checks[0]"]),
        (DATED, "dataset_checks: [{ freshness: { column: t, max_age: 1h } }, { freshness: { column: a, max_age: 1h } }, { freshness: { column: u, max_age: 1h } }]", ["error dataset_checks[1]", "error dataset_checks[2]"]),
        (DATED, "dataset_checks: [{ null_ratio_max: { column: b, ratio: 2 } }, { unique_ratio_min: { column: a, ratio: -1 } }]", ["error dataset_checks[0]"] * 2 + ["error dataset_checks[1]"]),
        (DATED, "dataset_checks: [{ references: { columns: [b, a, a], dataset: x, to: [p, q, r] } }]", ["error dataset_checks[0]"] * 2),
        (DATED, "primary_key: [a]\ndataset_checks: [{ references: { columns: [a], dataset: d, to: [a] } }]", ["warning dataset_checks[0]"]),
        (DATED, "primary_key: [a, b, a]", ["error primary_key"] * 2),
    ],
)
def test_every_finding_and_its_place(columns, rest, found):
    assert [f"{f.severity} {f.path}" for f in lint(contract(columns, rest))] == found


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        (COL % ", pii: email", COL % ", pii: phone", ["semantic columns.a.pii"]),
        (COL % ", pii: email", COL % ", pii: none", ["semantic columns.a.pii"]),
        (COL % ", pii: email", COL % "", ["semantic columns.a.pii"]),
        (COL % ", pii: none", COL % "", ["semantic columns.a.pii"]),
        (COL % ", pii: none", COL % ", pii: none", []),
        (COL % ", stability: beta", COL % "", ["non_breaking columns.a.stability"]),
        (COL % "", COL % ", sunset: 2026-05-01", ["semantic columns.a.sunset"]),
        (COL % ", sunset: 2026-05-01", COL % "", ["non_breaking columns.a.sunset"]),
        (COL % ", description: x", COL % "", ["semantic columns.a.description"]),
        (CHECKS % ("int", "{ min: 1 }"), CHECKS % ("int", "{ min: 2, severity: warn }"), ["non_breaking columns.a.checks[min]"]),
        (CHECKS % ("int", "{ min: 2, severity: warn }"), CHECKS % ("int", "{ min: 1 }"), ["breaking columns.a.checks[min]"]),
        (CHECKS % ("int", "{ max: 2 }"), CHECKS % ("int", "{ max: 3 }"), ["non_breaking columns.a.checks[max]"]),
        (CHECKS % ("int", "{ max: 2 }"), CHECKS % ("int", "{ max: 2.0 }"), []),
        (CHECKS % ("string", "{ length: 3 }"), CHECKS % ("string", "{ length: { min: 3 } }"), ["non_breaking columns.a.checks[length]"]),
        (CHECKS % ("string", "{ length: 3 }"), CHECKS % ("string", "{ length: 4 }"), ["breaking columns.a.checks[length]"]),
        (CHECKS % ("string", "{ length: { min: 2, max: 9 } }"), CHECKS % ("string", "{ length: { min: 1, max: 8 }, severity: warn }"), ["non_breaking columns.a.checks[length]"]),
        (CHECKS % ("string", "{ enum: [a, b] }"), CHECKS % ("string", "{ enum: [b, a] }"), []),
        (CHECKS % ("string", "{ enum: [a, b] }"), CHECKS % ("string", "{ enum: [a, c] }"), ["breaking columns.a.checks[enum]"]),
        (CHECKS % ("string", "{ enum: [a] }"), CHECKS % ("string", "{ enum: [a, c] }"), ["non_breaking columns.a.checks[enum]"]),
        (CHECKS % ("string", "{ format: email }"), CHECKS % ("string", "{ format: uuid }"), ["breaking columns.a.checks[format]"]),
        (CHECKS % ("string", "unique"), CHECKS % ("string", "{ unique: { approx: true } }"), ["non_breaking columns.a.checks[unique]"]),
        (CHECKS % ("string", "{ unique: { approx: true } }"), CHECKS % ("string", "unique"), ["breaking columns.a.checks[unique]"]),
        (CHECKS % ("int", "{ unique_ratio_min: 0.5 }"), CHECKS % ("int", "{ unique_ratio_min: 0.6 }"), ["breaking columns.a.checks[unique_ratio_min]"]),
        (CHECKS % ("string", "{ regex: a }, { regex: b }"), CHECKS % ("string", "{ regex: b }, { regex: c }"), ["non_breaking columns.a.checks[regex]", "breaking columns.a.checks[regex]"]),
        (CHECKS % ("string", "{ regex: a }, { regex: a }"), CHECKS % ("string", "{ regex: a }"), []),
        (CHECKS % ("string", "not_empty_string"), CHECKS % ("string", "{ regex: a, severity: warn }"), ["non_breaking columns.a.checks[not_empty_string]", "non_breaking columns.a.checks[regex]"]),
    ],
)
def test_every_change_and_its_place(old, new, want):
    assert [f"{c.impact} {c.path}" for c in diff(contract(old), contract(new))] == want
