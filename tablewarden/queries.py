"""Queries over the synthetic tables, one per operator, with the SQL to hold them against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract.parse import parse_contract
from .functions.keys import key_hash
from .operators.execute import run_check
from .operators.keys import collect_key_set
from .operators.profile import profile_frame
from .operators.samples import repeats_frame
from .plans.planner import NestedColumnError
from .session import scratch_folder
from .sources import ReadOptions, open_source

NOW = "2024-02-01T00:00:00Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CHECK = "SELECT '{id}' AS check_id, CAST({n} AS BIGINT) AS rows_evaluated, CAST({bad} AS BIGINT) AS rows_failed, CAST({failed} AS BOOLEAN) AS failed FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def outcomes(spark: SparkSession, frame: DataFrame, columns: str, rest: str = "", **options) -> DataFrame:
    """Run a contract given by its columns (and more) and show one row per check."""
    contract = parse_contract(f"apiVersion: v1\ndataset: t\ncolumns:\n{columns}\n{rest}")
    result = run_check(contract, frame, now=NOW, sample_failures=0, profile=False, **options)
    return result.to_frame(spark).select(F.col("id").alias("check_id"), "rows_evaluated", "rows_failed", (F.col("status") == "failed").alias("failed"))


def only(frame: DataFrame, *ids: str) -> DataFrame:
    return frame.where(F.col("check_id").isin(*ids))


def counted(check_id: str, column: str, bad: str, source: str) -> str:
    n = f"SUM(CASE WHEN {column} IS NOT NULL AND {bad} THEN 1 ELSE 0 END)"
    return CHECK.format(id=check_id, n=f"COUNT({column})", bad=f"COALESCE({n}, 0)", failed=f"COALESCE({n}, 0) > 0", table=source)


def whole(check_id: str, failed: str, source: str, n: str = "NULL", bad: str = "NULL") -> str:
    return CHECK.format(id=check_id, n=n, bad=bad, failed=failed, table=source)


_BRANDS = "(SELECT NULLIF(p_brand, 'Brand#11') AS b FROM part)"


@query(CHECK.format(id="b.required", n="COUNT(*)", bad="COUNT(*) - COUNT(b)", failed="COUNT(*) > COUNT(b)", table=_BRANDS))
def check_required(spark, sf_dir):
    frame = table(spark, sf_dir, "part").select(F.nullif("p_brand", F.lit("Brand#11")).alias("b"))
    return only(outcomes(spark, frame, "  b: { type: string, required: true }"), "b.required")


@query(counted("c_acctbal.min", "c_acctbal", "c_acctbal < 0", "customer"))
def check_min(spark, sf_dir):
    return only(outcomes(spark, table(spark, sf_dir, "customer"), "  c_acctbal: { type: float, checks: [{ min: 0 }] }"), "c_acctbal.min")


@query(counted("o_totalprice.max", "o_totalprice", "o_totalprice > 250000.5", "orders"))
def check_max(spark, sf_dir):
    return only(outcomes(spark, table(spark, sf_dir, "orders"), "  o_totalprice: { type: float, checks: [{ max: 250000.5 }] }"), "o_totalprice.max")


@query(counted("o_orderdate.min", "o_orderdate", "epoch_us(o_orderdate) < 820454400000000", "orders"))
def check_min_temporal(spark, sf_dir):
    return only(outcomes(spark, table(spark, sf_dir, "orders"), "  o_orderdate: { type: datetime, checks: [{ min: 820454400000000 }] }"), "o_orderdate.min")


@query(counted("c_name.regex", "c_name", "NOT regexp_matches(c_name, '^Customer#0{4}[0-9]{4}[1-7]$')", "customer") + " UNION ALL " + counted("url.regex", "url", "NOT regexp_matches(url, '^https://[a-z.-]+/(en|de)/')", "pages"))
def check_regex(spark, sf_dir):
    a = outcomes(spark, table(spark, sf_dir, "customer"), "  c_name: { type: string, checks: [{ regex: '^Customer#0{4}[0-9]{4}[1-7]$' }] }")
    b = outcomes(spark, table(spark, sf_dir, "pages"), "  url: { type: string, checks: [{ regex: '^https://[a-z.-]+/(en|de)/' }] }")
    return only(a.union(b), "c_name.regex", "url.regex")


# texts in which dialects differ: line ends, letters beyond ASCII, POSIX classes
_TEXTS = "CASE c_custkey % 8 WHEN 0 THEN concat('a', chr(13), 'b') WHEN 1 THEN concat('a', chr(10), 'b') WHEN 2 THEN concat('a', chr(133), 'b') WHEN 3 THEN 'abé' WHEN 4 THEN 'abc' WHEN 5 THEN concat('abc', chr(10)) WHEN 6 THEN concat('a', chr(11), 'b') ELSE 'a-b' END"
_DIALECT = {"p": "^a.b", "q": "^[[:alpha:]]+$", "r": "^[[:^digit:]]{3}$", "s": "^a[[:space:]]b$", "t": "a[^[:punct:]]b", "u": "^a\\x{0D}b$"}


@query(" UNION ALL ".join(counted(f"{k}.regex", "v", f"NOT regexp_matches(v, '{p}')", f"(SELECT {_TEXTS} AS v FROM customer)") for k, p in _DIALECT.items()))
def check_regex_dialect(spark, sf_dir):
    text = F.expr(_TEXTS.replace("chr(133)", "decode(unhex('C285'), 'utf-8')"))
    frame = table(spark, sf_dir, "customer").select(*(text.alias(k) for k in _DIALECT))
    found = outcomes(spark, frame, "\n".join(f"  {k}: {{ type: string, checks: [{{ regex: '{p}' }}] }}" for k, p in _DIALECT.items()))
    return only(found, *(f"{k}.regex" for k in _DIALECT))


def _format(spark, sf_dir, name: str, expression: str, source: str = "customer") -> DataFrame:
    frame = table(spark, sf_dir, source).select(F.expr(expression).alias("v"))
    return only(outcomes(spark, frame, f"  v: {{ type: string, checks: [{{ format: {name} }}] }}"), f"v.format.{name}")


def _format_sql(name: str, expression: str, bad: str, source: str = "customer") -> str:
    return counted(f"v.format.{name}", "v", bad, f"(SELECT {expression} AS v FROM {source})")


_EMAIL = "CASE WHEN c_custkey % 7 = 0 THEN 'bad@@x.org' WHEN c_custkey % 11 = 0 THEN concat('u', c_custkey, '@host') ELSE concat('user.', c_custkey, '+a@mail.example.com') END"


@query(_format_sql("email", _EMAIL, "NOT regexp_full_match(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')"))
def check_format_email(spark, sf_dir):
    return _format(spark, sf_dir, "email", _EMAIL)


_H = "md5(CAST(c_custkey AS STRING))"
_UUID = f"concat(CASE WHEN c_custkey % 5 = 0 THEN 'g' ELSE substr({_H}, 1, 1) END, substr({_H}, 2, 7), '-', substr({_H}, 9, 4), '-', upper(substr({_H}, 13, 4)), '-', substr({_H}, 17, 4), '-', substr({_H}, 21, 12))"


@query(_format_sql("uuid", _UUID, "NOT regexp_full_match(v, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')"))
def check_format_uuid(spark, sf_dir):
    return _format(spark, sf_dir, "uuid", _UUID)


_DATE = "CASE c_custkey % 6 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026-7-9' WHEN 2 THEN '2026-07-09T00' WHEN 3 THEN '2024-02-29' ELSE '2024-01-15' END"


@query(_format_sql("iso_date", _DATE, "NOT (regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(v AS DATE) IS NOT NULL)"))
def check_format_iso_date(spark, sf_dir):
    return _format(spark, sf_dir, "iso_date", _DATE)


_STAMP = "CASE c_custkey % 8 WHEN 0 THEN '2026-07-09T10:11:12Z' WHEN 1 THEN '2026-07-09T10:11:12.5+02:00' WHEN 2 THEN '2026-07-09T10:11:12' WHEN 3 THEN '2026-07-09 10:11:12' WHEN 4 THEN '2026-07-09T10:11' WHEN 5 THEN '2026-07-09' WHEN 6 THEN '2026-07-09T25:11:12' ELSE '2026-02-30T10:11:12Z' END"


@query(_format_sql("iso_datetime", _STAMP, "NOT (regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?| [0-9]{2}:[0-9]{2}:[0-9]{2})') AND TRY_CAST(substr(replace(v, 'T', ' '), 1, 19) AS TIMESTAMP) IS NOT NULL)"))
def check_format_iso_datetime(spark, sf_dir):
    return _format(spark, sf_dir, "iso_datetime", _STAMP)


_URL = "CASE WHEN page_id % 9 = 0 THEN 'not a url' WHEN page_id % 9 = 1 THEN substr(url, 5, 100) WHEN page_id % 9 = 2 THEN 'http:// x' WHEN page_id % 9 = 3 THEN 'http://a b/' WHEN page_id % 9 = 4 THEN concat('http://host:', 65530 + page_id % 11, '/x') WHEN page_id % 9 = 5 THEN 'http://u:7@host:8080?q' ELSE url END"


@query(_format_sql("url", _URL, "NOT (regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\s@]*@)?[A-Za-z0-9.-]+(:[0-9]*)?([/?#]|$)') AND COALESCE(TRY_CAST(NULLIF(regexp_extract(v, ':([0-9]+)(?:[/?#]|$)', 1), '') AS INTEGER) <= 65535, TRUE))", "pages"))
def check_format_url(spark, sf_dir):
    return _format(spark, sf_dir, "url", _URL, "pages")


_COUNTRY = "CASE c_custkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'usa' WHEN 2 THEN 'DE' WHEN 3 THEN 'XX' WHEN 4 THEN 'gb' ELSE 'GB' END"


@query(_format_sql("country_code_iso2", _COUNTRY, "v NOT IN ('US', 'DE', 'GB')"))
def check_format_country(spark, sf_dir):
    return _format(spark, sf_dir, "country_code_iso2", _COUNTRY)


@query(counted("o_orderstatus.enum", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')", "orders") + " UNION ALL " + counted("n.enum", "n", "n NOT IN (1, 2, 3)", "(SELECT l_linenumber AS n FROM lineitem)"))
def check_enum(spark, sf_dir):
    a = outcomes(spark, table(spark, sf_dir, "orders"), "  o_orderstatus: { type: string, checks: [{ enum: [F, O] }] }")
    b = outcomes(spark, table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")), "  n: { type: int, checks: [{ enum: [1, 2, 3.0] }] }")
    return only(a.union(b), "o_orderstatus.enum", "n.enum")


@query(counted("text.length", "text", "(length(text) < 20 OR length(text) > 2000)", "documents"))
def check_length(spark, sf_dir):
    return only(outcomes(spark, table(spark, sf_dir, "documents"), "  text: { type: string, checks: [{ length: { min: 20, max: 2000 } }] }"), "text.length")


@query(counted("v.not_empty_string", "v", "v = ''", "(SELECT CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN ' ' WHEN doc_id % 10 = 2 THEN NULL ELSE source END AS v FROM documents)"))
def check_not_empty_string(spark, sf_dir):
    frame = table(spark, sf_dir, "documents").select(F.expr("CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN ' ' WHEN doc_id % 10 = 2 THEN NULL ELSE source END").alias("v"))
    return only(outcomes(spark, frame, "  v: { type: string, checks: [not_empty_string] }"), "v.not_empty_string")


_CELLS = "CASE event_id % 13 WHEN 0 THEN ' 12 ' WHEN 1 THEN '+5' WHEN 2 THEN '1.0' WHEN 3 THEN '1e3' WHEN 4 THEN '9223372036854775808' WHEN 5 THEN 'yes' WHEN 6 THEN '0' WHEN 7 THEN 'NaN' WHEN 8 THEN '2026-02-30' WHEN 9 THEN '2026-7-9' WHEN 10 THEN '2026-07-09T10:11:12Z' WHEN 11 THEN '2026-07-09 10:11' ELSE NULL END"
_CELL_TABLE = f"(SELECT {_CELLS} AS v FROM events)"
_TYPE_BAD = {
    "int": "NOT (regexp_full_match(trim(v), '[+-]?[0-9]+') AND TRY_CAST(trim(v) AS BIGINT) IS NOT NULL)",
    "float": "NOT (regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL)",
    "bool": "lower(trim(v)) NOT IN ('true', 't', '1', 'yes', 'y', 'false', 'f', '0', 'no', 'n')",
    "date": "NOT (regexp_full_match(trim(v), '[+-]?[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}') AND TRY_CAST(trim(v) AS DATE) IS NOT NULL)",
    "datetime": "NOT (regexp_full_match(trim(v), '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?)?)?') AND TRY_CAST(substr(replace(trim(v), 'T', ' '), 1, 10) AS DATE) IS NOT NULL)",
}


@query(" UNION ALL ".join(counted(f"{k}.type", "v", bad, _CELL_TABLE) for k, bad in _TYPE_BAD.items()))
def check_type_text(spark, sf_dir):
    cell = F.expr(_CELLS)
    frame = table(spark, sf_dir, "events").select(*(cell.alias(k) for k in _TYPE_BAD))
    found = outcomes(spark, frame, "\n".join(f"  {k}: {{ type: {k} }}" for k in _TYPE_BAD), typed=False)
    return only(found, *(f"{k}.type" for k in _TYPE_BAD))


_NULL_TYPE = "SELECT '{}.type' AS check_id, CAST(NULL AS BIGINT) AS rows_evaluated, CAST(NULL AS BIGINT) AS rows_failed, TRUE AS failed"


@query(_NULL_TYPE.format("o_orderstatus") + " UNION ALL " + counted("o_totalprice.type", "o_totalprice", "FALSE", "orders"))
def check_type_structural(spark, sf_dir):
    found = outcomes(spark, table(spark, sf_dir, "orders"), "  o_orderstatus: { type: int }\n  o_totalprice: { type: float }")
    return only(found, "o_orderstatus.type", "o_totalprice.type")


def _unique_sql(check_id: str, column: str, source: str) -> str:
    return CHECK.format(id=check_id, n=f"COUNT({column})", bad=f"COUNT({column}) - COUNT(DISTINCT {column})", failed=f"COUNT({column}) > COUNT(DISTINCT {column})", table=source)


@query(" UNION ALL ".join(_unique_sql(f"{c}.unique", c, t) for c, t in (("p_name", "part"), ("text", "documents"), ("o_orderkey", "orders"))))
def check_unique(spark, sf_dir):
    found = [outcomes(spark, table(spark, sf_dir, t), f"  {c}: {{ type: {k}, checks: [unique] }}") for c, t, k in (("p_name", "part", "string"), ("text", "documents", "string"), ("o_orderkey", "orders", "int"))]
    return only(found[0].union(found[1]).union(found[2]), "p_name.unique", "text.unique", "o_orderkey.unique")


@query("SELECT p_partkey, p_name, occurrence FROM (SELECT p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS INTEGER) AS occurrence FROM part) WHERE occurrence > 1")
def check_unique_repeats(spark, sf_dir):
    return repeats_frame(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], ["p_partkey"]).select("p_partkey", "p_name", "occurrence")


@query("SELECT 'user_id.unique' AS check_id, COUNT(DISTINCT user_id) < floor(COUNT(user_id) * 0.98) AS failed FROM events UNION ALL SELECT 'o_orderkey.unique', COUNT(DISTINCT o_orderkey) < floor(COUNT(o_orderkey) * 0.98) FROM orders")
def check_unique_approx(spark, sf_dir):
    a = outcomes(spark, table(spark, sf_dir, "events"), "  user_id: { type: int, checks: [{ unique: { approx: true } }] }")
    b = outcomes(spark, table(spark, sf_dir, "orders"), "  o_orderkey: { type: int, checks: [{ unique: { approx: true } }] }")
    return only(a.union(b), "user_id.unique", "o_orderkey.unique").select("check_id", "failed")


_PROPS = "(SELECT NULLIF(event_type, 'click') AS e, user_id FROM events)"


@query(" UNION ALL ".join(CHECK.format(id=i, n="COUNT(*)", bad="COUNT(*) - COUNT(e)", failed=f"(COUNT(*) - COUNT(e)) / COUNT(*)::DOUBLE > {r}", table=_PROPS) for i, r in (("e.null_ratio_max", 0.5), ("dataset.null_ratio_max.e", 0.01))))
def check_null_ratio_max(spark, sf_dir):
    frame = table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("click")).alias("e"), "user_id")
    found = outcomes(spark, frame, "  e: { type: string, checks: [{ null_ratio_max: 0.5 }] }\n  user_id: { type: int }", "dataset_checks:\n  - null_ratio_max: { column: e, ratio: 0.01 }")
    return only(found, "e.null_ratio_max", "dataset.null_ratio_max.e")


@query(" UNION ALL ".join(CHECK.format(id=i, n="COUNT(user_id)", bad="NULL", failed=f"COUNT(DISTINCT user_id) / COUNT(user_id)::DOUBLE < {r}", table="events") for i, r in (("user_id.unique_ratio_min", 0.5), ("dataset.unique_ratio_min.user_id", 0.001))))
def check_unique_ratio_min(spark, sf_dir):
    found = outcomes(spark, table(spark, sf_dir, "events"), "  user_id: { type: int, checks: [{ unique_ratio_min: 0.5 }] }", "dataset_checks:\n  - unique_ratio_min: { column: user_id, ratio: 0.001 }")
    return only(found, "user_id.unique_ratio_min", "dataset.unique_ratio_min.user_id")


@query(whole("dataset.row_count_min", "COUNT(*) < 100", "nation") + " UNION ALL " + whole("dataset.row_count_max", "COUNT(*) > 100", "nation"))
def check_row_count(spark, sf_dir):
    return only(outcomes(spark, table(spark, sf_dir, "nation"), "  n_name: { type: string }", "dataset_checks:\n  - row_count_min: 100\n  - row_count_max: 100"), "dataset.row_count_min", "dataset.row_count_max")


@query("SELECT 'dataset.freshness.ts' AS check_id, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(MAX(ts)) > 24 * 3600 * 1000000::BIGINT AS failed, CAST(round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(MAX(ts))) / 3600000000.0, 6) AS DOUBLE) AS age_hours FROM events")
def check_freshness(spark, sf_dir):
    contract = parse_contract("apiVersion: v1\ndataset: t\ncolumns: { ts: { type: datetime } }\ndataset_checks: [{ freshness: { column: ts, max_age: 24h } }]")
    result = run_check(contract, table(spark, sf_dir, "events"), now=NOW, profile=False, sample_failures=0).to_frame(spark)
    return result.where("id = 'dataset.freshness.ts'").select(F.col("id").alias("check_id"), (F.col("status") == "failed").alias("failed"), F.get_json_object("observed", "$.age_hours").cast("double").alias("age_hours"))


def _key_sql(check_id: str, key: str, source: str) -> str:
    return f"SELECT '{check_id}' AS check_id, CAST(SUM(n) AS BIGINT) AS rows_evaluated, CAST(SUM(n - 1) AS BIGINT) AS rows_failed, SUM(n - 1) > 0 AS failed FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY {key})"


@query(_key_sql("lineitem", "l_orderkey, l_linenumber", "lineitem") + " UNION ALL " + _key_sql("conversations", "conv_id, turn", "conversations"))
def check_primary_key(spark, sf_dir):
    found = []
    for name, key in (("lineitem", ("l_orderkey", "l_linenumber")), ("conversations", ("conv_id", "turn"))):
        one = outcomes(spark, table(spark, sf_dir, name), "\n".join(f"  {k}: {{ type: int }}" for k in key), f"primary_key: [{', '.join(key)}]")
        found.append(only(one, "dataset.primary_key").withColumn("check_id", F.lit(name)))
    return found[0].union(found[1])


_ORPHAN = "SELECT 'dataset.references.{d}' AS check_id, COUNT(*) AS rows_evaluated, CAST(COALESCE(SUM(CASE WHEN NOT EXISTS (SELECT 1 FROM {t} WHERE {on}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS rows_failed, COALESCE(SUM(CASE WHEN NOT EXISTS (SELECT 1 FROM {t} WHERE {on}) THEN 1 ELSE 0 END), 0) > 0 AS failed FROM {source}"


@query(_ORPHAN.format(d="customers", t="(SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) c", on="c.c_custkey = o.o_custkey", source="orders o") + " UNION ALL " + _ORPHAN.format(d="orders", t="orders o", on="o.o_orderkey = l.l_orderkey", source="lineitem l"))
def check_references(spark, sf_dir):
    customers = collect_key_set(table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), ["c_custkey"])
    a = outcomes(spark, table(spark, sf_dir, "orders"), "  o_custkey: { type: int }", "dataset_checks: [{ references: { columns: [o_custkey], dataset: customers, to: [c_custkey] } }]", references={"customers": customers})
    keys = collect_key_set(table(spark, sf_dir, "orders"), ["o_orderkey"])
    b = outcomes(spark, table(spark, sf_dir, "lineitem"), "  l_orderkey: { type: int }", "dataset_checks: [{ references: { columns: [l_orderkey], dataset: orders, to: [o_orderkey] } }]", references={"orders": keys})
    return only(a.union(b), "dataset.references.customers", "dataset.references.orders")


_ASSERTS = ("SUM(l_quantity) > 0", "COUNT(DISTINCT l_suppkey) >= 1000000", "AVG(l_discount) BETWEEN 0.01 AND 0.09")


@query(" UNION ALL ".join(f"SELECT {i} AS n, NOT COALESCE({e}, FALSE) AS failed FROM lineitem" for i, e in enumerate(_ASSERTS)))
def check_assert(spark, sf_dir):
    contract = parse_contract("apiVersion: v1\ndataset: t\ncolumns: { l_quantity: { type: float }, l_suppkey: { type: int }, l_discount: { type: float } }\ndataset_checks:\n" + "".join(f'  - assert: "{e}"\n' for e in _ASSERTS))
    result = run_check(contract, table(spark, sf_dir, "lineitem"), now=NOW, profile=False, sample_failures=0)
    rows = [(i, c.status == "failed") for i, c in enumerate(c for c in result.checks if c.kind == "assert")]
    return spark.createDataFrame(rows, "n int, failed boolean")


@query(CHECK.format(id="dataset.custom_expr", n="COUNT(*)", bad="SUM(CASE WHEN COALESCE(NULLIF(l_discount, 0) <= l_tax * 2, TRUE) THEN 0 ELSE 1 END)", failed="SUM(CASE WHEN COALESCE(NULLIF(l_discount, 0) <= l_tax * 2, TRUE) THEN 0 ELSE 1 END) > 0", table="lineitem"))
def check_custom_expr(spark, sf_dir):
    found = outcomes(spark, table(spark, sf_dir, "lineitem"), "  l_tax: { type: float }", 'dataset_checks: [{ custom_expr: "NULLIF(l_discount, 0) <= l_tax * 2" }]')
    return only(found, "dataset.custom_expr")


def _first_bad(check_id: str, bad: str, value: str, key: str, source: str, n: int = 4) -> str:
    return f"(SELECT '{check_id}' AS check_id, \"row\", {value} AS \"value\" FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS \"row\" FROM {source}) WHERE {bad} ORDER BY \"row\" LIMIT {n})"


_REPEATS = "(SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS occurrence FROM part)"


@query(
    " UNION ALL ".join(
        [
            _first_bad("o_orderstatus.enum", "o_orderstatus NOT IN ('F', 'O')", "o_orderstatus", "o_orderkey", "orders"),
            _first_bad("o_orderpriority.regex", "NOT regexp_matches(o_orderpriority, '^[1-3]-')", "o_orderpriority", "o_orderkey", "orders"),
            _first_bad("o_custkey.max", "o_custkey > 100", "CAST(o_custkey AS VARCHAR)", "o_orderkey", "orders"),
            _first_bad("p_brand.unique", "occurrence > 1", "p_brand", "p_partkey", _REPEATS),
        ]
    )
)
def failure_samples(spark, sf_dir):
    """The first failing rows of each failed check, by their place in the file."""
    columns = "  o_orderstatus: { type: string, checks: [{ enum: [F, O] }] }\n  o_orderpriority: { type: string, checks: [{ regex: '^[1-3]-' }] }\n  o_custkey: { type: int, checks: [{ max: 100 }] }"
    rows = []
    for name, spec in (("orders", columns), ("part", "  p_brand: { type: string, checks: [unique] }")):
        contract = parse_contract(f"apiVersion: v1\ndataset: t\ncolumns:\n{spec}\n")
        result = run_check(contract, table(spark, sf_dir, name), now=NOW, sample_failures=4, profile=False)
        rows += [(c.id, s["row"], s["value"]) for c in result.checks for s in c.samples]
    return spark.createDataFrame(rows, "check_id string, row long, value string")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, chr(10), '"', c_mktsegment, '",', chr(10), chr(10), 'x') ELSE c_name END AS v, c_mktsegment AS w FROM customer""")
def read_csv_quoted(spark, sf_dir):
    """A delimited file with quoted line breaks, separators and quotes, written and read back as text."""
    where = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    text = F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '\\n\"', c_mktsegment, '\",\\n\\n', 'x') ELSE c_name END")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.alias("v"), F.col("c_mktsegment").alias("w")).write.options(header=True, quote='"', escape='"').csv(where)
    return open_source(spark, where, ReadOptions(format="csv")).frame


@query("SELECT 'dataset.columns' AS check_id, CAST(NULL AS BIGINT) AS rows_evaluated, CAST(NULL AS BIGINT) AS rows_failed, TRUE AS failed UNION ALL SELECT 'gone.present', NULL, NULL, TRUE")
def check_columns(spark, sf_dir):
    found = outcomes(spark, table(spark, sf_dir, "nation"), "  n_name: { type: string }\n  gone: { type: int }", "settings: { allow_extra_columns: false }")
    return only(found, "dataset.columns", "gone.present")


@query("SELECT k, CAST(CAST(concat('0x', substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) AS UBIGINT) AS VARCHAR) AS key_hash FROM (SELECT k, sha256(unhex(concat(printf('%02x', length(k)), '00000000000000')) || encode(k) || unhex('1f')) AS h FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders))")
def key_hashes(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(k.alias("k"), key_hash([k]).alias("key_hash"))


@query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS k0, c_mktsegment AS k1 FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL")
def key_set(spark, sf_dir):
    return collect_key_set(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]).keys


def _profile_sql(columns: dict[str, bool], source: str) -> str:
    one = []
    for c, numeric in columns.items():
        text = f"CAST({c} AS VARCHAR)"
        mean, std = (f"CAST(round(AVG({c}), 6) AS DOUBLE)", f"CAST(round(STDDEV_SAMP({c}), 6) AS DOUBLE)") if numeric else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
        one.append(f"SELECT '{c}' AS name, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS n_distinct, {'NULL' if numeric else f'MIN({text})'} AS first_text, {'NULL' if numeric else f'MAX({text})'} AS last_text, {mean} AS mean, {std} AS std FROM {source}")
    return " UNION ALL ".join(one)


def _profile(spark, sf_dir, name: str, columns: dict[str, bool]) -> DataFrame:
    found = profile_frame(table(spark, sf_dir, name).select(*columns), typed=True)
    rows = [(p.name, p.null_count, p.distinct, None if columns[p.name] else p.min, None if columns[p.name] else p.max, p.mean, p.std) for p in found]
    out = spark.createDataFrame(rows, "name string, null_count long, n_distinct long, first_text string, last_text string, mean double, std double")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_PROFILES = {
    "orders": {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderpriority": False},
    "events": {"event_id": True, "user_id": True, "event_type": False, "value": True, "props": False},
    "customer": {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False},
}


@query(_profile_sql(_PROFILES["orders"], "orders"))
def profile_orders(spark, sf_dir):
    return _profile(spark, sf_dir, "orders", _PROFILES["orders"])


@query(_profile_sql(_PROFILES["events"], "events"))
def profile_events(spark, sf_dir):
    return _profile(spark, sf_dir, "events", _PROFILES["events"])


@query(_profile_sql(_PROFILES["customer"], "customer"))
def profile_customer(spark, sf_dir):
    return _profile(spark, sf_dir, "customer", _PROFILES["customer"])


@query("SELECT * FROM (VALUES ('event_id', 'int'), ('ts', 'datetime'), ('user_id', 'int'), ('event_type', 'string'), ('value', 'float'), ('day', 'date'), ('even', 'bool')) AS t(name, inferred)")
def infer_types(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = e.select(*(F.col(c).cast("string").alias(c) for c in ("event_id", "ts", "user_id", "event_type", "value")), F.to_date("ts").cast("string").alias("day"), (F.col("event_id") % 2 == 0).cast("string").alias("even"))
    return spark.createDataFrame([(p.name, p.inferred_type) for p in profile_frame(text, typed=False)], "name string, inferred string")


@query("SELECT DISTINCT 'event_type' AS name, event_type AS v FROM events UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def value_sets(spark, sf_dir):
    found = [(p.name, v) for t, c in (("events", "event_type"), ("orders", "o_orderpriority")) for p in profile_frame(table(spark, sf_dir, t).select(c), typed=True) for v in p.values]
    return spark.createDataFrame(found, "name string, v string")


ORDERS_CONTRACT = """\
  o_orderkey: { type: int, required: true, checks: [unique, { min: 0 }] }
  o_custkey: { type: int, required: true }
  o_orderstatus: { type: string, required: true, checks: [{ enum: [F, O] }, { length: 1 }] }
  o_totalprice: { type: float, checks: [{ min: 0 }, { max: 400000 }] }
  o_orderpriority: { type: string, checks: [{ regex: '^[1-5]-' }, not_empty_string] }
"""


def _all(column: str, *extra: str) -> list[str]:
    return [counted(f"{column}.type", column, "FALSE", "orders"), *extra]


_REQUIRED = lambda c: CHECK.format(id=f"{c}.required", n="COUNT(*)", bad=f"COUNT(*) - COUNT({c})", failed=f"COUNT(*) > COUNT({c})", table="orders")


@query(
    " UNION ALL ".join(
        [
            *_all("o_orderkey", _REQUIRED("o_orderkey"), _unique_sql("o_orderkey.unique", "o_orderkey", "orders"), counted("o_orderkey.min", "o_orderkey", "o_orderkey < 0", "orders")),
            *_all("o_custkey", _REQUIRED("o_custkey")),
            *_all("o_orderstatus", _REQUIRED("o_orderstatus"), counted("o_orderstatus.enum", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')", "orders"), counted("o_orderstatus.length", "o_orderstatus", "length(o_orderstatus) <> 1", "orders")),
            *_all("o_totalprice", counted("o_totalprice.min", "o_totalprice", "o_totalprice < 0", "orders"), counted("o_totalprice.max", "o_totalprice", "o_totalprice > 400000", "orders")),
            *_all("o_orderpriority", counted("o_orderpriority.regex", "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[1-5]-')", "orders"), counted("o_orderpriority.not_empty_string", "o_orderpriority", "o_orderpriority = ''", "orders")),
            whole("dataset.row_count_min", "COUNT(*) < 1", "orders"),
            _key_sql("dataset.primary_key", "o_orderkey", "orders"),
            "SELECT 'dataset.columns' AS check_id, CAST(NULL AS BIGINT) AS rows_evaluated, CAST(NULL AS BIGINT) AS rows_failed, FALSE AS failed",
        ]
    )
)
def contract_check_orders(spark, sf_dir):
    return outcomes(spark, table(spark, sf_dir, "orders"), ORDERS_CONTRACT, "primary_key: [o_orderkey]\ndataset_checks: [{ row_count_min: 1 }]")


@query("SELECT 'embedding' AS name, 'array' AS kind")
def nested_column_error(spark, sf_dir):
    try:
        outcomes(spark, table(spark, sf_dir, "embeddings"), "  embedding: { type: string }")
    except NestedColumnError as e:
        return spark.createDataFrame([(e.column, e.kind)], "name string, kind string")
    raise AssertionError("the nested column was accepted")
