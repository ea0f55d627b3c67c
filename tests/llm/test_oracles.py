"""The SQL of the training-data queries against their operators, on planted tables and the smallest ones."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

from tablewarden.llm import quality, shared, url_filters
from tablewarden.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

DATA = Path("/root/testdata/sf0.001")


def shape(rows):
    return sorted(tuple("" if v is None else f"{float(v):.9g}" if isinstance(v, bool | int | float) else str(v) for v in r) for r in rows)


def same(frame, con, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert shape(frame.select(*names).collect()) == shape(want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="the synthetic tables are not here")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    same(QUERIES[name](spark, str(DATA)), con, ORACLE_SQL[name])


@pytest.mark.parametrize("size", [8 << 20, 0])
def test_links_between_hosts(spark, size, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", size)
    r = random.Random(3)
    hosts = [f"h{i}.{x}" for i in range(12) for x in ("example.com", "org", "net", "info")]
    rows = []
    for i in range(300):
        links = "".join(f'<a {r.choice(("href=", "HREF = "))}{q}{r.choice(("http:", ""))}//{r.choice(hosts).upper() if r.random() < 0.2 else r.choice(hosts)}/x{q}>' for q in r.choices(('"', "'", ""), k=r.randint(0, 6)))
        rows.append((i, f"https://{r.choice(hosts)}/{r.choice(('en', 'de', 'es', 'fr'))}/{r.randint(1, 99)}" if i % 50 else None, links if i % 7 else None))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = url_filters.judge_urls(pages, URL_RULES)
    same(got, con, ORACLE_SQL["op6_url_filters"])
    assert got.where("rule is null and verdict = 'block'").count() > 0


@pytest.mark.parametrize("size", [8 << 20, 0])
def test_hosts_far_above_the_fitted_prior(spark, size, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", size)
    r = random.Random(4)
    good = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(30))
    rows = []
    for h in range(40):
        share = 0.4 if h == 7 else 0.1
        rows += [(len(rows) + i, "bad" if r.random() < share else good(), f"h{h}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = quality.judge_documents(docs)
    same(got, con, ORACLE_SQL["op7_quality_rules"])
    lost = {rows[x.doc_id][2] for x in got.where("not base_failed and not kept").collect()}
    assert lost == {"h7"}
