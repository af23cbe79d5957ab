"""Registered queries against their SQL in DuckDB, plans, streams, and life without the llm folders."""

import datetime
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).resolve().parent
SQL = entry.oracle_sql()
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("op")])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_asked_for(spark):
    p = plan(entry.queries()["facet_language"](spark, SF))
    assert "ReadSchema: struct<lang:string>" in p
    p = plan(entry.queries()["keyset_page"](spark, SF))
    assert "PushedFilters" in p and "o_orderdate" in p and "TakeOrderedAndProject" in p


def test_no_query_has_a_cartesian_product(spark):
    for name in ("endpoint_match", "knowledge_conflicts", "overlap_pairs", "resolve_names", "snapshot_diff", "undocumented"):
        assert "CartesianProduct" not in plan(entry.queries()[name](spark, SF))


def test_native_queries_stay_in_the_jvm(spark):
    for name in ("bm25_search", "usage_rollups", "http_keys", "secret_tokens", "path_classes"):
        p = plan(entry.queries()[name](spark, SF))
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


@pytest.fixture(scope="module")
def many_of_a_source(spark, tmp_path_factory):
    """450 documents of one source and 3 of another, with copies; 220 of the first are larger than any budget."""
    d = tmp_path_factory.mktemp("many")
    rows = [(i, "w " * (9000 + i if i < 220 else 1 + (i * 37) % 400), "a") for i in range(450)] + [(900 + i, "z" * (9 + i), "b") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_pack_budget_sees_every_row_of_a_source(spark, many_of_a_source):
    from tessera.functions import text as X

    docs = spark.read.parquet(f"{many_of_a_source}/documents.parquet").select("doc_id", "source", X.estimate("text").alias("cost")).collect()
    want, left, rank = set(), {}, Counter()
    for r in sorted(docs, key=lambda r: (-r["cost"], r["doc_id"])):
        rank[r["source"]] += 1
        if r["cost"] <= left.setdefault(r["source"], 4000):
            left[r["source"]] -= r["cost"]
            want.add((r["source"], r["doc_id"], r["cost"], rank[r["source"]]))
    got = [(r["source"], r["doc_id"], r["cost"], r["rank"]) for r in entry.queries()["pack_budget"](spark, many_of_a_source).collect()]
    assert len(got) == len(want) and set(got) == want and max(r for *_, r in want) > 200


def test_context_pack_gives_every_row_a_state(spark, many_of_a_source):
    from tessera.functions import text as X
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{many_of_a_source}/documents.parquet").select("doc_id", "source", "text", X.estimate("text").alias("body"), X.estimate(F.substring("text", 1, 80)).alias("skeleton")).collect()
    want = {}
    for s in ("a", "b"):
        left, seen, mine = 4000, set(), sorted((r for r in docs if r["source"] == s), key=lambda r: r["doc_id"])
        for r in mine:
            state = "stale" if r["doc_id"] % 11 == 0 else "duplicate" if r["text"] in seen else "skeleton" if r["skeleton"] <= left else "over_budget"
            if state == "skeleton":
                seen.add(r["text"])
                left -= r["skeleton"]
            want[r["doc_id"]] = state
        for r in mine:
            if want[r["doc_id"]] == "skeleton" and r["body"] - r["skeleton"] <= left:
                left -= r["body"] - r["skeleton"]
                want[r["doc_id"]] = "body"
    got = entry.queries()["context_pack"](spark, many_of_a_source).collect()
    assert len(got) == len(want) == 453 and {r["id"]: r["packed"] for r in got} == want
    assert {"stale", "over_budget", "skeleton", "body"} <= set(want.values())


def test_late_batches_do_not_move_a_view_back(spark):
    from tessera import streaming as ST

    df = lambda *rows: spark.createDataFrame(list(rows), "view_id string, generation long, payload string")
    state = ST.fenced(df(("v", 5, "new")), df(("v", 4, "late"), ("w", 1, "first")))
    assert {tuple(r) for r in state.collect()} == {("v", 5, "new"), ("w", 1, "first")}


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for x in ("tessera", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    shutil.rmtree(tmp_path / "tessera/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
