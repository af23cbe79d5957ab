"""Catalogue and report queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reports as R
from tessera.session import table


def top_languages(spark: SparkSession, d: str) -> DataFrame:
    return R.top_languages(table(spark, d, "documents").select(F.col("source").alias("project"), F.col("lang").alias("language")), 2)


def switch_estimate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    return R.switch_estimate(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("hash")), dims=768, usd_per_million=0.02)


def rank_and_limit(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("location"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_extendedprice").cast("double").alias("score"))
    return R.rank_and_limit(li, 3, 100)


def find_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("symbol"), F.col("p_partkey").alias("path"))
    return R.find_symbols(p, "widget", 40)


def insights(spark: SparkSession, d: str) -> DataFrame:
    """Contracts are pairs of part and supplier; return flags and line states make their edges."""
    kinds = F.array(*map(F.lit, ("endpoint", "topic", "table", "i18n", "env")))
    edges = F.array(*map(F.lit, ("exposes", "consumes", "produces", "defines", "reads", "writes", "references")))
    e = table(spark, d, "lineitem").select(F.element_at(kinds, (F.col("l_partkey") % 5 + 1).cast("int")).alias("contract_kind"), F.concat_ws(":", "l_partkey", F.col("l_suppkey") % 20).alias("key"), F.element_at(edges, (F.col("l_orderkey") % 7 + 1).cast("int")).alias("kind"))
    return R.insights(e).groupBy("code", "severity").agg(F.count("*").alias("n"))


def view_groups(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share a nation and a band of balance, or a band of keys, work on one task."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("view"), F.concat_ws("/", "s_nationkey", F.floor(F.col("s_acctbal") / 500)).alias("slug"), F.when(F.col("s_suppkey") % 3 == 0, F.floor(F.col("s_suppkey") / 6)).alias("branch"))
    return R.groups(s, "slug", "branch")


def inspect_links(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("facet"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start"), (F.col("l_linestatus") == "F").alias("is_import"), (F.col("l_quantity").cast("int") % 4).alias("ev"), (F.col("l_orderkey") % 2).alias("res"))
    return R.inspect_links(li, 5)


QUERIES = {f.__name__: f for f in (top_languages, switch_estimate, rank_and_limit, find_symbols, insights, view_groups, inspect_links)}

_INSIGHTS = "\nUNION ALL ".join(
    f"SELECT '{code}' AS code, '{sev}' AS severity FROM g WHERE ck = '{k}' AND list_has_any(ks, {list(there)}) AND NOT list_has_any(ks, {list(lacks)})" for code, (k, there, lacks, sev) in R.INSIGHTS.items())
SQL = {
    "top_languages": "SELECT * FROM (SELECT source AS project, lang AS language, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rank FROM documents WHERE lang IS NOT NULL AND lang <> 'text' GROUP BY 1, 2) WHERE rank <= 2",
    "switch_estimate": "SELECT count(*) AS chunks, coalesce(sum(ceil(strlen(coalesce(text, '')) / 4)), 0)::bigint AS tokens, round(coalesce(sum(ceil(strlen(coalesce(text, '')) / 4)), 0) * 0.02 / 1e6, 6) AS usd, count(*) * 1536 AS disk_bytes FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "rank_and_limit": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY project, location ORDER BY score DESC, id) AS k FROM (SELECT l_suppkey AS project, l_partkey AS location, l_orderkey || '-' || l_linenumber AS id, l_extendedprice::double AS score FROM lineitem)),
q AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, location, id) AS q FROM b WHERE k = 1) SELECT project, location, id, score, row_number() OVER (ORDER BY score DESC, location, id) AS rank FROM q WHERE q <= 3 ORDER BY score DESC, location, id LIMIT 100""",
    "find_symbols": "WITH s AS (SELECT replace(p_name, ' ', '.') AS symbol, p_partkey AS path FROM part) SELECT * FROM (SELECT *, CASE WHEN symbol = 'widget' THEN 0 WHEN string_split(symbol, '.')[-1] = 'widget' THEN 1 WHEN ends_with(symbol, '.widget') THEN 2 END AS how FROM s) WHERE how IS NOT NULL ORDER BY how, symbol, path LIMIT 40",
    "insights": f"""WITH g AS (SELECT ['endpoint', 'topic', 'table', 'i18n', 'env'][l_partkey % 5 + 1] AS ck, l_partkey || ':' || (l_suppkey % 20) AS key, list(DISTINCT ['exposes', 'consumes', 'produces', 'defines', 'reads', 'writes', 'references'][l_orderkey % 7 + 1]) AS ks FROM lineitem GROUP BY 1, 2),
i AS ({_INSIGHTS}) SELECT code, severity, count(*) AS n FROM i GROUP BY 1, 2""",
    "view_groups": """WITH RECURSIVE s AS (SELECT s_suppkey AS v, s_nationkey || '/' || floor(s_acctbal / 500)::bigint AS a, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey // 6 END AS b FROM supplier),
l AS (SELECT x.v AS x, y.v AS y FROM s x JOIN s y ON x.a = y.a UNION SELECT x.v, y.v FROM s x JOIN s y ON x.b = y.b), r(v, c) AS (SELECT v, v FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v) SELECT v AS view, min(c) AS component FROM r GROUP BY 1""",
    "inspect_links": """WITH l AS (SELECT l_suppkey AS symbol, l_returnflag AS facet, l_partkey AS path, l_linenumber AS start, l_linestatus = 'F' AS imp, l_quantity::int % 4 AS ev, l_orderkey % 2 AS res FROM lineitem),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, facet, path, start, imp ORDER BY ev, res) AS k FROM l) WHERE k = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol, facet ORDER BY ev, res, path, start) AS rank, greatest(count(*) OVER (PARTITION BY symbol, facet) - 5, 0) AS omitted FROM o) SELECT symbol, facet, path, start, rank, omitted FROM f WHERE rank <= 5""",
}
