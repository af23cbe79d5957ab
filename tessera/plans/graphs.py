"""Versioned-table and graph queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import versioned as V
from tessera.session import table


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versioned files: a customer's orders of one priority are the versions of a path."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("view_id"), F.concat_ws("/", F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)).alias("path"),
                                         F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("valid_from"), "o_orderkey")
    o = o.groupBy("view_id", "path", "valid_from").agg((F.max("o_orderkey") % 50).cast("string").alias("content_hash"))
    return o.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("view_id", "path").orderBy("valid_from"))).select("view_id", "path", "valid_from", "valid_to", "content_hash")


_V = """v0 AS (SELECT o_custkey % 10 AS view_id, o_custkey || '/' || o_orderpriority[1] AS path, date_diff('day', DATE '1995-01-01', o_orderdate::date) AS valid_from, (max(o_orderkey) % 50)::varchar AS content_hash FROM orders GROUP BY 1, 2, 3),
v AS (SELECT view_id, path, valid_from, lead(valid_from) OVER (PARTITION BY view_id, path ORDER BY valid_from) AS valid_to, content_hash FROM v0)"""
_AT = "SELECT view_id, path, content_hash FROM v WHERE valid_from <= {g} AND (valid_to IS NULL OR valid_to > {g})"


def _pins(spark: SparkSession, g: int) -> DataFrame:
    return spark.range(10).select(F.col("id").alias("view_id"), F.lit(g).cast("long").alias("generation"))


def as_of_files(spark: SparkSession, d: str) -> DataFrame:
    return V.as_of(versions(spark, d), _pins(spark, 1000)).select("view_id", "path", "content_hash")


def files_page(spark: SparkSession, d: str) -> DataFrame:
    return V.page_at(V.as_of(versions(spark, d), _pins(spark, 1000)), "3", 200).select("path", "content_hash")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d).where("path LIKE '%/1' OR path LIKE '%/2'")
    old = V.as_of(v.where("path LIKE '%/1' OR valid_from < 900"), _pins(spark, 1000))
    new = V.as_of(v.where("path LIKE '%/2' OR valid_from > 500"), _pins(spark, 1200))
    return V.diff(old, new, "view_id", "path")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


_DIFF = _V + """, o AS (SELECT * FROM ({o}) WHERE 1 = 1), n AS (SELECT * FROM ({n}) WHERE 1 = 1),
c AS (SELECT * FROM (SELECT coalesce(o.view_id, n.view_id) AS view_id, coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'delete' WHEN o.path IS NULL OR o.content_hash <> n.content_hash THEN 'upsert' END AS op,
  o.content_hash AS old_hash, n.content_hash AS content_hash FROM o FULL JOIN n ON o.view_id = n.view_id AND o.path = n.path) WHERE op IS NOT NULL)""".format(
    o=_AT.format(g=1000) + " AND (path LIKE '%/1' OR (path LIKE '%/2' AND valid_from < 900))", n=_AT.format(g=1200) + " AND (path LIKE '%/2' OR (path LIKE '%/1' AND valid_from > 500))")


def rename_detect(spark: SparkSession, d: str) -> DataFrame:
    return V.renames(_changes(spark, d), "view_id").select("view_id", "path", "op", "renamed_from")


def apply_interval_changes(spark: SparkSession, d: str) -> DataFrame:
    """Open and closed rows of each view after the changes are applied, twice as a retry does."""
    v = versions(spark, d).where("valid_from < 1000").withColumn("valid_to", F.when(F.col("valid_to") < 1000, F.col("valid_to")))
    c = _changes(spark, d)
    once = V.apply_changes(v, c, 1200)
    twice = V.apply_changes(once, c, 1200)
    return twice.groupBy("view_id").agg(F.count("*").alias("n"), F.sum(F.col("valid_to").isNull().cast("long")).alias("n_open"), F.sum((F.col("valid_to") == 1200).cast("long")).alias("n_closed"))


def prune_intervals(spark: SparkSession, d: str) -> DataFrame:
    cut = spark.range(10).select(F.col("id").alias("view_id"), (F.col("id") * 100 + 500).alias("keep_from"), F.lit(1400).cast("long").alias("active"), F.when(F.col("id") % 2 == 0, F.lit(700).cast("long")).alias("oldest_pin"))
    return V.prune(versions(spark, d), cut).groupBy("view_id").agg(F.count("*").alias("n"), F.min("valid_to").alias("first_end"))


def activate_generation(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "nation").select(F.concat(F.lit("v"), F.col("n_regionkey")).alias("view_id"), F.col("n_nationkey").cast("long").alias("generation"),
                                         F.when(F.col("n_nationkey") < 5, "active").when(F.col("n_nationkey") < 20, "retired").otherwise("building").alias("state"))
    return V.activate(V.activate(g, "v1", 21), "v2", 12)


def overlay_shadow(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("path"), "p_partkey")
    base, over = p.where("p_partkey % 7 <> 0"), p.where("p_partkey % 7 = 0")
    declared = p.where("p_partkey % 97 = 0")
    return V.shadow(base, over, declared).groupBy("project", "layer").agg(F.count("*").alias("n"))


def co_change(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("h", F.date_trunc("hour", "ts"))
    return V.co_changes(e, group="h", item="user_id", least=3)


def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("seq"))
    levels = V.tree_levels(docs)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents with a vector, by source; 1 where there is nothing to embed."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    g = docs.join(e, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("has").alias("n_embedded"))
    return g.withColumn("coverage", F.round(F.when(F.col("n") == 0, 1.0).otherwise(F.col("n_embedded") / F.col("n")), 6))


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    docs, e = table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings")
    return docs.join(e, docs.doc_id == e.vec_id, "left_anti")


def symbol_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    s = p.select(F.concat_ws(".", "p_brand", "p_name").alias("symbol"), "p_partkey").groupBy("symbol").agg(F.min("p_partkey").alias("k"))
    b = s.select(F.regexp_replace("symbol", "\\.[^.]*$", "").alias("symbol"), "k").groupBy("symbol").agg(F.max("k").alias("k"))
    b = b.where("symbol <> 'Brand#1'")
    s = s.unionByName(b)
    old = s.where("k % 3 <> 0").select("symbol", (F.col("k") % 5).alias("hash"))
    new = s.where("k % 4 <> 0").select("symbol", F.when(F.col("k") % 2 == 0, F.col("k") % 5).otherwise(-1).alias("hash"))
    return V.symbol_diff(old, new)


def file_history(spark: SparkSession, d: str) -> DataFrame:
    """Chains over nations: each was renamed from the one seven below."""
    n = table(spark, d, "nation").select("n_nationkey")
    e = n.where("n_nationkey >= 7").select(F.concat(F.lit("f"), "n_nationkey").alias("path"), F.concat(F.lit("f"), F.col("n_nationkey") - 7).alias("renamed_from"))
    return V.history(e, n.where("n_nationkey > 17").select(F.concat(F.lit("f"), "n_nationkey").alias("path")))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers place orders, orders hold parts, parts come from suppliers, suppliers live in nations."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders")
    s = table(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def edge(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str, ev, res) -> DataFrame:  # one projection, so that a semi join on an end goes below it
        return df.select(name(*a).alias("src"), name(*b).alias("dst"), F.lit(kind).alias("kind"), ev.alias("ev"), res.alias("res"), F.concat_ws(">", name(*a), name(*b)).alias("id"))

    ev = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    e = edge(o, ("c", "o_custkey"), ("o", "o_orderkey"), "calls", F.lit(0), F.lit(0))
    e = e.unionByName(edge(li.groupBy("l_orderkey", "l_partkey").agg(F.min(ev).alias("ev")), ("o", "l_orderkey"), ("p", "l_partkey"), "reads", F.col("ev"), F.lit(0)))
    e = e.unionByName(edge(li.groupBy("l_partkey", "l_suppkey").agg(F.min(ev).alias("ev"), F.min((F.col("l_quantity") > 45).cast("int")).alias("res")), ("p", "l_partkey"), ("s", "l_suppkey"), "exposes", F.col("ev"), F.col("res")))
    return e.unionByName(edge(s, ("s", "s_suppkey"), ("n", "s_nationkey"), "tests", F.lit(2), F.lit(0)))


_E = """li AS (SELECT * FROM lineitem), ev AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 3 END AS ev FROM li),
e0 AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'calls' AS kind, 0 AS ev, 0 AS res FROM orders
 UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'reads', min(ev), 0 FROM ev GROUP BY l_orderkey, l_partkey
 UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'exposes', min(ev), min((l_quantity > 45)::int) FROM ev GROUP BY l_partkey, l_suppkey
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'tests', 2, 0 FROM supplier),
e AS (SELECT *, src || '>' || dst AS id FROM e0)"""


def _start(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def graph_walk(spark: SparkSession, d: str) -> DataFrame:
    return G.walk_edges(graph_edges(spark, d), _start(spark, "c899", "c769"), 3)


def graph_walk_both(spark: SparkSession, d: str) -> DataFrame:
    return G.walk_edges(graph_edges(spark, d).where("kind <> 'tests'"), _start(spark, "o7"), 3, direction="both")


_WALK = "WITH RECURSIVE {e}, st AS ({st}), w(id, cur, depth, path) AS (SELECT st.id, st.dst, 1, [st.src, st.dst] FROM st WHERE st.src IN ({start}) UNION ALL SELECT st.id, st.dst, depth + 1, list_append(path, st.dst) FROM w JOIN st ON st.src = w.cur WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY id"


def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    return G.bfs(e.select("src", "dst"), _start(spark, "c899"), 4)


def fan_out_round_robin(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat("kind", F.col("ev").cast("string")).alias("kind"), "id")
    return G.round_robin(e, F.asc("id")).where("position <= 10").select("src", "id", "kind", "position")


def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    i = G.impact(graph_edges(spark, d).where("kind <> 'tests'"), _start(spark, "s3"), 3)
    return i.select("node", "weakest", "flagged", "hops", G.risk().alias("risk"))


def impact_projects(spark: SparkSession, d: str) -> DataFrame:
    i = impact_risk(spark, d)
    nodes = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderpriority").alias("project"))
    return G.impact_by_project(i, nodes)


def flow_paths(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    f = G.flow(e, _start(spark, "c899"), e.where("src LIKE 's%'").select(F.col("dst").alias("node")).distinct(), 4, 10)
    return f.select(F.concat_ws(" ", "path").alias("path"), "weakest", "flagged", "hops")


def insight_orphan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return G.unused(p, table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_linenumber = 1").select(F.col("l_partkey").alias("key")))


def insight_drift(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    prov = li.where("l_linenumber = 1").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("schema_hash"))
    cons = li.where("l_linenumber = 2").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("consumer"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("schema_hash"))
    return G.drift(prov, cons).select("key", "consumer", F.concat_ws(",", "provided").alias("provided"), "used")


def missing_locale(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").select(F.lit("all").alias("project"), F.concat_ws("/", "source", (F.col("doc_id") % 250).cast("string")).alias("key"), F.col("lang").alias("locale"))
    return G.missing_locales(k).select("key", F.concat_ws(",", "missing").alias("missing"))


def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    e = li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("reads").alias("kind"), F.when(F.col("l_returnflag") == "A", 0).otherwise(3).alias("ev"), (F.col("l_quantity") > 45).cast("int").alias("res"), F.col("l_orderkey").cast("string").alias("evidence"))
    return G.merge_edges(e).select("src", "dst", "ev", "res", F.concat_ws(",", "evidence").alias("evidence"))


def contract_parties(spark: SparkSession, d: str) -> DataFrame:
    c = versions(spark, d).select("view_id", F.substring_index("path", "/", -1).alias("kind"), F.col("content_hash").alias("key"), F.when(F.col("valid_from") % 2 == 0, "producer").otherwise("consumer").alias("role"), F.substring_index("path", "/", 1).alias("party"), "valid_from", "valid_to")
    p = G.parties(c, _pins(spark, 1500))
    return p.select("kind", "key", F.concat_ws(",", "producers").alias("producers"), F.concat_ws(",", "consumers").alias("consumers"))


def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.concat_ws("/", "l_shipdate", "l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("o"))
    return G.module_rollup(li.select(F.col("src"), F.col("dst"), "m", "o"), F.col("m"), F.col("o"))


QUERIES = {f.__name__: f for f in (
    as_of_files, files_page, snapshot_diff, rename_detect, apply_interval_changes, prune_intervals, activate_generation, overlay_shadow, co_change, merkle_root, embedding_coverage, missing_embeddings, symbol_changes,
    file_history, graph_walk, graph_walk_both, graph_bfs, fan_out_round_robin, impact_risk, impact_projects, flow_paths, insight_orphan, insight_drift, missing_locale, edge_merge, contract_parties, module_rollup)}

_STEP = """x{k} AS (SELECT node, k FROM b{j} UNION ALL SELECT to_, struct_pack(weakest := greatest(k.weakest, ev), flagged := k.flagged + (ev >= 3 OR res > 0)::int, hops := k.hops + 1, via := list_append(k.via, id), max_res := greatest(k.max_res, res), provided := fwd) FROM b{j} JOIN st ON cur = node AND NOT (k.provided AND kind = 'exposes' AND NOT fwd)),
b{k} AS (SELECT node, min(k) AS k FROM x{k} GROUP BY node)"""
_IMPACT = f"""WITH {_E}, st AS (SELECT dst AS cur, src AS to_, ev, res, id, kind, false AS fwd FROM e WHERE kind <> 'tests' UNION ALL SELECT src, dst, ev, res, id, kind, true FROM e WHERE kind = 'exposes'),
b0 AS (SELECT 's3' AS node, struct_pack(weakest := 0, flagged := 0, hops := 0, via := []::varchar[], max_res := 0, provided := false) AS k), {", ".join(_STEP.format(k=k, j=k - 1) for k in (1, 2, 3))},
i AS (SELECT node, k.weakest AS weakest, k.flagged AS flagged, k.hops AS hops, CASE WHEN k.max_res = 2 THEN 'unknown' WHEN k.max_res = 1 OR k.weakest >= 3 THEN 'low' WHEN k.weakest = 2 OR k.hops > 2 THEN 'medium' ELSE 'high' END AS risk FROM b3 WHERE k.hops > 0)"""

_LEVEL = "SELECT path[:greatest(length(path) - length(name) - 1, 0)] AS path, sha256(string_agg(entry, '|' ORDER BY entry)) AS hash FROM (SELECT path, string_split(path, '/')[-1] AS name, concat_ws(':', kind, length(string_split(path, '/')[-1]), string_split(path, '/')[-1], hash) AS entry FROM ({of})) GROUP BY 1"
SQL = {
    "as_of_files": f"WITH {_V} {_AT.format(g=1000)}",
    "files_page": f"WITH {_V} SELECT path, content_hash FROM ({_AT.format(g=1000)}) WHERE path > '3' ORDER BY path LIMIT 200",
    "snapshot_diff": f"WITH {_DIFF} SELECT * FROM c",
    "rename_detect": f"WITH {_DIFF}, g AS (SELECT *, row_number() OVER (PARTITION BY view_id, old_hash ORDER BY path) AS k FROM c WHERE op = 'delete'), u AS (SELECT *, row_number() OVER (PARTITION BY view_id, content_hash ORDER BY path) AS k FROM c WHERE op = 'upsert' AND old_hash IS NULL) SELECT c.view_id, c.path, c.op, g.path AS renamed_from FROM c LEFT JOIN u ON c.view_id = u.view_id AND c.path = u.path AND c.op = 'upsert' LEFT JOIN g ON g.view_id = u.view_id AND g.old_hash = u.content_hash AND g.k = u.k",
    "apply_interval_changes": f"""WITH {_DIFF}, b AS (SELECT view_id, path, valid_from, CASE WHEN valid_to < 1000 THEN valid_to END AS valid_to FROM v WHERE valid_from < 1000),
t AS (SELECT view_id, path, valid_from, CASE WHEN valid_to IS NULL AND EXISTS (SELECT 1 FROM c WHERE c.view_id = b.view_id AND c.path = b.path) THEN 1200 ELSE valid_to END AS valid_to FROM b UNION ALL SELECT view_id, path, 1200, NULL FROM c WHERE op = 'upsert')
SELECT view_id, count(*) AS n, sum((valid_to IS NULL)::int)::bigint AS n_open, sum((valid_to = 1200)::int)::bigint AS n_closed FROM t GROUP BY 1""",
    "prune_intervals": f"WITH {_V} SELECT view_id, count(*) AS n, min(valid_to) AS first_end FROM v WHERE valid_to IS NULL OR valid_to > least(view_id * 100 + 500, 1400, CASE WHEN view_id % 2 = 0 THEN 700 ELSE 9999 END) GROUP BY 1",
    "activate_generation": "SELECT 'v' || n_regionkey AS view_id, n_nationkey::bigint AS generation, CASE WHEN n_regionkey = 1 AND n_nationkey = 21 THEN 'active' WHEN n_regionkey = 1 AND n_nationkey < 5 THEN 'retired' WHEN n_nationkey < 5 THEN 'active' WHEN n_nationkey < 20 THEN 'retired' ELSE 'building' END AS state FROM nation",
    "overlay_shadow": "WITH p AS (SELECT p_brand AS project, p_name AS path, p_partkey AS k FROM part) SELECT project, 'base' AS layer, count(*) AS n FROM p WHERE k % 7 <> 0 AND (project, path) NOT IN (SELECT (project, path) FROM p WHERE k % 7 = 0 OR k % 97 = 0) GROUP BY 1 UNION ALL SELECT project, 'overlay', count(*) FROM p WHERE k % 7 = 0 GROUP BY 1",
    "co_change": "WITH c AS (SELECT DISTINCT date_trunc('hour', ts) AS h, user_id AS u FROM events) SELECT x.u AS a, y.u AS b, count(*) AS n FROM c x JOIN c y ON x.h = y.h AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 3",
    "embedding_coverage": "SELECT source, count(*) AS n, count(vec_id) AS n_embedded, round(count(vec_id) / count(*), 6) AS coverage FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "symbol_changes": """WITH s0 AS (SELECT p_brand || '.' || p_name AS symbol, min(p_partkey) AS k FROM part GROUP BY 1), s AS (SELECT * FROM s0 UNION ALL SELECT regexp_replace(symbol, '\\.[^.]*$', '') AS b, max(k) FROM s0 GROUP BY 1 HAVING b <> 'Brand#1'),
o AS (SELECT symbol, k % 5 AS h FROM s WHERE k % 3 <> 0), n AS (SELECT symbol, CASE WHEN k % 2 = 0 THEN k % 5 ELSE -1 END AS h FROM s WHERE k % 4 <> 0),
c AS (SELECT * FROM (SELECT coalesce(o.symbol, n.symbol) AS symbol, CASE WHEN o.symbol IS NULL THEN 'added' WHEN n.symbol IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' END AS change FROM o FULL JOIN n ON o.symbol = n.symbol) WHERE change IS NOT NULL)
SELECT * FROM c WHERE symbol NOT IN (SELECT regexp_replace(symbol, '\\.[^.]*$', '') FROM c WHERE contains(symbol, '.'))""",
    "file_history": "WITH RECURSIVE h AS (SELECT n_nationkey AS o, n_nationkey AS p, 0 AS step FROM nation WHERE n_nationkey > 17 UNION ALL SELECT o, p - 7, step + 1 FROM h WHERE p >= 7) SELECT 'f' || o AS origin, 'f' || p AS path, step FROM h",
    "graph_walk": _WALK.format(e=_E, st="SELECT src, dst, id FROM e", start="'c899', 'c769'"),
    "graph_walk_both": _WALK.format(e=_E, st="SELECT src, dst, id FROM e WHERE kind <> 'tests' UNION ALL SELECT dst, src, id FROM e WHERE kind <> 'tests'", start="'o7'"),
    "graph_bfs": f"WITH RECURSIVE {_E}, w(node, depth) AS (SELECT 'c899', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 4), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT m.node, m.depth, min(p.node) AS parent FROM m LEFT JOIN e ON e.dst = m.node LEFT JOIN m p ON p.node = e.src AND p.depth = m.depth - 1 GROUP BY 1, 2",
    "fan_out_round_robin": f"WITH {_E} SELECT src, id, kind, position FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY turn, kind, id) AS position FROM (SELECT dst AS src, id, kind || ev AS kind, row_number() OVER (PARTITION BY dst, kind || ev ORDER BY id) AS turn FROM e)) WHERE position <= 10",
    "impact_risk": _IMPACT + " SELECT * FROM i",
    "impact_projects": _IMPACT + " SELECT o_orderpriority AS project, count(*) AS n, CASE min(CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS risk FROM i LEFT JOIN orders ON node = 'o' || o_orderkey GROUP BY 1",
    "flow_paths": f"WITH RECURSIVE {_E}, w(path, ids, weakest, flagged, hops) AS (SELECT ['c899'], []::varchar[], 0, 0, 0 UNION ALL SELECT list_append(path, dst), list_append(ids, id), greatest(weakest, ev), flagged + (ev >= 3 OR res > 0)::int, hops + 1 FROM w JOIN e ON src = path[-1] WHERE hops < 4 AND NOT list_contains(path, dst)) SELECT array_to_string(path, ' ') AS path, weakest, flagged, hops FROM w WHERE path[-1][1] = 'n' ORDER BY weakest, flagged, hops, ids LIMIT 10",
    "insight_orphan": "SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)",
    "insight_drift": "WITH li AS (SELECT * FROM lineitem), p AS (SELECT l_partkey AS key, list_sort(list_distinct(list(l_returnflag))) AS p FROM li WHERE l_linenumber = 1 GROUP BY 1) SELECT key, l_orderkey AS consumer, array_to_string(p, ',') AS provided, l_returnflag AS used FROM li JOIN p ON key = l_partkey WHERE l_linenumber = 2 AND l_linestatus = 'F' AND NOT list_contains(p, l_returnflag)",
    "missing_locale": "WITH k AS (SELECT DISTINCT source || '/' || (doc_id % 250) AS key, lang FROM documents), a AS (SELECT DISTINCT lang FROM k) SELECT key, string_agg(a.lang, ',' ORDER BY a.lang) AS missing FROM (SELECT DISTINCT key FROM k) x CROSS JOIN a WHERE (key, a.lang) NOT IN (SELECT (key, lang) FROM k) GROUP BY 1",
    "edge_merge": "SELECT l_partkey AS src, l_suppkey AS dst, min(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 3 END) AS ev, min((l_quantity > 45)::int) AS res, array_to_string(list_sort(list_distinct(list(l_orderkey::varchar))), ',') AS evidence FROM lineitem GROUP BY 1, 2",
    "contract_parties": f"WITH {_V} SELECT string_split(path, '/')[-1] AS kind, content_hash AS key, coalesce(array_to_string(list_sort(list_distinct(list(string_split(path, '/')[1]) FILTER (valid_from % 2 = 0))), ','), '') AS producers, coalesce(array_to_string(list_sort(list_distinct(list(string_split(path, '/')[1]) FILTER (valid_from % 2 <> 0))), ','), '') AS consumers FROM v WHERE valid_from <= 1500 AND (valid_to IS NULL OR valid_to > 1500) GROUP BY 1, 2",
    "module_rollup": "SELECT l_returnflag AS module, l_linestatus AS other, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> l_linestatus) GROUP BY 1, 2",
    "merkle_root": f"""WITH f AS (SELECT path, arg_max(hash, doc_id) AS hash, 'f' AS kind, len(string_split(path, '/')) AS depth FROM (SELECT concat_ws('/', lang, source, doc_id) AS path, sha256(text) AS hash, doc_id FROM documents) GROUP BY 1),
c AS ({_LEVEL.format(of="SELECT path, hash, kind FROM f WHERE depth = 3")}),
b AS ({_LEVEL.format(of="SELECT path, hash, kind FROM f WHERE depth = 2 UNION ALL SELECT path, hash, 'd' FROM c")}),
a AS ({_LEVEL.format(of="SELECT path, hash, kind FROM f WHERE depth = 1 UNION ALL SELECT path, hash, 'd' FROM b")}) SELECT * FROM c UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a""",
}
