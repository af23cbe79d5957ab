"""Usage, jobs, contracts, paths, secrets, knowledge, code and streaming queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources as S
from tessera import streaming as ST
from tessera.functions import contracts as K
from tessera.functions import paths as P
from tessera.functions import secrets as X
from tessera.operators import code as C
from tessera.operators import knowledge as N
from tessera.operators import linking as L
from tessera.operators import usage as U
from tessera.session import table


def calls_of(events: DataFrame) -> DataFrame:
    """Events as tool calls: the value is the latency."""
    ms = F.floor(F.abs("value") * 10).cast("long")
    return events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("tool"), U.agent_label(F.concat(F.lit("agent "), F.col("user_id") % 5)).alias("agent"), ms.alias("latency_ms"), (ms % 7 != 0).alias("ok"), (F.col("event_id") % 100).alias("output_tokens"))


def _hour(c: str):
    return F.date_format(c, "yyyy-MM-dd HH").alias("hour")


def _hist(h: DataFrame) -> DataFrame:
    used = F.filter(F.transform("buckets", lambda n, i: F.when(n > 0, F.concat_ws(":", i.cast("string"), n.cast("string")))), lambda x: x.isNotNull())
    return h.select(_hour("hour"), "tool", "agent", "calls", "errors", "tokens", "latency_ms_sum", F.array_join(used, " ").alias("histogram"))


def usage_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _hist(U.hourly(calls_of(table(spark, d, "events"))))


def usage_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored and buffered hours, added up, are those of all calls."""
    e = table(spark, d, "events")
    return _hist(U.merge(U.hourly(calls_of(e.where("event_id % 3 = 0"))), U.hourly(calls_of(e.where("event_id % 3 <> 0"))), *U.KEY))


def usage_rollups(spark: SparkSession, d: str) -> DataFrame:
    return U.report(calls_of(table(spark, d, "events")), F.lit("2024-01-05").cast("timestamp"))


def stream_usage_hourly(spark: SparkSession, d: str) -> DataFrame:
    """The same hours from a stream, by update mode with a watermark."""
    out = ST.run_to_end(ST.hourly_usage(calls_of(ST.read_files(spark, f"{d}/events.parquet")), "60 days"), name="usage")
    return _hist(U.histogram(ST.latest(spark, out, *U.KEY, "bucket"), *U.KEY))


def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """A user's events with less than 30 minutes between them are one change."""
    e = ST.read_files(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("view_id"))
    out = ST.run_to_end(ST.debounce(e, quiet="30 minutes", late="60 days"), name="debounce", mode="complete")
    return ST.latest(spark, out, "view_id", "start").groupBy("n").agg(F.count("*").alias("sessions"))


def jobs_of(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, "running").otherwise("queued").alias("state"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
                    F.lit(4).alias("max_attempts"), F.col("o_orderdate").cast("timestamp").alias("run_after"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("w"), F.col("o_orderkey") % 4)).alias("lease_owner"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp")).alias("lease_expires_at"), F.concat(F.lit("k"), F.col("o_custkey")).alias("idempotency_key"))


def _now():
    return F.lit("1996-01-01 00:00:00").cast("timestamp")


def job_claim(spark: SparkSession, d: str) -> DataFrame:
    return U.claim(jobs_of(spark, d), ["F", "P"], "w9", _now(), 30_000, 50).select("id", "priority", "attempts", "lease_owner", F.date_format("lease_expires_at", "yyyy-MM-dd HH:mm:ss").alias("lease"))


def job_fail(spark: SparkSession, d: str) -> DataFrame:
    f = U.fail(jobs_of(spark, d), "w1", _now(), base_ms=1000, max_ms=3000)
    return f.groupBy("state", "attempts").agg(F.count("*").alias("n"), F.count("lease_owner").alias("leased"), F.count(F.when(F.col("run_after") == U.later(_now(), F.lit(2000)), 1)).alias("in_2s"))


def job_reclaim(spark: SparkSession, d: str) -> DataFrame:
    return U.reclaim(jobs_of(spark, d), _now()).groupBy("state").agg(F.count("*").alias("n"), F.count("lease_owner").alias("leased"))


def job_enqueue(spark: SparkSession, d: str) -> DataFrame:
    j = jobs_of(spark, d)
    return U.enqueue(j.where("id % 2 = 0"), j.where("id % 2 = 1")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def page_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), K.http_key(F.concat(F.lit("get "), "url")).alias("key"))


def http_keys(spark: SparkSession, d: str) -> DataFrame:
    return page_keys(spark, d).groupBy("key").agg(F.count("*").alias("n"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Some pages' keys as they stand, and each folder with a parameter."""
    k = page_keys(spark, d)
    return k.where("page_id % 10 = 0").select("key").unionByName(k.select(F.regexp_replace("key", "/[^/]*$", "/{}").alias("key"))).distinct()


def endpoint_match(spark: SparkSession, d: str) -> DataFrame:
    return L.match_endpoints(page_keys(spark, d).select("key"), _known(spark, d))


def contract_resolve(spark: SparkSession, d: str) -> DataFrame:
    k = page_keys(spark, d).select(F.lit("endpoint").alias("kind"), F.regexp_replace("key", "^GET /", "GET /api/").alias("key"), F.lit(False).alias("dynamic"))
    return L.resolve(k, _known(spark, d).withColumn("kind", F.lit("endpoint")), prefixes=("/api",)).groupBy("how", "resolution").agg(F.count("*").alias("n"))


def contract_catalogue(spark: SparkSession, d: str) -> DataFrame:
    k = page_keys(spark, d).select(F.lit("endpoint").alias("kind"), F.regexp_replace("key", "/[^/]*$", "/{}").alias("key"), F.when(F.col("page_id") % 2 == 0, "producer").otherwise("consumer").alias("role"), F.col("host").alias("party"), (F.col("page_id") % 3).cast("string").alias("schema_hash"))
    return L.catalogue(k, query="/E", limit=2).select("kind", "key", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"), "drift", "more_available")


def undocumented(spark: SparkSession, d: str) -> DataFrame:
    k = page_keys(spark, d)
    return L.documentation(k.select(F.col("host").alias("project"), "key"), k.where("page_id % 4 <> 0").select(F.concat(F.lit("doc"), F.col("page_id") % 3).alias("doc"), F.lit("none").alias("stem"), "key")).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def without_provider(spark: SparkSession, d: str) -> DataFrame:
    k = page_keys(spark, d)
    return L.without_provider(k.select(F.when(F.col("page_id") % 5 == 0, "exposes").otherwise("consumes").alias("kind"), "key")).select("code", "key")


def edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, ("definition", "producer", "consumer", "reads", "writes"))), (F.col("event_id") % 5 + 1).cast("int")).alias("role"), F.element_at(F.array(*map(F.lit, ("endpoint", "topic", "table", "env", "i18n", "rpc", "package", "infra"))), (F.floor(F.col("event_id") / 5) % 8 + 1).cast("int")).alias("kind"))
    return e.groupBy("role", "kind", L.edge_kind(F.col("role"), F.col("kind")).alias("edge")).agg(F.count("*").alias("n"))


def schema_history(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's nation is a database; its parts add and drop columns."""
    s = table(spark, d, "supplier")
    op = F.element_at(F.array(*map(F.lit, ("create", "add_column", "add_column", "drop_column"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    o = s.select(F.concat(F.lit("db"), "s_nationkey").alias("database"), F.lit("p").alias("project"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("path"), F.lit(1).alias("line"), F.concat(F.lit("t"), F.col("s_suppkey") % 2).alias("table"), op.alias("op"), F.concat(F.lit("c"), F.col("s_suppkey") % 6).alias("column"), F.lit(None).cast("string").alias("new_name"))
    return L.schema_history(o).select("database", "table", "version", F.array_join("columns", ",").alias("columns"), "dropped")


CODE_PATHS = ("src/app.py", "web/Index.TSX", "go.sum", "deploy/.env.prod", "a/tests/x.rs", "Dockerfile", "keys/id_rsa", "api/user.pb.go", ".kube/config", "include/x.h", "notes", "x.min.js")


def path_classes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, CODE_PATHS)), (F.col("doc_id") % len(CODE_PATHS) + 1).cast("int")).alias("path"), "text")
    return p.groupBy("path", P.language(F.col("path"), F.lit("")).alias("language"), F.coalesce(P.sensitive(F.col("path")), F.lit("none")).alias("sensitive"), P.generated(F.col("path"), F.lit("")).alias("generated"), P.is_test(F.col("path")).alias("test")).agg(F.count("*").alias("n"))


def secret_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token shapes in documents and in canaries put into some of them."""
    i = F.lpad(F.col("doc_id").cast("string"), 16, "0")
    canary = F.when(F.col("doc_id") % 50 == 1, F.concat(F.lit(" AKIA"), i)).when(F.col("doc_id") % 50 == 2, F.concat(F.lit(" ghp_"), i, i, i)).when(F.col("doc_id") % 50 == 3, F.concat(F.lit(" db://u:"), i, F.lit("@h"))).otherwise("")
    t = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), canary).alias("text"))
    n = X.token_counts(F.col("text"))
    return t.select("doc_id", *[n[k].cast("long").alias(k) for k in ("aws_access_key_id", "github_token", "url_password")]).where("aws_access_key_id + github_token + url_password > 0")


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", F.explode(X.scan("text")).alias("f"))
    return f.select("doc_id", "f.kind", "f.line", "f.start", "f.end")


def redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.redact("text").alias("t")).where(F.col("t").contains("[REDACTED:")).select("doc_id", F.sha2("t", 256).alias("sha256"))


def records_of(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, N.BREADTH[:3])), (k % 3 + 1).cast("int"))
    return p.select(k.alias("id"), kind.alias("scope_kind"), F.when(kind != "organization", F.concat(F.lit("w"), k % 4)).alias("workspace"), F.when(kind == "project", F.concat(F.lit("p"), k % 8)).alias("project"), F.col("p_brand").alias("kind"), F.concat(F.lit("s"), k % 97).alias("subject"), F.col("p_name").alias("body"),
                    F.when(k % 5 == 0, "proposed").when(k % 5 == 1, "rejected").otherwise("accepted").alias("state"), (k % 11 == 0).alias("pinned"), F.array(F.concat(F.lit("f"), k % 50)).alias("related_symbols"))


def knowledge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return N.conflicts(records_of(spark, d))


def staleness(spark: SparkSession, d: str) -> DataFrame:
    r = records_of(spark, d)
    e = r.select(F.col("id").alias("record_id"), F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("id") % 40).alias("path"), (F.col("id") % 3).cast("string").alias("content_hash"))
    c = spark.range(20).select(F.lit("p").alias("project"), F.concat(F.lit("f"), "id").alias("path"), F.lit("0").alias("old_hash"), F.when(F.col("id") % 4 != 0, (F.col("id") % 3).cast("string")).alias("new_hash"))
    s = spark.range(5).select(F.concat(F.lit("f"), "id").alias("symbol"), F.when(F.col("id") % 2 == 0, "changed").otherwise("removed").alias("kind"))
    return N.staleness(r, e, c, s).select("id", "stale", F.array_join("reasons", ";").alias("reasons"))


def bootstrap_pack(spark: SparkSession, d: str) -> DataFrame:
    r = records_of(spark, d).where("state = 'accepted'")
    breadth = F.array_position(F.array(*map(F.lit, N.BREADTH)), F.col("scope_kind"))
    i = r.select(F.col("kind").alias("brand"), "id", N.tier(F.col("pinned"), F.col("id") % 7 == 0, F.when(F.col("id") % 2 == 0, "human").otherwise("code")).alias("tier"), breadth.alias("breadth"), "subject", F.timestamp_seconds(F.col("id") * 60).alias("updated_at"), F.repeat("body", 5).alias("text"))
    return N.bootstrap(i, 400, by="brand")


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    m = c.select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("commit"))
    return N.manifest_diff(m.where("project % 3 <> 0"), m.where("project % 4 <> 0").withColumn("commit", F.when(F.col("project") % 5 == 0, "new").otherwise(F.col("commit"))))


def row_access(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "nation").select(F.concat(F.lit("u"), F.col("n_regionkey")).alias("user"), F.col("n_nationkey").alias("project"), (F.col("n_nationkey") % 3).alias("role"))
    return N.visible(table(spark, d, "customer").withColumnRenamed("c_nationkey", "project"), g, "u1", 1).groupBy("project").agg(F.count("*").alias("n"))


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunks(table(spark, d, "documents"), "doc_id")
    return c.select("doc_id", "ordinal", "start_line", "end_line", F.length("text").alias("n_chars"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.transform(C.embed("text"), lambda x: F.round(x, 6)).alias("v")).select("item_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Truncated to 16 components and normalised again."""
    e = table(spark, d, "embeddings").select("vec_id", C.unit(F.col("embedding"), 16).alias("u"))
    return e.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 16), 6).alias("last"))


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    file = F.concat(F.lit("d"), F.col("l_orderkey") % 100, F.lit("/"), "l_orderkey")
    uses = li.select(file.alias("file"), F.concat(F.lit("n"), F.col("l_partkey") % 300).alias("name"))
    defs = li.where("l_linenumber = 1").select(file.alias("file"), F.concat(F.lit("n"), F.col("l_suppkey") % 300).alias("name"), F.concat_ws("#", file, "l_suppkey").alias("symbol"))
    return C.resolve_names(uses, defs, li.where("l_linenumber = 2").select(file.alias("file"), F.concat(F.lit("d"), F.col("l_suppkey") % 100, F.lit("/"), F.col("l_suppkey")).alias("target"))).groupBy("scope", "ambiguous").agg(F.count("*").alias("n"))


FILES = (
    ("api", "src/routes.ts", "typescript", "app.get('/v1/orders/:id', h);\nrouter.post(`/v1/orders`, h);\nconst u = process.env.API_URL;\nproducer.send({ topic: 'order.created' })"),
    ("web", "src/client.ts", "typescript", "axios.get(`/v1/orders/${id}`)\nfetch('/v1/orders?x=1')\nt('cart.title')"),
    ("job", "job/main.py", "python", "import os\nrequests.post('http://api/v1/orders')\nos.environ['DB_URL']\nq = 'SELECT * FROM public.orders JOIN items'\n__tablename__ = 'orders'"),
    ("db", "migrations/001.sql", "sql", "CREATE TABLE orders (id int primary key, total numeric(10,2), unique (id));\nALTER TABLE orders ADD COLUMN note text, DROP COLUMN total;\nALTER TABLE orders RENAME TO sales;"),
)


def extract_contracts(spark: SparkSession, d: str) -> DataFrame:
    """The rules over small files, a copy of them for each region."""
    each = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(f, ("project", "path", "language", "text"))]) for f in FILES])).alias("f")
    e = C.extract(table(spark, d, "region").select("r_name", each).select(F.concat_ws("-", "r_name", "f.project").alias("project"), "f.path", "f.language", "f.text"))
    return e.select("project", "path", "line", "pack", "kind", "role", "key", "dynamic")


def table_migrations(spark: SparkSession, d: str) -> DataFrame:
    return S.migrations(spark.createDataFrame(list(FILES), "project string, path string, language string, text string"))


QUERIES = {f.__name__: f for f in (
    usage_hourly, usage_merge, usage_rollups, stream_usage_hourly, stream_debounce, job_claim, job_fail, job_reclaim, job_enqueue, http_keys, endpoint_match, contract_resolve, contract_catalogue, undocumented, without_provider, edge_kinds, schema_history,
    path_classes, secret_tokens, secret_scan, redact, knowledge_conflicts, staleness, bootstrap_pack, manifest_diff, row_access, chunk_text, hash_embedding, unit_vectors, resolve_names, extract_contracts, table_migrations)}

_CALLS = """c0 AS (SELECT ts AS tm, event_type AS tool, 'agent_' || (user_id % 5) AS agent, floor(abs(value) * 10)::bigint AS ms, event_id % 100 AS tok FROM events),
calls AS (SELECT *, ms % 7 <> 0 AS ok, CASE WHEN ms < 4 THEN ms ELSE least(4 + (length(bin(ms)) - 3) * 4 + (ms >> (length(bin(ms)) - 3)) % 4, 95) END AS b FROM c0)"""
_HOURS = f"""WITH {_CALLS}, p AS (SELECT strftime(tm, '%Y-%m-%d %H') AS hour, tool, agent, b, count(*) AS n, sum((NOT ok)::int) AS e, sum(tok) AS t, sum(ms) AS s FROM calls GROUP BY ALL)
SELECT hour, tool, agent, sum(n)::bigint AS calls, sum(e)::bigint AS errors, sum(t)::bigint AS tokens, sum(s)::bigint AS latency_ms_sum, string_agg(b || ':' || n, ' ' ORDER BY b) AS histogram FROM p GROUP BY hour, tool, agent"""
_JOBS = """j AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_orderpriority[1]::int AS priority, CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'queued' END AS state, (o_orderkey % 5)::int AS attempts, 4 AS max_attempts, o_orderdate::timestamp AS run_after,
  CASE WHEN o_orderkey % 3 = 0 THEN 'w' || (o_orderkey % 4) END AS owner, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::timestamp END AS expires, 'k' || o_custkey AS ik FROM orders)"""
_KEYS = """k AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host, 'GET /' || array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '^https?://[^/]*', ''), '^([^?#]*)', 1), '/'), lambda x: x <> ''), '/') AS key FROM pages),
kn AS (SELECT DISTINCT key FROM (SELECT key FROM k WHERE page_id % 10 = 0 UNION ALL SELECT regexp_replace(key, '/[^/]*$', '/{}') FROM k))"""
_PAIRS = """pr AS (SELECT c.key, p.key AS target, string_split(c.key[6:], '/') AS cs, string_split(p.key[6:], '/') AS ps FROM (SELECT DISTINCT key FROM k) c JOIN kn p ON len(string_split(c.key, '/')) = len(string_split(p.key, '/'))),
sc AS (SELECT key, target, 1 + list_sum(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN ps[i] = '{}' OR cs[i] = '{}' THEN 0 WHEN ps[i] = cs[i] THEN 2 ELSE -1000 END)) AS score FROM pr),
best AS (SELECT key, target, score::int AS score FROM (SELECT *, max(score) OVER (PARTITION BY key) AS m FROM sc WHERE score >= 0) WHERE score = m)"""
_R = """r AS (SELECT p_partkey AS id, ['organization', 'workspace', 'project'][p_partkey % 3 + 1] AS sk, CASE WHEN p_partkey % 3 <> 0 THEN 'w' || (p_partkey % 4) END AS w, CASE WHEN p_partkey % 3 = 2 THEN 'p' || (p_partkey % 8) END AS p, 's' || (p_partkey % 97) AS subject,
  p_name AS body, CASE p_partkey % 5 WHEN 0 THEN 'proposed' WHEN 1 THEN 'rejected' ELSE 'accepted' END AS state FROM part)"""
_CANARY = "SELECT doc_id, coalesce(text, '') || CASE doc_id % 50 WHEN 1 THEN ' AKIA' || i WHEN 2 THEN ' ghp_' || i || i || i WHEN 3 THEN ' db://u:' || i || '@h' ELSE '' END AS t FROM (SELECT *, lpad(doc_id::varchar, 16, '0') AS i FROM documents)"
_ROLES = "['definition', 'producer', 'consumer', 'reads', 'writes'][event_id % 5 + 1]"
_KINDS = "['endpoint', 'topic', 'table', 'env', 'i18n', 'rpc', 'package', 'infra'][(event_id // 5) % 8 + 1]"
SQL = {
    "usage_hourly": _HOURS, "usage_merge": _HOURS, "stream_usage_hourly": _HOURS,
    "usage_rollups": f"""WITH {_CALLS}, x AS (SELECT 'tool' AS kind, tool AS name, * FROM calls UNION ALL SELECT 'agent', agent, * FROM calls UNION ALL SELECT 'day', strftime(tm, '%Y-%m-%d'), * FROM calls),
g AS (SELECT kind, name, count(*) AS calls, sum((NOT ok)::int)::bigint AS errors, list_sort(list(b)) AS l FROM x WHERE tm >= TIMESTAMP '2024-01-05' GROUP BY 1, 2),
q AS (SELECT *, l[(calls - 1) * 50 // 100 + 1] AS b50, l[(calls - 1) * 95 // 100 + 1] AS b95 FROM g)
SELECT kind, name, calls, errors, (CASE WHEN b50 < 4 THEN b50 ELSE (5 + (b50 - 4) % 4) * (1::bigint << ((b50 - 4) // 4)) - 1 END)::bigint AS p50, (CASE WHEN b95 < 4 THEN b95 ELSE (5 + (b95 - 4) % 4) * (1::bigint << ((b95 - 4) // 4)) - 1 END)::bigint AS p95 FROM q""",
    "stream_debounce": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT count(*) AS n FROM s GROUP BY user_id, s) SELECT n, count(*) AS sessions FROM c GROUP BY 1",
    "job_claim": f"WITH {_JOBS} SELECT id, priority, attempts + 1 AS attempts, 'w9' AS lease_owner, '1996-01-01 00:00:30' AS lease FROM j WHERE state = 'queued' AND kind IN ('F', 'P') AND run_after <= TIMESTAMP '1996-01-01' ORDER BY priority DESC, run_after, id LIMIT 50",
    "job_fail": f"WITH {_JOBS}, f AS (SELECT CASE WHEN owner = 'w1' THEN CASE WHEN attempts >= 4 THEN 'dead' ELSE 'failed' END ELSE state END AS state, attempts, CASE WHEN owner = 'w1' THEN NULL ELSE owner END AS owner, owner = 'w1' AND attempts = 2 AS two FROM j) SELECT state, attempts, count(*) AS n, count(owner) AS leased, sum(coalesce(two, false)::int)::bigint AS in_2s FROM f GROUP BY 1, 2",
    "job_reclaim": f"WITH {_JOBS}, f AS (SELECT CASE WHEN expires < TIMESTAMP '1996-01-01' THEN CASE WHEN attempts >= 4 THEN 'dead' ELSE 'queued' END ELSE state END AS state, CASE WHEN expires < TIMESTAMP '1996-01-01' THEN NULL ELSE owner END AS owner FROM j) SELECT state, count(*) AS n, count(owner) AS leased FROM f GROUP BY 1",
    "job_enqueue": f"WITH {_JOBS}, a AS (SELECT id, kind FROM j WHERE id % 2 = 0 UNION ALL SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY ik ORDER BY id) AS n FROM j WHERE id % 2 = 1) WHERE n = 1 AND ik NOT IN (SELECT ik FROM j WHERE id % 2 = 0)) SELECT kind, count(*) AS n, sum(id)::bigint AS ids FROM a GROUP BY 1",
    "http_keys": f"WITH {_KEYS} SELECT key, count(*) AS n FROM k GROUP BY 1",
    "endpoint_match": f"WITH {_KEYS}, {_PAIRS} SELECT key, target, score FROM best",
    "contract_resolve": f"WITH {_KEYS}, {_PAIRS}, h AS (SELECT key, count(*) AS c FROM best GROUP BY 1) SELECT 'prefix' AS how, CASE WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution, sum(c)::bigint AS n FROM h GROUP BY 1, 2",
    "contract_catalogue": f"""WITH {_KEYS}, c AS (SELECT 'endpoint' AS kind, regexp_replace(key, '/[^/]*$', '/{{}}') AS key, page_id % 2 = 0 AS prod, host, (page_id % 3)::varchar AS h FROM k),
g AS (SELECT kind, key, coalesce(string_agg(DISTINCT host, ',' ORDER BY host) FILTER (prod), '') AS producers, coalesce(string_agg(DISTINCT host, ',' ORDER BY host) FILTER (NOT prod), '') AS consumers, coalesce(list(DISTINCT h) FILTER (prod), []) AS p, coalesce(list(DISTINCT h) FILTER (NOT prod), []) AS u FROM c WHERE contains(lower(key), '/e') GROUP BY 1, 2)
SELECT kind, key, producers, consumers, len(p) > 0 AND len(list_filter(u, lambda x: NOT list_contains(p, x))) > 0 AS drift, (SELECT count(*) FROM g) > 2 AS more_available FROM g ORDER BY kind, key LIMIT 2""",
    "undocumented": f"""WITH {_KEYS}, s AS (SELECT DISTINCT host, key FROM k), d AS (SELECT DISTINCT 'doc' || (page_id % 3) AS doc, key FROM k WHERE page_id % 4 <> 0), cv AS (SELECT DISTINCT host, doc FROM s JOIN d USING (key)),
u AS (SELECT host, key FROM s WHERE host IN (SELECT host FROM cv) AND NOT EXISTS (SELECT 1 FROM d JOIN cv ON cv.doc = d.doc AND cv.host = s.host WHERE d.key = s.key)),
m AS (SELECT doc, key FROM d WHERE doc IN (SELECT doc FROM cv) AND NOT EXISTS (SELECT 1 FROM s JOIN cv ON cv.host = s.host AND cv.doc = d.doc WHERE s.key = d.key))
SELECT * FROM (SELECT 'link.endpoint_undocumented' AS code, count(*) AS n, count(DISTINCT key) AS keys FROM u UNION ALL SELECT 'link.endpoint_unimplemented', count(*), count(DISTINCT key) FROM m) WHERE n > 0""",
    "without_provider": f"WITH {_KEYS} SELECT DISTINCT 'link.endpoint_without_provider' AS code, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE page_id % 5 = 0)",
    "edge_kinds": f"""WITH e AS (SELECT {_ROLES} AS role, {_KINDS} AS kind FROM events) SELECT role, kind, CASE role WHEN 'definition' THEN 'defines' WHEN 'reads' THEN 'reads' WHEN 'writes' THEN 'writes'
WHEN 'producer' THEN CASE WHEN kind IN ('endpoint', 'rpc', 'infra') THEN 'exposes' WHEN kind = 'topic' THEN 'produces' WHEN kind = 'table' THEN 'writes' ELSE 'defines' END
ELSE CASE WHEN kind IN ('endpoint', 'rpc', 'topic') THEN 'consumes' WHEN kind IN ('table', 'env') THEN 'reads' WHEN kind = 'i18n' THEN 'references' ELSE 'depends_on' END END AS edge, count(*) AS n FROM e GROUP BY ALL""",
    "path_classes": """WITH v(path, language, sensitive, generated, test) AS (VALUES ('src/app.py', 'python', 'none', false, false), ('web/Index.TSX', 'tsx', 'none', false, false), ('go.sum', 'text', 'none', true, false), ('deploy/.env.prod', 'text', 'env_file', false, false),
('a/tests/x.rs', 'rust', 'none', false, true), ('Dockerfile', 'dockerfile', 'none', false, false), ('keys/id_rsa', 'text', 'private_key', false, false), ('api/user.pb.go', 'go', 'none', true, false), ('.kube/config', 'text', 'infra_state', false, false),
('include/x.h', 'c', 'none', false, false), ('notes', 'text', 'none', false, false), ('x.min.js', 'javascript', 'none', true, false)), n AS (SELECT *, row_number() OVER () - 1 AS i FROM v) SELECT path, language, sensitive, generated, test, count(*) AS n FROM documents JOIN n ON doc_id % 12 = i GROUP BY ALL""",
    "secret_tokens": f"""SELECT * FROM (SELECT doc_id, len(regexp_extract_all(t, '\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b'))::bigint AS aws_access_key_id, len(regexp_extract_all(t, '(?:gh[pousr]_[A-Za-z0-9]{{36,255}}|github_pat_[A-Za-z0-9_]{{22,255}})'))::bigint AS github_token,
len(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9+.\\-]*://[^\\s/:@''"<>]+:([^\\s/@''"<>]+)@'))::bigint AS url_password FROM ({_CANARY})) WHERE aws_access_key_id + github_token + url_password > 0""",
    "knowledge_conflicts": f"""WITH {_R}, a AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS b FROM r WHERE state = 'accepted')
SELECT x.subject, x.id AS first, y.id AS second FROM a x JOIN a y ON x.subject = y.subject AND x.id < y.id AND x.b <> y.b WHERE (x.sk = 'organization' OR y.sk = 'organization') OR (x.sk <> y.sk AND x.w = y.w) OR (x.sk = y.sk AND x.w = y.w AND x.p IS NOT DISTINCT FROM y.p)""",
    "staleness": f"""WITH {_R}, w AS (SELECT id, CASE WHEN f % 4 = 0 THEN 'file_deleted:' ELSE 'file_changed:' END || 'p/f' || f AS reason FROM (SELECT id, id % 40 AS f, id % 3 AS h FROM r) WHERE f < 20 AND (f % 4 = 0 OR (f % 3 <> 0 AND f % 3 <> h))
UNION ALL SELECT id, 'symbol_' || CASE WHEN id % 50 % 2 = 0 THEN 'changed' ELSE 'removed' END || ':f' || (id % 50) FROM r WHERE id % 50 < 5) SELECT id, state = 'accepted' AS stale, string_agg(reason, ';' ORDER BY reason) AS reasons FROM r JOIN w USING (id) WHERE state IN ('accepted', 'proposed') GROUP BY 1, 2""",
    "manifest_diff": "WITH o AS (SELECT c_custkey AS project, c_mktsegment AS c FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS project, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS c FROM customer WHERE c_custkey % 4 <> 0) SELECT * FROM (SELECT coalesce(o.project, n.project) AS project, CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' WHEN o.c <> n.c THEN 'moved' END AS change, o.c AS old_commit, n.c AS new_commit FROM o FULL JOIN n ON o.project = n.project) WHERE change IS NOT NULL",
    "row_access": "SELECT c_nationkey AS project, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 >= 1) GROUP BY 1",
    "unit_vectors": "WITH e AS (SELECT vec_id, embedding[1:16]::double[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e) SELECT vec_id, round(v[1] / n, 6) AS first, round(v[16] / n, 6) AS last FROM n",
    "resolve_names": f"""WITH li AS (SELECT *, 'd' || (l_orderkey % 100) || '/' || l_orderkey AS file, 'd' || (l_orderkey % 100) AS dir FROM lineitem),
u AS (SELECT DISTINCT file, dir, 'n' || (l_partkey % 300) AS name FROM li), d AS (SELECT file, dir, 'n' || (l_suppkey % 300) AS name, file || '#' || l_suppkey AS symbol FROM li WHERE l_linenumber = 1),
i AS (SELECT file, 'd' || (l_suppkey % 100) || '/' || l_suppkey AS target FROM li WHERE l_linenumber = 2),
s AS (SELECT u.file, u.name, symbol, 1 AS scope FROM u JOIN d ON d.file = u.file AND d.name = u.name
UNION SELECT u.file, u.name, symbol, 2 FROM u JOIN i ON i.file = u.file JOIN d ON d.file = i.target AND d.name = u.name
UNION SELECT u.file, u.name, symbol, 3 FROM u JOIN d ON d.dir = u.dir AND d.name = u.name AND d.file <> u.file),
g AS (SELECT file, name, scope, count(*) AS n, row_number() OVER (PARTITION BY file, name ORDER BY scope) AS k FROM s GROUP BY 1, 2, 3)
SELECT ['file', 'import', 'directory'][scope] AS scope, n > 1 AS ambiguous, count(*) AS n FROM g WHERE k = 1 AND n <= {C.MAX_CANDIDATES} GROUP BY 1, 2""",
}
