"""Contract linking and checks: edge kinds, resolution of keys, schema history, rule findings, catalogue.

extractions: (project, path, line, kind, role, key, dynamic, symbol, evidence);
known keys: (kind, key) that some project defines or provides.  Keys of a hot
contract are joined by equality on the key or on blocks of it; no join here has
a condition without an equality.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import contracts as K

# Fixed values: (role, contract kind) -> edge kind; a missing kind is any.
EDGE_KINDS = {
    ("definition", None): "defines", ("reads", None): "reads", ("writes", None): "writes",
    ("producer", "endpoint"): "exposes", ("producer", "rpc"): "exposes", ("producer", "infra"): "exposes", ("producer", "topic"): "produces", ("producer", "table"): "writes",
    ("producer", "env"): "defines", ("producer", "i18n"): "defines", ("producer", "package"): "defines",
    ("consumer", "endpoint"): "consumes", ("consumer", "rpc"): "consumes", ("consumer", "topic"): "consumes", ("consumer", "table"): "reads", ("consumer", "env"): "reads",
    ("consumer", "i18n"): "references", ("consumer", "package"): "depends_on", ("consumer", "infra"): "depends_on",
}


def edge_kind(role: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for (r, k), e in EDGE_KINDS.items():
        out = F.when((role == r) & (F.lit(True) if k is None else kind == k), e).otherwise(out)
    return out


def match_endpoints(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """(key, target, score): for each distinct consumer key the provider keys with the highest score.

    A key's mask is which of its segments hold ``{}``.  Two keys can match only
    if they have as many segments and agree in all that are literal in both, so
    they meet by equality on (segments, both masks, those segments): each key is
    listed once for each mask that the other side has at its length.  The masks
    are few (shapes of paths, not paths), and they alone are broadcast.
    """
    def keyed(df: DataFrame, name: str, segs: str, mask: str) -> DataFrame:
        d = df.select(F.col("key").alias(name)).distinct().withColumn(segs, K.segments_of(F.col(name)))
        return d.withColumns({"n": F.size(segs), mask: F.array_join(F.transform(segs, lambda x: x.contains("{}").cast("int").cast("string")), "")})

    def against(own: DataFrame, segs: str, mine: str, other: DataFrame, theirs: str) -> DataFrame:
        shapes = other.select("n", theirs).distinct()
        literal = F.filter(F.transform(segs, lambda x, i: F.when((F.substring(F.col(mine), i + 1, F.lit(1)) == "0") & (F.substring(F.col(theirs), i + 1, F.lit(1)) == "0"), x)), lambda x: x.isNotNull())
        return own.join(F.broadcast(shapes), "n").withColumn("rest", literal)

    c, p = keyed(consumers, "key", "cs", "cm"), keyed(providers, "target", "ps", "pm")
    j = against(c, "cs", "cm", p, "pm").join(against(p, "ps", "pm", c, "cm"), ["n", "cm", "pm", "rest"])
    s = j.select("key", "target", K.endpoint_score(F.col("key"), F.col("target"), F.col("cs"), F.col("ps")).alias("score")).where("score IS NOT NULL")
    best = F.max("score").over(Window.partitionBy("key"))
    return s.withColumn("best", best).where("score = best").select("key", "target", "score")


def match_rpcs(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """(key, target): equal methods whatever their case, and equal short service names unless the consumer's is unknown."""
    def parts(df: DataFrame, name: str) -> DataFrame:
        service = F.when(F.instr("key", "/") > 0, F.regexp_replace("key", "/[^/]*$", "")).otherwise("")
        return df.select(F.col("key").alias(name), F.lower(F.substring_index("key", "/", -1)).alias("m"), F.substring_index(service, ".", -1).alias(f"{name}_s")).distinct()

    return parts(consumers, "key").join(parts(providers, "target"), "m").where((F.col("key_s").isin("", "{}")) | (F.col("key_s") == F.col("target_s"))).select("key", "target")


def match_globs(dynamic: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, key, target): dynamic keys of topics, tables and so on against literal ones; they meet by kind and the text before the first ``{}``, 4 characters at most."""
    d = dynamic.select("kind", "key", F.substring(F.substring_index("key", "{}", 1), 1, 4).alias("pre")).distinct()
    k = known.where(~F.col("key").contains("{}")).select("kind", F.col("key").alias("target")).distinct()
    k = k.withColumn("pre", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(4), F.length("target"))), lambda n: F.substring(F.col("target"), F.lit(1), n))))
    return d.join(k, ["kind", "pre"]).where(K.glob_fits(F.col("target"), F.col("key"))).select("kind", "key", "target").distinct()


def resolve(extractions: DataFrame, known: DataFrame, *, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(kind, key, target, how, resolution): exact, then pattern, then without a path prefix, suffix for RPC, glob for other dynamic keys; none keeps its own key."""
    e = extractions.select("kind", "key", "dynamic").groupBy("kind", "key").agg(F.max("dynamic").alias("dynamic"))
    exact = e.join(known.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("kind", "key", F.col("key").alias("target"), F.lit("exact").alias("how"))
    rest = e.join(exact.select("kind", "key"), ["kind", "key"], "left_anti")
    ends, known_ends = rest.where("kind = 'endpoint'"), known.where("kind = 'endpoint'")
    found = match_endpoints(ends, known_ends).select(F.lit("endpoint").alias("kind"), "key", "target", F.lit("pattern").alias("how"))
    for prefix in prefixes:
        left = ends.join(found.select("key"), "key", "left_anti").withColumn("cut", F.regexp_replace("key", f"^(\\S+ ){prefix.rstrip('/')}(?=/)", "$1")).where("cut <> key")
        got = match_endpoints(left.select(F.col("cut").alias("key")), known_ends).withColumnRenamed("key", "cut")
        found = found.unionByName(left.join(got, "cut").select("kind", "key", "target", F.lit("prefix").alias("how")))
    rpc = match_rpcs(rest.where("kind = 'rpc'"), known.where("kind = 'rpc'")).select(F.lit("rpc").alias("kind"), "key", "target", F.lit("suffix").alias("how"))
    glob = match_globs(rest.where("kind NOT IN ('endpoint', 'rpc') AND key LIKE '%{}%'"), known).select("kind", "key", "target", F.lit("glob").alias("how"))
    hits = exact.unionByName(found).unionByName(rpc).unionByName(glob)
    n = hits.groupBy("kind", "key").agg(F.count("*").alias("n"))
    some = hits.join(n, ["kind", "key"]).select("kind", "key", "target", "how", F.when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("resolution"))
    none = e.join(n, ["kind", "key"], "left_anti").select("kind", "key", F.col("key").alias("target"), F.lit("none").alias("how"), F.when(F.col("dynamic"), "unresolved").otherwise("resolved").alias("resolution"))
    return some.unionByName(none)


# table operations: (project, path, line, table, op, column, new_name)


def schema_history(ops: DataFrame) -> DataFrame:
    """(database, table, version, project, path, columns, added, dropped): the shape of each table after each migration file that touches it.

    A rename moves columns between tables, so one fold sees a database's
    operations in order; ``database`` is a column of ``ops`` and its groups are
    independent.
    """
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(late=p["op"] != "create").sort_values(["project", "path", "line", "table", "late", "op", "column"], na_position="first")  # on one line a table is created first
        columns: dict[str, set] = {}
        added: dict[str, set] = {}
        dropped: dict[str, bool] = {}
        count: dict[str, int] = {}
        out = []
        for (project, path), file in p.groupby(["project", "path"], sort=False):
            created, touched = set(), set()
            for r in file.itertuples():
                t, c, new = r.table, r.column.lower() if isinstance(r.column, str) else None, r.new_name.lower() if isinstance(r.new_name, str) else None
                cols = columns.setdefault(t, set())
                touched.add(t)
                if r.op == "create":
                    if t not in created:
                        created.add(t)
                        cols.clear()
                        added[t], dropped[t] = set(), False
                    cols |= {c} - {None}
                elif r.op == "add_column" and c:
                    cols.add(c)
                    added.setdefault(t, set()).add(c)
                elif r.op == "drop_column" and c:
                    cols.discard(c)
                    added.setdefault(t, set()).discard(c)
                elif r.op == "rename_column" and c and new:
                    for s in (cols, added.setdefault(t, set())):
                        if c in s:
                            s.remove(c)
                            s.add(new)
                elif r.op == "drop_table":
                    cols.clear()
                    added[t], dropped[t] = set(), True
                elif r.op == "rename_table" and new:
                    columns[new], columns[t] = set(cols), set()
                    added[new], added[t] = added.get(new, set()) | added.get(t, set()), set()
                    dropped[t] = True
                    touched.add(new)
            for t in sorted(touched):
                count[t] = count.get(t, 0) + 1
                out.append((p["database"].iloc[0], t, count[t], project, path, sorted(columns.get(t, ())), sorted(added.get(t, ())), dropped.get(t, False)))
        return pd.DataFrame(out, columns=["database", "table", "version", "project", "path", "columns", "added", "dropped"])

    return ops.groupBy("database").applyInPandas(fold, "database string, table string, version bigint, project string, path string, columns array<string>, added array<string>, dropped boolean")


def built_against(entities: DataFrame, history: DataFrame) -> DataFrame:
    """(entity, version): the newest version that has all mapped columns and whose columns added until then are all mapped."""
    w = Window.partitionBy("database", "table").orderBy("version")
    h = history.withColumn("first", F.first("columns").over(w)).withColumn("before", F.lag("columns").over(w))
    new = F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array_except("columns", "before"))
    h = h.withColumn("grown", F.flatten(F.collect_list(new).over(w)))
    ok = (F.size(F.array_except("mapped", "columns")) == 0) & (F.size(F.array_except(F.array_intersect("grown", "columns"), F.col("mapped"))) == 0)
    return entities.join(h, ["database", "table"]).groupBy("entity").agg(F.max(F.when(ok, F.col("version"))).alias("version"))


def entity_mismatch(entities: DataFrame, history: DataFrame) -> DataFrame:
    """(code, entity, detail): an entity maps a dropped table, unknown columns, or misses added ones."""
    last = history.groupBy("database", "table").agg(F.max_by(F.struct("columns", "added", "dropped"), "version").alias("t")).select("database", "table", "t.*")
    j = entities.where(F.size("mapped") > 0).join(last, ["database", "table"])
    unknown, missing = F.array_sort(F.array_except("mapped", "columns")), F.array_sort(F.array_except(F.array_intersect("added", "columns"), F.col("mapped")))
    detail = F.when(F.col("dropped"), "dropped").when(F.size(unknown) + F.size(missing) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, ","), F.lit(" missing:"), F.array_join(missing, ",")))
    return j.select(F.lit("link.migration_entity_mismatch").alias("code"), "entity", detail.alias("detail")).where("detail IS NOT NULL")


def documentation(served: DataFrame, documented: DataFrame) -> DataFrame:
    """(code, project, key): endpoints that a covering document leaves out, and documented ones that no covered service has.

    served: (project, key); documented: (doc, stem, key).  A document covers a
    service by its name or by one endpoint in common; methods fit if equal or ``*``.
    """
    split = lambda df: df.withColumns({"m": K.method_of(F.col("key")), "p": F.regexp_replace("key", r"^\S+ ", "")})
    s, d = split(served).distinct(), split(documented).distinct()
    fit = lambda a, b: (F.col(f"{a}.m") == F.col(f"{b}.m")) | (F.col(f"{a}.m") == "*") | (F.col(f"{b}.m") == "*")
    common = s.alias("s").join(d.alias("d"), F.col("s.p") == F.col("d.p")).where(fit("s", "d"))
    covers = common.select(F.col("s.project").alias("project"), F.col("d.doc").alias("doc")).unionByName(s.select("project").distinct().join(d.select(F.col("stem").alias("project"), "doc").distinct(), "project")).distinct()
    held = common.join(covers.alias("c"), (F.col("s.project") == F.col("c.project")) & (F.col("d.doc") == F.col("c.doc")), "left_semi")
    undocumented = s.join(covers.select("project").distinct(), "project", "left_semi").join(held.select(F.col("s.project").alias("project"), F.col("s.key").alias("key")), ["project", "key"], "left_anti")
    missing = d.join(covers.select("doc").distinct(), "doc", "left_semi").join(held.select(F.col("d.doc").alias("doc"), F.col("d.key").alias("key")), ["doc", "key"], "left_anti")
    return undocumented.select(F.lit("link.endpoint_undocumented").alias("code"), "project", "key").unionByName(missing.select(F.lit("link.endpoint_unimplemented").alias("code"), F.col("doc").alias("project"), "key"))


def fold_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def consumer_fields(topics: DataFrame, consumers: DataFrame, shapes: DataFrame) -> DataFrame:
    """(topic, project, symbol, unknown): fields that a consumer's payload type reads and the schema lacks.

    topics: (topic, fields); consumers: (topic, project); shapes: (project, symbol, fields).
    """
    # What a payload type's name may add to the topic's.
    ends = ("", "event", "payload", "message", "data", "v1", "v2", "v3")
    t = topics.withColumns({"schema": F.transform("fields", fold_name), "name": F.explode(F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(fold_name(F.col("topic")), e)))}).drop("fields")
    s = shapes.withColumn("name", fold_name(F.regexp_extract("symbol", r"([^.:]*)$", 1)))
    j = t.join(consumers, "topic").join(s, ["project", "name"])
    unknown = F.filter("fields", lambda f: ~F.array_contains("schema", fold_name(f)))
    return j.select("topic", "project", "symbol", F.array_sort(unknown).alias("unknown")).where(F.size("unknown") > 0)


def without_provider(edges: DataFrame) -> DataFrame:
    """Endpoint keys that are consumed and neither exposed nor defined.  edges: (kind, key)."""
    g = edges.groupBy("key").agg(F.max((F.col("kind") == "consumes").cast("int")).alias("c"), F.max(F.col("kind").isin("exposes", "defines").cast("int")).alias("p"))
    return g.where("c = 1 AND p = 0").select(F.lit("link.endpoint_without_provider").alias("code"), "key")


def doc_drift(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Code spans of documents (doc, span) that name nothing known (name) any more."""
    return spans.distinct().join(known.select(F.col("name").alias("span")), "span", "left_anti").select("doc", "span")


def catalogue(contracts: DataFrame, *, query: str | None = None, only_drift: bool = False, limit: int = 100) -> DataFrame:
    """(kind, key, producers, consumers, drift, more_available): contracts whose key holds the query; one more row than the limit tells of more.

    contracts: (kind, key, role, party, schema_hash).
    """
    c = contracts if query is None else contracts.where(F.lower("key").contains(query.lower()))
    side = lambda r: F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("party"))))
    hashes = lambda r: F.collect_set(F.when(F.col("role") == r, F.col("schema_hash")))
    g = c.groupBy("kind", "key").agg(side("producer").alias("producers"), side("consumer").alias("consumers"), hashes("producer").alias("_p"), hashes("consumer").alias("_c"))
    g = g.withColumn("drift", (F.size("_p") > 0) & (F.size(F.array_except("_c", "_p")) > 0)).drop("_p", "_c")
    g = (g.where("drift") if only_drift else g).orderBy("kind", "key").limit(limit + 1)
    w = Window.orderBy("kind", "key")  # limit + 1 rows at most
    return g.withColumns({"n": F.row_number().over(w), "more_available": F.count("*").over(Window.partitionBy()) > limit}).where(F.col("n") <= limit).drop("n")


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result a row as JSON.  findings: (code, severity, message, path, line)."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    mark = F.struct(F.sha2(F.concat_ws("|", "code", "path", "message"), 256).alias("primary/v1"))
    return findings.select(F.to_json(F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), mark.alias("partialFingerprints"))).alias("value"))
