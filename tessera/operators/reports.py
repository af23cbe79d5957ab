"""Catalogue and report operators: top languages, switch estimates, per-source ranks, symbol lookup, insights, groups of views, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def top_languages(files: DataFrame, n: int = 5) -> DataFrame:
    """(project, language, n, rank): the languages of a project with most files, plain text left out."""
    g = files.where(F.col("language").isNotNull() & (F.col("language") != "text")).groupBy("project", "language").agg(F.count("*").alias("n"))
    w = Window.partitionBy("project").orderBy(F.desc("n"), "language")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def switch_estimate(chunks: DataFrame, done: DataFrame, *, dims: int, usd_per_million: float) -> DataFrame:
    """(chunks, tokens, usd, disk_bytes) that a new embedding profile costs for what it does not hold yet.  chunks: (hash, bytes); done: (hash)."""
    left = chunks.join(done.select("hash"), "hash", "left_anti")
    return left.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.ceil(F.col("bytes") / 4)), F.lit(0)).cast("long").alias("tokens")).select(
        "chunks", "tokens", F.round(F.col("tokens") * usd_per_million / 1e6, 6).alias("usd"), (F.col("chunks") * dims * 2).alias("disk_bytes"))


def rank_and_limit(candidates: DataFrame, per_project: int, n: int) -> DataFrame:
    """(project, location, id, score, rank): a location once, by its best candidate; ``per_project`` of a project, ``n`` in all, ranks without gaps."""
    best = candidates.groupBy("project", "location").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("b")).select("project", "location", "b.id", "b.score")
    w = Window.partitionBy("project").orderBy(F.desc("score"), "location", "id")
    some = best.withColumn("_q", F.row_number().over(w)).where(F.col("_q") <= per_project).drop("_q")
    top = some.orderBy(F.desc("score"), "location", "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "location", "id")))  # n rows


def find_symbols(symbols: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Symbols by qualified name, then by name, then by the end of a qualified name."""
    how = F.when(F.col("symbol") == term, 0).when(F.substring_index("symbol", ".", -1) == term, 1).when(F.col("symbol").endswith("." + term), 2)
    return symbols.withColumn("how", how).where("how IS NOT NULL").orderBy("how", "symbol", "path").limit(limit)


# Insight code -> (contract kind, edge kind that is there, edge kinds one of which is missing, severity).
INSIGHTS = {
    "graph.endpoint_without_client": ("endpoint", ("exposes",), ("consumes",), "info"),
    "graph.topic_without_consumer": ("topic", ("produces",), ("consumes",), "warning"),
    "graph.topic_without_producer": ("topic", ("consumes", "defines"), ("produces",), "warning"),
    "graph.table_never_read": ("table", ("writes", "defines"), ("reads",), "info"),
    "graph.i18n_key_undefined": ("i18n", ("references",), ("defines",), "error"),
    "graph.i18n_key_unused": ("i18n", ("defines",), ("references",), "info"),
    "graph.env_undeclared": ("env", ("reads",), ("defines",), "warning"),
}


def insights(edges: DataFrame) -> DataFrame:
    """(code, severity, key): contracts that have one kind of edge and lack another.  edges: (contract_kind, key, kind); one aggregate answers all codes."""
    g = edges.groupBy("contract_kind", "key").agg(F.collect_set("kind").alias("kinds"))
    has = lambda ks: F.arrays_overlap("kinds", F.array(*map(F.lit, ks)))
    found = [F.when((F.col("contract_kind") == k) & has(there) & ~has(lacks), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (k, there, lacks, severity) in INSIGHTS.items()]
    return g.select("key", F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.code", "i.severity", "key")


def groups(views: DataFrame, *keys: str, rounds: int = 32) -> DataFrame:
    """(view, component): views that share a value of any key, directly or by others; the smallest view names them.

    Minimum labels go from views to values and back; both sides are grouped
    aggregates, so a value that many views share sends one row a task.
    """
    pairs = None
    for k in keys:
        p = views.where(F.col(k).isNotNull()).select("view", F.concat_ws("=", F.lit(k), F.col(k).cast("string")).alias("value"))
        pairs = p if pairs is None else pairs.unionByName(p)
    pairs = cut(pairs.distinct())
    label = views.select("view", F.col("view").alias("component")).distinct()
    for _ in range(rounds):
        of_value = pairs.join(label, "view").groupBy("value").agg(F.min("component").alias("c"))
        better = pairs.join(of_value, "value").groupBy("view").agg(F.min("c").alias("c"))
        new = cut(label.join(better, "view", "left").select("view", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved")))
        label = new.select("view", "component")
        if new.where("moved").isEmpty():
            return label
    raise RuntimeError("groups did not settle")


def explain_empty(states: DataFrame) -> DataFrame:
    """(reason) why a query has no result.  states: (source, state, candidates, rejected) of each source that was asked."""
    s = states.agg(F.count(F.when(F.col("state") == "answered", 1)).alias("answered"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("c"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("r"))
    return s.select(F.when((F.col("answered") == 0) & (F.col("failed") > 0), "all_sources_failed").when(F.col("answered") == 0, "no_source_consulted").when((F.col("c") > 0) & (F.col("c") == F.col("r")), "everything_out_of_scope").when(F.col("failed") > 0, "partial_absence").otherwise("absent").alias("reason"))


def inspect_links(links: DataFrame, limit: int) -> DataFrame:
    """(symbol, facet, path, start, rank, omitted): a place once, strongest evidence first, ``limit`` a facet and how many more there are."""
    once = Window.partitionBy("symbol", "facet", "path", "start", "is_import").orderBy("ev", "res")
    facet = Window.partitionBy("symbol", "facet")
    order = facet.orderBy("ev", "res", "path", "start")
    d = links.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    d = d.withColumns({"rank": F.row_number().over(order), "omitted": F.greatest(F.count("*").over(facet) - limit, F.lit(0))})
    return d.where(F.col("rank") <= limit).select("symbol", "facet", "path", "start", "rank", "omitted")


def matches(column: Column, wanted: object | None) -> Column:
    """An optional filter: nothing asked for is no filter."""
    return F.lit(True) if wanted is None else column == F.lit(wanted)


def list_audit(audit: DataFrame, *, actor: str | None = None, action: str | None = None, before: tuple | None = None, limit: int = 100) -> DataFrame:
    """A page of the audit log, newest first, behind (at, id)."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    a = audit.where(matches(F.col("actor"), actor) & matches(F.col("action"), action))
    if before is not None:
        at, key = F.lit(before[0]), F.lit(before[1])
        a = a.where((F.col("at") < at) | ((F.col("at") == at) & (F.col("id") < key)))
    return a.orderBy(F.desc("at"), F.desc("id")).limit(limit)
