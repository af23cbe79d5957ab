"""Property-graph operators: walks, impact, flow, insights, contract parties.

Frontiers are DataFrames; a level is one join.  Levels are cut in the shared
checkpoint folder so that plans stay small.  The edges are not: a level asks for
those at its frontier (``touching``), which goes down to their scan.  Edges: (src, dst, kind, ev, res)
with ``ev`` the rank of the evidence (0 is strongest) and ``res`` 0 resolved,
1 ambiguous, 2 unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

MAX_DEPTH = 8
BROADCAST_NODES = 200_000  # of a frontier that is sent to every executor
INCOMING = ("calls", "references", "implements", "imports", "depends_on", "consumes", "reads", "writes", "produces", "exposes", "tests", "documents", "decides")
PROVIDER = ("exposes", "produces", "writes")


def edge_filter(edges: DataFrame, *, kinds: tuple[str, ...] = (), max_ev: int | None = None, excluded_ev: tuple[int, ...] = (), ambiguous: bool = True, unresolved: bool = False) -> DataFrame:
    e = edges.where(F.col("kind").isin(list(kinds))) if kinds else edges
    e = e if max_ev is None else e.where(F.col("ev") <= max_ev)
    e = e.where(~F.col("ev").isin(list(excluded_ev))) if excluded_ev else e
    e = e if ambiguous else e.where("res <> 1")
    return e if unresolved else e.where("res <> 2")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: a union of two equi joins later on, never an OR."""
    return edges.select("src", "dst", "id").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id"))


def touching(edges: DataFrame, nodes: DataFrame, n: int, end: str) -> DataFrame:
    """Edges with their ``end`` (src or dst) among the ``n`` rows of ``nodes`` (node).

    Up to ``BROADCAST_NODES`` are broadcast, and the optimizer carries the semi
    join below unions and aggregates to the scans: other edges are never
    grouped, shuffled or written.  A larger frontier is joined by a shuffle.
    """
    at = nodes.select(F.col("node").alias("_at")).distinct()
    return edges.join(F.broadcast(at) if n <= BROADCAST_NODES else at, F.col(end) == F.col("_at"), "left_semi")


def walk_edges(edges: DataFrame, start: DataFrame, depth: int, *, direction: str = "out", limit: int | None = None) -> DataFrame:
    """(id, depth): edges on a path of at most ``depth`` steps from ``start`` (node), each at its least depth.

    A path may not visit a node twice; since a shortest way never does, the
    least depth is found without paths: nodes at their first level are enough.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError("depth is 1 to 8")
    edges = edges.select("src", "dst", "id")
    front = cut(start.select("node").distinct())
    n = front.count()
    seen, out = front, None
    for d in range(1, depth + 1):
        ahead, back = touching(edges, front, n, "src"), touching(edges, front, n, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id")
        e = ahead if direction == "out" else back if direction == "in" else ahead.unionByName(back)
        step = cut(e.select("id", "dst", F.lit(d).alias("depth")))
        out = step.select("id", "depth") if out is None else out.unionByName(step.select("id", "depth"))
        front = cut(step.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        n = front.count()
        if not n:
            break
        seen = seen.unionByName(front)
    out = out.groupBy("id").agg(F.min("depth").alias("depth"))
    return out if limit is None else out.orderBy("depth", "id").limit(limit)


def bfs(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth, parent): shortest distance, and the smallest parent on a shortest way."""
    front = cut(start.select("node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")))
    n = front.count()
    seen = front
    edges = edges.select("src", "dst")
    for d in range(1, depth + 1):
        step = cut(touching(edges, front, n, "src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"))
        n = front.count()
        if not n:
            break
        seen = seen.unionByName(front)
    return seen


def round_robin(edges: DataFrame, *order: Column, by: str = "src", kind: str = "kind") -> DataFrame:
    """Fan-out that takes a node's edge kinds in turn."""
    n = Window.partitionBy(by, kind).orderBy(*order)
    return edges.withColumn("turn", F.row_number().over(n)).withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("turn", kind, *order)))


def best_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: strongest evidence, best resolution, kind, id."""
    w = Window.partitionBy("src", "dst").orderBy("ev", "res", "kind", "id")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def impact_steps(into: DataFrame, out_of: DataFrame) -> DataFrame:
    """(at, to, ..., forward): how a change moves: to the source of an edge ``into`` it, and for providers to the target of one ``out_of`` it too."""
    back = into.where(F.col("kind").isin(list(INCOMING))).select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind", "ev", "res", "id", F.lit(False).alias("forward"))
    return back.unionByName(out_of.where(F.col("kind").isin(list(PROVIDER))).select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind", "ev", "res", "id", F.lit(True).alias("forward")))


def impact(edges: DataFrame, start: DataFrame, depth: int = 4, *, terminal_kinds: tuple[str, ...] = ("tests", "documents", "decides"), terminal: DataFrame | None = None) -> DataFrame:
    """(node, weakest, flagged, hops, max_res, via): what a change reaches, by its best path, and what carries it.

    Paths compare by (weakest evidence, flagged hops, hops, edge ids).  A change
    that came to something by its provider goes on to those who use it, not to
    its other providers.  Tests, documents and decisions are not gone on from:
    what a terminal kind of edge comes from, and the nodes of ``terminal`` (node).
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError("depth is 1 to 8")
    kind = edges.schema["id"].dataType.simpleString()
    best = start.select("node", F.lit(0).alias("weakest"), F.lit(0).alias("flagged"), F.lit(0).alias("hops"), F.lit(0).alias("max_res"), F.array().cast(f"array<{kind}>").alias("via"), F.lit(False).alias("provided"), F.lit(False).alias("ends"))
    front, size = best, start.count()
    for _ in range(depth):
        on = front.where("NOT ends")
        steps = cut(impact_steps(touching(edges, on, size, "dst"), touching(edges, on, size, "src")))
        s = steps.join(front.where("NOT ends"), steps["at"] == front["node"]).where(~(F.col("provided") & ~F.col("forward") & F.col("kind").isin(list(PROVIDER))))
        n = s.select(F.col("to").alias("node"), F.greatest("weakest", "ev").alias("weakest"), (F.col("flagged") + ((F.col("ev") >= 3) | (F.col("res") > 0)).cast("int")).alias("flagged"), (F.col("hops") + 1).alias("hops"),
                     F.greatest("max_res", "res").alias("max_res"), F.concat("via", F.array("id")).alias("via"), F.col("forward").alias("provided"), (F.col("kind").isin(list(terminal_kinds)) & ~F.col("forward")).alias("ends"))
        key = F.struct("weakest", "flagged", "hops", "via")
        n = n.groupBy("node").agg(F.min_by(F.struct(*[c for c in n.columns if c != "node"]), key).alias("b")).select("node", "b.*")
        if terminal is not None:
            n = n.join(terminal.select("node", F.lit(True).alias("_end")).distinct(), "node", "left").withColumn("ends", F.col("ends") | F.coalesce("_end", F.lit(False))).drop("_end")
        both = best.withColumn("_old", F.lit(1)).unionByName(n.withColumn("_old", F.lit(0)))
        new = cut(both.groupBy("node").agg(F.min_by(F.struct(*[c for c in both.columns if c != "node"]), F.struct("weakest", "flagged", "hops", "via", F.col("_old") * -1)).alias("b")).select("node", "b.*"))
        front, best = new.where("_old = 0").drop("_old"), new.drop("_old")
        size = front.count()
        if not size:
            break
    return best.where("hops > 0").drop("ends", "provided")


def risk() -> Column:
    """unknown, low, medium or high of an impact row; evidence: 0 precise, 1 contract, 2 syntactic, 3 heuristic."""
    return F.when(F.col("max_res") == 2, "unknown").when((F.col("max_res") == 1) | (F.col("weakest") >= 3), "low").when((F.col("weakest") == 2) | (F.col("hops") > 2), "medium").otherwise("high")


def impact_by_project(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, n, risk): the worst first, nodes without a project last."""
    level = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 2).otherwise(3)
    g = found.join(nodes, "node", "left").groupBy("project").agg(F.count("*").alias("n"), F.min(level).alias("level"))
    return g.select("project", "n", F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "unknown"))), F.col("level") + 1).alias("risk")).orderBy(F.col("project").isNull(), "level", "project")


def flow(edges: DataFrame, start: DataFrame, goal: DataFrame | None, depth: int, n: int) -> DataFrame:
    """(path, ids, weakest, flagged, hops): the best ``n`` simple paths, to ``goal`` (node) if given.

    All simple paths of ``depth`` steps are followed except those that can no
    longer be among the best ``n`` found, whose key only grows.
    """
    kind, ids = edges.schema["src"].dataType.simpleString(), edges.schema["id"].dataType.simpleString()
    front = start.select(F.array(F.col("node").cast(kind)).alias("path"), F.array().cast(f"array<{ids}>").alias("ids"), F.lit(0).alias("weakest"), F.lit(0).alias("flagged"), F.lit(0).alias("hops"))
    done, goal = None, goal if goal is None else goal.select(F.col("node").alias("at")).distinct()
    order = ("weakest", "flagged", "hops", "ids")
    for _ in range(depth):
        ends = cut(front.select(F.element_at("path", -1).alias("node")).distinct())
        e = cut(best_parallel(touching(edges, ends, ends.count(), "src")).select("src", "dst", "ev", "res", "id"))  # all edges of a pair have its source
        j = front.withColumn("at", F.element_at("path", -1)).join(e, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = cut(j.select(F.concat("path", F.array("dst")).alias("path"), F.concat("ids", F.array("id")).alias("ids"), F.greatest("weakest", "ev").alias("weakest"), (F.col("flagged") + ((F.col("ev") >= 3) | (F.col("res") > 0)).cast("int")).alias("flagged"), (F.col("hops") + 1).alias("hops")))
        hit = front if goal is None else front.withColumn("at", F.element_at("path", -1)).join(goal, "at", "left_semi").drop("at")
        done = hit if done is None else done.unionByName(hit)
        done = cut(done.orderBy(*order).limit(n))
        if goal is not None:
            front = front.withColumn("at", F.element_at("path", -1)).join(goal, "at", "left_anti").drop("at")
            worst = done.agg(F.count("*").alias("c"), F.max(F.struct("weakest", "flagged")).alias("w")).first()
            if worst["c"] == n:
                front = front.where((F.col("weakest") < worst["w"]["weakest"]) | ((F.col("weakest") == worst["w"]["weakest"]) & (F.col("flagged") <= worst["w"]["flagged"])))
        if front.isEmpty():
            break
    return done.orderBy(*order)


def apply_delta(edges: DataFrame, delta: DataFrame, removed: DataFrame, *, project: str, generation: int, current: int) -> DataFrame:
    """Edges with a project's delta; a generation older than the current one is refused and changes nothing."""
    if generation < current:
        return edges
    key = ["src", "dst", "kind"]
    mine = edges.where(F.col("project") == project)
    kept = mine.join(removed.select(*key), key, "left_anti").join(delta.select(*key), key, "left_anti")
    return edges.where(F.col("project") != project).unionByName(kept).unionByName(delta.withColumn("project", F.lit(project)))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for (src, dst, kind): strongest evidence, best resolution, all evidence references."""
    return edges.groupBy("src", "dst", "kind").agg(F.min("ev").alias("ev"), F.min("res").alias("res"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def unused(providers: DataFrame, consumers: DataFrame, key: str = "key") -> DataFrame:
    """Keys that are provided and never consumed."""
    return providers.select(key).distinct().join(consumers.select(key), key, "left_anti")


def drift(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(key, consumer, provided, used): a consumer's schema hash differs from every provider's; an unknown hash is no drift."""
    p = providers.where("schema_hash IS NOT NULL").groupBy("key").agg(F.collect_set("schema_hash").alias("provided"))
    c = consumers.where("schema_hash IS NOT NULL").select("key", "consumer", F.col("schema_hash").alias("used"))
    return c.join(p, "key").where(~F.array_contains("provided", F.col("used"))).select("key", "consumer", F.array_sort("provided").alias("provided"), "used")


def missing_locales(keys: DataFrame, locales: list[str] | None = None) -> DataFrame:
    """(project, key, missing): locales that other keys of the project have and this one lacks."""
    every = keys.groupBy("project").agg(F.collect_set("locale").alias("every")) if locales is None else keys.select("project").distinct().withColumn("every", F.array(*map(F.lit, locales)))
    own = keys.groupBy("project", "key").agg(F.collect_set("locale").alias("own"))
    return own.join(every, "project").select("project", "key", F.array_sort(F.array_except("every", "own")).alias("missing")).where(F.size("missing") > 0)


def parties(contracts: DataFrame, pins: DataFrame) -> DataFrame:
    """Producers and consumers of each contract at pins, sorted."""
    from tessera.operators.versioned import as_of

    c = as_of(contracts, pins)
    side = lambda r: F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("party"))))
    return c.groupBy("kind", "key").agg(side("producer").alias("producers"), side("consumer").alias("consumers"))


def module_rollup(edges: DataFrame, module: Column, other: Column) -> DataFrame:
    """(module, other, n): distinct pairs of files that link two modules."""
    return edges.select(module.alias("module"), other.alias("other"), "src", "dst").where("module <> other").distinct().groupBy("module", "other").agg(F.count("*").alias("n"))
