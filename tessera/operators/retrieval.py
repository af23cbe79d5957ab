"""Retrieval: BM25, exact and vector candidates, fusion, quotas, overlap, expansion, packing, metrics.

Candidates are rows (source, query, location columns, source_rank, raw_score).
Every ranking has a total order, so results do not depend on partitioning.
Filters come before quotas and limits.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut

K1, B, PATH_BOOST = 1.2, 0.75, 1.5


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, term, tf, len) of an inverted index."""
    t = docs.select(F.col(id_col).alias("id"), tokens.alias("t"))
    return t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: list[str], *, body: Column, path: Column | None = None, id_col: str = "doc_id", coordination: float = 1.0) -> DataFrame:
    """(id, score, matched_terms): OR of the distinct terms over the body and, boosted, the path.

    Only asked terms leave the scan: term frequencies are counted inside each
    row's array, so nothing but matches is shuffled.  N, df and the average
    length are of each field, from one aggregate whose single row becomes literals.
    """
    terms = list(dict.fromkeys(terms))
    fields = [("body", body, 1.0)] + ([("path", path, PATH_BOOST)] if path is not None else [])
    d = docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c, _ in fields])
    asked = [F.lit(t) for t in terms]
    # the long arrays are read once; what is counted a term at a time holds asked terms only
    d = d.select("id", *[F.size(n).alias(f"{n}_len") for n, _, _ in fields], *[F.filter(n, lambda x: x.isin(asked)).alias(n) for n, _, _ in fields])
    cols = {f"{n}_len": F.col(f"{n}_len") for n, _, _ in fields}
    for n, _, _ in fields:
        for i, term in enumerate(terms):
            cols[f"{n}_{i}"] = F.size(F.array_compact(F.transform(n, _equal(term))))
    # statistics and scores both need these few numbers a row: texts are tokenised once for them
    tf = cut(d.select("id", *[c.alias(k) for k, c in cols.items()]))
    stats = tf.agg(F.count("*").alias("n"), *[F.avg(f"{n}_len").alias(f"{n}_avg") for n, _, _ in fields], *[F.sum((F.col(f"{n}_{i}") > 0).cast("long")).alias(f"{n}_df_{i}") for n, _, _ in fields for i in range(len(terms))])
    hits = tf.where(" OR ".join(f"{n}_{i} > 0" for n, _, _ in fields for i in range(len(terms))) or "false")
    known = stats.first().asDict()  # one row, whatever the corpus
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        seen = F.lit(False)
        for n, _, boost in fields:
            f, df = F.col(f"{n}_{i}"), F.lit(known[f"{n}_df_{i}"] or 0)
            idf = F.log(1 + (F.lit(known["n"]) - df + 0.5) / (df + 0.5))
            norm = K1 * (1 - B + B * F.col(f"{n}_len") / F.lit(known[f"{n}_avg"] or 1.0))
            score = score + F.when(f > 0, boost * idf * f * (K1 + 1) / (f + norm)).otherwise(0.0)
            seen = seen | (f > 0)
        matched = matched + seen.cast("int")
    return hits.select("id", (score * F.pow(matched / len(terms), F.lit(coordination))).alias("score"), matched.alias("matched_terms"))


def _equal(term: str):
    return lambda x: F.when(x == F.lit(term), F.lit(1))


def grep(docs: DataFrame, words: list[str], text: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_total): distinct words found, and all their occurrences, as plain text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = [(F.length("l") - F.length(F.replace(F.col("l"), F.lit(w), F.lit("")))) / len(w) for w in words]
    d = docs.select(F.col(id_col).alias("id"), low.alias("l"))
    return d.select("id", sum(((x > 0).cast("int") for x in n), F.lit(0)).alias("n_words"), sum((x for x in n), F.lit(0)).cast("long").alias("n_total")).where("n_words > 0")


def ranked(df: DataFrame, *order: Column, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``n`` rows with their ranks: only they meet in one task."""
    return ranked(df.orderBy(*order).limit(n), *order, name=name)


def symbol_strength(local: Column, name: Column, term: str) -> Column:
    t = term.strip().replace("::", ".").replace("#", ".")
    qualified = "." in t
    out = F.when(local == t, 6)
    if qualified:
        out = out.when(local.endswith(f".{t}"), 5)
    out = out.when(F.lower(local) == t.lower(), 4)
    return out if qualified else out.when(name == t, 3).when(F.lower(name) == t.lower(), 2)


def path_strength(path: Column, term: str) -> Column:
    t = term[2:] if term.startswith("./") else term
    out = F.when(path == t, 6)
    return out.when(path.endswith(f"/{t}"), 5) if "/" in t else out.when(F.substring_index(path, "/", -1) == t, 3)


def contract_match(key: Column, term: str) -> Column:
    """Strength 7 where the key, or the route behind its method, is the term, whatever its case."""
    return F.when((F.lower(key) == term.lower()) | (F.lower(F.substring_index(key, " ", -1)) == term.lower()), 7)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance): exact cosine distance, ties by id; vectors without a direction are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull()).where(dot(F.col("v"), F.col("v")) > 0)
    near = d.select("id", (1 - cosine(F.col("v"), q)).alias("distance")).orderBy("distance", "id").limit(k)
    return near.select("id", F.round("distance", 6).alias("distance"))


def rrf(lists: DataFrame, weights: dict[str, float], *, k: int = 60, by: tuple[str, ...] = (), id_col: str = "id") -> DataFrame:
    """Weighted reciprocal-rank fusion of (source, id, source_rank); order: score, number of sources, best rank, id."""
    w = F.create_map(*[x for s, v in weights.items() for x in (F.lit(s), F.lit(float(v)))])
    g = lists.groupBy(*by, id_col).agg(F.sum(F.coalesce(w[F.col("source")], F.lit(0.0)) / (k + F.col("source_rank"))).alias("score"),
                                       F.count_distinct("source").alias("n_sources"), F.min("source_rank").alias("best_rank"))
    # equal sums in another order differ in the last bits only
    g = g.withColumn("score", F.round("score", 12))
    return ranked(g, F.desc("score"), F.desc("n_sources"), F.asc("best_rank"), F.asc(id_col), by=by)


def source_quota(df: DataFrame, quota: int, *order: Column, by: tuple[str, ...] = ("source", "project")) -> DataFrame:
    """The first ``quota`` candidates of each source and project."""
    return ranked(df, *order, by=by, name="_q").where(F.col("_q") <= quota).drop("_q")


def result_quota(df: DataFrame, quota: int, by: str = "project", rank: str = "rank") -> DataFrame:
    """Work-conserving: what is beyond a project's quota goes behind all the rest, nothing is dropped."""
    late = ranked(df, F.asc(rank), by=(by,), name="_q").withColumn("deferred", F.col("_q") > quota).drop("_q")
    return ranked(late, F.asc("deferred"), F.asc(rank), name="position")


def waves(df: DataFrame, file: str, *order: Column) -> DataFrame:
    """Round robin over files: every file's first span, then every second one."""
    w = ranked(df, *order, by=(file,), name="wave")
    return ranked(w, F.asc("wave"), *order, name="position")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def merge_overlaps(groups: DataFrame, *, by: str = "file") -> DataFrame:
    """Kept groups (file, start, end, score, n_merged): in order of score, a group joins the first kept one it overlaps.

    Sequential by meaning, so a file's rows meet in one task, sorted, and are
    folded as they stream by: many small files cost no more than their rows.
    """
    kind = groups.schema[by].dataType.simpleString()

    def fold(batches):
        file, kept = None, []
        for p in batches:
            out = []
            for f, start, end, score in zip(*[p[c].tolist() for c in (by, "start", "end", "score")]):
                if f != file:
                    out += [[file, *k] for k in kept]
                    file, kept = f, []
                k = next((x for x in kept if start <= x[1] and x[0] <= end), None)
                if k is None:
                    kept.append([start, end, score, 1])
                else:
                    k[2] += score
                    k[3] += 1
            yield pd.DataFrame(out, columns=[by, "start", "end", "score", "n_merged"])
        yield pd.DataFrame([[file, *k] for k in kept], columns=[by, "start", "end", "score", "n_merged"])

    ordered = groups.select(by, "start", "end", "score").repartition(by).sortWithinPartitions(by, F.desc("score"), "start", "end")
    return ordered.mapInPandas(fold, f"{by} {kind}, start bigint, end bigint, score double, n_merged bigint")


def overlap_keepers(groups: DataFrame, *order: Column, by: tuple[str, ...]) -> DataFrame:
    """``groups`` with (kept_start, kept_end): the first kept range of the file that a range overlaps, in order, else the range itself.

    A file's ranges come sorted, batch by batch; only its kept ranges are carried on.
    """

    def fold(batches):
        file, kept = object(), []
        for b in batches:
            found = []
            for f, start, end in zip(zip(*(b.column(c).to_pylist() for c in by)), b.column("start").to_pylist(), b.column("end").to_pylist()):
                if f != file:
                    file, kept = f, []
                at = next((x for x in kept if start <= x[1] and x[0] <= end), None)
                if at is None:
                    at = (start, end)
                    kept.append(at)
                found.append(at)
            ends = [pa.array([x[k] for x in found], b.schema.field(c).type) for k, c in enumerate(("start", "end"))]
            yield pa.RecordBatch.from_arrays([*b.columns, *ends], names=[*b.schema.names, "kept_start", "kept_end"])

    out = T.StructType([*groups.schema.fields, T.StructField("kept_start", groups.schema["start"].dataType), T.StructField("kept_end", groups.schema["end"].dataType)])
    return groups.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(fold, out)


FILE = ("project", "path", "view", "generation")


def fuse(candidates: DataFrame, pins: DataFrame, weights: dict[str, float], *, quota: int, declared: DataFrame | None = None, k: int = 60) -> DataFrame:
    """The fused shortlist (project, path, view, generation, start, end, score, n_sources, best_rank, n_merged, rank).

    In order: well-formed candidates of pinned views; base rows whose path the
    overlay has, or declares as changed, go; ``quota`` of each source and
    project; equal locations are one group; a group joins the best one of its
    file that it overlaps, each source with its best rank; all sorted anew.
    candidates: (source, id, project, path, view, generation, start, end,
    source_rank, raw_score); pins: (project, view, generation, layer), layer
    base or overlay, small; declared: (project, path).  A candidate without
    one of path, range, rank or a finite score is not well-formed.
    """
    c = candidates.where((F.col("source_rank") >= 1) & (F.col("path") != "") & (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.abs("raw_score") < float("inf")))
    c = c.join(pins.select("project", "view", "generation", "layer").distinct(), ["project", "view", "generation"])
    hides = c.where("layer = 'overlay'").select("project", "path")
    hides = hides if declared is None else hides.unionByName(declared.select("project", "path"))
    c = c.join(hides.distinct().withColumn("layer", F.lit("base")), ["project", "path", "layer"], "left_anti")
    c = source_quota(c, quota, F.asc("source_rank"), F.desc("raw_score"), *(F.asc(x) for x in (*FILE, "start", "end", "id")))
    place = (*FILE, "start", "end")
    weight = F.coalesce(F.create_map(*[x for n, v in weights.items() for x in (F.lit(n), F.lit(float(v)))])[F.col("source")], F.lit(0.0))
    total = (F.round(F.sum(weight / (k + F.col("r"))), 12).alias("score"), F.count("*").alias("n_sources"), F.min("r").alias("best_rank"))
    groups = c.groupBy(*place, "source").agg(F.min("source_rank").alias("r")).groupBy(*place).agg(*total, F.collect_list(F.struct("source", "r")).alias("hits"))
    best = (F.desc("score"), F.desc("n_sources"), F.asc("best_rank"))
    kept = overlap_keepers(groups, *best, F.asc("start"), F.asc("end"), by=FILE).select(*FILE, F.col("kept_start").alias("start"), F.col("kept_end").alias("end"), ((F.col("start") != F.col("kept_start")) | (F.col("end") != F.col("kept_end"))).cast("long").alias("m"), F.posexplode("hits").alias("at", "hit"))
    hits = kept.groupBy(*place, F.col("hit.source").alias("source")).agg(F.min("hit.r").alias("r"), F.sum(F.when(F.col("at") == 0, F.col("m")).otherwise(0)).alias("m"))
    return ranked(hits.groupBy(*place).agg(*total, F.sum("m").alias("n_merged")), *best, *(F.asc(x) for x in place))


def smallest_enclosing(spans: DataFrame, symbols: DataFrame, by: str = "file") -> DataFrame:
    """Of each span the symbol that holds it: fewest lines, then lowest start."""
    j = spans.alias("a").join(symbols.alias("b"), (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("b.end") >= F.col("a.end")))
    best = F.min_by(F.col("b.symbol"), F.struct((F.col("b.end") - F.col("b.start")), F.col("b.start"), F.col("b.symbol")))
    return j.groupBy(F.col(f"a.{by}").alias(by), F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(best.alias("symbol"))


def rerank(df: DataFrame, scores: DataFrame, n: int, id_col: str = "id", rank: str = "rank") -> DataFrame:
    """The first ``n`` by their new score, the others behind as they were; a missing or NaN score keeps its order last of the ``n``."""
    j = df.join(scores.select(id_col, F.when(~F.isnan("rerank_score"), F.col("rerank_score")).alias("rerank_score")), id_col, "left")
    inside = F.col(rank) <= n
    return ranked(j, F.desc(inside), F.when(inside, F.col("rerank_score")).desc_nulls_last(), F.asc(rank), name="position")


def overlap_score(query: list[str], tokens: Column) -> Column:
    """Shared query tokens over query tokens."""
    q = F.array(*[F.lit(t) for t in query])
    return F.size(F.array_intersect(q, tokens)) / F.lit(float(max(1, len(query))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def expand(seeds: DataFrame, edges: DataFrame, *, depth: int = 2, fan_out: int = 10, budget: int = 20, n_seeds: int = 5) -> DataFrame:
    """Neighbours (id, score, depth, via) of the best seeds: score falls by half a step, ``fan_out`` edges a node."""
    seeds = seeds.orderBy(F.desc("score"), "id").limit(n_seeds).select("id", "score", F.lit(0).alias("depth"), F.col("id").alias("via"))
    found, front = seeds, seeds
    e = ranked(edges.select("src", "dst", "rank"), F.asc("rank"), F.asc("dst"), by=("src",), name="_f").where(F.col("_f") <= fan_out).drop("_f", "rank")
    for d in range(1, depth + 1):
        nxt = front.join(e, front.id == e.src).groupBy("dst").agg(F.max_by("via", F.struct("score", F.col("via"))).alias("via"), F.max("score").alias("score"))
        nxt = nxt.select(F.col("dst").alias("id"), (F.col("score") * 0.5).alias("score"), F.lit(d).alias("depth"), "via").join(found.select("id"), "id", "left_anti")
        front, found = nxt, found.unionByName(nxt)
    return found.where("depth > 0").orderBy(F.desc("score"), "depth", "id").limit(budget)


def drop_counters(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(reason).count()


def greedy_budget(items: DataFrame, budget: int, *, by: str, cost: str = "cost", order: str = "rank") -> DataFrame:
    """Taken items of each query: in order, whatever still fits; what does not fit is skipped, not an end.

    A query's rows come sorted, batch by batch; only the budget left is carried from one to the next.
    """

    def take(batches):
        key, left = object(), budget
        for b in batches:
            keep = []
            for g, c in zip(b.column(by).to_pylist(), b.column(cost).to_pylist()):
                if g != key:
                    key, left = g, budget
                ok = c is not None and c <= left
                left -= c if ok else 0
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return items.repartition(by).sortWithinPartitions(by, order).mapInArrow(take, items.schema)


def batch_split(items: DataFrame, max_items: int, max_tokens: int, *, by: str, cost: str = "cost", order: str = "rank") -> DataFrame:
    """``items`` with a batch number: a batch ends before it would hold too many entries or tokens.  No cost is a cost of 0.

    A source's rows come sorted, batch by batch; only the open batch's size is carried from one to the next.
    """

    def split(batches):
        key, batch, n, size = object(), 0, 0, 0
        for b in batches:
            out = []
            for g, c in zip(b.column(by).to_pylist(), b.column(cost).to_pylist()):
                c = c or 0
                if g != key:
                    key, batch, n, size = g, 0, 0, 0
                if n and (n >= max_items or size + c > max_tokens):
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + c
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "batch"])

    return items.repartition(by).sortWithinPartitions(by, order).mapInArrow(split, T.StructType([*items.schema.fields, T.StructField("batch", T.LongType())]))


def context_pack(items: DataFrame, budget: int, *, by: str = "query") -> DataFrame:
    """Skeletons of all items first, then bodies while they fit; a body gives back its skeleton's cost.

    items: (query, rank, id, content_hash, skeleton_cost, body_cost, stale); equal
    content is packed once, stale items are left out with a reason.
    """

    kind = {c: items.schema[c].dataType.simpleString() for c in (by, "rank", "id")}

    def fill(batches):
        key, left, seen, held = object(), budget, set(), []  # held: the skeletons taken, whose bodies wait for the query's last row
        names = [by, "rank", "id", "packed"]
        types = None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def bodies():
            nonlocal left
            out = []
            for g, rank, i, more in held:
                fits = more is not None and more <= left
                left -= more if fits else 0
                out.append((g, rank, i, "body" if fits else "skeleton"))
            held.clear()
            return out

        for b in batches:
            types = [b.schema.field(c).type for c in names[:3]] + [pa.string()]
            out = []
            for g, rank, i, content, skeleton, body, stale in zip(*(b.column(c).to_pylist() for c in (by, "rank", "id", "content_hash", "skeleton_cost", "body_cost", "stale"))):
                if g != key:
                    out += bodies()
                    key, left, seen = g, budget, set()
                if stale:
                    out.append((g, rank, i, "stale"))
                elif content in seen:
                    out.append((g, rank, i, "duplicate"))
                elif skeleton is not None and skeleton <= left:
                    seen.add(content)
                    left -= skeleton
                    held.append((g, rank, i, None if body is None else body - skeleton))
                else:
                    out.append((g, rank, i, "over_budget"))
            if out:
                yield table(out)
        if held:
            yield table(bodies())

    asked = items.select(by, "rank", "id", "content_hash", "skeleton_cost", "body_cost", "stale")
    return asked.repartition(by).sortWithinPartitions(by, "rank").mapInArrow(fill, f"{by} {kind[by]}, rank {kind['rank']}, id {kind['id']}, packed string")


def metrics(ranking: DataFrame, judgments: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query_id, recall@k, mrr@10, ndcg@10, abstained) of each judged query; grades gain 2^g - 1, rank r counts 1/log2(r+1)."""
    j = judgments.where("grade > 0")
    hit = ranking.join(j, ["query_id", "doc"])
    rel = j.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc")
    ideal = j.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1.0)).alias("idcg"))
    got = hit.groupBy("query_id").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"hit_{k}") for k in cutoffs], F.min("rank").alias("first"),
                                      F.sum(F.when(F.col("rank") <= 10, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    any_result = ranking.select("query_id").distinct().withColumn("_any", F.lit(True))
    out = rel.join(ideal, "query_id").join(got, "query_id", "left").join(any_result, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query_id", *[F.round(zero(F.col(f"hit_{k}")) / F.col("n_rel"), 4).alias(f"recall_{k}") for k in cutoffs],
                      F.round(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0), 4).alias("mrr_10"),
                      F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg"), 4).alias("ndcg_10"), F.col("_any").isNull().alias("abstained"))


def compare_reports(old: DataFrame, new: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(metric, old, new, verdict) over metric keys of two reports."""
    j = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric", "full_outer")
    d = F.col("new") - F.col("old")
    return j.select("metric", "old", "new", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.abs(d) <= tolerance, "same").when(d > 0, "better").otherwise("worse").alias("verdict"))


def expand_glossary(queries: DataFrame, glossary: DataFrame, max_words: int = 4) -> DataFrame:
    """(query, phrase, expansion): word n-grams of a query that a glossary term (both ways) or its stem is, longest first."""
    w = queries.select("query", F.split(F.lower("query"), "\\s+").alias("w"))
    grams = w.select("query", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_words)), lambda n: F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(n.alias("n"), i.alias("i"), F.array_join(F.slice("w", i, n), " ").alias("g")))))).alias("x"))
    grams = grams.select("query", "x.n", "x.i", "x.g").where(F.size(F.split("g", " ")) == F.col("n"))
    both = glossary.select("term", "other").unionByName(glossary.select(F.col("other").alias("term"), F.col("term").alias("other")))
    hit = grams.join(both, F.col("g") == F.lower("term"))
    return hit.withColumn("r", F.rank().over(Window.partitionBy("query", "i").orderBy(F.desc("n")))).where("r = 1").select("query", F.col("g").alias("phrase"), F.col("other").alias("expansion")).distinct()
