"""Knowledge records: staleness, conflicts, revalidation, acceptance, bootstrap pack, task resume, visibility.

records: (id, scope_kind, workspace, project, kind, subject, title, body, state,
pinned, tags, related_symbols, updated_at); evidence: (record_id, project, path,
content_hash); changes: (project, path, old_hash, new_hash), a null new hash is
a deleted file; symbol changes: (symbol, kind), changed or removed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREADTH = ("organization", "workspace", "project", "task", "user")
MIN_PARTIAL = 32


def staleness(records: DataFrame, evidence: DataFrame, changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, stale, reasons) of accepted (stale) and proposed records that a change touches; evidence already at the new hash is not touched."""
    real = changes.where(F.col("new_hash").isNull() | (F.col("new_hash") != F.col("old_hash")))
    e = evidence.join(real.select("project", "path", "new_hash"), ["project", "path"]).where(F.col("new_hash").isNull() | (F.col("new_hash") != F.col("content_hash")))
    by_file = e.select(F.col("record_id").alias("id"), F.concat(F.when(F.col("new_hash").isNull(), "file_deleted:").otherwise("file_changed:"), "project", F.lit("/"), "path").alias("reason"))
    s = records.select("id", F.explode("related_symbols").alias("symbol")).join(symbols, "symbol").select("id", F.concat(F.lit("symbol_"), "kind", F.lit(":"), "symbol").alias("reason"))
    why = by_file.unionByName(s).groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return records.where(F.col("state").isin("accepted", "proposed")).join(why, "id").select("id", (F.col("state") == "accepted").alias("stale"), "reasons")


def revalidation(queue: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The queue (id, reasons, queued_at) with what was found stale: reasons add up, the first date stays."""
    new = found.where("stale").select("id", "reasons", at.alias("queued_at"))
    return queue.unionByName(new).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.min("queued_at").alias("queued_at"))


def scopes_overlap(a: str, b: str) -> Column:
    """The organisation covers workspaces and projects, a workspace its projects; others only themselves.  a and b: aliases of records."""
    k, o = F.col(f"{a}.scope_kind"), F.col(f"{b}.scope_kind")
    wide = F.array(*map(F.lit, BREADTH[:3]))
    org = ((k == "organization") & F.array_contains(wide, o)) | ((o == "organization") & F.array_contains(wide, k))
    ws = F.col(f"{a}.workspace").eqNullSafe(F.col(f"{b}.workspace"))
    mixed = (((k == "workspace") & (o == "project")) | ((k == "project") & (o == "workspace"))) & ws
    return org | mixed | ((k == o) & ws & F.col(f"{a}.project").eqNullSafe(F.col(f"{b}.project")))


def canonical_body(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def conflicts(records: DataFrame, *, spread: int = 16) -> DataFrame:
    """(subject, first, second): accepted records of one subject with overlapping scopes and other bodies.

    Equal bodies in equal scopes agree, so a subject's pairs are formed between
    distinct (scope, body) groups only, and each group's records are listed.
    The groups are small and the pairs are not, so a subject's groups are dealt
    into ``spread`` keys on one side and copied to each on the other, in a fixed
    number of partitions: sized by their bytes they would be pairs of few tasks.
    """
    r = records.where("state = 'accepted'").withColumn("h", F.sha2(canonical_body(F.col("body")), 256))
    g = r.groupBy("subject", "scope_kind", "workspace", "project", "h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * records.sparkSession.sparkContext.defaultParallelism)
    a = g.withColumn("k", F.pmod(F.xxhash64("scope_kind", "workspace", "project", "h"), F.lit(spread)).cast("int")).repartition(parts, "subject", "k").alias("a")
    b = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(parts, "subject", "k").alias("b")
    j = a.join(b.hint("shuffle_hash"), (F.col("a.subject") == F.col("b.subject")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.h") < F.col("b.h"))).where(scopes_overlap("a", "b"))
    p = j.select(F.col("a.subject").alias("subject"), F.explode("a.ids").alias("x"), F.col("b.ids").alias("ids")).select("subject", "x", F.explode("ids").alias("y"))
    return p.select("subject", F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))


def citing(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Records with evidence in one of the files (project, path)."""
    return evidence.join(files, ["project", "path"], "left_semi").select("record_id").distinct()


def about(records: DataFrame, symbols: list[str]) -> DataFrame:
    return records.where(F.arrays_overlap("related_symbols", F.array(*map(F.lit, symbols))))


def select_records(records: DataFrame, *, scopes: DataFrame | None = None, states: list[str] = (), kinds: list[str] = (), subject: str | None = None, pinned: bool | None = None, tag: str | None = None) -> DataFrame:
    """Conjunctive filter; what is not asked for is no filter.  scopes: (scope_kind, workspace, project) that the caller may read, joined first."""
    r = records if scopes is None else records.join(scopes, [records[c].eqNullSafe(scopes[c]) for c in ("scope_kind", "workspace", "project")], "left_semi")
    for c, v in (("state", states), ("kind", kinds)):
        r = r.where(F.col(c).isin(list(v))) if v else r
    r = r if subject is None else r.where(F.col("subject") == subject)
    r = r if pinned is None else r.where(F.col("pinned") == pinned)
    return r if tag is None else r.where(F.array_contains("tags", tag))


def next_state(state: Column, event: Column, approvals: Column, needed: Column, conflict: Column) -> Column:
    """Where an event leads a record; null where it may not happen.

    A proposal is accepted with enough approvals and no conflict; stale records
    are accepted again by revalidation; superseded and rejected are the end.
    """
    return (F.when((state == "proposed") & (event == "accept"), F.when((approvals >= needed) & ~conflict, "accepted"))
            .when((state == "proposed") & (event == "reject"), "rejected").when((state == "accepted") & (event == "mark_stale"), "stale")
            .when((state == "stale") & (event == "revalidate"), "accepted").when(state.isin("accepted", "stale") & (event == "supersede"), "superseded").when((state == "stale") & (event == "reject"), "rejected"))


def tier(pinned: Column, rule: Column, kind: Column) -> Column:
    return F.when(pinned, 0).when(rule, 1).when(kind == "human", 2).when(kind == "task", 3).when(kind == "map", 4).otherwise(5)


def bootstrap(items: DataFrame, budget: int, *, by: str) -> DataFrame:
    """(by, id, tier, tokens, truncated): pinned, rules, decisions, tasks, maps, then other knowledge, while the budget lasts.

    items: (by, id, tier, breadth, subject, updated_at, text).  Broad scopes
    come first among pinned records and rules, recent ones elsewhere.  What does
    not fit is cut if ``MIN_PARTIAL`` tokens are left, else skipped.  The order
    is made by a shuffle's sort, and items stream through one fold a group.
    """
    kind = {c: items.schema[c].dataType.simpleString() for c in (by, "id")}
    early = F.col("tier") <= 1
    order = [F.col(by), F.col("tier"), F.when(early, F.col("breadth")), F.when(early, F.col("subject")), F.when(~early, -F.unix_micros("updated_at")), F.col("id")]
    x = items.select(by, "id", "tier", F.ceil(F.char_length("text") / 4).cast("long").alias("cost"), *[c.alias(f"_{i}") for i, c in enumerate(order)]).repartition(by).sortWithinPartitions(*[f"_{i}" for i in range(len(order))])

    def fold(batches):
        group, left = object(), 0
        for p in batches:
            out = []
            for g, i, t, cost in zip(p[by], p["id"], p["tier"], p["cost"]):
                if g != group:
                    group, left = g, budget
                if cost <= left:
                    out.append((g, i, t, cost, False))
                    left -= cost
                elif left >= MIN_PARTIAL:
                    out.append((g, i, t, left, True))
                    left = 0
            yield pd.DataFrame(out, columns=[by, "id", "tier", "tokens", "truncated"])

    return x.mapInPandas(fold, f"{by} {kind[by]}, id {kind['id']}, tier int, tokens bigint, truncated boolean")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, change, old_commit, new_commit): projects added, removed or moved since a checkpoint."""
    j = old.select("project", F.col("commit").alias("old_commit")).join(new.select("project", F.col("commit").alias("new_commit")), "project", "full_outer")
    c = F.when(F.col("old_commit").isNull(), "added").when(F.col("new_commit").isNull(), "removed").when(F.col("old_commit") != F.col("new_commit"), "moved")
    return j.select("project", c.alias("change"), "old_commit", "new_commit").where("change IS NOT NULL")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The newest checkpoint of each task; of equal times the one written last."""
    w = Window.partitionBy("task").orderBy(F.desc("at"), F.desc("seq"))
    return checkpoints.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def visible(rows: DataFrame, grants: DataFrame, user: str, need: int = 1) -> DataFrame:
    """Rows of the projects on which ``user`` has a role of ``need`` or more.  grants: (user, project, role), joined below everything else."""
    return rows.join(grants.where((F.col("user") == user) & (F.col("role") >= need)).select("project"), "project", "left_semi")
