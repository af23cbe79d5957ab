"""Versioned tables: interval-valid rows, pins, diffs, renames, incremental maintenance, history.

A row is valid at generation g if ``valid_from <= g`` and ``valid_to`` is null
or beyond g.  A pin is (view_id, generation): reads go through pins, so many
views are read at a consistent point in one job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(g: Column) -> Column:
    return (F.col("valid_from") <= g) & (F.col("valid_to").isNull() | (F.col("valid_to") > g))


def as_of(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """The rows that pins (view_id, generation) see."""
    return rows.join(pins.select("view_id", "generation"), "view_id").where(valid_at(F.col("generation")))


def page_at(rows: DataFrame, after: str | None, n: int, key: str = "path") -> DataFrame:
    """A keyset page in byte order."""
    if not 1 <= n <= 10_000:
        raise ValueError("a page has 1 to 10000 rows")
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(n)


def diff(old: DataFrame, new: DataFrame, *keys: str, hash_col: str = "content_hash") -> DataFrame:
    """(keys, op, old_hash, content_hash) of what changed: upsert or delete."""
    o, n = old.select(*keys, F.col(hash_col).alias("old_hash")), new.select(*keys, F.col(hash_col).alias("new_hash"))
    j = o.join(n, list(keys), "full_outer")
    op = F.when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("new_hash")), "upsert")
    return j.select(*keys, op.alias("op"), "old_hash", F.col("new_hash").alias("content_hash")).where("op IS NOT NULL")


def renames(changes: DataFrame, *by: str) -> DataFrame:
    """``changes`` with ``renamed_from``: a new path takes the deleted path of equal content; each source is used once."""
    gone = changes.where("op = 'delete'").select(*by, F.col("path").alias("renamed_from"), F.col("old_hash").alias("h"))
    gone = gone.withColumn("k", F.row_number().over(Window.partitionBy(*by, "h").orderBy("renamed_from")))
    new = changes.where("op = 'upsert' AND old_hash IS NULL").select(*by, "path", F.col("content_hash").alias("h"))
    new = new.withColumn("k", F.row_number().over(Window.partitionBy(*by, "h").orderBy("path")))
    pairs = new.join(gone, [*by, "h", "k"]).select(*by, "path", "renamed_from")
    return changes.join(pairs, [*by, "path"], "left")


def apply_changes(rows: DataFrame, changes: DataFrame, g: int) -> DataFrame:
    """Close what changed at ``g`` and open the new versions; applied again, it changes nothing."""
    touched = changes.select("view_id", "path").distinct().withColumn("_t", F.lit(True))
    kept = rows.where(F.col("valid_from") != g).unionByName(rows.where(F.col("valid_from") == g).join(touched, ["view_id", "path"], "left_anti"))
    # a retry finds rows that its first try closed at g: the same result
    open_ = F.col("valid_to").isNull() | (F.col("valid_to") > g)
    closed = kept.join(touched, ["view_id", "path"], "left").withColumn("valid_to", F.when(F.col("_t") & open_ & (F.col("valid_from") < g), F.lit(g)).otherwise(F.col("valid_to"))).drop("_t")
    new = changes.where("op = 'upsert'").select("view_id", "path", F.lit(g).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), "content_hash")
    return closed.select("view_id", "path", "valid_from", "valid_to", "content_hash").unionByName(new)


def replace_by_origin(rows: DataFrame, new: DataFrame, origins: DataFrame, g: int) -> DataFrame:
    """Rows of ``origins`` (view_id, origin) are closed at ``g`` unless written again unchanged; new ones open."""
    key = [c for c in new.columns if c not in ("valid_from", "valid_to")]
    live = rows.where("valid_to IS NULL")
    same = live.join(new.select(*key), key, "left_semi")
    gone = live.join(origins, ["view_id", "origin"], "left_semi").join(new.select(*key), key, "left_anti").withColumn("valid_to", F.lit(g).cast("long"))
    rest = live.join(origins, ["view_id", "origin"], "left_anti")
    fresh = new.select(*key).join(live.select(*key), key, "left_anti").withColumns({"valid_from": F.lit(g).cast("long"), "valid_to": F.lit(None).cast("long")})
    kept = same.join(origins, ["view_id", "origin"], "left_semi")
    return rows.where("valid_to IS NOT NULL").unionByName(gone).unionByName(rest).unionByName(kept).unionByName(fresh)


def prune(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Without what ended at or before the view's cutoff: the least of what is to be kept, the active and the oldest pinned."""
    c = cutoffs.select("view_id", F.least("keep_from", "active", "oldest_pin").alias("cutoff"))
    return rows.join(c, "view_id", "left").where(F.col("cutoff").isNull() | F.col("valid_to").isNull() | (F.col("valid_to") > F.col("cutoff"))).drop("cutoff")


def activate(generations: DataFrame, view: str, g: int) -> DataFrame:
    """Generation ``g`` of ``view`` becomes active if it is building and newer than the active one; the former is retired."""
    mine = F.col("view_id") == view
    w = Window.partitionBy("view_id")
    ok = F.max(F.when((F.col("generation") == g) & (F.col("state") == "building"), 1)).over(w).isNotNull() & (F.coalesce(F.max(F.when(F.col("state") == "active", F.col("generation"))).over(w), F.lit(-1)) < g)
    state = F.when(mine & ok & (F.col("generation") == g), "active").when(mine & ok & (F.col("state") == "active"), "retired").otherwise(F.col("state"))
    return generations.withColumn("state", state)


def shadow(base: DataFrame, overlay: DataFrame, declared: DataFrame) -> DataFrame:
    """Base rows whose path an overlay has or declares are hidden; overlay rows come instead."""
    hidden = overlay.select("project", "path").unionByName(declared.select("project", "path")).distinct()
    return base.join(hidden, ["project", "path"], "left_anti").withColumn("layer", F.lit("base")).unionByName(overlay.withColumn("layer", F.lit("overlay")))


def co_changes(changes: DataFrame, *, group: str, item: str, block: int = 512, least: int = 1, tile: int = 2048, tiled: bool | None = None) -> DataFrame:
    """(a, b, n): how often two items change in one group, ``least`` times at least, whatever the group's size.

    Two ways with one result, ``tiled`` or not; unless it is named, the one that
    moves fewer rows.  By pairs: a group of more than ``block`` items is dealt
    into blocks of about that many, and each pair of blocks is a key of its own:
    no task gets all pairs of a group.  By tiles: see ``_tiled``.
    """
    c = changes.select(F.col(group).alias("g"), F.col(item).alias("i")).dropna().distinct()
    if tiled is None:
        sizes = c.groupBy("g").agg(F.count("*").alias("c"))
        size = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2), F.lit(0.0)).alias("pairs")).first()
        blocks = _blocks(c.select("i").distinct().count(), tile)
        tiled = size["pairs"] > size["rows"] * blocks
    if tiled:
        return _tiled(c, tile, least)
    large = c.groupBy("g").count().where(F.col("count") > block).select("g", F.ceil(F.col("count") / block).cast("int").alias("n"))
    c = c.join(large, "g", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("k", F.pmod(F.xxhash64("i"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    x, y = c.select("g", "i", F.col("k").alias("p"), every.alias("q")), c.select("g", "i", every.alias("p"), F.col("k").alias("q"))
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    return x.alias("x").join(y.alias("y"), same & (F.col("x.i") < F.col("y.i"))).groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _blocks(items: int, tile: int) -> int:
    """Blocks of at most about ``tile`` items, 8 at least, so that few items still make 36 tiles."""
    return max(8, -(-items // tile))


def _tiled(c: DataFrame, tile: int, least: int) -> DataFrame:
    """The counts of ``co_changes`` by tiles of the matrix of items.

    Items are dealt into blocks and each pair of blocks is a tile, which gets
    its items' groups once and has every count of its pairs: a row is moved
    once a block, and no pair is shuffled.  A tile's counts are bounded by its
    items, whatever the number of groups.
    """
    n = _blocks(c.select("i").distinct().count(), tile)
    rows = c.groupBy("i").agg(F.collect_list("g").alias("g")).withColumn("k", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"))
    rows = rows.select("i", "g", "k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    rows = rows.select(F.least("k", "o").alias("p"), F.greatest("k", "o").alias("q"), (F.col("k") <= F.col("o")).alias("left"), "i", "g")
    kind = c.schema["i"].dataType.simpleString()

    def count(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        left = t["left"].to_numpy(zero_copy_only=False)
        lists = t["g"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(t)), lists.value_lengths().to_numpy(zero_copy_only=False))
        alone = t["p"][0] == t["q"][0]  # a block with itself: each pair once
        place = np.where(left, np.cumsum(left) - 1, np.cumsum(~left) - 1)
        a, b = np.flatnonzero(left), np.flatnonzero(left if alone else ~left)
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        found = np.zeros((len(a), len(b)), np.int32)
        groups = int(codes[-1]) + 1 if len(codes) else 0
        for low in range(0, groups, 1024):  # a bounded slice of the groups at a time
            i, j = np.searchsorted(codes, (low, low + 1024))
            wide = min(1024, groups - low)
            x, y = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
            g, r = codes[i:j] - low, at[i:j]
            x[place[r[left[r]]], g[left[r]]] = 1
            if alone:
                y = x
            else:
                y[place[r[~left[r]]], g[~left[r]]] = 1
            found += (x @ y.T).astype(np.int32)
        u, v = np.nonzero(np.triu(found, 1) >= least if alone else found >= least)
        items = t["i"]
        return pa.table({"a": items.take(pa.array(a[u])), "b": items.take(pa.array(b[v])), "n": pa.array(found[u, v].astype(np.int64))})

    tiles = rows.repartition(min(n * (n + 1) // 2, 2000), "p", "q").groupBy("p", "q").applyInArrow(count, f"a {kind}, b {kind}, n bigint")
    return tiles.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")


def tree_levels(files: DataFrame) -> list[DataFrame]:
    """(path, hash) of every level of directories, the deepest first; the root is the last, with path ``''``.

    files: (path, hash, seq); the last of repeated paths wins.
    """
    last = files.groupBy("path").agg(F.max_by("hash", "seq").alias("hash"))
    nodes = last.withColumn("depth", F.size(F.split("path", "/")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    out, up = [], None
    for depth in range(deepest, 0, -1):
        here = nodes.where(F.col("depth") == depth).select("path", "hash", F.lit("f").alias("kind"))
        here = here if up is None else here.unionByName(up.withColumn("kind", F.lit("d")))
        parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        name = F.substring_index("path", "/", -1)
        entry = F.concat_ws(":", F.col("kind"), F.length(name).cast("string"), name, F.col("hash"))
        up = here.groupBy(parent.alias("path")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "|"), 256).alias("hash"))
        out.append(up)
    return out


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, change): added, removed or modified; a container is left out when one of its members changed."""
    j = old.select("symbol", F.col("hash").alias("o")).join(new.select("symbol", F.col("hash").alias("n")), "symbol", "full_outer")
    c = j.select("symbol", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified").alias("change")).where("change IS NOT NULL")
    holders = c.where(F.instr("symbol", ".") > 0).select(F.regexp_replace("symbol", "\\.[^.]*$", "").alias("symbol"))
    return c.join(holders.distinct(), "symbol", "left_anti")


def history(edges: DataFrame, start: DataFrame, depth: int = 20) -> DataFrame:
    """(origin, path, step): a path and what it was renamed from, back to its first name."""
    cur = start.select(F.col("path").alias("origin"), "path", F.lit(0).alias("step"))
    out = cur
    for s in range(1, depth + 1):
        cur = cur.join(edges, "path").select("origin", F.col("renamed_from").alias("path"), F.lit(s).alias("step"))
        if cur.isEmpty():
            break
        out = out.unionByName(cur)
    return out


def plan_kind(previous: Column, parser: Column, last_parser: Column, ratio: Column, rewritten: Column) -> Column:
    """How a build is done: initial, rewrite (history was), rebuild (parser or most files changed), else incremental."""
    return F.when(previous.isNull(), "initial").when(rewritten, "rewrite").when((parser != last_parser) | (ratio > 0.5), "rebuild").otherwise("incremental")
