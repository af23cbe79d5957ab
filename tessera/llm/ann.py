"""Approximate nearest neighbours (3) by learned partitions.

On a bounded sample (``SAMPLE`` vectors with the smallest hash) the neighbour
graph by inner product is built and cut into balanced parts: each cut splits a
part at the median of a smoothed vector of the graph and then swaps vectors
across it while edges are saved.  A small network (one hidden layer) learns, for
a vector, how its neighbours spread over the parts.  It places every row of the
table into its most probable part and sends a query to as many of the most
probable parts as ``TARGET`` recall needs between sample vectors that were kept
out of the training (one in ``HELD``), queries and neighbours both.  Those parts'
vectors are scored exactly, in double precision, and reranked.

A part is learned from 64 sample vectors at least.  So a table of under 128
vectors is one part; every other has two at least, and about ``PART_ROWS`` rows
a part where it is large.

A part is dealt into blocks of about ``BLOCK`` rows, and its queries too, so a
part with a third of all rows (one vector repeated) is spread over tasks; a
block gives at most ``k`` rows a query.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most of the sample's take no part, nor do rows with
a null id; rows that share the query's id are its own; a query id that repeats
is asked once, with its first vector by value; ties go to the smaller id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

SAMPLE, PART_ROWS, MAX_PARTS, BLOCK, QUERIES, NEIGHBOURS, HIDDEN, TARGET, EVERY, K = 8192, 4096, 128, 8192, 4096, 15, 96, 0.97, 20, 20
LEAST_PARTS, HELD = 2, 4


def usable(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part."""
    d = df.select(F.col("vec_id").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return d.where(fine & F.exists("v", lambda x: x != 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, n_parts: int, seed: int = 3) -> np.ndarray:
    """A part for each node: sizes differ by one at most per cut."""
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    src, dst = np.repeat(np.arange(n), k), graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, np.int64)
    done = 1
    while done < n_parts:
        same = part[src] == part[dst]
        s, d = src[same], dst[same]
        deg = np.maximum(1, np.bincount(s, minlength=n))
        size = np.bincount(part, minlength=done)
        v = rng.standard_normal(n)
        for _ in range(30):  # smooth over the graph, away from each part's constant
            v = 0.5 * v + 0.5 * np.bincount(s, weights=v[d], minlength=n) / deg
            v -= (np.bincount(part, weights=v, minlength=done) / size)[part]
        order = np.lexsort((v, part))
        start = np.cumsum(size) - size
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - start[part[order]]
        side = rank >= (size[part] // 2)
        for _ in range(8):  # swap as many from each side as gain by it
            other = np.bincount(s, weights=(side[s] != side[d]), minlength=n)
            gain = 2 * other - np.bincount(s, minlength=n)
            moved = 0
            for p in range(done):
                i = np.flatnonzero((part == p) & (gain > 0))
                a, b = i[side[i]], i[~side[i]]
                a, b = a[np.argsort(-gain[a])], b[np.argsort(-gain[b])]
                m = min(len(a), len(b)) // 2
                side[a[:m]], side[b[:m]] = False, True
                moved += m
            if not moved:
                break
        part = 2 * part + side
        done *= 2
    return part


class Router:
    """A network of one hidden layer from vectors to part probabilities."""

    def __init__(self, scale, w1, b1, w2, b2):
        self.scale, self.w1, self.b1, self.w2, self.b2 = scale, w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (x * self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    @classmethod
    def train(cls, x: np.ndarray, soft: np.ndarray, hidden: int = HIDDEN, epochs: int = 25, seed: int = 4) -> Router:
        rng = np.random.default_rng(seed)
        d, c = x.shape[1], soft.shape[1]
        scale = np.sqrt(d) / max(1e-12, float(np.sqrt((x * x).sum(axis=1).mean())))
        p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, c)) * np.sqrt(1 / hidden), np.zeros(c)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                xb = x[i] * scale
                h = np.maximum(0, xb @ p[0] + p[1])
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                dz = (z / z.sum(axis=1, keepdims=True) - soft[i]) / len(i)
                dh = (dz @ p[2].T) * (h > 0)
                step += 1
                for j, g in enumerate((xb.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] -= 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        return cls(scale, *p)


def learn(x: np.ndarray, n_parts: int, k: int = K, target: float = TARGET) -> tuple[Router, int]:
    """The router and the number of parts a query is sent to."""
    mixed = np.random.default_rng(1).permutation(len(x))
    held, t = mixed[: len(x) // HELD], x[mixed[len(x) // HELD :]]
    graph = neighbour_graph(t, NEIGHBOURS)
    part = balanced_parts(graph, n_parts)
    soft = np.zeros((len(t), n_parts))
    np.add.at(soft, (np.repeat(np.arange(len(t)), graph.shape[1]), part[graph].ravel()), 1.0)
    soft[np.arange(len(t)), part] += graph.shape[1]
    router = Router.train(t, soft / soft.sum(axis=1, keepdims=True))
    z = router.logits(x)
    placed = z.argmax(axis=1)
    near = neighbour_graph_of(x, held, k)
    order = np.argsort(-z[held], axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n_parts)[None, :], axis=1)
    # most rows of a large table are as new to the router as these
    needed = place[np.arange(len(held))[:, None], placed[near]][np.isin(near, held)]
    for p in range(1, n_parts + 1):
        if len(needed) and (needed < p).mean() >= target:
            return router, p
    return router, n_parts


def neighbour_graph_of(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def top_k(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's ``k`` nearest of a block by (score down, id up)."""
    a, b, c = [], [], []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        for r in range(len(s)):
            row, own = s[r], ids != qid[at + r]
            i = np.flatnonzero(own)
            if len(i) > k:
                low = np.partition(row[i], len(i) - k)[len(i) - k]
                i = i[row[i] >= low - 1e-9 * (1.0 + abs(low))]
            # equal vectors must score alike, so the kept ones are summed one way
            score = (x[i] * q[at + r]).sum(axis=1)
            o = np.lexsort((ids[i], -score))[:k]
            a += [int(qid[at + r])] * len(o)
            b += ids[i][o].tolist()
            c += score[o].tolist()
    return a, b, c


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def search(vectors: DataFrame, *, every: int = EVERY, k: int = K, sample: int = SAMPLE, target: float = TARGET, vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_col)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = rows.count()
    if not n:
        return empty
    # a threshold on the hash leaves about twice the sample, wherever the rows are; the smallest hashes of these are taken
    near = rows.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1 << 31)) <= min(1 << 31, (sample << 32) // n))
    got = near.groupBy("h", "id").agg(F.min("v").alias("v")).orderBy(F.pmod("h", F.lit(1 << 31)), "id").limit(sample).collect()
    sizes = np.bincount([len(r["v"]) for r in got])
    dim = int(sizes.argmax())
    x = np.asarray([r["v"] for r in got if len(r["v"]) == dim], dtype=np.float64)
    rows = rows.where(F.size("v") == dim)
    n_parts = 1
    while n_parts < MAX_PARTS and (n_parts < LEAST_PARTS or n_parts * PART_ROWS < n) and n_parts * 64 < len(x):
        n_parts *= 2
    router, probes = learn(x, n_parts, k, target) if n_parts > 1 else (None, 1)

    def place(batches):
        for b in batches:
            v = _matrix(b.column(1))
            p = router.logits(v).argmax(axis=1) if router is not None and len(v) else np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.astype(np.int32))], names=["id", "v", "part"])

    placed = cut(rows.mapInArrow(place, "id bigint, v array<double>, part int"))
    queries = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))

    def route(batches):
        for b in batches:
            v = _matrix(b.column(1))
            z = router.logits(v) if router is not None and len(v) else np.zeros((len(v), 1))
            p = np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32)
            i = np.repeat(np.arange(len(v)), p.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(p.ravel())], names=["id", "v", "part"])

    routed = cut(queries.mapInArrow(route, "id bigint, v array<double>, part int"))
    members = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # MAX_PARTS rows at most
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = {p: -(-c // BLOCK) for p, c in members.items()}
    chunks = {p: -(-c // QUERIES) for p, c in asked.items() if p in members}
    if not chunks:
        return empty

    def of(table: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(y) for p, c in table.items() for y in (p, c)]), F.col("part"))

    # a block meets every chunk of its part's queries
    salt = F.xxhash64(F.col("id"), F.monotonically_increasing_id())
    m = placed.where(F.col("part").isin(list(chunks))).withColumn("b", F.pmod(salt, of(blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), of(chunks) - 1)))
    q = routed.where(F.col("part").isin(list(chunks))).withColumn("c", F.pmod(F.xxhash64("id"), of(chunks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), of(blocks) - 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, c = [], [], []
        if left.num_rows and right.num_rows:
            a, b, c = top_k(left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = m.groupBy("part", "b", "c").cogroup(q.groupBy("part", "b", "c")).applyInArrow(score, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
