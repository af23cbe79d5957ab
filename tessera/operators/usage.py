"""Usage histograms, job queue and retention over DataFrames.

A latency histogram is counted by (hour, tool, agent, bucket) and only then put
in an array: the shuffle carries one row a bucket and task at most, so one hot
tool costs no more than others, and stored histograms merge by adding up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 96
KEY = ("hour", "tool", "agent")


def latency_bucket(ms: Column) -> Column:
    """Exact below 4 ms, then four a power of two, ``BUCKETS`` in all."""
    ms = ms.cast("long")
    octave = F.length(F.bin(ms)) - 1
    quarter = F.floor(ms / F.pow(F.lit(2.0), octave - 2)).cast("long") % 4
    return F.when(ms < 4, F.greatest(ms, F.lit(0))).otherwise(F.least(4 + (octave - 2) * 4 + quarter, F.lit(BUCKETS - 1))).cast("int")


def bucket_bound(bucket: Column) -> Column:
    """The largest latency of a bucket; of the last one the smallest."""
    octave, quarter = F.floor((bucket - 4) / 4), (bucket - 4) % 4
    low = (4 + quarter) * F.pow(F.lit(2.0), octave)
    high = (5 + quarter) * F.pow(F.lit(2.0), octave) - 1
    return F.when(bucket < 4, bucket).when(bucket == BUCKETS - 1, low).otherwise(high).cast("long")


def agent_label(client: Column) -> Column:
    label = F.substring(F.regexp_replace(F.coalesce(client, F.lit("")), "[^A-Za-z0-9._-]", "_"), 1, 64)
    return F.when(label == "", "mcp-client").otherwise(label)


def count_buckets(calls: DataFrame, *by: str) -> DataFrame:
    """(by, bucket, n, errors, tokens, ms, last_at) of calls (by, latency_ms, ok, output_tokens, at)."""
    return calls.groupBy(*by, latency_bucket(F.col("latency_ms")).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum((~F.col("ok")).cast("long")).alias("errors"), F.sum("output_tokens").alias("tokens"), F.sum(F.col("latency_ms").cast("long")).alias("ms"), F.max("at").alias("last_at"))


def histogram(counted: DataFrame, *by: str) -> DataFrame:
    """One row for each group, with its buckets as an array of ``BUCKETS`` counts."""
    at = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    g = counted.groupBy(*by).agg(at.alias("m"), F.sum("n").alias("calls"), F.sum("errors").alias("errors"), F.sum("tokens").alias("tokens"), F.sum("ms").alias("latency_ms_sum"), F.max("last_at").alias("last_call_at"))
    return g.withColumn("buckets", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))).drop("m")


def hourly(calls: DataFrame) -> DataFrame:
    c = calls.withColumn("hour", F.date_trunc("hour", "at"))
    return histogram(count_buckets(c, *KEY), *KEY)


def merge(stored: DataFrame, more: DataFrame, *by: str) -> DataFrame:
    """Two histograms with the same keys, added up."""
    both = stored.unionByName(more)
    flat = both.select(*by, F.posexplode("buckets").alias("bucket", "n")).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    sums = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("calls", "errors", "tokens", "latency_ms_sum")], F.max("last_call_at").alias("last_call_at"))
    arrays = flat.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("buckets"))
    return sums.join(arrays, list(by))


def percentile(buckets: Column, p: int) -> Column:
    """The bound of the bucket with rank (n - 1) * p / 100, from 0; 0 without calls."""
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, x: a + x)
    rank = F.floor((total - 1) * p / 100)
    step = lambda a, x: F.struct((a["seen"] + x).alias("seen"), (a["at"] + ((a["seen"] + x) <= rank).cast("int")).alias("at"))
    at = F.aggregate(buckets, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at")), step)["at"]
    return F.when(total > 0, bucket_bound(at)).otherwise(F.lit(0).cast("long"))


def report(calls: DataFrame, since: Column) -> DataFrame:
    """(kind, name, calls, errors, p50, p95): rollups by tool, by agent and by day from one pass."""
    c = calls.where(F.col("at") >= since).select("tool", "agent", F.date_format("at", "yyyy-MM-dd").alias("day"), latency_bucket(F.col("latency_ms")).alias("bucket"), "ok")
    part = c.groupBy("tool", "agent", "day", "bucket").agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("long")).alias("errors"))
    sets = [[F.col(k), F.col("bucket")] for k in ("tool", "agent", "day")]
    r = part.groupingSets(sets, F.col("tool"), F.col("agent"), F.col("day"), F.col("bucket")).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 6, "tool").when(F.col("g") == 10, "agent").otherwise("day")
    r = r.select(kind.alias("kind"), F.coalesce("tool", "agent", "day").alias("name"), "bucket", "n", "errors", F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("ms"), F.lit(None).cast("timestamp").alias("last_at"))
    h = histogram(r, "kind", "name")
    return h.select("kind", "name", "calls", "errors", percentile(F.col("buckets"), 50).alias("p50"), percentile(F.col("buckets"), 95).alias("p95"))


def prune(rows: DataFrame, at: str, before: Column, *, keep: Column | None = None) -> DataFrame:
    """Retention: what is older than ``before`` goes, but for ``keep``."""
    old = F.col(at) < before
    return rows.where(~old if keep is None else ~old | keep)


# jobs: (id, kind, priority, state, attempts, max_attempts, run_after, lease_owner, lease_expires_at, idempotency_key)


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs whose idempotency key is not there yet; of equal new keys the smallest id; no key, no check."""
    w = Window.partitionBy("idempotency_key").orderBy("id")
    keyed = new.where("idempotency_key IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(jobs.select("idempotency_key"), "idempotency_key", "left_anti")
    return jobs.unionByName(keyed.select(*jobs.columns)).unionByName(new.where("idempotency_key IS NULL"))


def claim(jobs: DataFrame, kinds: list[str], worker: str, now: Column, lease_ms: int, n: int = 1) -> DataFrame:
    """The ``n`` most urgent runnable jobs (priority, run_after, id), leased to ``worker``."""
    if not kinds:
        raise ValueError("a claim names one kind at least")
    due = jobs.where(F.col("state").isin("queued", "failed") & (F.col("run_after") <= now) & F.col("kind").isin(kinds))
    got = due.orderBy(F.desc("priority"), "run_after", "id").limit(n)
    return got.withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(worker), "lease_expires_at": later(now, F.lit(lease_ms))})


def later(at: Column, ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + (ms * 1000).cast("long"))


def backoff(attempts: Column, base_ms: float, max_ms: float) -> Column:
    return F.least(base_ms * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(max_ms)))


def fail(jobs: DataFrame, worker: str, now: Column, *, base_ms: float, max_ms: float) -> DataFrame:
    """Running jobs of ``worker`` end as failed, due again after a backoff, or dead after their last attempt."""
    mine = (F.col("state") == "running") & (F.col("lease_owner") == worker)
    last = F.col("attempts") >= F.col("max_attempts")
    return jobs.withColumns({"run_after": F.when(mine & ~last, later(now, backoff(F.col("attempts"), base_ms, max_ms))).otherwise(F.col("run_after")), "state": F.when(mine, F.when(last, "dead").otherwise("failed")).otherwise(F.col("state")),
                             "lease_owner": F.when(~mine, F.col("lease_owner")), "lease_expires_at": F.when(~mine, F.col("lease_expires_at"))})


def reclaim(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has run out are queued again, or dead."""
    out = (F.col("state") == "running") & (F.col("lease_expires_at") < now)
    state = F.when(out, F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("queued")).otherwise(F.col("state"))
    out = F.coalesce(out, F.lit(False))
    return jobs.withColumns({"state": state, "lease_owner": F.when(~out, F.col("lease_owner")), "lease_expires_at": F.when(~out, F.col("lease_expires_at"))})
