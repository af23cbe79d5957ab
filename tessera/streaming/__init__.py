"""Structured Streaming: usage histograms, debounced changes, fenced activation, ordered writes.

Results of ``update`` mode are written a batch at a time under the shared
folder; ``latest`` reads each key's last state.  A batch that is run again
after a failure writes the same folder, so a retry changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import usage as U
from tessera.session import shared_folder


def shared(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files at ``path``, with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    # a pattern stands for a file and for a folder alike
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, *, name: str, mode: str = "update", write=None) -> str:
    """Run all that is there now; each batch goes to ``<folder>/out/batch=<id>`` unless ``write`` does something else with it."""
    base = shared(stream.sparkSession, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write or put).start()
    q.awaitTermination()
    return f"{base}/out"


def latest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def hourly_usage(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by (hour, tool, agent, bucket) of a stream of calls; an hour's state is dropped ``late`` after its end.

    State is one row a bucket, so that no group grows with its calls.
    """
    c = calls.withWatermark("at", late)
    return c.groupBy(F.window("at", "1 hour").alias("w"), "tool", "agent", U.latency_bucket(F.col("latency_ms")).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum((~F.col("ok")).cast("long")).alias("errors"), F.sum("output_tokens").alias("tokens"), F.sum(F.col("latency_ms").cast("long")).alias("ms"), F.max("at").alias("last_at")).select(
        F.col("w.start").alias("hour"), "tool", "agent", "bucket", "n", "errors", "tokens", "ms", "last_at")


def debounce(changes: DataFrame, *, quiet: str = "300 milliseconds", late: str = "3 seconds", by: str = "view_id") -> DataFrame:
    """Changes (by, at, path) of a view that follow each other within ``quiet`` are one: (by, start, end, n)."""
    c = changes.withWatermark("at", late)
    return c.groupBy(F.session_window("at", quiet).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(requests: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Retries of a request within ``late`` are dropped."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def fenced(current: DataFrame, batch: DataFrame, key: str = "view_id", seq: str = "generation") -> DataFrame:
    """The state after a batch: a key's newest sequence number; what comes late and is older changes nothing."""
    both = current.select(key, seq, "payload").unionByName(batch.select(key, seq, "payload"))
    return both.groupBy(key).agg(F.max_by(F.struct(seq, "payload"), seq).alias("b")).select(key, "b.*")

