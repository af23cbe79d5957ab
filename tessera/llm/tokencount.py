"""Token counts (4): a separator scan over flat, unindexed token files.

A token file is a stream of fixed-width ids in which an end-of-document id
ends each document; nothing says where.  Files are read in blocks of a fixed
number of bytes, cut without regard to documents.  Each block is searched by
itself for end ids, all at once, and gives a summary: how many ends, how many
tokens before the first and behind the last.  A prefix scan over summaries says
how many documents have ended before a block and how many tokens its first end
has to take over from earlier blocks, across any number of blocks without an
end.  Summaries are scanned in two levels, ``SEGMENT`` blocks at a time, so a
file with a third of all data is no single task's work; the data is not
shuffled.

Defined cases: documents without tokens count 0; texts and documents of any
length run over as many blocks as they need; an id that does not fit into
``width`` bytes is an error; tokens behind a file's last
end are a last document, with ``ended`` false; an empty file has no documents;
a width that does not divide a block's bytes is an error; for ``write_flat``,
null text counts as empty, repeated rows are each written, and extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import run_ids
from tessera.session import cut

BLOCK_BYTES, SEGMENT, WIDTH = 1 << 18, 1024, 2


def write_flat(documents: DataFrame, tokenizer: str, end_id: int, *, block_bytes: int = BLOCK_BYTES, width: int = WIDTH, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, order): token files as blocks (file, block, data), one file a partition, and (file, ordinal, doc_id).

    Both are stored in the shared folder.  Strings of special tokens in a text
    are ordinary text, so an end id is always an end.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def write(batches):
        from pyspark import TaskContext

        file, block, ordinal, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        ids = run_ids(tokenizer, plain=True)

        def blocks(data: list[bytes], first: int):
            return pa.RecordBatch.from_arrays([pa.array([file] * len(data), pa.int64()), pa.array(range(first, first + len(data)), pa.int64()), pa.array(data, pa.binary()), pa.nulls(len(data), doc_kind)],
                                              names=["file", "at", "data", "doc_id"])

        for b in batches:
            doc_kind = b.schema.field(0).type
            for data in ids.encode(b.column(1).to_pylist(), end_id):
                x = np.frombuffer(data, "<u4")
                if x.max() >> (8 * width):
                    raise ValueError(f"a token id of {x.max()} does not fit into {width} bytes")
                held.append(x.astype(f"<u{width}").tobytes())
                size += len(held[-1])
                if size >= 16 * block_bytes:
                    data = b"".join(held)
                    full = len(data) // block_bytes
                    yield blocks([data[i * block_bytes : (i + 1) * block_bytes] for i in range(full)], block)
                    block, held = block + full, [data[full * block_bytes :]]
                    size = len(held[0])
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.nulls(n, pa.binary()), b.column(0)], names=["file", "at", "data", "doc_id"])
            ordinal += n
        if size:
            data = b"".join(held)
            yield blocks([data[i : i + block_bytes] for i in range(0, len(data), block_bytes)], block)

    both = cut(documents.select("doc_id", F.col(text_col).cast("binary").alias("t")).mapInArrow(write, f"file bigint, at bigint, data binary, doc_id {kind}"))
    return (both.where("data IS NOT NULL").select("file", F.col("at").alias("block"), "data"),
            both.where("data IS NULL").select("file", F.col("at").alias("ordinal"), "doc_id"))


def read_flat(spark: SparkSession, path: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (file, block, data) of real token files; a file's bytes are one row before they are cut (2 GB at most)."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    n = F.greatest(F.ceil(F.col("length") / block_bytes), F.lit(1)).cast("int")
    cut_up = whole.where("length > 0").select("file", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return cut_up.select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes)).alias("data"))


def _tokens(data: bytes, width: int) -> np.ndarray:
    if len(data) % width:
        raise ValueError(f"a block of {len(data)} bytes does not hold whole tokens of {width}")
    return np.frombuffer(data, f"<u{width}")


def document_tokens(blocks: DataFrame, end_id: int, *, width: int = WIDTH) -> DataFrame:
    """file, ordinal, n_tokens (without the end id), ended of every document of the files."""
    kind = blocks.schema["file"].dataType.simpleString()

    def summarise(batches):
        for b in batches:
            n_end, head, tail, inner = [], [], [], []
            for d in b.column(2):
                x = _tokens(d.as_buffer().to_pybytes(), width)
                ends = np.flatnonzero(x == end_id)
                n_end.append(len(ends))
                head.append(int(ends[0]) if len(ends) else len(x))
                tail.append(len(x) - 1 - int(ends[-1]) if len(ends) else len(x))
                inner.append((np.diff(ends) - 1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_end, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.binary())],
                                             names=["file", "block", "n_end", "head", "tail", "inner"])

    s = cut(blocks.select("file", "block", "data").mapInArrow(summarise, f"file {kind}, block bigint, n_end bigint, head bigint, tail bigint, inner binary"))
    small = s.select("file", "block", "n_end", "head", "tail", F.floor(F.col("block") / SEGMENT).alias("seg"))
    # a run of blocks is (ends, tokens behind the last end): runs join associatively
    within = Window.partitionBy("file", "seg").orderBy("block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("n_end").over(before), F.lit(0))
    last_end = F.max(F.when(F.col("n_end") > 0, F.col("block"))).over(before)
    carried = F.coalesce(F.sum("tail").over(before), F.lit(0)) - F.coalesce(F.max(F.when(F.col("n_end") > 0, F.col("upto") - F.col("tail"))).over(before), F.lit(0))
    upto = F.sum("tail").over(within.rowsBetween(Window.unboundedPreceding, 0))
    inner = small.withColumn("upto", upto).withColumns({"ends": seen, "carry": carried, "broken": last_end.isNotNull()})
    segs = small.withColumn("upto", upto).groupBy("file", "seg").agg(
        F.sum("n_end").alias("n_end"), (F.sum("tail") - F.coalesce(F.max(F.when(F.col("n_end") > 0, F.col("upto") - F.col("tail"))), F.lit(0))).alias("tail"))
    by_file = Window.partitionBy("file").orderBy("seg")
    prior = by_file.rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("upto", F.sum("tail").over(by_file.rowsBetween(Window.unboundedPreceding, 0))).select(
        "file", "seg", F.coalesce(F.sum("n_end").over(prior), F.lit(0)).alias("seg_ends"),
        (F.coalesce(F.sum("tail").over(prior), F.lit(0)) - F.coalesce(F.max(F.when(F.col("n_end") > 0, F.col("upto") - F.col("tail"))).over(prior), F.lit(0))).alias("seg_carry"),
        (F.col("seg") == F.max("seg").over(Window.partitionBy("file"))).alias("last_seg"))
    w_last = Window.partitionBy("file", "seg")
    placed = inner.withColumn("last", F.col("block") == F.max("block").over(w_last)).join(segs, ["file", "seg"]).select(
        "file", "block", (F.col("seg_ends") + F.col("ends")).alias("ordinal"),
        (F.col("carry") + F.when(F.col("broken"), 0).otherwise(F.col("seg_carry"))).alias("carry"), (F.col("last") & F.col("last_seg")).alias("last"))
    whole = s.join(placed, ["file", "block"]).select("file", "n_end", "head", "tail", "inner", "ordinal", "carry", "last")

    def spell(batches):
        for b in batches:
            row, ordinal, count, ended = [], [], [], []
            for r, (n, h, t, i, o, c, last) in enumerate(zip(*[b.column(k).to_pylist() for k in range(1, 8)])):
                if n:
                    lengths = np.concatenate([[c + h], np.frombuffer(i, "<u4")]).astype(np.int64)
                    row.append(np.full(n, r)), ordinal.append(np.arange(o, o + n)), count.append(lengths), ended.append(np.ones(n, bool))
                rest = t if n else c + t
                if last and rest:
                    row.append(np.full(1, r)), ordinal.append(np.asarray([o + n])), count.append(np.asarray([rest])), ended.append(np.zeros(1, bool))
            if row:
                row, ordinal, count, ended = map(np.concatenate, (row, ordinal, count, ended))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(ordinal), pa.array(count), pa.array(ended)], names=["file", "ordinal", "n_tokens", "ended"])

    return whole.mapInArrow(spell, f"file {kind}, ordinal bigint, n_tokens bigint, ended boolean")


def count_documents(documents: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """doc_id, file, ordinal, n_tokens of every document, counted in token files written for it."""
    blocks, order = write_flat(documents, tokenizer, end_id, **options)
    return order.join(document_tokens(blocks, end_id), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
