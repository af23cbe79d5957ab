"""LM scoring (9): an n-gram model in Elias-Fano levels, sharded by context.

Text is lower-cased for A-Z and split at ASCII white space; every document ends
with one end token.  With h the words before w and h' without the first of them,

    p(w) = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M)

up to ``ORDER`` words, M by the gram's length (``MASS``): Dirichlet smoothing
over an add-one unigram, normalised over the vocabulary and one unknown word.
What the model stores of a gram of two words and more is that smoothed
probability as one byte (``quantise``: the nearest multiple of 0.05 decades, so
a token's log10 probability is off by 0.025 at most at each level, and sums
over the vocabulary are 1 to within the same); what it has not stored is formed
by the formula with a count of zero.

A level has the contexts that occur ``LEAST`` times or more; after others the
shorter gram's probability is taken as it is.

Documents become blocks of about ``BLOCK`` tokens: numbers of the block's own
words, stored once in the shared folder in buckets by block, so that meeting
the answers moves only these.  Level by level a block then sends its distinct
grams with the counts of its training documents to shards, an entry a block at
most, however frequent a gram is; only grams whose context and last word the
model has.  With them go what the levels before have told the block:
the context's count and the probability of the shorter gram.  A shard adds up
the counts, forms the probabilities, builds its level and answers every block by
the level's own successor search.  Nothing about the vocabulary is broadcast or
collected; only N, V and the number of tokens, sums, pass through the driver.

Grams are sharded by their context; a context with over 1/``HOT`` of all tokens
is dealt by its followers over all shards, because all that its probabilities
need comes with the grams.  There are as many shards as blocks of full size, so
a shard's rows do not grow with the corpus, and a block sends no row to a shard
that it has no gram for.

Words are known by 64-bit hashes, contexts by 40 bits besides their shard's and
followers by 32 bits within their context: the chance that a gram is taken for
another one is about a shard's contexts over 2^40 and followers over 2^32.

Defined cases: null text counts as empty, one end token; repeated rows are each
scored and counted; a document of any length is one block's; an empty table
gives no rows; without training documents every count is zero; extra columns are
ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.eliasfano import Level, Words, counts_at, dequantise, quantise
from tessera.session import cut, shared_folder

BLOCK, SHARDS, HOT, ORDER = 2_500_000, 8, 4096, 2
MASS, LEAST = (0.0, 0.0, 12.0, 4.0), (0, 0, 1, 2)  # by the number of words in a gram
END = b"\n"  # no word holds white space, and neither do the marks before a document hold anything else
U64 = np.uint64


def start(k: int) -> bytes:
    """The mark ``k`` words before a document's first word."""
    return b" " * k


def held_out():
    return F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2, F.lit(False))


def _hash(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = list(words)
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def squeezed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: a first byte tells the width, eight more how many."""
    width = x.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def narrow(x: np.ndarray) -> bytes:
    """Counts in the least width that holds them all."""
    top = x.max() if len(x) else 0
    return squeezed(x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"))


def wide(x: bytes) -> np.ndarray:
    return unsqueezed(x).astype(np.int64)


def stored(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` written in the shared folder in buckets by ``key``, and read from there."""
    spark, name = df.sparkSession, f"lm_blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


class Packer:
    """Documents as numbers of the block's words."""

    def __init__(self, order: int):
        self.number: dict[bytes, int] = {END: 0} | {start(k): k for k in range(1, order)}
        self.parts, self.lengths, self.held, self.ids, self.size = [], [], [], [], 0

    def add(self, doc_id, held: bool, text: bytes | None) -> None:
        w = (text or b"").lower().split()
        number = self.number
        self.parts += [np.fromiter([number.setdefault(x, len(number)) for x in w], dtype=np.uint32, count=len(w)), np.zeros(1, np.uint32)]
        self.lengths.append(len(w) + 1)
        self.held.append(held)
        self.ids.append(doc_id)
        self.size += len(w) + 1


class Block:
    """A block's grams, level by level, with what the model's answers say of them."""

    def __init__(self, row: dict, order: int, shards: int, n_all: int = 0, v_all: int = 0):
        stream, self.lengths = unsqueezed(row["stream"]), wide(row["lengths"])
        held = np.asarray(row["held"], bool)
        self.order, self.shards, self.n_all, self.v_all = order, shards, n_all, v_all
        pad, n_docs = order - 1, len(self.lengths)
        # every document after its start marks
        padded = self.lengths + pad
        first = np.cumsum(padded) - padded
        self.at = np.arange(int(padded.sum())) - np.repeat(first, padded)
        self.real = self.at >= pad
        self.tok = np.empty(len(self.at), np.int64)
        self.tok[self.real] = stream
        self.tok[~self.real] = np.tile(np.arange(pad, 0, -1), n_docs)
        self.train = np.repeat(~held, padded)
        self.hashes = [np.frombuffer(row["hashes"], np.uint64)]
        self.level = 1
        self.g, self.context, self.follower, self.suffix = self.tok, None, None, None
        self.c: list[np.ndarray] = []
        self.p: list[np.ndarray] = []
        self._place(np.arange(len(self.hashes[0])), (self.hashes[0] >> U64(8)) % U64(shards))

    def _place(self, asked: np.ndarray, shard: np.ndarray, context: np.ndarray | None = None) -> None:
        """asked: grams by shard and context; cuts: where each shard's begin."""
        order = np.argsort(shard if context is None else (shard << U64(40)) | context, kind="stable")
        self.asked, self.cuts = asked[order], np.searchsorted(shard[order], np.arange(self.shards + 1, dtype=np.uint64))

    def counts(self) -> np.ndarray:
        """Of each gram of this level in training documents."""
        use = self.train & (self.g >= 0)
        return np.bincount(self.g[use], minlength=len(self.hashes[-1]))

    def learn(self, answers: dict[int, tuple[bytes, bytes]]) -> None:
        """Counts and probabilities of this level's grams, from the shards' answers (counts, codes); then the next level's grams."""
        n = len(self.hashes[-1])
        count, code = np.zeros(n, np.int64), np.zeros(n, np.uint8)
        for s, (counts, codes) in answers.items():
            mine = self.asked[self.cuts[s] : self.cuts[s + 1]]
            if counts:
                count[mine] = wide(counts)
            if codes:
                code[mine] = unsqueezed(codes)
        if self.level == 1:
            self.p.append((count + 1.0) / (self.n_all + self.v_all + 1.0))
        else:
            mass, shorter, of = MASS[self.level], self.p[-1][self.suffix], self.c[-1][self.context]
            self.p.append(np.where(code > 0, dequantise(code), mass * shorter / (np.where(of < LEAST[self.level], 0, of) + mass)))
        self.c.append(count)
        if self.level < self.order:
            self._next()

    def _next(self) -> None:
        before, words = self.g, self.hashes[0]
        self.level += 1
        i = np.flatnonzero(self.at >= self.level - 1)
        number, key = pd.factorize(before[i - 1].astype(np.uint64) * U64(len(words)) + self.tok[i].astype(np.uint64))
        self.g = np.full(len(before), -1, np.int64)
        self.g[i] = number
        self.context, self.follower = (key // U64(len(words))).astype(np.int64), (key % U64(len(words))).astype(np.int64)
        self.suffix = np.empty(len(key), np.int64)
        self.suffix[number] = before[i]
        mixed = (self.hashes[-1][self.context] ^ U64(0x9E3779B97F4A7C15)) * U64(0xC2B2AE3D27D4EB4F) ^ words[self.follower]
        self.hashes.append(mixed ^ (mixed >> U64(29)))
        # what the model cannot have is not asked for
        ask = np.flatnonzero((self.c[-1][self.context] >= LEAST[self.level]) & (self.c[0][self.follower] > 0))
        context, follower = self.hashes[-2][self.context[ask]], words[self.follower[ask]]
        hot = self.c[-1][self.context[ask]] * HOT > self.n_all
        shard = np.where(hot, (context >> U64(8)) + (follower >> U64(32)) * U64(0x9E3779B1), context >> U64(8)) % U64(self.shards)
        self._place(ask, shard, top40(context))

    def asks(self):
        """Of each shard that has grams: context hashes, followers of each, context counts, followers, counts, shorter grams' probabilities."""
        counts = self.counts()
        for s in np.flatnonzero(np.diff(self.cuts)).tolist():
            mine = self.asked[self.cuts[s] : self.cuts[s + 1]]
            if self.level == 1:
                yield s, self.hashes[0][mine].tobytes(), b"", b"", b"", narrow(counts[mine]), b""
                continue
            c = self.context[mine]
            new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            rising = top40(self.hashes[-2][c[new]])
            yield (s, squeezed(np.diff(rising, prepend=U64(0))), narrow(np.diff(np.append(new, len(mine)))), narrow(self.c[-1][c[new]]),
                   low32(self.hashes[0][self.follower[mine]]).tobytes(), narrow(counts[mine]), squeezed(quantise(self.p[-1][self.suffix[mine]])))


def top40(h: np.ndarray) -> np.ndarray:
    return h >> U64(24)


def low32(h: np.ndarray) -> np.ndarray:
    return (h & U64(0xFFFFFFFF)).astype("<u4")


_ASK = "shard int, block bigint, level int, contexts binary, n binary, of binary, followers binary, counts binary, shorter binary"
_ANSWER = "block bigint, level int, shard int, counts binary, codes binary, tokens bigint, types bigint"


def serve_words(asks: list[tuple], marks: np.ndarray) -> tuple[list[bytes], int, int]:
    """Every ask's counts, and the tokens and types among the words."""
    words, place = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([a[1] for a in asks]), minlength=len(words)).astype(np.int64)
    seen = counts > 0
    level = Words.build(words[seen], counts[seen])
    real = seen & ~np.isin(words, marks)
    return [narrow(level.count(a[0])) for a in asks], int(counts[real].sum()), int(real.sum())


def level_of(asks: list[tuple], mass: float) -> Level:
    """The level of all blocks' asks: (contexts, followers of each, context counts, followers, counts, shorter)."""
    contexts, place = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
    of = np.zeros(len(contexts), np.int64)
    of[place] = np.concatenate([a[2] for a in asks])  # a context's count is the same in all asks
    key = (np.repeat(place, np.concatenate([a[1] for a in asks])).astype(np.uint64) << U64(32)) | np.concatenate([a[3] for a in asks])
    got = np.concatenate([a[4] for a in asks])
    trained = got > 0  # a gram of held-out documents only is not in the model
    key, first, inv = np.unique(key[trained], return_index=True, return_inverse=True)
    count = np.bincount(inv, weights=got[trained], minlength=len(key)).astype(np.int64)
    shorter = dequantise(np.concatenate([a[5] for a in asks])[trained][first])
    at = (key >> U64(32)).astype(np.int64)
    n = np.bincount(at, minlength=len(contexts))
    return Level.build(contexts[n > 0], n[n > 0], key & U64(0xFFFFFFFF), count, (count + mass * shorter) / (of[at] + mass))


def score(documents: DataFrame, *, order: int = ORDER, block: int = BLOCK, shards: int | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(documents.schema["doc_id"].dataType)

    def packed(batches):
        from pyspark import TaskContext

        part, k, b = TaskContext.get().partitionId(), 0, Packer(order)

        def row(k: int, b: Packer):
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + k], pa.int64()), pa.array([b.size], pa.int64()), pa.array([b.ids], pa.list_(id_type)), pa.array([b.held], pa.list_(pa.bool_())),
                 pa.array([narrow(np.asarray(b.lengths, np.int64))], pa.binary()), pa.array([squeezed(np.concatenate(b.parts).astype("<u4"))], pa.binary()), pa.array([_hash(b.number).tobytes()], pa.binary())],
                names=["block", "size", "ids", "held", "lengths", "stream", "hashes"])

        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = t.as_buffer()
                b.add(i, h, t.to_pybytes() if t is not None else None)
                if b.size >= block:
                    yield row(k, b)
                    k, b = k + 1, Packer(order)
        if b.size:
            yield row(k, b)

    docs = documents.select("doc_id", held_out().alias("held"), F.col(text_col).cast("binary").alias("t"))
    made = docs.mapInArrow(packed, f"block bigint, size bigint, ids array<{kind}>, held array<boolean>, lengths binary, stream binary, hashes binary")
    blocks = stored(made, "block", min(50_000, max(8, 2 * docs.rdd.getNumPartitions())))
    if shards is None:
        shards = max(SHARDS, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // block))
    marks = _hash(start(k) for k in range(1, order))

    def asking(level: int):
        def ask_rows(b: Block, number: int) -> pa.Table:
            rows = [(s, number, level, *x) for s, *x in b.asks()]
            kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 6
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=[x.split()[0] for x in _ASK.split(", ")])

        return ask_rows

    def serving(level: int):
        def serve(t: pa.Table) -> pa.Table:
            raw = [t.column(c).to_pylist() for c in ("contexts", "n", "of", "followers", "counts", "shorter")]
            k, tokens, types = t.num_rows, 0, 0
            if level == 1:
                counts, tokens, types = serve_words([(np.frombuffer(w, np.uint64), wide(c)) for w, c in zip(raw[0], raw[4])], marks)
                codes = [b""] * k
            else:
                asks = [(np.cumsum(unsqueezed(a), dtype=np.uint64), wide(b), wide(c), np.frombuffer(d, "<u4"), wide(e), unsqueezed(f)) for a, b, c, d, e, f in zip(*raw)]
                built = level_of(asks, MASS[level])
                places = [built.find(a[0], a[1], a[3]) for a in asks]
                codes = [squeezed(built.code(at)) for at in places]
                counts = [narrow(counts_at(built.totals, at)) if level < order else b"" for at in places]
            return pa.table({"block": t.column("block"), "level": t.column("level"), "shard": t.column("shard"), "counts": pa.array(counts, pa.binary()), "codes": pa.array(codes, pa.binary()),
                             "tokens": pa.array([tokens] + [0] * (k - 1), pa.int64()), "types": pa.array([types] + [0] * (k - 1), pa.int64())})

        return serve

    def known(left: pa.Table, right: pa.Table, upto: int, n_all: int, v_all: int) -> Block:
        """The block with the answers of the levels up to ``upto``."""
        b = Block({c: left.column(c)[0].as_py() for c in ("held", "lengths", "stream", "hashes")}, order, shards, n_all, v_all)
        by: dict[int, dict] = {}
        for level, s, counts, codes in zip(*(right.column(c).to_pylist() for c in ("level", "shard", "counts", "codes"))):
            by.setdefault(level, {})[s] = (counts, codes)
        for level in range(1, upto + 1):  # a level that was asked for nothing has no answers
            b.learn(by.get(level, {}))
        return b

    def first(batches):
        rows = asking(1)
        for b in batches:
            for r in b.to_pylist():
                yield from rows(Block(r, order, shards), r["block"]).to_batches()

    def further(level: int, n_all: int, v_all: int):
        rows = asking(level)
        return lambda left, right: rows(known(left, right, level - 1, n_all, v_all), left.column("block")[0].as_py())

    told, n_all, v_all = None, 0, 0
    for level in range(1, order + 1):
        if level == 1:
            asks = blocks.mapInArrow(first, _ASK)
        else:
            asks = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(further(level, n_all, v_all), _ASK)
        answers = cut(asks.repartition(shards, "shard").groupBy("shard").applyInArrow(serving(level), _ANSWER))
        if level == 1:
            total = answers.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
            n_all, v_all = int(total["n"] or 0), int(total["v"] or 0)
        told = answers if told is None else told.unionByName(answers)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = known(left, right, order, n_all, v_all)
        at = np.cumsum(b.lengths) - b.lengths
        words, grams = b.tok[b.real], b.g[b.real]
        total = lambda x: pa.array(np.add.reduceat(x, at))
        return pa.table({"doc_id": left.column("ids")[0].values, "held_out": left.column("held")[0].values, "n_tokens": pa.array(b.lengths), "n_known": total((b.c[0] > 0).astype(np.int64)[words]),
                         "train_tokens": pa.array(np.full(len(at), n_all)), "base_score": total(np.log10(b.p[0])[words]), "score": total(np.log10(b.p[-1])[grams])})

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        finish, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
