"""SimHash near-duplicates (2) by anchor-point covering.

Fingerprint: A-Z are lower-cased, words are runs without ASCII white space,
shingles are three words joined by blanks (fewer words: the whole sequence),
and a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Links: two fingerprints at ``THRESHOLD`` = 3 or fewer differing bits.  A
64-bit fingerprint is two halves of 32 bits, and a linked pair differs in at
most one bit of one of them.  On a half, anchors are the code words of the
perfect Hamming code of length 31 with any last bit: covering radius 1, so a
half lies within 1 of exactly one anchor.  A fingerprint is at home there and
is replicated to every anchor within covering radius plus the half's threshold,
2 in all: 16 places a half.  A linked pair then meets at the home of either.

Only distinct fingerprints take part, so exact copies cost nothing.  Rows of an
anchor are compared home against all, whole fingerprints, vectorised; an
anchor gives a spanning forest of its links, never all pairs, so a large group
of near copies gives as many links as members.  An anchor with more than
``LARGE`` rows is cut by four 16-bit blocks of the fingerprint (a linked pair
is equal in one) before comparing.  Components come from the links by
star contraction over DataFrames; the driver sees none of it.

Defined cases: null or wordless text has fingerprint zero, which links like any
other; repeated rows and equal doc_ids each give a row; an empty table gives no
rows; null doc_ids take part in links but never name a component unless nothing
else is there; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.session import cut

THRESHOLD = 3
LARGE = 4096
HOT = 4096


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else list(map(b" ".join, zip(w, w[1:], w[2:])))
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and h (a hash of the text) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = np.empty(b.num_rows, np.uint64)
            for i, t in enumerate(b.column(1)):
                t = t.as_buffer()
                out[i] = fingerprint(t.to_pybytes() if t is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64)), b.column(2)], names=["doc_id", "fp", "h"])

    return documents.select("doc_id", F.col(text_col).cast("binary").alias("t"), text_hash(text_col).alias("h")).mapInArrow(run, f"doc_id {kind}, fp bigint, h bigint")


def text_hash(text_col: str):
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code of length 31: bit i (0..30) has the column i + 1."""
    s = np.zeros(x.shape, np.uint64)
    for j in range(5):
        mask = np.uint64(sum(1 << i for i in range(31) if (i + 1) >> j & 1))
        s |= (np.bitwise_count(x & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    return s


def _home(half: np.ndarray) -> np.ndarray:
    s = _syndrome(half)
    return np.where(s == 0, half, half ^ (np.uint64(1) << (s - np.uint64(1)) % np.uint64(64)))


def anchors(half: np.ndarray) -> np.ndarray:
    """The anchors within 2 of each half (n x 17, its home first; repeats where there are fewer)."""
    home, s = _home(half), _syndrome(half)
    out = [home, home ^ np.uint64(1 << 31)]  # the last bit is uncoded: the home with it flipped is within 2 as well
    for i in range(31):  # the code words at distance 2: flip i, and the bit that then mends the syndrome
        t = s ^ np.uint64(i + 1)
        j = t - np.uint64(1)
        ok = (s != 0) & (t != 0) & (t > np.uint64(i + 1))
        out.append(np.where(ok, half ^ np.uint64(1 << i) ^ (np.uint64(1) << (j % np.uint64(64))), home))
    every = np.stack(out, axis=1)
    rest = np.sort(every[:, 1:], axis=1)
    # 15 distinct ones at most besides the home and its flip; what equals the home is filler
    key = np.where(rest == home[:, None], np.uint64((1 << 64) - 1), rest)
    key = np.sort(key, axis=1)[:, :16]
    return np.concatenate([home[:, None], np.where(key == np.uint64((1 << 64) - 1), home[:, None], key)], axis=1)


def replicate(distinct: DataFrame) -> DataFrame:
    """(anchor, at_home, fp): a row for every place of a fingerprint."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for side, half in enumerate((fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))):
                a = anchors(half)
                keep = np.ones(a.shape, bool)
                keep[:, 1:] = a[:, 1:] != a[:, :1]
                home = np.zeros(a.shape, bool)
                home[:, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((a << np.uint64(1)) | np.uint64(side))[keep].view(np.int64)), pa.array(home[keep]), pa.array(np.repeat(fp, keep.sum(axis=1)).view(np.int64))],
                    names=["anchor", "at_home", "fp"])

    return distinct.mapInArrow(run, "anchor bigint, at_home boolean, fp bigint")


def _forest(fp: np.ndarray, near: int) -> list[tuple[int, int]]:
    """A spanning forest, as (index, index), of distinct fingerprints that differ in ``near`` bits at most."""
    left = np.arange(len(fp))
    links = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(fp[left] ^ fp[x]) <= near
            if close.any():
                got = left[close].tolist()
                links += [(x, y) for y in got]
                queue += got
                left = left[~close]
    return links


def _forest_of_large(fp: np.ndarray, near: int) -> list[tuple[int, int]]:
    links = []
    for block in range(4):
        key = (fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                links += [(int(part[x]), int(part[y])) for x, y in _forest(fp[part], near)]
    return links


def links_within(placed: DataFrame, near: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect what is linked at some anchor.  placed: clustered and sorted by anchor."""

    def of(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sizes = np.diff(np.append(starts, len(anchor)))
        a, b = [], []
        # small anchors: all places against each other at once, by distance in the sorted rows
        small = np.repeat(sizes <= 32, sizes)
        for d in range(1, int(min(32, sizes.max(initial=0)))):
            x = np.flatnonzero((anchor[d:] == anchor[:-d]) & small[d:])
            x = x[home[x] | home[x + d]]
            x = x[np.bitwise_count(fp[x] ^ fp[x + d]) <= near]
            a.append(fp[x])
            b.append(fp[x + d])
        for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
            if home[s : s + n].any():
                part = fp[s : s + n]
                got = np.asarray((_forest if n <= LARGE else _forest_of_large)(part, near), dtype=np.int64).reshape(-1, 2)
                a.append(part[got[:, 0]])
                b.append(part[got[:, 1]])
        return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(rows):
            anchor, home, fp = (np.concatenate([r[i] for r in rows]) for i in range(3))
            a, b = of(anchor, fp, home)
            if len(a):
                p = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
                new = [x for x in map(tuple, p.tolist()) if x not in seen]
                if len(seen) < 200_000:
                    seen.update(new)
                if new:
                    q = np.asarray(new, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(q[:, 0].copy().view(np.int64)), pa.array(q[:, 1].copy().view(np.int64))], names=["a", "b"])

        for bt in batches:
            if not bt.num_rows:
                continue
            anchor = bt.column(0).to_numpy(zero_copy_only=False)
            home = np.asarray(bt.column(1).to_pylist(), dtype=bool) if bt.num_rows < 64 else bt.column(1).cast(pa.uint8()).to_numpy(zero_copy_only=False).astype(bool)
            fp = bt.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            # the last anchor of a batch may go on in the next one
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last:
                yield from flush([*held, (anchor[:last], home[:last], fp[:last])])
                held = []
            elif held and held[-1][0][-1] != anchor[0]:
                yield from flush(held)
                held = []
            held.append((anchor[last:], home[last:], fp[last:]))
        if held:
            yield from flush(held)

    return placed.mapInArrow(run, "a bigint, b bigint")


def _grouped(documents: DataFrame, near: int, text_col: str) -> DataFrame:
    """doc_id, fp, h, root (a fingerprint of the component) and component_id of every row."""
    docs = cut(fingerprints(documents, text_col))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    parts = max(8, documents.rdd.getNumPartitions(), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = replicate(distinct.select("fp")).repartition(parts, "anchor").sortWithinPartitions("anchor")
    roots = connected_components(links_within(placed, near))
    # the smallest doc_id of each component that has more than one fingerprint
    low = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "low").unionByName(
        distinct.join(roots.select("root").distinct(), distinct.fp == F.col("root"), "left_semi").select("fp", F.col("fp").alias("root"), "low"))
    low = cut(low)
    best = low.groupBy("root").agg(F.min("low").alias("c"))
    of_linked = low.join(best, "root").select("fp", "root", F.col("c").alias("linked"))
    known = distinct.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("linked", "low").alias("component_id"))
    # a fingerprint with over 1/HOT of all rows is one of HOT at most: these are broadcast, the others' rows meet them by shuffle
    many = F.col("n") * HOT > docs.count()
    hot, cold = known.where(many).drop("n"), known.where(~many).drop("n")
    return docs.join(F.broadcast(hot), "fp").unionByName(docs.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp"))


def near_duplicates(documents: DataFrame, *, near: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable) of every row."""
    return _grouped(documents, near, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, *, near: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest doc_id.

    Where that id repeats within the group, its text with the smallest hash
    stays, once; rows without an id come after all others.
    """
    from pyspark.sql import Window

    rows = _grouped(documents, near, text_col)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("f"))
    named = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    names = documents.columns
    free = "_" * (1 + max(map(len, names)))  # no column's name
    keys, number = [f"{free}i", f"{free}h"], f"{free}n"
    stays = first.select(named("f.doc_id").alias(keys[0]), F.col("f.h").alias(keys[1]))
    # the join and the numbering of repeated rows have the same keys: one shuffle
    w = Window.partitionBy(*keys).orderBy(F.lit(1))
    kept = documents.withColumns({keys[0]: named("doc_id"), keys[1]: text_hash(text_col)}).join(stays.hint("shuffle_hash"), keys, "left_semi")
    return kept.withColumn(number, F.row_number().over(w)).where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in names])
