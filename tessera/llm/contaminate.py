"""Benchmark decontamination (7): one Aho-Corasick automaton over normalised benchmark text.

Normalisation lower-cases A-Z and keeps words of ASCII letters, digits and
anything beyond ASCII; every other byte separates words.  It works on UTF-8
bytes, one to one, so a word's place leads straight back to the original text.
Windows are ``window`` consecutive words of an item; an item of fewer words is
one window.  The automaton's letters are the numbers of the benchmark's words
(0: any other word), its patterns the distinct windows, and it reads a document
once.

The windows are made and counted by a job; what is broadcast is bounded by
``max_nodes``, the nodes that an automaton can have (window times windows).  A
larger benchmark is dealt by the windows' hash into as many automata as it
needs, and documents pass one scan for each; the hits travel in a column, so no
shuffle is needed for any size.

Defined cases: null or wordless text has no words and is never hit; an item
without words has no window; items with equal windows are all reported; an item
without an id hits words but is not listed; repeated rows are each reported; an
empty benchmark marks nothing; texts of any length are read whole; extra columns
of ``documents`` are ignored by ``decontaminate`` and kept by
``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

WINDOW = 10
MAX_NODES = 2_000_000

_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(text: bytes | None, window: int = WINDOW) -> list[bytes]:
    """The distinct windows of one item, words between blanks."""
    w = words_of(text)
    m = min(window, len(w))
    return list(dict.fromkeys(b" ".join(w[i : i + m]) for i in range(len(w) - m + 1))) if w else []


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w, items): every distinct window and the ids of the items that hold it."""

    def run(batches):
        for b in batches:
            item, found = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                got = windows_of(t, window)
                item += [r] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(0).take(pa.array(item, pa.int32()))], names=["w", "item"])

    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    return b.mapInArrow(run, "w binary, item string").groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Matcher:
    """The automaton of some windows, over word numbers."""

    def __init__(self, found: list[tuple[bytes, tuple[str, ...]]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        number = self.number
        for w, items in found:
            key = tuple(number.setdefault(x, len(number) + 1) for x in w.split(b" "))
            self.automaton.add_word(key, (len(key), items))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges (first, last) and items of one text."""
        w = words_of(text)
        hits, items = [], set()
        if w and self.number:
            get = self.number.get
            ids = tuple(map(get, w, repeat(0)))
            if any(ids):
                for last, (m, who) in self.automaton.iter(ids):
                    hits.append((last - m + 1, last))
                    items.update(who)
        return len(w), hits, items


_MATCHERS: dict[str, Matcher] = {}


def matcher(key: str, shared) -> Matcher:
    """The worker's own, built once from the broadcast windows and kept between tasks."""
    if key not in _MATCHERS:
        if len(_MATCHERS) > 1:
            _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value)
    return _MATCHERS[key]


def n_covered(n: int, hits: list[tuple[int, int]]) -> int:
    if not len(hits):
        return 0
    d = np.zeros(n + 1, dtype=np.int64)
    h = np.asarray(hits, dtype=np.int64)
    np.add.at(d, h[:, 0], 1)
    np.add.at(d, h[:, 1] + 1, -1)
    return int((np.cumsum(d[:n]) > 0).sum())


def spans_in_original(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as (start, end) code points of the original text, end exclusive, merged and sorted."""
    norm = np.frombuffer(text.translate(_TABLE), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], norm.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    merged: list[list[int]] = []
    for a, b in sorted(set(hits)):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(int(chars[starts[a]]), int(chars[ends[b]])) for a, b in merged]


def benchmark_parts(benchmark: DataFrame, window: int, max_nodes: int) -> Iterator[tuple[str, object]]:
    """(key, broadcast windows): as many as keep each automaton within ``max_nodes``."""
    made = cut(windows(benchmark, window))
    n = max(1, -(-made.count() * window // max_nodes))
    for k in range(n):
        part = made if n == 1 else made.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k)
        found = [(bytes(r["w"]), tuple(r["items"])) for r in part.toLocalIterator()]  # about max_nodes / window rows
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(found)


_STATE = "struct<n:bigint,hits:binary,items:array<string>,spans:array<struct<start:int,end:int>>>"


def mark(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_nodes: int = MAX_NODES, text_col: str = "text", into: str = "marked") -> DataFrame:
    """``documents`` with a column ``into``: number of words, hits (int32 pairs of first and last word), items, spans in the original text."""
    df = documents.withColumn(into, F.lit(None).cast(_STATE))
    schema = df.schema
    for key, shared in benchmark_parts(benchmark, window, max_nodes):

        def scan(batches, key=key, shared=shared):
            m = matcher(key, shared)
            for b in batches:
                at, state = b.schema.get_field_index(into), []
                for t, old in zip(b.column(b.schema.get_field_index(text_col)).cast(pa.binary()), b.column(at).to_pylist()):
                    t = None if (x := t.as_buffer()) is None else x.to_pybytes()
                    n, hits, items = m.scan(t)
                    if old and old["hits"]:
                        hits += map(tuple, np.frombuffer(old["hits"], dtype=np.int32).reshape(-1, 2).tolist())
                        items.update(old["items"])
                    state.append({"n": n, "hits": np.asarray(sorted(set(hits)), dtype=np.int32).tobytes() if hits else None, "items": sorted(items),
                                  "spans": [{"start": a, "end": z} for a, z in spans_in_original(t, hits)] if hits else []})
                yield b.set_column(at, b.schema.field(at), pa.array(state, b.schema.field(at).type))

        df = df.mapInArrow(scan, schema)
    return df


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans of its text in code points."""
    marked = mark(documents.select("doc_id", F.col(text_col).alias("text")), benchmark, **options).select("doc_id", "marked")

    def tell(batches):
        for b in batches:
            state = b.column(1).to_pylist()
            n_hit = [n_covered(s["n"], np.frombuffer(s["hits"], dtype=np.int32).reshape(-1, 2)) if s["hits"] else 0 for s in state]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s["n"] for s in state], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(s["items"]) for s in state], pa.int64()),
                 pa.array([hashlib.sha256(",".join(s["items"]).encode()).hexdigest() for s in state]), pa.array([n > 0 for n in n_hit]), b.column(1).field(3)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(tell, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_nodes: int = MAX_NODES, text_col: str = "text") -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns: one filter an automaton."""
    df = documents
    for key, shared in benchmark_parts(benchmark, window, max_nodes):

        def clean(batches, key=key, shared=shared):
            m = matcher(key, shared)
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).cast(pa.binary())
                yield b.filter(pa.array([not m.scan(t.as_buffer().to_pybytes() if t.is_valid else None)[1] for t in texts], pa.bool_()))

        df = df.mapInArrow(clean, documents.schema)
    return df
