"""Language identification (8): a linear-chain conditional random field over words.

A word (a run of letters and anything beyond ASCII) has features for its
affixes and inner n-grams (2 to 4 bytes of the word between blanks, so that
n-grams at an edge are affixes) and for itself (the lexicon), all hashed into
``DIM`` weights a label.  Transitions between labels are learned with them, by
gradient descent on the likelihood of runs of ``RUN`` words that are put
together from pieces of several languages, as in code-switched text.
Forward-backward gives each word's label probabilities; a document's language
has the largest sum of them, and its score is that sum's share.

Fitting takes a bounded sample of labelled rows: the ``PER_LABEL`` documents of
each label with the smallest hash of the id, and of each ``RUNS`` runs of
``RUN`` words, one from every stretch of the whole text (all words of a text
that has no more).  The rows are found by a threshold on the hash, so no label
meets in one task.  At most the ``MAX_LABELS`` most frequent labels are learned.
Prediction reads whole texts.  Long texts are cut into chunks only to compute
side by side: a chunk is first a matrix from its left to its right edge, edges
are then filled in along each document, so results are those of one pass.

Defined cases: null text or text without a letter is ``und`` with score 0; so
is all text if nothing labelled was learned from; ties go to the first label in
order; texts of any length are read whole; repeated rows each give a row; documents without a label are predicted
but not learned from; extra columns are ignored by ``predict`` and kept by
``keep_identified``.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, RUN, RUNS, PER_LABEL, STEPS, BATCH, CHUNK = 1 << 16, 32, 64, 400, 160, 192, 96
MAX_LABELS = 256
CACHE = 400_000
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return any(97 <= c <= 122 for c in set(text.lower())) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in order, and where each word's begin."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    blank = buf == 32
    word_at = np.cumsum(blank) - 1  # of each place: the word that a gram starting there belongs to
    n = len(words)
    idx, owner = [np.fromiter(map(crc32, words), dtype=np.uint32, count=n) % DIM], [np.arange(n)]
    h = buf.copy()
    for size in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) ^ buf[size - 1 :]
        ok = np.ones(len(h), bool)
        for k in range(1, size - 1):
            ok &= ~blank[k : k + len(h)]
        ok &= ~(blank[: len(h)] & blank[size - 1 :][: len(h)] if size == 2 else np.zeros(len(h), bool))
        mixed = (h[ok] ^ np.uint32(0x9E3779B1 * size & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        # a gram that starts at a blank belongs to the word behind it, and word_at says so there already
        idx.append((mixed >> np.uint32(13)) % DIM)
        owner.append(np.minimum(word_at[: len(h)][ok], n - 1))
    idx, owner = np.concatenate(idx), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return idx[order].astype(np.int64), np.searchsorted(owner[order], np.arange(n))


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Log potentials (words x labels)."""
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    out = []
    for at in range(0, len(words), 50_000):
        idx, start = features(words[at : at + 50_000])
        out.append(np.add.reduceat(weights[idx], start, axis=0))
    return np.concatenate(out)


def marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Label probabilities of each word.  e: log potentials of documents one after the other; lengths: their words."""
    n_labels = e.shape[1]
    if not len(e):
        return np.zeros_like(e)
    t = np.exp(trans - trans.max()).astype(np.float32)
    p = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    per = -(-lengths // chunk)  # chunks of each document
    first = np.cumsum(per) - per
    doc_start = np.cumsum(lengths) - lengths
    total = int(per.sum())
    which = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(total) - first[which]
    start, size = doc_start[which] + k * chunk, np.minimum(chunk, lengths[which] - k * chunk)
    order = np.argsort(-size, kind="stable")  # at each step the chunks that go on are the first ones
    so, zo = start[order], size[order]
    active = [int((zo > s).sum()) for s in range(int(zo[0]))]
    m = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (total, n_labels, n_labels)).copy()
    many = per[which[order]] > 1  # one chunk needs no matrix
    if many.any():
        sel = np.flatnonzero(many)
        for s, a in enumerate(active):
            i = sel[: np.searchsorted(sel, a)]
            x = (m[i] @ t) * p[so[i] + s][:, None, :]
            m[i] = x / x.max(axis=(1, 2), keepdims=True)
    back = np.empty(total, np.int64)
    back[order] = np.arange(total)
    left = np.full((total, n_labels), 1.0 / n_labels, np.float32)
    right = np.full((total, n_labels), 1.0, np.float32)
    for s in range(1, int(per.max())):  # along each document, all documents at once
        d = np.flatnonzero(per > s)
        x = np.einsum("il,ilk->ik", left[first[d] + s - 1], m[back[first[d] + s - 1]])
        left[first[d] + s] = x / x.sum(axis=1, keepdims=True)
        c = first[d] + per[d] - 1 - s
        x = np.einsum("ilk,ik->il", m[back[c + 1]], right[c + 1])
        right[c] = x / x.max(axis=1, keepdims=True)
    alpha = np.empty_like(p)
    a_now = left[order]
    for s, a in enumerate(active):
        x = (a_now[:a] @ t) * p[so[:a] + s]
        a_now[:a] = x / x.sum(axis=1, keepdims=True)
        alpha[so[:a] + s] = a_now[:a]
    b_now = right[order]
    for s in range(len(active) - 1, -1, -1):
        a = active[s]
        at = so[:a] + s
        g = alpha[at] * b_now[:a]
        x = (b_now[:a] * p[at]) @ t.T
        b_now[:a] = x / x.max(axis=1, keepdims=True)
        alpha[at] = g / g.sum(axis=1, keepdims=True)
    return alpha


def train(docs: list[tuple[int, bytes]], n_labels: int, *, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from (label, text) pairs."""
    rng = np.random.default_rng(seed)
    by = [[w for y, t in docs if y == label and len(w := words_of(t)) >= 1] for label in range(n_labels)]
    have = [i for i in range(n_labels) if by[i]]
    w, tr = np.zeros((DIM, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float64)
    gw, gt = np.full((DIM, n_labels), 1e-3, np.float32), np.full((n_labels, n_labels), 1e-3)
    if len(have) < 2:
        return w, tr
    for step in range(steps):
        words, ys = [], []
        for _ in range(BATCH):
            run, y = [], []
            while len(run) < RUN:
                label = have[rng.integers(len(have))]
                d = by[label][rng.integers(len(by[label]))]
                n = min(RUN - len(run), int(rng.integers(3, RUN)))
                at = int(rng.integers(max(1, len(d) - n + 1)))
                part = d[at : at + n]
                run += part
                y += [label] * len(part)
            words += run[:RUN]
            ys += y[:RUN]
        idx, start = features(words)
        counts = np.diff(np.append(start, len(idx)))
        e = np.add.reduceat(w[idx], start, axis=0).reshape(BATCH, RUN, n_labels)
        y = np.asarray(ys).reshape(BATCH, RUN)
        p = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64)
        t = np.exp(tr - tr.max())
        a, b = np.empty_like(p), np.empty_like(p)
        cur = np.full((BATCH, n_labels), 1.0 / n_labels)
        for s in range(RUN):
            cur = (cur @ t) * p[:, s]
            cur /= cur.sum(axis=1, keepdims=True)
            a[:, s] = cur
        cur = np.ones((BATCH, n_labels))
        for s in range(RUN - 1, -1, -1):
            b[:, s] = cur
            cur = (cur * p[:, s]) @ t.T
            cur /= cur.sum(axis=1, keepdims=True)
        g = a * b
        g /= g.sum(axis=2, keepdims=True)
        pair = a[:, :-1, :, None] * t[None, None] * (p[:, 1:] * b[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        seen = np.zeros((n_labels, n_labels))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        d_t = (pair.sum(axis=(0, 1)) - seen) / BATCH
        g.reshape(-1, n_labels)[np.arange(BATCH * RUN), y.ravel()] -= 1.0
        of_word = np.repeat(np.arange(BATCH * RUN), counts)
        gg = g.reshape(-1, n_labels)
        d_w = np.stack([np.bincount(idx, weights=gg[of_word, label], minlength=DIM) for label in range(n_labels)], axis=1).astype(np.float32) / BATCH + 1e-5 * w
        gw += d_w * d_w
        gt += d_t * d_t
        w -= 0.25 * d_w / np.sqrt(gw)
        tr -= 0.1 * d_t / np.sqrt(gt)
    return w, tr


class Model:
    """Labels, weights and transitions; a worker keeps the potentials of the words it has seen."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans
        self._reset()

    def __reduce__(self):
        return Model, (self.labels, self.weights, self.trans)

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.known = np.zeros((0, len(self.labels)), np.float32)

    def word_marginals(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.number) > CACHE:
            self._reset()
        number = self.number
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in texts for w in ws), dtype=np.int64, count=sum(map(len, texts)))
        if len(number) > len(self.known):
            new = list(number)[len(self.known) :]
            self.known = np.concatenate([self.known, emissions(new, self.weights)])
        lengths = np.asarray([len(w) for w in texts], dtype=np.int64)
        return marginals(self.known[ids], lengths[lengths > 0], self.trans)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return lang, score
        at, group, held = [], [], 0

        def flush() -> None:
            g = self.word_marginals(group)
            n = np.asarray([len(w) for w in group])
            s = np.add.reduceat(g, np.cumsum(n) - n, axis=0, dtype=np.float64)
            for i, row, k in zip(at, s, n):
                j = int(np.argmax(row))
                lang[i], score[i] = self.labels[j], float(min(1.0, row[j] / k))

        for i, t in enumerate(texts):
            w = words_of(t)
            if w and has_letter(t):
                at.append(i)
                group.append(w)
                held += len(w)
                if held > 1_000_000:
                    flush()
                    at, group, held = [], [], 0
        if group:
            flush()
        return lang, score


def sampled(text: bytes, runs: int = RUNS, run: int = RUN) -> bytes:
    """``runs`` runs of words, one at a random place of each equal stretch of the text; all words where there are no more."""
    w = words_of(text)
    if len(w) > runs * run:
        edge = np.linspace(0, len(w), runs + 1).astype(int)
        at = np.random.default_rng(crc32(text)).integers(edge[:-1], edge[1:] - run + 1)
        w = [x for i in at.tolist() for x in w[i : i + run]]
    return b" ".join(w)


def fit(documents: DataFrame, *, per_label: int = PER_LABEL, text_col: str = "text", label_col: str = "lang") -> Model:
    """A model from the rows of ``documents`` that have an id, a label and a text."""
    d = documents.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col("doc_id").isNotNull())
    count = d.groupBy(F.col(label_col).alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MAX_LABELS).collect()
    if not count:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0)))
    # of each label half as many again as are asked for, so that chance leaves enough
    share = F.create_map(*[x for r in count for x in (F.lit(r["y"]), F.lit(min(1 << 31, (3 * per_label << 30) // r["n"] + 1)))])
    some = d.select(F.col(label_col).alias("y"), F.xxhash64("doc_id").alias("h"), F.col(text_col).cast("binary").alias("t")).where(F.pmod("h", F.lit(1 << 31)) < share[F.col("y")])

    def pick(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sampled(t) for t in b.column(2).to_pylist()], pa.binary())], names=["y", "h", "t"])

    # an id that repeats with a label is taken once
    rows = some.mapInArrow(pick, "y string, h bigint, t binary").groupBy("y", "h").agg(F.min("t").alias("t")).collect()
    labels = sorted({r["y"] for r in rows})
    docs, taken = [], dict.fromkeys(labels, 0)
    for r in sorted(rows, key=lambda r: (r["h"] % (1 << 31), r["h"], r["y"])):
        if taken[r["y"]] < per_label:
            taken[r["y"]] += 1
            docs.append((labels.index(r["y"]), bytes(r["t"])))
    return Model(labels, *train(sorted(docs), len(labels)))


_MODELS: dict[str, Model] = {}


def _mine(key: str, shared) -> Model:
    """The worker's own copy, kept between tasks with the words it has seen."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = shared.value
    return _MODELS[key]


def held_out(mod: int = 5, rest: int = 0):
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod) == rest


def _model_of(documents: DataFrame):
    import uuid

    model = fit(documents.where(~held_out()))
    return uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(model)  # DIM x labels floats


def predict(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    key, shared = _model_of(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = _mine(key, shared)
        for b in batches:
            texts = [None if (x := t.as_buffer()) is None else x.to_pybytes() for t in b.column(2)]
            lang, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, *, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose language is told with ``min_score`` or more, with all their columns."""
    key, shared = _model_of(documents)

    def run(batches):
        model = _mine(key, shared)
        for b in batches:
            i = b.schema.get_field_index(text_col)
            texts = [None if (x := t.as_buffer()) is None else x.to_pybytes() for t in b.column(i).cast(pa.binary())]
            lang, score = model.predict(texts)
            yield b.filter(pa.array([y != "und" and s >= min_score for y, s in zip(lang, score)]))

    return documents.mapInArrow(run, documents.schema)
