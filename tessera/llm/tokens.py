"""Token ids of texts by a word-splitting tokenizer, one run between blanks at a time.

The tokenizer splits at white space before anything else, so a run encodes
alike wherever it stands, and a worker keeps the ids of the runs it has seen,
``CACHE`` at most.  Runs not yet seen are encoded together, many in one call,
with a mark between them.
"""

from __future__ import annotations

import os

import numpy as np

CACHE = 900_000
_SPACES = bytes(32 if c in b"\t\n\r " else c for c in range(256))
_MARK = "⌘"
_PUNCTUATION = b"!#$%&()*+,-./:;=?@[]^_`{|}~"  # not the apostrophe, which can begin a word, nor what special tokens hold
_OPEN: dict[tuple[str, bool], RunIds] = {}


class RunIds:
    """Run -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain  # special tokens' strings are then ordinary text
        self.mark = np.asarray(self._ids(_MARK), dtype="<u4")
        vocab = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, runs: list[bytes]) -> None:
        """Three ways: letters only are one word each; letters and then punctuation are two; the rest go between marks."""
        known = self.known
        words, split, rest = {}, [], []
        for r in runs:
            base = r.rstrip(_PUNCTUATION)
            text = base.decode("utf-8", "replace")
            if not text.isascii():  # a character at a time, as the tokenizer does: str.lower() writes a last sigma otherwise
                text = "".join(map(str.lower, text))
            if not text.isalpha() or len(text) > 200:
                rest.append(r)
                continue
            if base not in known:
                words[base] = text
            if len(base) < len(r):
                split.append((r, base))
        w = list(words)
        for at in range(0, len(w), 4000):
            part = w[at : at + 4000]
            ids = np.asarray(self.tok.encode_batch_fast([" ".join([words[x] for x in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and (not len(ids) or ends[-1] == len(ids)):
                data, ends = ids.tobytes(), (4 * ends).tolist()
                for x, i, j in zip(part, [0, *ends], ends):
                    known[x] = data[i:j]
            else:
                rest += part
        self._between_marks(rest)
        tails = {r[len(base) :] for r, base in split}
        self._between_marks([t for t in tails if t not in known])
        for r, base in split:
            known[r] = known[base] + known[r[len(base) :]]

    def _between_marks(self, runs: list[bytes]) -> None:
        known, m = self.known, len(self.mark)
        for at in range(0, len(runs), 4000):
            part = runs[at : at + 4000]
            texts = [r.decode("utf-8", "replace") for r in part]
            safe = [i for i, t in enumerate(texts) if _MARK not in t and len(t) < 200]
            ids = np.asarray(self.tok.encode_batch_fast([f" {_MARK} ".join(["", *(texts[i] for i in safe), ""])], add_special_tokens=False)[0].ids, dtype="<u4")
            hit = np.ones(max(0, len(ids) - m + 1), bool)
            for k in range(m):
                hit &= ids[k : k + len(hit)] == self.mark[k]
            cuts = np.flatnonzero(hit)
            if len(cuts) == len(safe) + 1:  # else the mark's ids came out of a run: encode them one by one
                data = ids.tobytes()
                for j, i in enumerate(safe):
                    known[part[i]] = data[4 * (cuts[j] + m) : 4 * cuts[j + 1]]
            for i, r in enumerate(part):
                if r not in known:
                    known[r] = np.asarray(self._ids(texts[i]), dtype="<u4").tobytes()

    def encode(self, texts: list[bytes | None], end_id: int = 0):
        """The ids and an end id of each text, 4 bytes each, one text at a time."""
        end, at = end_id.to_bytes(4, "little"), 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < 4 << 20):
                t = texts[at] or b""
                size += len(t)
                # lower case comes out of the tokenizer anyway; special tokens' strings keep their case
                t = t if b"<|" in t else t.lower()
                group.append(t.translate(_SPACES).split(b" "))
                at += 1
            if len(self.known) > CACHE:
                self.known.clear()
            new = set().union(*group).difference(self.known)
            self._learn(list(new))
            get = self.known.__getitem__
            for runs in group:
                yield b"".join(map(get, runs)) + end


def run_ids(path: str, plain: bool = False) -> RunIds:
    if (path, plain) not in _OPEN:
        _OPEN[path, plain] = RunIds(path, plain)
    return _OPEN[path, plain]
