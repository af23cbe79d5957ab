"""Operators on texts against brute force, with the defined cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tessera.llm import contaminate, langid, license, lm, packing, simhash, tokencount
from tessera.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards box with quite a few jolly judges near old mill"


def rows(*texts, ids=None):
    return [(i if ids is None else ids[k], t, "en", "s", len(t or "")) for k, (i, t) in enumerate(enumerate(texts))]


TEXTS = rows(BASE, BASE, BASE.upper(), BASE + " tail", None, "", " \t\n", "one", "one two", "é ñ Ünïcode ‘quoted’ text", "All Rights Reserved", "x" * 300, " ".join(f"w{i % 977}" for i in range(30_000)),
             "licensed under the Apache License, Version 2.0", "GNU General Public License general public license version 3 licensed under the gnu general public license version 3", BASE + " cc by")
TEXTS += [TEXTS[0], (None, BASE, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """The table with extra columns named like those that the operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("fp", "t", "h", "s", "fingerprint", "component_id", "n_words", "score", "labels", "held_out", "piece", "g", "marked", "spans", "_n", "file", "block", "anchor")})


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x, 42) for x in g]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, near=3):
    at = list(range(len(fps)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near:
                at[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(docs):
    got = simhash.near_duplicates(clash(docs)).collect()
    fps = [brute_fingerprint(r[1]) for r in TEXTS]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(TEXTS, fps, brute_components([r[0] for r in TEXTS], fps)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_simhash_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for c in centres.tolist():
        for n in range(12):
            x = c
            for b in rng.choice(64, n % 5, replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    from tessera.llm.components import connected_components

    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    placed = simhash.replicate(df).repartition(4, "anchor").sortWithinPartitions("anchor")
    found = connected_components(simhash.links_within(placed)).collect()
    roots = {x % (1 << 64): r["root"] for r in found for x in (r["node"], r["root"])}
    want = brute_components(list(range(len(fps))), fps)
    groups = {}
    for x, c in zip(fps, want):
        groups.setdefault(c, []).append(x)
    for members in groups.values():
        if len(members) > 1:
            assert len({roots[m] for m in members}) == 1
        else:
            assert members[0] not in roots
    assert len({roots[m[0]] for m in groups.values() if len(m) > 1}) == sum(len(m) > 1 for m in groups.values())


def test_every_pair_within_three_bits_meets_at_a_home():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, 300, dtype=np.uint64)
    for flips in (0, 1):
        b = a.copy()
        for _ in range(flips):
            b ^= np.uint64(1) << rng.integers(0, 32, len(a), dtype=np.uint64)
        pa, pb = simhash.anchors(a), simhash.anchors(b)
        assert all(x[0] in set(y.tolist()) and y[0] in set(x.tolist()) for x, y in zip(pa, pb))


def test_keep_one_keeps_one_of_each_group_and_all_columns(docs):
    src = clash(docs)
    kept = simhash.keep_one(src)
    assert kept.columns == src.columns
    fps = [brute_fingerprint(r[1]) for r in TEXTS]
    want = set(brute_components([r[0] for r in TEXTS], fps))
    got = [r["doc_id"] for r in kept.collect()]
    assert Counter(got) == Counter(want)


OTHER_TEXT = " ".join(f"other{i}" for i in range(40))


@pytest.mark.parametrize("ids_and_texts, want", [
    ([(1, OTHER_TEXT), (5, BASE), (5, OTHER_TEXT)], [(1, OTHER_TEXT), (5, BASE)]), ([(5, BASE), (5, BASE), (None, BASE)], [(5, BASE)]),
    ([(None, BASE), (None, BASE), (None, None), (7, "")], [(7, ""), (None, BASE)]), ([(3, BASE), (3, BASE.upper()), (4, BASE)], None)])
def test_keep_one_of_repeated_and_missing_ids(spark, ids_and_texts, want):
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(ids_and_texts, "doc_id bigint, text string")).collect()]
    if want is None:  # one of two texts of the smallest id
        assert len(got) == 1 and got[0][0] == 3
    else:
        assert Counter(got) == Counter(want)


def test_a_hot_fingerprint_and_many_single_ones(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    texts = [(i, BASE if i % 3 == 0 else " ".join(f"d{i}x{k}" for k in range(30))) for i in range(90)]
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    fps = [brute_fingerprint(t) for _, t in texts]
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(zip(range(90), brute_components(range(90), fps))) and len(got) == 90


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [("a", BASE), ("b", "fox jumps over"), ("c", None), ("d", "!?"), ("e", "fox jumps over"), (None, "seven wizards"), ("f", "one"), ("a", BASE)]


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute_hits(text):
    w, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        x = words(t)
        m = min(10, len(x))
        for i in range(len(x) - m + 1 if x else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == x[i : i + m]:
                    hit |= set(range(k, k + m))
                    items |= {item} - {None}
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("nodes", [1 << 20, 60])
def test_decontaminate_equals_brute_force(spark, docs, nodes):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = contaminate.decontaminate(clash(docs), bench, max_nodes=nodes).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter((r[0], *brute_hits(r[1])) for r in TEXTS)
    by = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert by[3] == [(0, len(BASE))] and by[4] == [] and by[2] == [(0, len(BASE))]
    clean = contaminate.drop_contaminated(clash(docs), bench, max_nodes=nodes)
    assert clean.columns == clash(docs).columns
    assert Counter(r["text"] for r in clean.collect()) == Counter(r[1] for r in TEXTS if not brute_hits(r[1])[4])


def test_decontaminate_spans_lead_to_the_original():
    text = "Ünder – The QUICK brown-fox, jumps".encode()
    n, hits, items = contaminate.Matcher([(b"quick brown fox", ("a",))]).scan(text)
    (a, z), = contaminate.spans_in_original(text, hits)
    assert text.decode()[a:z] == "QUICK brown-fox" and items == {"a"} and n == 7  # the dash is a word too


def test_empty_benchmark_marks_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert not any(r["contaminated"] for r in contaminate.decontaminate(docs, none).collect())
    assert contaminate.drop_contaminated(docs, none).count() == len(TEXTS)


def brute_pieces(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = np.asarray([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]


def test_packing_is_whole_and_gapless(docs):
    got = packing.pack(clash(docs), tokenizer_path()).collect()
    want = Counter((r[0], *p) for r in TEXTS for p in brute_pieces(r[1]))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    at, total = {}, 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        total += r["length"]
    assert max(at.values()) <= 2048 and len(at) <= -(-total // 2048) + 1


def fewest(lengths, size):
    """Smallest number of bins by exhaustive search."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bin_completion_beats_best_fit_and_meets_the_optimum():
    rng = np.random.default_rng(2)
    better = 0
    for _ in range(60):
        x = sorted(rng.integers(15, 60, 9).tolist(), reverse=True)
        got = packing.pack_lengths(x, 100)
        assert sorted(v for b in got for v in b) == sorted(x) and all(sum(b) <= 100 for b in got)
        best = fewest(x, 100)
        assert best <= len(got) <= len(packing.best_fit(x, 100))
        better += len(got) < len(packing.best_fit(x, 100))
        assert len(got) == best
    assert better > 0


def test_completions_are_all_undominated_fillings():
    from itertools import combinations

    rng = np.random.default_rng(8)
    for _ in range(40):
        size, x = 40, sorted(rng.integers(3, 30, 8).tolist())
        first, rest = x[-1], x[:-1]
        subsets = {tuple(sorted(c)) for k in range(len(rest) + 1) for c in combinations(rest, k) if sum(c) <= size - first}

        def dominated(c):
            out = Counter(rest) - Counter(c)
            room = size - first - sum(c)
            return any((sum(p) < y or len(p) > 1 and sum(p) == y) and y <= sum(p) + room for k in range(len(c) + 1) for p in combinations(c, k) for y in out)

        want = {c for c in subsets if not dominated(c)}
        got = [tuple(sorted(c)) for c in packing.completions(first, sorted(set(x)), Counter(x), size, size)]
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(c) for c in got] == sorted((sum(c) for c in got), reverse=True)


def test_bin_completion_takes_all_bins_of_a_large_group():
    x = [1034] * 600 + [532] * 600 + [522] * 600 + [492] * 1200
    got = packing.pack_lengths(x)
    assert sorted(v for b in got for v in b) == sorted(x) and all(sum(b) <= 2048 for b in got)
    assert len(got) == 900 and len(packing.best_fit(x, 2048)) == 1100
    assert packing.least_bins([1100] * 10 + [900] * 3 + [800] * 9, 2048) == 11  # 2 of the 12 small ones, two in a bin
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = rng.integers(10, 90, 8).tolist()
        assert packing.least_bins(x, 100) <= fewest(x, 100)


def test_token_runs_encode_like_the_tokenizer(docs):
    from tessera.llm.tokens import run_ids
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = [r[1] for r in TEXTS] + ["it's a <|endoftext|> mark, don't!", "⌘ command ⌘", "a\u00a0b\u2003c", "ǅ İ ß \U0001f600 ok", "a" * 5000, "…--...!!!", "12,345.67 (x)", "ΟΔΟΣ ΟΔΟΣ, Σ ΑΣ ΣΑΣ.", "ДОМ Дом"]
    for t, data in zip(texts, run_ids(tokenizer_path()).encode([None if t is None else t.encode() for t in texts])):
        assert np.frombuffer(data, "<u4").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 0], t


def test_mixed_alphabets_encode_like_the_tokenizer():
    from tessera.llm.tokens import run_ids
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(11)
    letters = list("abXYZ ΣσςΟΔαβ ДжЯя İıßẞ ǅǈ éÉñ שלום 中文字 0129 '.,!-_ \u0301")
    texts = ["".join(rng.choice(letters, rng.integers(1, 24))) for _ in range(2000)]
    for t, data in zip(texts, run_ids(tokenizer_path()).encode([t.encode() for t in texts])):
        assert np.frombuffer(data, "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t


def test_ids_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, BASE)], "doc_id bigint, text string")
    with pytest.raises(Exception, match="does not fit"):
        tokencount.count_documents(df, tokenizer_path(), 7, width=1)


@pytest.mark.parametrize("block_bytes", [64, 1 << 12])
def test_token_counts_across_blocks(docs, block_bytes):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = tokencount.count_documents(clash(docs), tokenizer_path(), 49407, block_bytes=block_bytes).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in TEXTS)


def test_token_files_as_bytes(spark, tmp_path):
    x = np.asarray([5, 6, 9, 9, 1, 2, 3, 4, 5, 6, 7, 9, 8], "<u2")
    (tmp_path / "a.bin").write_bytes(x.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = tokencount.document_tokens(tokencount.read_flat(spark, f"{tmp_path}/*.bin", block_bytes=4), 9).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["n_tokens"], r["ended"]) for r in got] == [(0, 2, True), (1, 0, True), (2, 7, True), (3, 1, False)]
    with pytest.raises(Exception, match="whole tokens"):
        tokencount.document_tokens(tokencount.read_flat(spark, f"{tmp_path}/a.bin", block_bytes=3), 9).collect()


def brute_lm(order):
    """Rows by the model's formula over plain dictionaries, with the quantiser where a gram is stored."""
    from tessera.llm.eliasfano import dequantise, quantise

    train = [r for r in TEXTS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    split = lambda t: [*(lm.start(k) for k in range(order - 1, 0, -1)), *(t or "").encode().lower().split(), b"\n"]
    count = Counter()
    for r in train:
        w = split(r[1])
        count.update(tuple(w[i - k + 1 : i + 1]) for i in range(len(w)) for k in range(1, order + 1) if i - k + 1 >= 0)
    real = {g: c for g, c in count.items() if len(g) == 1 and g[0].strip(b" ")}
    n, v = sum(real.values()), len(real)

    def p(g, stored=True):
        if len(g) == 1:
            return (count[g] + 1) / (n + v + 1)
        m = lm.MASS[len(g)]
        if count[g[:-1]] < lm.LEAST[len(g)]:
            return p(g[1:])
        x = (count[g] + m * p(g[1:])) / (count[g[:-1]] + m)
        return float(dequantise(quantise(np.asarray([x])))[0]) if count[g] else x

    out = Counter()
    for r in TEXTS:
        w = split(r[1])
        at = range(order - 1, len(w))
        out[r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2, len(at), sum(count[w[i],] > 0 for i in at), n,
            round(sum(math.log10(p((w[i],))) for i in at), 5), round(sum(math.log10(p(tuple(w[i - order + 1 : i + 1]))) for i in at), 2)] += 1
    return out


@pytest.mark.parametrize("order, block, shards, hot", [(3, 20_000, None, 4096), (3, 40, 5, 2), (2, 20_000, 3, 4096), (1, 20_000, None, 4096)])
def test_lm_equals_its_formula(docs, monkeypatch, order, block, shards, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    got = lm.score(clash(docs), order=order, block=block, shards=shards).collect()
    want = brute_lm(order)
    key = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
    assert Counter(map(key, got)) == sum((Counter({k[:-1]: c}) for k, c in want.items()), Counter())  # the exact columns
    # a probability next to the edge of two steps may take either: a step a token at most, and hardly any take it
    for r in got:
        near = [k[-1] for k in want if k[:-1] == key(r)]
        assert min(abs(r["score"] - x) for x in near) <= 0.01 + 0.0005 * r["n_tokens"] + (0.05 if order > 1 else 0)


def test_lm_sums_to_one_within_the_quantiser():
    from tessera.llm.eliasfano import STEP, dequantise, quantise

    p = np.random.default_rng(0).dirichlet(np.full(5000, 0.3)) + 1e-12
    assert np.abs(np.log10(dequantise(quantise(p)) / p)).max() <= STEP / 2 + 1e-9
    assert abs(dequantise(quantise(p)).sum() - 1) < 0.02


def test_lm_learns_from_all_documents_but_the_held_out(spark):
    docs = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(60)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([*docs, (100, docs[0][1]), (101, docs[0][1])], "doc_id bigint, text string")).collect()}
    once = [r["score"] for i, r in got.items() if not r["held_out"] and 0 < i < 100]
    new = [r["score"] for i, r in got.items() if r["held_out"] and 0 < i < 100]
    assert got[100]["score"] > max(once) and min(once) > max(new)  # a repeated text is told from those that occur once


def brute_license(text):
    w = words(text)
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_equals_brute_force(docs):
    got = license.scan(clash(docs)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r[0], *brute_license(r[1])) for r in TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[13]["labels"] == "apache-2.0" and by[13]["score"] == 1.0
    assert by[14]["labels"] == "gpl,gpl-3.0"
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)


@pytest.mark.parametrize("text,labels", [
    ("all rights reserved all rights reserved", "reserved"), ("small rights reserved", ""), ("CC-BY", "cc-by"), ("\u212ACC BY \u0130CC BY, cc by\u212A", ""), ("..cc\t\n by..", "cc-by"), ("mit license", ""), ("Released under the MIT License.", "mit"), ("license mit the under released", ""),
    ("/* This script is free software: you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. */", "gpl,gpl-3.0")])
def test_license_labels(spark, text, labels):
    assert license.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["labels"] == labels


def brute_labels(texts):
    """The method over plain lists: labels of each text."""
    df = Counter(x for t in texts for x in set(words(t)))
    out = []
    for text in texts:
        w, found = words(text), set()
        where = {}
        for i, x in enumerate(w):
            where.setdefault(x, []).append(i)
        for label, t, keys in license.TEMPLATES:
            tw = words(t)
            top = sorted(set(tw), key=lambda x: (df[x], x))[: license.RARE]
            best = Counter((i - j) for x in top for i, j in {(i - j, 0) for j, y in enumerate(tw) if y == x for i in where.get(x, ())})
            good = max(best.values(), default=0) >= license.MIN_SHARE * len(top)
            if good and all(f" {k} " in f" {' '.join(w)} " for k in keys):
                found.add(label)
        out.append(",".join(sorted(found | ({x for x in brute_license(text)[4].split(",")} - {""}))))
    return out


def test_license_method_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    notices = [t for _, t, _ in license.TEMPLATES]
    texts = [None, "", *notices, *(f"{BASE} {a}. {b}" for a, b in zip(notices, notices[3:]))]
    for t in notices * 3:  # some words are left out or exchanged
        w = t.split()
        for k in rng.choice(len(w), max(1, len(w) // 8), replace=False):
            w[k] = rng.choice(["", "other", "the"])
        texts.append(" ".join([BASE, *w, BASE]))
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == dict(enumerate(brute_labels(texts)))


SPEECH = {"en": "the of and to in that was he for it with as his on be at by had not are but from or have they which one you were her all she there would their".split(),
          "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme".split(),
          "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split()}


@pytest.fixture(scope="module")
def speech(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(240):
        y = list(SPEECH)[i % 3]
        out.append((i, " ".join(rng.choice(SPEECH[y], rng.integers(5, 60))), y, "s", 0))
    return spark.createDataFrame(out, SCHEMA)


def test_langid_on_held_out_documents(speech):
    got = langid.predict(speech).join(speech.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_langid_words_of_code_switched_text(speech):
    model = langid.fit(speech)
    text = [w.encode() for w in SPEECH["en"][:12] + SPEECH["de"][:12]]
    best = model.word_marginals([text]).argmax(axis=1)
    assert [model.labels[i] for i in best[[1, 5, 9, 14, 18, 22]]] == ["en"] * 3 + ["de"] * 3


def test_langid_samples_runs_of_the_whole_text():
    text = " ".join("word" + "abcdefghij"[i // 1000 % 10] + "klmnopqrst"[i // 100 % 10] + "uvwxyzabcd"[i // 10 % 10] for i in range(10_000)).encode()
    w = langid.sampled(text).split()
    assert len(w) == langid.RUN * langid.RUNS and {x[4:5] for x in w} == {c.encode() for c in "abcdefghij"}
    assert langid.sampled(b"one two, three") == b"one two three" and langid.sampled(b"") == b""


def test_langid_sample_does_not_depend_on_partitions(speech):
    a = langid.fit(speech, per_label=20)
    b = langid.fit(speech.repartition(7), per_label=20)
    assert a.labels == b.labels == ["de", "en", "fr"] and (a.weights == b.weights).all()


def test_langid_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    e, t = rng.standard_normal((37, 3)).astype(np.float32), rng.standard_normal((3, 3))
    lengths = np.asarray([1, 20, 16])
    got = langid.marginals(e, lengths, t, chunk=5)
    at = 0
    for n in lengths:
        p, tt = np.exp(e[at : at + n].astype(float)), np.exp(t)
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        cur = np.full(3, 1 / 3)
        for i in range(n):
            cur = (cur @ tt) * p[i]
            a[i] = cur
        for i in range(n - 2, -1, -1):
            b[i] = tt @ (p[i + 1] * b[i + 1])
        g = a * b
        np.testing.assert_allclose(got[at : at + n], g / g.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_langid_defined_cases(spark, docs, speech, empty):
    from pyspark.sql import functions as F

    got = langid.predict(clash(docs)).collect()
    assert len(got) == len(TEXTS)
    for r, (d, t, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"])), sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))):
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert by[4] == by[5] == by[6] == "und" and by[0] == "en"
    assert langid.predict(speech.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    mixed = speech.unionByName(spark.createDataFrame([(900, "12 34 !!", "en", "s", 8), (901, None, "en", "s", 0)], SCHEMA))
    assert {r["doc_id"] for r in langid.keep_identified(mixed).collect()} == set(range(240))


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    for df in (simhash.near_duplicates(empty), simhash.keep_one(empty), packing.pack(empty, tokenizer_path()), tokencount.count_documents(empty, tokenizer_path(), 49407), langid.predict(empty), langid.keep_identified(empty),
               lm.score(empty), license.scan(empty), contaminate.decontaminate(empty, bench), contaminate.drop_contaminated(empty, bench)):
        assert df.count() == 0
