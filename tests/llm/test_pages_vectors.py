"""URL filters, main text and nearest neighbours: rules, labelled pages, recall against brute force, defined cases."""

import re

import numpy as np
import pytest

from tessera.llm import ann, eliasfano, htmltext, urlfilter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = ["http://A.Example.COM/en/1", "https://www.example.com/en/2?q=1", "http://x.net/es/", "http://x.net/esp/", "http://net/fr/a#f", "http://bad.org/a/?utm_x=1&k=v", "https://www.bad.org:443/a?k=v#z", "http://bad.org/b",
        "no scheme", "", None, "http://", "://h.com", "http://h.com?x://y", "http://evilexample.com/en/", "x://bad.org/a?k=v", "http://A.Example.COM/en/1"]
LISTED = ["http://bad.org/a?k=v", None, "", "http://a.example.com/en/1"]


def parts(u):
    if u is None or "://" not in u:
        return "", ""
    r = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", r)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", r[len(host):])[0]


def brute(u):
    host, path = parts(u)
    best = max(((len(h) + len(p), len(h), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best and best[3]


@pytest.mark.parametrize("max_blocks", [1, 1 << 16])
def test_url_filter(spark, max_blocks):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "key", "block", "w0", "rule", "verdict", "hit")})
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, listed, max_blocks=max_blocks).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, action = brute(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        known = i in (0, 5, 6, 15, 16)
        assert r["listed"] == known and r["verdict"] == (action or ("block" if known else "allow"))
    assert urlfilter.judge(pages.limit(0), listed).count() == 0
    assert urlfilter.judge(pages, listed.limit(0)).where("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    urls = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".org/"), "id").alias("url"))
    got = urlfilter.judge(urls, urls.where("page_id % 3 = 0").select("url"), max_blocks=4)
    assert got.where("listed <> (page_id % 3 = 0)").count() == 0


PAGES = {
    "": "", None: "", "<p>": "",
    "<html><body><nav><a>Home</a></nav><article><h1>Title &amp; more</h1><p>First   line\n here.<p>Second &eacute; line.</article><footer>&copy; x</footer></body></html>": "Title & more First line here. Second é line.",
    "<body><script>var t='</p><article>no</article>';</script><article><p>Only <b>this</b> text stays here, as it is.</p><!-- no --></article><div class='comments'><p>Nice post!</p></div>": "Only this text stays here, as it is.",
}


def test_main_text(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)]
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(rows + rows[:1], "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as h")).collect()}
    for (i, _, h), want in zip(rows, PAGES.values()):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


#: Pages written by hand, unlike those that the field is trained on, with the text that a reader would call the article.
GOLD = [
    ("<body><p>The harbour froze over on Tuesday night, and boats stayed where they lay.</p><p>By noon people walked across it.</p><aside>Read also: winter tyres</aside></body>",
     "The harbour froze over on Tuesday night, and boats stayed where they lay. By noon people walked across it."),
    ('<html><body><div id="top"><a href="/">Daily Lamp</a></div><nav><a href="/n">News</a> <a href="/s">Sport</a></nav><main><h1>A bridge reopens</h1><p class="lead hidden-xs">After two years of work the old bridge carries traffic again.</p>'
     '<p class="x hidden y">The mayor cut a ribbon before some hundred onlookers.</p></main><footer>Imprint</footer></body></html>',
     "A bridge reopens After two years of work the old bridge carries traffic again. The mayor cut a ribbon before some hundred onlookers."),
    ("<body><article><h2>Energy</h2><p>Mass and energy are related by <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> in this theory.</p>"
     "<p>A <span aria-hidden=true>decorated</span> word stays in the sentence.</p><p hidden>Draft only.</p><p style='display:none'>Nor this one.</p></article></body>",
     "Energy Mass and energy are related by E=mc2 in this theory. A decorated word stays in the sentence."),
    ('<body><header><h1>Blog of a gardener</h1></header><article><h2>Pruning roses</h2><p>Cut just above an outward bud, at a slant.</p><ul><li>Use clean shears.</li><li>Burn what is diseased.</li></ul></article>'
     '<section id="comments"><h3>2 comments</h3><div class="comment"><p>Thanks, very useful.</p></div></section><footer><p>&copy; 2020</p></footer></body>',
     "Pruning roses Cut just above an outward bud, at a slant. Use clean shears. Burn what is diseased."),
]


@pytest.mark.parametrize("page, want", GOLD)
def test_main_text_of_pages_written_by_hand(page, want):
    assert htmltext.main_text(page) == want


def test_crf_on_labelled_pages_it_was_not_trained_on():
    wrong = total = 0
    for page in htmltext.labelled_pages(60, seed=77):
        blocks = htmltext.blocks_of(page)
        y = htmltext.field().decode(htmltext.features_of(blocks))
        want = [sum(w[:1] in "qQ" for w in b.text.split()) * 2 > len(b.text.split()) for b in blocks]
        wrong += sum(bool(a) != b for a, b in zip(y, want))
        total += len(blocks)
    assert wrong / total < 0.03


@pytest.mark.parametrize("tag", ["font", "div", "span"])
def test_end_tags_and_links_are_found_at_any_depth(tag):
    page = f"<body><article><p>first</p>{f'<{tag}>' * 60}inner</article><div>comment</div><a href=x>{'<span>' * 9}linked</a>plain</body>"
    b = {x.text: x for x in htmltext.blocks_of(page)}
    assert "article" in b["inner"].path and "article" not in b["comment"].path
    assert b["linkedplain"].n_link == len("linked") and b["first"].n_link == b["comment"].n_link == 0


def test_a_very_long_page_is_whole():
    body = "".join(f"<p>Sentence number {i} of a long article.</p>" for i in range(5000))
    text = htmltext.main_text(f"<body><nav><ul><li><a>x</a></li></ul></nav><article>{body}</article><footer>z</footer></body>")
    assert text == " ".join(f"Sentence number {i} of a long article." for i in range(5000))


def test_viterbi_is_the_best_labelling():
    from itertools import product

    from tessera.llm.crf import ChainCRF

    rng = np.random.default_rng(4)
    crf = ChainCRF(2, 6)
    crf.w, crf.t, crf.s = rng.standard_normal((6, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2)
    seq = [[0, 3], [1], [2, 4], [5], [0]]
    e = crf.potentials(seq)
    score = lambda y: crf.s[y[0]] + sum(e[i, c] for i, c in enumerate(y)) + sum(crf.t[a, b] for a, b in zip(y, y[1:]))
    assert tuple(crf.decode(seq)) == max(product(range(2), repeat=5), key=score)


def brute_nearest(ids, x, q, k=20):
    s = np.asarray([(v * x[q]).sum() for v in x])
    order = sorted((j for j in range(len(x)) if ids[j] != ids[q]), key=lambda j: (-s[j], ids[j]))[:k]
    return [(ids[j], s[j]) for j in order]


def test_nearest_neighbours_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 256)  # several partitions on a small table
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16)) * 2
    x = centres[rng.integers(0, 12, 2000)] + rng.standard_normal((2000, 16))
    x[100:700] = x[100]  # one vector is a third of the rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 2000, 20):
        want = brute_nearest(list(range(2000)), x, q)
        assert len(got[q]) == 20
        for (v, s) in got[q]:
            assert s == pytest.approx(float((x[v] * x[q]).sum()), rel=1e-12)
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
        floor = want[-1][1]
        hits += sum(s >= floor - 1e-9 for _, s in got[q])
        total += 20
    assert hits / total >= 0.9


def test_probes_suffice_for_rows_that_the_router_has_not_seen():
    x = np.random.default_rng(7).standard_normal((20000, 64))
    router, probes = ann.learn(x[:1200], 16)
    z = router.logits(x)
    q = np.arange(19000, 20000)
    home = z.argmax(axis=1)[ann.neighbour_graph_of(x, q, 20)]
    asked = np.argsort(-z[q], axis=1)[:, :probes]
    assert (home[:, :, None] == asked[:, None, :]).any(axis=2).mean() >= ann.TARGET


@pytest.mark.parametrize("n, parts", [(1500, 2), (20000, 8)])
def test_nearest_neighbours_are_routed_at_every_size(spark, monkeypatch, n, parts):
    made, learn = [], ann.learn
    monkeypatch.setattr(ann, "learn", lambda x, n_parts, *a: made.append(n_parts) or learn(x, n_parts, *a))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, n)] * 2 + rng.standard_normal((n, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df, every=100).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    assert made == [parts] and set(got) == set(range(0, n, 100))
    s = x[::100] @ x.T
    s[np.arange(len(s)), np.arange(0, n, 100)] = -np.inf
    floor = np.sort(s, axis=1)[:, -20]
    assert np.mean([v >= floor[q // 100] - 1e-9 for q, vs in got.items() for v in vs]) >= 0.95


def test_nearest_neighbours_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [None, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as part", "2 as rank", "3 as id", "4 as v")
    got = [tuple(r) for r in ann.search(df).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    assert [r for r in got if r[0] == 0][:3] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5)]
    assert {r[0] for r in got} == {0, 100} and 100 not in {r[2] for r in got if r[0] == 100} and not {20, 40, 60, 80, 4, 5} & {r[2] for r in got}
    assert ann.search(df.limit(0)).count() == 0


def test_elias_fano_round_trip_and_successors(tmp_path):
    rng = np.random.default_rng(9)
    v = np.unique(rng.integers(0, 2**62, 5000, dtype=np.uint64))
    ef = eliasfano.EliasFano.of(v)
    np.testing.assert_array_equal(ef.get(np.arange(len(v))), v)
    q = np.concatenate([v[:50], v[:50] + np.uint64(1), np.asarray([0, 2**63], np.uint64)])
    np.testing.assert_array_equal(ef.successor(q), np.searchsorted(v, q))
    np.testing.assert_array_equal(ef.find(v), np.arange(len(v)))
    words = eliasfano.Words.build(np.asarray([3, 9, 2**60], np.uint64), np.asarray([5, 1, 300]))
    assert words.count(np.asarray([9, 2**60, 4], np.uint64)).tolist() == [1, 300, 0]
    level = eliasfano.Level.build(np.asarray([3, 9], np.uint64), np.asarray([2, 1]), np.asarray([1, 7, 7], np.uint32), np.asarray([4, 90, 100_000]), np.asarray([0.5, 1.0, 1e-6]))
    (tmp_path / "t").write_bytes(level.to_bytes())
    for t in (level, eliasfano.Level.view(level.to_bytes()), eliasfano.Level.load(str(tmp_path / "t"))):
        at = t.find(np.asarray([3, 9, 11], np.uint64), np.asarray([3, 1, 1]), np.asarray([1, 2, 7, 7, 1], np.uint32))
        assert at.tolist() == [0, -1, 1, 2, -1] and eliasfano.counts_at(t.totals, at).tolist() == [4, 0, 90, 100_000, 0]
        code = t.code(at)
        assert code[1] == code[4] == 0 and eliasfano.dequantise(code[[0, 2, 3]]) == pytest.approx([0.5, 1.0, 1e-6], rel=0.06)
        assert [x.tolist() for x in t.followers_of(3)] == [[1, 7], t.codes[:2].tolist()] and len(t.followers_of(4)[0]) == 0
    assert len(ef.low) * 8 + len(ef.high) < 8 * len(v)
    assert (np.diff(eliasfano.dequantise(np.arange(1, 256))) < 0).all()
