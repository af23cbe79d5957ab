"""Report operators on small inputs."""

from pyspark.sql import functions as F

from tessera.operators import knowledge as N
from tessera.operators import reports as R


def test_switch_estimate(spark):
    c = spark.createDataFrame([("a", 10), ("b", 4), ("c", 1)], "hash string, bytes int")
    r = R.switch_estimate(c, spark.createDataFrame([("b",)], "hash string"), dims=8, usd_per_million=1.0).first()
    assert (r["chunks"], r["tokens"], r["disk_bytes"]) == (2, 4, 32)
    assert R.switch_estimate(c.limit(0), c.select("hash"), dims=8, usd_per_million=1.0).first()["tokens"] == 0


def test_rank_and_limit_takes_a_place_once(spark):
    c = spark.createDataFrame([("p", "x", "1", 3.0), ("p", "x", "2", 5.0), ("p", "y", "3", 4.0), ("p", "z", "4", 1.0), ("q", "x", "5", 2.0)], "project string, location string, id string, score double")
    assert [(r["project"], r["location"], r["id"]) for r in R.rank_and_limit(c, 2, 3).orderBy("rank").collect()] == [("p", "x", "2"), ("p", "y", "3"), ("q", "x", "5")]


def test_insights(spark):
    e = spark.createDataFrame([("endpoint", "a", "exposes"), ("endpoint", "b", "exposes"), ("endpoint", "b", "consumes"), ("topic", "t", "consumes"), ("i18n", "k", "defines"), ("env", "X", "reads")], "contract_kind string, key string, kind string")
    assert {(r["code"], r["key"]) for r in R.insights(e).collect()} == {("graph.endpoint_without_client", "a"), ("graph.topic_without_producer", "t"), ("graph.i18n_key_unused", "k"), ("graph.env_undeclared", "X")}


def test_groups_join_by_any_key(spark):
    v = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (5, "b", "y"), (6, "c", "y")], "view int, slug string, branch string")
    assert {r["view"]: r["component"] for r in R.groups(v, "slug", "branch").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_explanations(spark):
    s = lambda *rows: R.explain_empty(spark.createDataFrame(list(rows), "source string, state string, candidates int, rejected int")).first()["reason"]
    assert s(("lexical", "failed", 0, 0)) == "all_sources_failed" and s(("lexical", "answered", 3, 3)) == "everything_out_of_scope" and s(("lexical", "answered", 0, 0)) == "absent" and s(("lexical", "answered", 0, 0), ("semantic", "failed", 0, 0)) == "partial_absence"


def test_states_of_a_record(spark):
    rows = [("proposed", "accept", 1, 1, False, "accepted"), ("proposed", "accept", 0, 1, False, None), ("proposed", "accept", 1, 1, True, None), ("accepted", "mark_stale", 0, 1, False, "stale"), ("stale", "revalidate", 0, 1, False, "accepted"), ("rejected", "accept", 9, 1, False, None)]
    df = spark.createDataFrame(rows, "state string, event string, approvals int, needed int, conflict boolean, want string")
    got = df.withColumn("next", N.next_state(*[F.col(c) for c in ("state", "event", "approvals", "needed", "conflict")]))
    assert got.where("NOT next <=> want").count() == 0
