"""The queries of this subpackage: ``opN_<name>`` for each operator, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Sites whose pages stand in for a list of known URLs.
LISTED_SITES = ("cheap-pills", "adult-x", "free-bets", "spam-farm", "casino-win", "ads-track")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical URLs of all pages on ``LISTED_SITES``: it grows with the table."""
    from tessera.llm.urlfilter import host_of, judge

    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(host_of(F.col("url")).rlike(r"(?:^|\.)(?:" + "|".join(LISTED_SITES) + r")\.example\.[a-z]+$"))
    return judge(pages, listed)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat token files that are written for it first; 49407 ends a document."""
    from tessera.llm.tokencount import count_documents

    return count_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 49407)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.contaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import predict

    return predict(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license import scan

    return scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_simhash_near_dedup, op3_nearest_neighbours, op4_token_counts, op5_html_extraction, op6_best_fit_packing, op7_benchmark_decontamination, op8_language_id, op9_lm_scoring, op10_license_scans)}
_REST = "CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END"
SQL: dict[str, str] = {
    "op1_url_filters": rf"""
WITH r AS (SELECT page_id, url, {_REST} AS rest FROM pages),
u AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM r),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, p, a)),
c AS (SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS k FROM (SELECT *, list_filter(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1, 's'), '&'),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')) AS q FROM u)),
l AS (SELECT DISTINCT k FROM c WHERE regexp_matches(host, '(^|\.)({"|".join(LISTED_SITES)})\.example\.[a-z]+$'))
SELECT page_id, host, path, best.s AS rule, coalesce(best.a, CASE WHEN host <> '' AND k IN (SELECT k FROM l) THEN 'block' ELSE 'allow' END) AS verdict,
  host <> '' AND k IN (SELECT k FROM l) AS listed
FROM (SELECT *, (SELECT max(struct_pack(n := length(h) + length(p), m := length(h), s := h || p, a := a)) FROM rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM c)
""",
}
