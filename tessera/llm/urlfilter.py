"""URL filters (1), native: a blocked Bloom filter before an exact hash join.

The list's canonical URLs are hashed into blocks of 256 bits; a key sets
``PROBES`` bits of one block.  The filter is a table of (block, four 64-bit
words), so a probe is one broadcast hash join on the block number and a few bit
tests, all generated code.  Its size is bounded whatever the list's length:
``max_blocks`` blocks.  A longer list only raises the share of false
positives; every URL that passes goes to an exact join with the list, by
shuffle, which removes them.  URLs that fail the filter are never shuffled.

Rules (host, path, action) are few by contract and are checked as expressions:
a rule fits its host and all subdomains if the URL's path starts with the
rule's; the longest rule (host and path together, then host) wins over the
list.

Canonical form: no scheme, host in lower case without ``www.`` and without
``:80``/``:443``, path without trailing slashes, query parameters that start
with ``utm_`` or are ``ref`` dropped, no fragment.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is allowed; repeated URLs are each judged; an empty list
blocks nothing; null list entries are ignored; extra columns of the URLs'
table are kept only if named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
PROBES = 8
BITS_PER_KEY = 24
MAX_BLOCKS = 1 << 16  # 40 bytes each: under 3 MB broadcast, however long the list


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The canonical form; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(?:80|443)$", "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[^=]*|ref)(?:=|$)")), "&")
    return F.when(host_of(url) != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _words(key: Column) -> list[Column]:
    """The key's bits in the four words of its block."""
    h = F.xxhash64(key, F.lit(0x5EED))
    words = [F.lit(0).cast("long")] * 4
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(63)).cast("int")
        words[i % 4] = words[i % 4].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return words


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a list of keys."""
    k = listed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col("key")))])
    return k.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` (host, path) with the rule that wins and its action."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):  # later ones cover earlier ones
        fits = (F.col("host") == h) | F.col("host").endswith("." + h)
        fits = fits & F.col("path").startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
    return df.withColumns({"rule": rule, "action": action})


def judge(pages: DataFrame, listed: DataFrame, *, rules=RULES, keep: tuple[str, ...] = ("page_id",), max_blocks: int = MAX_BLOCKS, url_col: str = "url") -> DataFrame:
    """``keep``, host, path, rule, verdict, listed for every URL.

    listed: a table with a string column ``url`` of URLs to block.
    """
    keys = listed.select(canonical(F.col("url")).alias("key")).where(F.col("key").isNotNull()).distinct()
    n = keys.count()
    blocks = 1
    while blocks < max_blocks and blocks * 256 < n * BITS_PER_KEY:
        blocks *= 2
    u = with_rule(pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("key")), rules)
    u = u.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    probed = u.join(F.broadcast(bloom(keys, blocks)), "block", "left")  # bounded by max_blocks
    hit = F.lit(True)
    for i, w in enumerate(_words(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(w) == w)
    probed = probed.withColumn("maybe", F.coalesce(hit, F.lit(False)) & F.col("key").isNotNull())
    names = [*keep, "host", "path", "rule", "action", "key"]
    no = probed.where(~F.col("maybe")).select(*names, F.lit(False).alias("listed"))
    yes = (probed.where("maybe").select(*names)
           .join(keys.select("key", F.lit(True).alias("hit")).hint("shuffle_hash"), "key", "left")
           .select(*names, F.col("hit").isNotNull().alias("listed")))
    return no.unionByName(yes).select(
        *keep, "host", "path", "rule",
        F.coalesce("action", F.when(F.col("listed"), F.lit("block")).otherwise("allow")).alias("verdict"), "listed")
