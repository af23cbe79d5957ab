"""Contract keys as column expressions: HTTP, topic, env, i18n, table and RPC keys from the text that code holds.

A part only known at run time arrives as ``DYN`` and leaves as ``{}``; declared
route parameters become ``{}`` too.  Everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DYN = "�"

# HTTP methods that may begin a key; ALL and ANY mean every method.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE", "CONNECT", "*", "ALL", "ANY")
# Schemas that a table name may leave out.
DEFAULT_SCHEMAS = ("public", "dbo", "main")


def render_dynamic(c: Column) -> Column:
    return F.regexp_replace(c, f"{DYN}+", "{}")


def has_literal(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("{}"), F.lit("")), DYN, "").rlike(r"[\p{L}\p{N}]")


def plain_key(raw: Column) -> Column:
    """Topics, i18n keys and packages: trimmed."""
    return render_dynamic(F.trim(raw))


def env_key(raw: Column) -> Column:
    """Null where the text cannot name a variable."""
    k = plain_key(raw)
    return F.when(k.rlike(r"^[A-Za-z0-9_.{}-]+$"), k)


def table_key(raw: Column) -> Column:
    """Lower case, without quotes and default schema; null where it is no name."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(F.trim(raw), r'["`\[\]]', "")), r"\."), lambda p: p != "")
    parts = F.when((F.size(parts) == 2) & parts[0].isin(list(DEFAULT_SCHEMAS)), F.slice(parts, 2, 1)).otherwise(parts)
    k = F.array_join(parts, ".")
    return F.when((k != "") & ~k.rlike(r"\s"), plain_key(k))


def rpc_key(raw: Column) -> Column:
    return plain_key(F.regexp_replace(F.trim(raw), "^/+", ""))


def _segment(s: Column) -> Column:
    whole = s.rlike(rf"^(?:{DYN}+|:.+|\{{.*\}}|<.*>|\[.*\]|\*\*?)$")
    inner = F.when(s.contains(DYN), render_dynamic(s)).otherwise(F.regexp_replace(s, r"\{[^{}]*\}", "{}"))
    return F.when(whole, F.lit("{}")).otherwise(inner)


def http_key(raw: Column, default_method: str = "*") -> Column:
    """``METHOD /path``: no scheme, host, query or fragment; parameters as ``{}``."""
    t = F.trim(raw)
    word = F.upper(F.regexp_extract(t, r"^(\S*)", 1))
    named = word.isin(list(METHODS))
    method = F.when(named, F.when(word.isin("ALL", "ANY"), "*").otherwise(word)).otherwise(default_method.upper())
    rest = F.when(named, F.trim(F.regexp_replace(t, r"^\S+", ""))).otherwise(t)
    path = F.regexp_replace(rest, rf"^(?:(?i:https?:)?//[^/]*|{DYN}+)", "")
    segments = F.transform(F.filter(F.split(F.regexp_extract(path, r"^([^?#]*)", 1), "/"), lambda p: p != ""), _segment)
    only_dynamic = rest.rlike(f"^{DYN}+$")
    return F.concat(method, F.lit(" "), F.when(only_dynamic, F.lit("{}")).otherwise(F.concat(F.lit("/"), F.array_join(segments, "/"))))


NORMALISERS = {"http": http_key, "topic": plain_key, "i18n": plain_key, "plain": plain_key, "env": env_key, "table": table_key, "rpc": rpc_key}


def method_of(key: Column) -> Column:
    return F.when(F.instr(key, " ") > 0, F.substring_index(key, " ", 1)).otherwise("*")


def segments_of(key: Column) -> Column:
    path = F.when(F.instr(key, " ") > 0, F.regexp_replace(key, r"^\S+ ", "")).otherwise(key)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def glob_fits(text: Column, glob: Column) -> Column:
    """``{}`` in the glob is any run of characters."""
    quoted = F.concat(F.lit(r"^\Q"), F.replace(glob, F.lit("{}"), F.lit(r"\E.*\Q")), F.lit(r"\E$"))
    return F.regexp_like(text, quoted)


def _pair(c: Column, p: Column) -> Column:
    """What a pair of segments adds; null where they cannot be the same."""
    c_glob, p_glob = c.contains("{}"), p.contains("{}")
    return (F.when((c == "{}") | (p == "{}"), 0).when(~c_glob & ~p_glob, F.when(c == p, 2))
            .when(c_glob & p_glob, F.when(c == p, 0)).when(c_glob, F.when(glob_fits(p, c), 1)).otherwise(F.when(glob_fits(c, p), 1)))


def endpoint_score(consumer: Column, provider: Column, cs: Column, ps: Column) -> Column:
    """Two a literal segment, one a glob, one for the very method; null: no match."""
    cm, pm = method_of(consumer), method_of(provider)
    ok = ((cm == pm) | (cm == "*") | (pm == "*")) & (F.size(cs) == F.size(ps))
    total = F.aggregate(F.zip_with(cs, ps, _pair), (cm == pm).cast("int"), lambda a, x: a + x)  # a null stays null
    return F.when(ok, total)
