"""Sources and sinks: file walks, structured files, migrations, manifests; SARIF, Markdown, reports, upserts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import paths as P

MAX_FILE = 1 << 20


def walk(spark: SparkSession, root: str, *, pattern: str = "*", max_bytes: int = MAX_FILE, excluded: Column | None = None) -> DataFrame:
    """(path, length, content_hash, language, text, skip_reason) of a folder's files; a skipped file's text is null.

    Names and sizes decide before a text is looked at, and text leaves the scan
    only for files that are taken.  Spark lists no names that begin with ``.``
    or ``_``: they are left out without a row.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), f"^{re.escape(root.rstrip('/'))}/", "")
    f = f.select(rel.alias("path"), "length", "content")
    why = P.skip_reason(F.col("path"), F.col("length"), F.substring("content", 1, 8192), max_bytes=max_bytes, excluded=excluded)
    text = F.when(why.isNull(), F.decode("content", "UTF-8"))
    return f.select("path", "length", F.when(why.isNull(), F.sha2("content", 256)).alias("content_hash"), P.language(F.col("path"), text).alias("language"), text.alias("text"), why.alias("skip_reason"))


def read_file(spark: SparkSession, path: str, max_bytes: int = MAX_FILE) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes).select("path", F.decode("content", "UTF-8").alias("text"))


PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


def flat(value: object, at: str = "") -> list[tuple[str, str]]:
    """Leaves of nested objects with dotted keys; list items by number."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flat(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flat(v, f"{at}.{i}" if at else str(i))]
    return [(at, value if isinstance(value, str) else json.dumps(value))]


def parsed(text: str | None, language: str | None) -> object:
    """JSON and TOML by the standard library, YAML where its library is there; null for what does not parse."""
    try:
        if language == "json":
            return json.loads(text)
        if language == "toml":
            import tomllib

            return tomllib.loads(text)
        if language == "yaml":
            import yaml

            return yaml.safe_load(text)
    except ImportError:
        return None
    except Exception:  # any text may come; one that does not parse has no leaves
        return None
    return None


@F.pandas_udf(PAIRS)
def leaves(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([[{"key": k, "value": v} for k, v in flat(x)] if isinstance(x := parsed(t, g), (dict, list)) else [] for t, g in zip(text, language)])


def locale_keys(files: DataFrame) -> DataFrame:
    """(project, path, locale, key) of locale files named by their locale; ``@`` keys describe others."""
    f = files.where(F.col("path").rlike(r"[./_-][a-z]{2}(?:[-_][A-Z]{2})?\.(?:json|arb)$"))
    return f.select("project", "path", F.regexp_extract("path", r"([a-z]{2}(?:[-_][A-Z]{2})?)\.(?:json|arb)$", 1).alias("locale"), F.explode(leaves(F.col("text"), F.lit("json"))).alias("x")).select("project", "path", "locale", F.col("x.key").alias("key")).where("key NOT LIKE '@%'")


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """(project, doc, stem, key) of the operations of OpenAPI documents."""
    from tessera.functions import contracts as K

    f = files.where(F.col("text").contains("openapi") | F.col("text").contains("swagger")).select("project", "path", F.explode(leaves(F.col("text"), F.col("language"))).alias("x"))
    k = f.select("project", "path", F.regexp_extract("x.key", r"^paths\.(/.*?)\.(?:get|post|put|patch|delete|head|options)(?:\.|$)", 1).alias("p"), F.upper(F.regexp_extract("x.key", r"^paths\./.*?\.(get|post|put|patch|delete|head|options)(?:\.|$)", 1)).alias("m")).where("p <> ''").distinct()
    return k.select("project", F.concat_ws("/", "project", "path").alias("doc"), F.substring_index(F.substring_index("path", "/", -1), ".", 1).alias("stem"), K.http_key(F.concat_ws(" ", "m", "p")).alias("key"))


_STATEMENT = re.compile(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\((.*?)\)\s*(?:;|$)|\balter\s+table\s+(?:if\s+exists\s+)?([\w.\"`\[\]]+)\s+(.*?)(?:;|$)|\bdrop\s+table\s+(?:if\s+exists\s+)?([\w.\"`\[\]]+)")
_NO_COLUMN = ("primary", "foreign", "unique", "constraint", "check", "key", "index", "exclude")


def _bare(name: str) -> str:
    parts = re.sub(r'["`\[\]]', "", name).lower().split(".")
    return ".".join(parts[1:] if len(parts) == 2 and parts[0] in ("public", "dbo", "main") else parts)


def _split(body: str) -> list[str]:
    """At commas outside parentheses."""
    out, depth, cur = [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [x.strip() for x in [*out, cur] if x.strip()]


def ddl(text: str | None) -> list[tuple[int, str, str, str | None, str | None]]:
    """(line, table, op, column, new_name) of a migration's statements."""
    text = re.sub(r"--[^\n]*", lambda m: " " * len(m[0]), text or "")
    out: list[tuple[int, str, str, str | None, str | None]] = []
    for m in _STATEMENT.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        if m[1]:
            cols = [_bare(c.split()[0]) for c in _split(m[2]) if c.split()[0].lower() not in _NO_COLUMN]
            out += [(line, _bare(m[1]), "create", c, None) for c in cols] or [(line, _bare(m[1]), "create", None, None)]
        elif m[5]:
            out.append((line, _bare(m[5]), "drop_table", None, None))
        else:
            t = _bare(m[3])
            for a in _split(m[4]):
                if x := re.match(r"(?is)add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?([\w\"`\[\]]+)\s+\w", a):
                    if x[1].lower() not in _NO_COLUMN:
                        out.append((line, t, "add_column", _bare(x[1]), None))
                elif x := re.match(r"(?is)drop\s+(?:column\s+)(?:if\s+exists\s+)?([\w\"`\[\]]+)", a):
                    out.append((line, t, "drop_column", _bare(x[1]), None))
                elif x := re.match(r"(?is)rename\s+(?:column\s+)?([\w\"`\[\]]+)\s+to\s+([\w\"`\[\]]+)", a):
                    out.append((line, t, "rename_column", _bare(x[1]), _bare(x[2])))
                elif x := re.match(r"(?is)rename\s+to\s+([\w\"`\[\].]+)", a):
                    out.append((line, t, "rename_table", None, _bare(x[1])))
    return out


OPS = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("table", "op", "column", "new_name")]]))


@F.pandas_udf(OPS)
def table_ops(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("line", "table", "op", "column", "new_name"), x)) for x in ddl(t)])


def migrations(files: DataFrame) -> DataFrame:
    """(project, path, line, table, op, column, new_name) of SQL files."""
    return files.where("path LIKE '%.sql'").select("project", "path", F.explode(table_ops("text")).alias("x")).select("project", "path", "x.*")


def dependencies(files: DataFrame) -> DataFrame:
    """(project, path, package) that package.json, pyproject.toml, Cargo.toml, go.mod and requirements.txt name."""
    name = P.file_name(F.col("path"))
    tree = files.where(name.isin("package.json", "pyproject.toml", "cargo.toml")).select("project", "path", name.alias("f"), F.explode(leaves(F.col("text"), F.when(name.endswith(".json"), "json").otherwise("toml"))).alias("x"))
    key = F.regexp_extract("x.key", r"^(?:dependencies|devDependencies|peerDependencies|dev-dependencies|build-dependencies|workspace\.dependencies)\.([^.]+)", 1)
    listed = F.when(F.col("x.key").rlike(r"^project\.(?:dependencies|optional-dependencies\.[^.]+)\.\d+$"), F.regexp_extract("x.value", r"^([\w.-]+)", 1)).otherwise(key)
    lines = files.where(name.isin("go.mod", "requirements.txt")).select("project", "path", F.explode(F.split("text", "\n")).alias("l"), name.alias("f"))
    line = F.when(F.col("f") == "go.mod", F.regexp_extract("l", r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v\d", 1)).otherwise(F.regexp_extract("l", r"^\s*([A-Za-z][\w.-]*)", 1))
    return tree.select("project", "path", listed.alias("package")).unionByName(lines.select("project", "path", line.alias("package"))).where("package <> ''").distinct()


def occurrences(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Precise occurrences (path, content_hash, symbol, start, end, role) whose file still has the hash they were made for."""
    return rows.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """Rows of both, the newest (``order``) of each key."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def write_sarif(findings: DataFrame, path: str) -> None:
    """A folder of SARIF results, one a line."""
    from tessera.operators.linking import sarif

    sarif(findings).write.mode("overwrite").text(path)


def markdown_section(rows: DataFrame, *, by: str, title: str, line: str, marker: str) -> DataFrame:
    """(by, section): a Markdown list between markers, for each document."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(title, line))), lambda x: F.concat(F.lit("- **"), x[title], F.lit("**: "), x[line])), "\n")
    return rows.groupBy(by).agg(F.concat(F.lit(f"<!-- {marker}:begin -->\n"), body, F.lit(f"\n<!-- {marker}:end -->")).alias("section"))


def write_back(text: Column, section: Column, marker: str) -> Column:
    """The text with its marked section replaced, or added at the end."""
    found = text.rlike(f"(?s)<!-- {marker}:begin -->.*?<!-- {marker}:end -->")
    before = F.substring_index(text, f"<!-- {marker}:begin -->", 1)
    after = F.regexp_replace(text, f"(?s)^.*?<!-- {marker}:end -->", "")
    return F.when(found, F.concat(before, section, after)).otherwise(F.concat(F.rtrim(text), F.lit("\n\n"), section, F.lit("\n")))


def write_report(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines; a report has a few rows."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
