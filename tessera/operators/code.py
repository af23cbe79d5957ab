"""Code operators: chunks, prepared inputs, hash embeddings, symbols, references, imports, extraction by rules."""

from __future__ import annotations

import ast
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, LEAST, OVERLAP, MAX_CANDIDATES, DIMS = 4000, 400, 200, 4, 64


def cut_line(line: str, target: int) -> list[str]:
    """Windows of a line longer than a chunk, cut behind white space in their second half where there is some."""
    out, at = [], 0
    while at < len(line):
        end = at + target
        if end < len(line):
            blank = max((m.end() for m in re.finditer(r"\s", line[at:end])), default=0)
            end = at + blank if blank > target // 2 else end
        out.append(line[at:end])
        at = end
    return out


def chunks_of(text: str | None, target: int = TARGET, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start_line, end_line, text): a short text whole; else lines up to ``target``, the last lines of a chunk again at the next one's start."""
    if not text or not text.strip():
        return []
    if len(text.strip()) <= least:
        return [(1, text.count("\n", 0, len(text.rstrip())) + 1, text.strip())]
    lines = [(n, p) for n, line in enumerate(text.splitlines(keepends=True), 1) for p in (cut_line(line, target) if len(line) > target else [line])]
    out: list[tuple[int, int, str]] = []
    held: list[tuple[int, str]] = []
    fresh = 0  # pieces that the last chunk does not hold

    def close() -> None:
        rows = held[:]
        while rows and not rows[0][1].strip():
            rows.pop(0)
        while rows and not rows[-1][1].strip():
            rows.pop()
        if rows:
            out.append((rows[0][0], rows[-1][0], "".join(x for _, x in rows).rstrip()))

    for piece in lines:
        if held and sum(len(x) for _, x in held) + len(piece[1]) > target and fresh:
            close()
            back, size = [], 0
            for p in reversed(held):
                if size + len(p[1]) > min(overlap, target // 4):
                    break
                back.insert(0, p)
                size += len(p[1])
            held, fresh = back, 0
        held.append(piece)
        fresh += 1
    if fresh:
        close()
    return out


CHUNK = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(CHUNK)
def chunk(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"ordinal": i, "start_line": a, "end_line": z, "text": x} for i, (a, z, x) in enumerate(chunks_of(t))])


def chunks(files: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    return files.select(*keys, F.explode(chunk(text_col)).alias("c")).select(*keys, "c.*")


def prepared(path: Column, language: Column, project: Column, symbol: Column, kind: Column, doc: Column, text: Column) -> Column:
    """The text to embed: a header of what is known of a chunk, then the chunk."""
    line = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.regexp_replace(F.trim(c), r"\s+", " ")))
    what = F.coalesce(F.when(symbol.isNotNull(), F.concat(F.lit("symbol: "), symbol, F.lit(" ("), kind, F.lit(")"))), F.concat(F.lit("kind: "), kind))
    return F.concat_ws("\n", line("path", path), line("language", language), line("project", project), what, line("doc", doc), F.lit(""), text)


_MASK = (1 << 64) - 1


def feature_hash(tag: bytes, data: bytes) -> int:
    """FNV-1a over tag and data, then the splitmix64 finish."""
    h = 0xCBF29CE484222325
    for b in tag + data:
        h = (h ^ b) * 0x100000001B3 & _MASK
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _MASK
    return h ^ h >> 31


def hash_embedding(text: str | None, dims: int = DIMS) -> list[float]:
    """A unit vector of words (1), their letter trigrams (0.3) and word pairs (0.5), each hashed to a place and a sign."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    found = [(b"w", w, 1.0) for w in words] + [(b"c", f"#{w}#"[i : i + 3], 0.3) for w in words for i in range(len(w))] + [(b"b", f"{a} {b}", 0.5) for a, b in zip(words, words[1:])]
    v = np.zeros(dims)
    for tag, x, weight in found:
        h = feature_hash(tag, x.encode())
        v[h % dims] += -weight if h >> 63 else weight
    if not v.any():
        h = feature_hash(b"r", (text or "").encode())
        v[h % dims] = -1.0 if h >> 63 else 1.0
    return (v / np.linalg.norm(v)).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(text: pd.Series) -> pd.Series:
    return text.map(hash_embedding)


def unit(v: Column, dims: int | None = None) -> Column:
    """L2-normalised, of the first ``dims`` components if given; null for empty, zero or non-finite vectors."""
    x = F.transform(v if dims is None else F.slice(v, 1, dims), lambda a: a.cast("double"))
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    fine = (F.size(x) > 0) & (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(fine, F.transform(x, lambda a: a / n))


SYMBOL = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("signature", T.StringType()), T.StructField("doc", T.StringType())]))
# Definitions of languages without a parser here: (languages, kind, pattern with the name as its group).
DEFINITIONS = (
    ("typescript tsx javascript jsx", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("typescript tsx javascript jsx java kotlin csharp dart swift php scala cpp", "class", r"^\s*(?:(?:export|default|abstract|public|private|internal|final|sealed|open|data)\s+)*class\s+(\w+)"),
    ("typescript tsx java csharp php kotlin go", "interface", r"^\s*(?:export\s+|public\s+|type\s+)*(?:interface\s+(\w+)|(\w+)\s+interface\b)"), ("rust", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"),
    ("rust", "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("go", "struct", r"^type\s+(\w+)\s+struct"), ("ruby", "function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"),
    ("kotlin", "function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)"), ("swift", "function", r"^\s*(?:\w+\s+)*func\s+(\w+)"), ("php", "function", r"^\s*(?:\w+\s+)*function\s+(\w+)"), ("protobuf", "message", r"^\s*(?:message|service|enum)\s+(\w+)"),
)


def python_symbols(text: str) -> list[dict]:
    out = []

    def walk(node: ast.AST, prefix: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{n.name}"
                head = f"class {n.name}" if isinstance(n, ast.ClassDef) else f"def {n.name}({ast.unparse(n.args)})"
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append({"name": name, "kind": kind, "start": n.lineno, "end": n.end_lineno, "signature": head, "doc": (ast.get_docstring(n) or "").split("\n")[0]})
                walk(n, f"{name}.")
            else:
                walk(n, prefix)

    walk(ast.parse(text), "")
    return out


def symbols_of(text: str | None, language: str | None) -> list[dict]:
    """Python by its own parser; other languages by their definition lines; a text that does not parse has none."""
    if language == "python":
        try:
            return python_symbols(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return []
    rules = [(k, re.compile(p)) for ls, k, p in DEFINITIONS if language in ls.split()]
    found = [{"name": next(g for g in m.groups() if g), "kind": k, "start": n, "end": n, "signature": line.strip()[:200], "doc": ""} for n, line in enumerate((text or "").split("\n"), 1) for k, p in rules if (m := p.match(line))]
    return found


@F.pandas_udf(SYMBOL)
def symbols(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([symbols_of(t, x) for t, x in zip(text, language)])


def skeleton(found: Column) -> Column:
    """Signatures and first lines of documentation, in order."""
    return F.array_join(F.transform(found, lambda s: F.concat(s["signature"], F.when(s["doc"] != "", F.concat(F.lit("  # "), s["doc"])).otherwise(""))), "\n")


def resolve_names(uses: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, symbols, scope): a name's definitions in its own file, else in imported files, else in its directory.

    The first scope with any decides; more than ``MAX_CANDIDATES`` are none.
    uses: (file, name); defs: (file, name, symbol); imports: (file, target).
    Only the used names' definitions are joined, scope by scope.  A directory's
    definitions of a name are listed before they meet its uses, and only where
    they are few enough: a directory is the last scope, so many of them there are
    as good as none.  (Where a file defines the name itself its own scope decides,
    so its directory's list may hold its own symbols.)
    """
    u = uses.select("file", "name").distinct()
    dir_ = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    own = u.join(defs, ["file", "name"]).select("file", "name", "symbol", F.lit(0).alias("scope"))
    imported = u.join(imports, "file").join(defs.select(F.col("file").alias("target"), "name", "symbol"), ["target", "name"]).select("file", "name", "symbol", F.lit(1).alias("scope"))
    d = defs.select(dir_("file").alias("d"), "name", "symbol").distinct()
    few = d.groupBy("d", "name").agg(F.count("symbol").alias("n")).where(F.col("n") <= MAX_CANDIDATES).select("d", "name")
    listed = d.join(few, ["d", "name"], "left_semi").groupBy("d", "name").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    near = u.withColumn("d", dir_("file")).join(listed, ["d", "name"]).select("file", "name", F.lit(2).alias("scope"), "symbols")
    g = own.unionByName(imported).groupBy("file", "name", "scope").agg(F.array_sort(F.collect_set("symbol")).alias("symbols")).unionByName(near)
    best = g.groupBy("file", "name").agg(F.min_by(F.struct("symbols", "scope"), "scope").alias("b")).select("file", "name", "b.symbols", "b.scope")
    scope = F.element_at(F.array(*map(F.lit, ("file", "import", "directory"))), F.col("scope") + 1)
    return best.where(F.size("symbols") <= MAX_CANDIDATES).select("file", "name", "symbols", scope.alias("scope"), (F.size("symbols") > 1).alias("ambiguous"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, target): relative specs to files, as they stand, with an extension or as a directory's index; the first that exists.

    imports: (file, spec); files: (path).
    """
    # Endings tried, in order.
    ends = ("", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs")
    i = imports.where(F.col("spec").startswith(".")).select("file", "spec", F.split(F.concat_ws("/", F.regexp_replace("file", "/?[^/]*$", ""), "spec"), "/").alias("p"))
    walk = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    i = i.select("file", "spec", F.array_join(F.aggregate("p", F.array().cast("array<string>"), walk), "/").alias("base"))
    c = i.select("file", "spec", F.posexplode(F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat("base", e))).alias("rank", "path"))
    return c.join(files.select("path"), "path", "left_semi").groupBy("file", "spec").agg(F.min_by("path", "rank").alias("target"))


# Rules: (pack, languages, contract kind, role, pattern, key template of groups, normaliser).
PACKS = (
    ("express", "typescript javascript", "endpoint", "producer", r"\b(?:app|router)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)", "{1} {2}", "http"),
    ("python-web", "python", "endpoint", "producer", r"@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)", "{1} {2}", "http"),
    ("nestjs", "typescript", "endpoint", "producer", r"@(Get|Post|Put|Patch|Delete)\(\s*['\"]([^'\"]*)", "{1} {2}", "http"),
    ("spring", "java kotlin", "endpoint", "producer", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)", "{1} {2}", "http"),
    ("go-http", "go", "endpoint", "producer", r"\.(GET|POST|PUT|PATCH|DELETE)\(\s*\"([^\"]+)", "{1} {2}", "http"),
    ("aspnet", "csharp", "endpoint", "producer", r"\[Http(Get|Post|Put|Patch|Delete)\(\"([^\"]*)", "{1} {2}", "http"),
    ("js-http-client", "typescript javascript tsx jsx", "endpoint", "consumer", r"\baxios\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)", "{1} {2}", "http"),
    ("js-http-client", "typescript javascript tsx jsx", "endpoint", "consumer", r"\bfetch\(\s*(['\"`])([^'\"`]+)", "* {2}", "http"),
    ("python-http-client", "python", "endpoint", "consumer", r"\b(?:requests|httpx)\.(get|post|put|patch|delete)\(\s*f?['\"]([^'\"]+)", "{1} {2}", "http"),
    ("retrofit", "java kotlin", "endpoint", "consumer", r"@(GET|POST|PUT|PATCH|DELETE)\(\"([^\"]+)", "{1} {2}", "http"),
    ("kafka", "typescript javascript", "topic", "producer", r"\.send\(\s*\{\s*(topic):\s*['\"`]([^'\"`]+)", "{2}", "topic"),
    ("kafka", "typescript javascript", "topic", "consumer", r"\.subscribe\(\s*\{\s*(topics?):\s*\[?\s*['\"`]([^'\"`]+)", "{2}", "topic"),
    ("nats", "go typescript javascript", "topic", "producer", r"\b(nc|nats)\.[Pp]ublish\(\s*['\"]([^'\"]+)", "{2}", "topic"),
    ("nats", "go typescript javascript", "topic", "consumer", r"\b(nc|nats)\.[Ss]ubscribe\(\s*['\"]([^'\"]+)", "{2}", "topic"),
    ("redis-pubsub", "python typescript javascript", "topic", "producer", r"\b(redis|client)\.publish\(\s*['\"]([^'\"]+)", "{2}", "topic"),
    ("rabbitmq", "python", "topic", "producer", r"(basic_publish)\([^)]*routing_key\s*=\s*['\"]([^'\"]+)", "{2}", "topic"),
    ("env", "typescript javascript tsx jsx", "env", "consumer", r"(process\.env|import\.meta\.env)\.(\w+)", "{2}", "env"),
    ("env", "python", "env", "consumer", r"os\.(environ\[|getenv\(|environ\.get\()\s*['\"](\w+)", "{2}", "env"),
    ("env", "go", "env", "consumer", r"os\.(Getenv|LookupEnv)\(\s*\"(\w+)", "{2}", "env"),
    ("env", "rust", "env", "consumer", r"(env::var|std::env::var)\(\s*\"(\w+)", "{2}", "env"),
    ("i18n", "typescript javascript tsx jsx vue", "i18n", "consumer", r"\b(t|i18n\.t|\$t)\(\s*['\"]([\w.-]+)", "{2}", "i18n"),
    ("typeorm", "typescript", "table", "definition", r"@(Entity)\(\s*['\"]([^'\"]+)", "{2}", "table"),
    ("python-orm", "python", "table", "definition", r"(__tablename__)\s*=\s*['\"]([^'\"]+)", "{2}", "table"),
    ("gorm", "go", "table", "definition", r"\)\s*(TableName)\(\)\s*string\s*\{\s*return\s+\"([^\"]+)", "{2}", "table"),
    ("sql-in-code", "typescript javascript python go java kotlin csharp php ruby", "table", "reads", r"(?i)\b(from|join)\s+([\w.\"`\[\]]+)", "{2}", "table"),
    ("sql-in-code", "typescript javascript python go java kotlin csharp php ruby", "table", "writes", r"(?i)\b(insert\s+into|update|delete\s+from)\s+([\w.\"`\[\]]+)", "{2}", "table"),
    ("grpc", "protobuf", "rpc", "definition", r"\b(rpc)\s+(\w+)\s*\(", "{2}", "rpc"),
    ("infra", "dockerfile yaml", "env", "definition", r"(?m)^\s*(ENV\s+|-\s+)([A-Z][A-Z0-9_]+)(?==|\s)", "{2}", "env"),
    ("sql-migrations", "sql", "table", "definition", r"(?i)\bcreate\s+(table)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)", "{2}", "table"),
)


def extract(files: DataFrame) -> DataFrame:
    """(project, path, line, pack, kind, role, key, dynamic, evidence) by rules of regular expressions, in generated code.

    files: (project, path, language, text).  A template's ``${...}`` is known at
    run time only.
    """
    from tessera.functions import contracts as K

    out = None
    for pack, languages, kind, role, pattern, template, normaliser in PACKS:
        f = files.where(F.col("language").isin(languages.split()) & F.col("text").rlike(pattern)).select("project", "path", "text")
        g = f.select("project", "path", "text", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("k"))).alias("n", "x"))
        value = F.regexp_replace("x.k", r"\$\{[^}]*\}", K.DYN)
        raw = F.concat_ws(" ", F.when(F.lit(template.startswith("{1}")), F.upper("x.m")).when(F.lit(template.startswith("*")), "*"), value)
        line = F.size(F.split(F.call_function("substring_index", F.col("text"), F.col("x.a"), F.lit(1)), "\n"))
        e = g.select("project", "path", line.alias("line"), F.lit(pack).alias("pack"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), K.NORMALISERS[normaliser](raw).alias("key"), value.contains(K.DYN).alias("dynamic"), F.lit("syntactic").alias("evidence"))
        out = e if out is None else out.unionByName(e)
    return out.where("key IS NOT NULL")


def best_spans(chunks_: DataFrame, terms: list[str], tokens: Column, n: int, *, by: str = "file") -> DataFrame:
    """The ``n`` chunks of each file that share most terms; a chunk within a better one's lines is left out."""
    q = F.array(*map(F.lit, terms))
    s = chunks_.withColumn("shared", F.size(F.array_intersect(tokens, q))).where("shared > 0")
    w = Window.partitionBy(by).orderBy(F.desc("shared"), "start_line", "end_line")
    s = s.withColumn("rank", F.row_number().over(w))
    a, b = s.alias("a"), s.select(F.col(by).alias("_f"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), F.col("rank").alias("_r")).alias("b")
    worse = a.join(b, (F.col(f"a.{by}") == F.col("_f")) & (F.col("a.start_line") >= F.col("_s")) & (F.col("a.end_line") <= F.col("_e")) & (F.col("_r") < F.col("a.rank")), "left_anti")
    return worse.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
