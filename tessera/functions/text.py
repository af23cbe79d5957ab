"""Text functions: code-aware tokens, folding, token estimates, entropy, shapes of query terms."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOPWORDS = tuple("the an of to in is are where how do does we what which and or for on it as be ve bir bu nerede nasil ne hangi mi mu icin ile".split())
_FOLD = str.maketrans("çÇğĞıİîÎöÖşŞüÜûÛâÂ", "ccggiiiioossuuuuaa")
FOLD_FROM, FOLD_TO = "çÇğĞıİîÎöÖşŞüÜûÛâÂ", "ccggiiiioossuuuuaa"
_RUN = re.compile("[\\w\u0300-\u036f]+")


def fold(s: str) -> str:
    """Turkish and other Latin letters to plain ones, before lower case."""
    return "".join(c for c in s.translate(_FOLD).lower() if not 0x300 <= ord(c) <= 0x36F)


def fold_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(c, FOLD_FROM, FOLD_TO)), "[\\u0300-\\u036f]", "")


def _kind(c: str) -> str:
    return "_" if c == "_" else "D" if c.isnumeric() else "U" if c.isupper() else "L"


def run_tokens(run: str) -> list[str]:
    """Tokens of one run: the compound first, then its parts, and a letter part with the digits behind it."""
    chars = [c for c in unicodedata.normalize("NFC", run) if not 0x300 <= ord(c) <= 0x36F]
    if not chars or len(chars) > 256:
        return []
    kinds = "".join(map(_kind, chars))
    parts: list[tuple[int, int, str]] = []
    for piece in re.finditer(r"[^_]+", kinds):
        # a camel boundary is before an upper letter behind a lower one, or before the last upper letter of a run
        at = piece.start()
        for m in re.finditer(r"D+|U+(?=UL|$|D)|UL+|U+|L+", piece[0]):
            parts.append((at + m.start(), at + m.end(), m[0][0]))
    out: list[str] = []

    def put(a: int, b: int) -> None:
        t = fold("".join(chars[a:b]))
        if 2 <= len(t) <= 64 and not (len(t) > 10 and all(c.isnumeric() for c in t)) and t not in out:
            out.append(t)

    if len(parts) > 1:
        put(parts[0][0], parts[-1][1])
    for i, (a, b, k) in enumerate(parts):
        put(a, b)
        if k == "D" and i and parts[i - 1][2] != "D" and parts[i - 1][1] == a:
            put(parts[i - 1][0], b)
    return out


_PLAIN = re.compile("[A-Z]?[a-z]+|[A-Z]+")  # a run that is one part, and one token
MEMO = 200_000  # runs whose tokens are kept in a process; those of more than 64 characters are not
_memo: dict[str, tuple[str, ...]] = {}


def _tokens_of(run: str) -> tuple[str, ...]:
    """``run_tokens``, remembered: a text's runs are the same few again and again."""
    found = _memo.get(run)
    if found is None:
        found = ((run.lower(),) if 2 <= len(run) <= 64 else ()) if _PLAIN.fullmatch(run) else tuple(run_tokens(run))
        if len(run) <= 64:
            if len(_memo) >= MEMO:
                _memo.clear()
            _memo[run] = found
    return found


def tokens(text: str | None) -> list[str]:
    return [t for r in map(_tokens_of, _RUN.findall(text or "")) for t in r]


def query_tokens(text: str) -> list[str]:
    """Distinct tokens without stop words; with them if nothing else is left."""
    every = list(dict.fromkeys(tokens(text)))
    return [t for t in every if t not in STOPWORDS] or every


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(text: pd.Series) -> pd.Series:
    """All tokens of a text, in order."""
    return text.map(tokens)


@F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_distinct", T.LongType())]))
def token_counts(text: pd.Series) -> pd.DataFrame:
    """How many tokens and distinct tokens ``tokenize`` gives; the tokens stay in the worker."""
    def count(t: str | None) -> tuple[int, int]:
        n, distinct = 0, set()
        runs: dict[str, int] = {}
        for r in _RUN.findall(t or ""):
            runs[r] = runs.get(r, 0) + 1
        for r, k in runs.items():
            found = _tokens_of(r)
            n += k * len(found)
            distinct.update(found)
        return n, len(distinct)

    return pd.DataFrame([count(t) for t in text], columns=["n_tokens", "n_distinct"])


def simple_tokens(text: Column) -> Column:
    """The ASCII variant in SQL: lower-case runs of letters, digits and ``_`` of 2 to 64 characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t).between(2, 64))


def estimate(text: Column, per: int = 4, least: int = 0) -> Column:
    """Token estimate by characters: 4 a token for packing and memory, 3 for embedding inputs (1 at least)."""
    return F.greatest(F.ceil(F.char_length(text) / per), F.lit(least)).cast("long")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression: ``**`` any depth, ``*`` and ``?`` within a segment."""
    if len(glob) > 512 or "\\" in glob:
        raise ValueError("a glob has 512 characters at most and no backslash")
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def any_of(c: Column, patterns: Iterable[str]) -> Column:
    """True where a pattern fits; no pattern is no filter."""
    found = [c.rlike(p) for p in patterns]
    if not found:
        return F.lit(True)
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


SHAPES = (  # in order of precedence
    ("url", r"^https?://\S+$"), ("line", r"^[\w./-]+\.\w+:\d+(?::\d+)?$"), ("route", r"^(?:(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+)?/[\w{}:.*/-]*$"),
    ("path", r"^(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+$|^[\w-]+\.(?:py|rs|go|ts|tsx|js|java|kt|cs|rb|php|sql|toml|ya?ml|json|md)$"),
    ("exception", r"^[A-Z]\w*(?:Error|Exception|Panic)$"), ("error_code", r"^(?:[A-Z]{1,8}-?\d{2,6}|0x[0-9a-fA-F]{4,8})$"),
    ("qualified", r"^\w+(?:(?:::|\.|#)\w+)+$"), ("identifier", r"^(?:[a-z]+(?:[A-Z][a-z0-9]*)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|\w+_\w+)$"),
)


def literal_prefixes(prefixes: Iterable[str]) -> list[str]:
    """Trimmed, distinct and sorted path prefixes; empty ones go, and what is no relative path is an error.  Wildcards stay literal."""
    found = set()
    for p in prefixes:
        if any(unicodedata.category(ch) == "Cc" for ch in p):
            raise ValueError("a prefix has no control characters")
        p = p.strip()
        if p and any(part in ("", ".", "..") for part in p.removesuffix("/").split("/")):
            raise ValueError("a prefix is a relative path without empty, '.' or '..' parts")
        found |= {p} - {""}
    return sorted(found)


def under_any(c: Column, prefixes: Iterable[str]) -> Column:
    """Whether a path starts with one of the prefixes; without any, every path does."""
    asked = literal_prefixes(prefixes)
    return functools.reduce(lambda a, b: a | b, (c.startswith(p) for p in asked)) if asked else F.lit(True)


#: Trace lines: a quoted file with its line; a call with its place in brackets; a bare place.  Places count lines from 1.
_PY_FRAME = r'^File "([^"]*)", line (\d+)(?:.*?, in (.*))?'
_CALL_FRAME = r"^at (.*)\(([^()]+?):0*([1-9]\d*)(?::(\d+))?\)$"
_BARE_FRAME = r"^at ([^()]+?):0*([1-9]\d*)(?::(\d+))?$"


def trace_frames(text: Column) -> Column:
    """array of (path, line, column, symbol): the frames of a stack trace, top down; other lines give none, null text an empty array.

    A line number is an integer, a missing column or symbol null; ``\\`` in paths becomes ``/``.
    """

    def frame(line: Column) -> Column:
        def part(pattern: str, n: int) -> Column:
            return F.trim(F.regexp_extract(line, pattern, n))

        def made(pattern: str, path: int, at: int, column: int | None, symbol: int | None) -> Column:
            other = lambda n: F.lit(None).cast("string") if n is None else F.nullif(part(pattern, n), F.lit(""))
            return F.struct(F.translate(part(pattern, path), "\\", "/").alias("path"), part(pattern, at).try_cast("int").alias("line"), other(column).try_cast("int").alias("column"), other(symbol).alias("symbol"))

        return (F.when(line.rlike(_PY_FRAME), made(_PY_FRAME, 1, 2, None, 3)).when(line.rlike(_CALL_FRAME), made(_CALL_FRAME, 2, 3, 4, 1))
                .when(line.rlike(_BARE_FRAME), made(_BARE_FRAME, 1, 2, 3, None)))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(F.transform(lines, frame), lambda x: x.isNotNull() & x["line"].isNotNull())


def shape(c: Column) -> Column:
    """What a query term looks like."""
    out = F.lit("word")
    for name, pattern in reversed(SHAPES):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


INTENTS = {  # (exact, lexical, semantic)
    "exact_symbol": (1.0, 0.8, 0.3), "path": (1.0, 0.7, 0.2), "endpoint": (1.0, 0.8, 0.4), "error": (0.9, 1.0, 0.4),
    "behavior": (0.4, 0.6, 1.0), "impact": (1.0, 0.6, 0.4), "why": (0.5, 0.8, 0.8)}
_INTENT_OF = {"identifier": "exact_symbol", "qualified": "exact_symbol", "path": "path", "line": "path", "route": "endpoint", "url": "endpoint", "error_code": "error", "exception": "error"}


def plan_query(text: str) -> dict:
    """Intent, weights, terms and shapes of one query; errors first, then endpoints, paths, symbols, then words of purpose."""
    shapes = [(t, next((n for n, p in SHAPES if re.match(p, t)), "word")) for t in text.split()]
    found = {_INTENT_OF[s] for _, s in shapes if s in _INTENT_OF}
    low = fold(text)
    words = set(re.findall(r"\w+", low))
    if words & {"why", "neden", "nicin", "reason"}:
        intent = "why"
    elif words & {"impact", "breaks", "affects", "etkiler"}:
        intent = "impact"
    else:
        intent = next((i for i in ("error", "endpoint", "path", "exact_symbol") if i in found), "behavior")
    return {"intent": intent, "weights": INTENTS[intent], "terms": query_tokens(text), "shapes": shapes}
