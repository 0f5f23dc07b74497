"""Scalar functions as Column expressions; all but ``slug`` stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

MAX_TERMS = 18


def stable_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed identifier: prefix, then the SHA-1 of the parts joined by U+001F; null parts count as empty."""
    return F.concat(F.lit(prefix), F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def slug_ascii(text: Column, fallback: str = "item") -> Column:
    """Lower case, white space to hyphens, only ASCII word characters, hyphens and CJK ideographs; for text that needs no normalisation."""
    x = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")
    x = F.regexp_replace(x, r"[^0-9a-z_\-\x{4e00}-\x{9fff}]+", "-")
    x = F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^[-_]+|[-_]+$", "")
    return F.when(x == "", fallback).otherwise(x)


def _slug(value: str | None, fallback: str = "item") -> str:
    x = re.sub(r"\s+", "-", unicodedata.normalize("NFKC", value or "").strip().lower())
    x = re.sub(r"-{2,}", "-", re.sub(r"[^\w\-一-鿿]+", "-", x))
    return x.strip("-_") or fallback


@F.pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    """Unicode slug with compatibility normalisation, which the JVM functions lack."""
    return text.map(_slug)


def humanize(text: Column, fallback: str = fixed.UNNAMED) -> Column:
    """Words of an identifier: camel case is split, underscores and hyphens are spaces."""
    x = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "[_-]+", " "), r"\s+", " "))
    return F.when(x == "", fallback).otherwise(x)


def clean_title(text: Column, limit: int = 160, fallback: str = fixed.UNNAMED) -> Column:
    x = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, limit)
    return F.when(x == "", fallback).otherwise(x)


def session_key(agent: Column, external: Column) -> Column:
    return F.concat(agent, F.lit(":"), external)


# --- Paths -----------------------------------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Directory of a path, empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Last extension in lower case; empty for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def normalize_path(path: Column) -> Column:
    """Resolve . and .. ; null when the path leaves its root."""
    step = lambda acc, x: (
        F.when(acc.isNull() | ((x == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
        .when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def loose_path(path: Column) -> Column:
    """Slashes forward, then all leading dots and slashes gone."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def event_path(path: Column, root: Column) -> Column:
    """Project-relative form of an absolute or relative path; null outside the root."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.when(F.startswith(p, F.concat(root, F.lit("/"))), F.substr(p, F.length(root) + 2, F.length(p))).when(~F.startswith(p, F.lit("/")), p)
    return normalize_path(inside)


def language(path: Column) -> Column:
    """Language of a path's extension, else the bare extension; without one the name of a well-known file, else unknown."""
    s, name = suffix(path), F.lower(basename(path))
    out = F.when(s == "", F.when(name.isin(fixed.EXTENSIONLESS_TEXT), name).otherwise("unknown"))
    for known, extensions in fixed.LANGUAGES.items():
        out = out.when(s.isin(extensions), known)
    return out.otherwise(F.substring(s, 2, 100))


def is_test_path(path: Column) -> Column:
    lowered = F.concat(F.lit("/"), F.lower(path))
    hit = F.lit(False)
    for m in fixed.TEST_MARKERS:
        hit = hit | F.contains(lowered, F.lit(m))
    return hit


def path_relation(path: Column) -> Column:
    """How a file serves its concept: tested_by, documented_by, configured_by or implemented_by."""
    lowered = F.concat(F.lit("/"), F.lower(path))
    return (
        F.when(is_test_path(path), "tested_by")
        .when(suffix(path).isin(fixed.DOCUMENT_EXTENSIONS) | F.contains(lowered, F.lit("/docs/")), "documented_by")
        .when(suffix(path).isin(fixed.CONFIG_EXTENSIONS) | F.contains(lowered, F.lit("/config/")), "configured_by")
        .otherwise("implemented_by")
    )


def role_relation(path: Column, roles: Column) -> Column:
    """Relation by roles: a test path first, then the first role that has one; null if none has."""
    known = F.create_map(*[F.lit(x) for kv in fixed.ROLE_RELATIONS.items() for x in kv])
    return F.when(is_test_path(path), "tested_by").otherwise(F.try_element_at(F.filter(F.transform(roles, lambda r: F.element_at(known, r)), lambda r: r.isNotNull()), F.lit(1)))


def _clean_segment(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)\.(test|spec)$", ""), "(?i)^test_", ""), r"^[-_. ]+|[-_. ]+$", "")


def concept_name(path: Column, project: Column) -> Column:
    """Directory, stem or project that names the concept of a file, before it becomes a slug or a label."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    folders = F.slice(parts, F.lit(1), F.greatest(n, F.lit(0)))
    pairs = F.filter(F.transform(folders, lambda x, i: F.struct(F.lower(x).alias("box"), _clean_segment(F.get(folders, i + 1)).alias("name"))), lambda p: p["box"].isin(fixed.CONTAINER_DIRECTORIES) & (p["name"] != "") & ~F.lower(p["name"]).isin(fixed.GENERIC_SEGMENTS))
    plain = F.filter(F.transform(F.filter(folders, lambda x: ~F.lower(x).isin(fixed.GENERIC_PREFIXES + fixed.GENERIC_SEGMENTS)), _clean_segment), lambda x: x != "")
    own = _clean_segment(stem(path))
    return F.coalesce(F.get(pairs, F.lit(0))["name"], F.get(plain, F.lit(0)), F.when((own != "") & ~F.lower(own).isin(fixed.GENERIC_STEMS), own), project)


def edge_confidence(n: Column) -> Column:
    """Confidence of an edge with n pieces of evidence."""
    return F.least(F.lit(0.97), F.lit(0.55) + F.lit(0.08) * F.greatest(n, F.lit(1)))


# --- Search -----------------------------------------------------------------------------------------------------------


def search_terms(query: str, limit: int = MAX_TERMS) -> list[str]:
    """Terms of one query: the whole query, its words, and the n-grams of its ideographs; longest first."""
    whole = " ".join(query.split())
    found = ([whole.lower()] if whole else []) + [w.lower() for w in re.findall(r"[A-Za-z0-9_.\-/]{2,}", whole)]
    for run in re.findall("[一-鿿]+", whole):
        found += [run] if len(run) <= 6 else []
        found += [run[i : i + n] for n in (6, 5, 4, 3, 2) for i in range(len(run) - n + 1)]
    return sorted({t for t in found if t.strip()}, key=lambda t: (-len(t), t))[:limit]


def search_terms_column(query: Column, limit: int = MAX_TERMS) -> Column:
    """``search_terms`` for a column of queries."""
    whole = F.trim(F.regexp_replace(query, r"\s+", " "))
    words = F.transform(F.regexp_extract_all(whole, F.lit(r"[A-Za-z0-9_.\-/]{2,}"), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(whole, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda t: F.flatten(F.transform(F.array(*[F.lit(n) for n in (6, 5, 4, 3, 2)]), lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, n))).otherwise(F.array().cast("array<string>"))))))
    every = F.array_distinct(F.filter(F.concat(F.array(F.lower(whole)), words, F.filter(runs, lambda t: F.length(t) <= 6), grams), lambda t: F.trim(t) != ""))
    ordered = F.array_sort(every, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.slice(ordered, 1, limit)


def matches(terms: Sequence[str], *columns: Column) -> Column:
    """Whether a column holds a term, literally and without case."""
    hit = F.lit(False)
    for t in terms:
        for c in columns:
            hit = hit | F.contains(F.lower(c), F.lit(t))
    return hit


def node_score(terms: Sequence[str], whole: str, label: Column, key: Column, data: Column, layer: Column, inactive: Column) -> Column:
    """Score of a node for a query; one expression without a shuffle."""
    low_label, low_key, low_data = F.lower(label), F.lower(key), F.lower(data)
    score = F.lit(1.0)
    for k, v in fixed.LAYER_SCORES.items():
        score = F.when(layer == k, F.lit(v)).otherwise(score)
    if whole:
        score = score + F.when(F.contains(low_label, F.lit(whole)), 12.0).otherwise(0.0) + F.when(F.contains(low_key, F.lit(whole)), 8.0).otherwise(0.0)
    for t in terms:
        score = score + F.when(low_label == t, 9.0).when(F.contains(low_label, F.lit(t)), 5.0).otherwise(0.0)
        score = score + F.when(low_key == t, 6.0).when(F.contains(low_key, F.lit(t)), 3.0).otherwise(0.0)
        score = score + F.when(F.contains(low_data, F.lit(t)), 1.0).otherwise(0.0)
    return score - F.when(inactive, 6.0).otherwise(0.0)


def filename_score(terms: Sequence[str], path: Column, label: Column) -> Column:
    """Score of a file by its name alone: equal 10, in the path 4 and a share of the term's length, in the label 3."""
    p, name = F.lower(path), F.lower(label)
    score = F.lit(0.0)
    for t in terms:
        score = score + F.when((p == t) | (name == t), 10.0).when(F.contains(p, F.lit(t)), 4.0 + min(len(t), 10) / 10).when(F.contains(name, F.lit(t)), 3.0).otherwise(0.0)
    return score


# --- Tools, statuses, types --------------------------------------------------------------------------------------------


def patch_paths(command: Column) -> Column:
    """Paths that a patch adds, updates or deletes."""
    return F.regexp_extract_all(command, F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File:\s+(.+?)\s*$"), F.lit(1))


def tool_class(tool: Column, command: Column) -> Column:
    """modify, read, search, test, command or tool: by parts of the tool's name and, for shells, by the command."""
    t, c = F.lower(F.coalesce(tool, F.lit(""))), F.lower(F.coalesce(command, F.lit("")))
    of = {k: t.rlike("|".join(v)) for k, v in fixed.TOOL_PARTS.items()}
    shell = F.when(c.rlike(fixed.TEST_COMMAND), "test").when(c.rlike(fixed.SEARCH_COMMAND), "search").otherwise("command")
    return F.when(of["modify"], "modify").when(of["read"], "read").when(of["search"], "search").when(of["command"], shell).otherwise("tool")


def end_status(explicit: Column, kind: Column, cause: Column) -> Column:
    """Terminal status of a task: a stated one, else by the kind of the end and, when aborted, by who did it."""
    e, k, c = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (explicit, kind, cause))
    return (
        F.when(e.isin(fixed.TERMINAL_STATUSES), e).when(k == "aborted", F.when(c == "user", "cancelled").otherwise("interrupted"))
        .when(k == "interrupted", "interrupted").when(k.isin("blocked", "error", "max-tokens", "failed"), "failed").otherwise("completed")
    )


def scalar_type(text: Column) -> Column:
    """empty, boolean, integer, number or string for one CSV cell."""
    t = F.trim(text)
    return (
        F.when(text.isNull() | (t == ""), "empty").when(F.lower(t).isin("true", "false"), "boolean").when(t.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), "integer")
        .when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(t).rlike(r"^[+-]?(nan|inf|infinity)$"), "number").otherwise("string")
    )


def sql_reads(sql: Column) -> Column:
    """Tables after FROM or JOIN, in order of first mention."""
    return F.slice(F.array_distinct(F.regexp_extract_all(sql, F.lit(fixed.SQL_READ), F.lit(1))), 1, 500)


def sql_writes(sql: Column) -> Column:
    """Tables that a statement inserts into, updates, deletes from, merges into, creates, alters or drops."""
    return F.slice(F.array_distinct(F.regexp_extract_all(sql, F.lit(fixed.SQL_WRITE), F.lit(1))), 1, 500)
