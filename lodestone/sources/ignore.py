"""Ignore rules: a translator of gitignore patterns to Java regular expressions, and verdicts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DENYLIST_DIRS
from ..functions import paths as P


@dataclass(frozen=True)
class Rule:
    """One pattern below `scope` (a folder, '' for the root): what it matches is ignored, or included
    again when `include`; `dir_only` patterns match what lies in a folder of that name."""

    scope: str
    order: int
    regex: str
    include: bool
    dir_only: bool


def _glob(body: str) -> str | None:
    """The regular expression of a glob without its slash rules; None when it cannot be one."""
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = body.find("]", i + 2 if body[i + 1 : i + 2] in ("!", "^", "]") else i + 1)
            if end < 0:
                return None
            inner = body[i + 1 : end]
            negate = inner[:1] in ("!", "^")
            inner = inner[1:] if negate else inner
            out += "[" + ("^" if negate else "") + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]"
            i = end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def compile_rule(line: str, scope: str = "", order: int = 0) -> Rule | None:
    """One line of an ignore file; None for blanks, comments and what is no pattern."""
    line = line.rstrip("\n").rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    include = line.startswith("!")
    body = line[1:] if include else line
    dir_only = body.endswith("/")
    body = body.rstrip("/") if dir_only else body
    if not body or body == "!":
        return None
    anchored = "/" in body
    glob = _glob(body.removeprefix("/"))
    if glob is None:
        return None
    head = "^" if anchored else "(?:^|/)"
    return Rule(scope, order, head + glob + ("/" if dir_only else "(?:$|/)"), include, dir_only)


def compile_rules(scope: str, lines: list[str], start: int = 0) -> list[Rule]:
    return [r for i, line in enumerate(lines) if (r := compile_rule(line, scope, start + i))]


def match(rules: list[Rule], path: str, is_dir: bool) -> bool | None:
    """The driver's verdict on one path: the last matching rule of the deepest scope with an opinion."""
    best = None
    for r in rules:
        if r.scope and not path.startswith(r.scope + "/"):
            continue
        below = path[len(r.scope) + 1 :] if r.scope else path
        if re.search(r.regex, below + "/" if is_dir else below):
            key = (r.scope.count("/") + (r.scope != ""), r.order)
            if best is None or key >= best[0]:
                best = (key, not r.include)
    return None if best is None else best[1]


def _opinion(path: Column, rules: list[Rule], is_dir: bool) -> Column:
    """match() as an expression."""
    hits = []
    for r in rules:
        below = F.substring(path, F.lit(len(r.scope) + 2), F.length(path)) if r.scope else path
        fits = (F.concat(below, F.lit("/")) if is_dir else below).rlike(r.regex)
        fits = fits & path.startswith(r.scope + "/") if r.scope else fits
        depth = r.scope.count("/") + (r.scope != "")
        hits.append(F.when(fits, F.struct(F.lit(depth).alias("d"), F.lit(r.order).alias("o"), F.lit(not r.include).alias("v"))))
    return F.array_max(F.array_compact(F.array(*hits)))["v"]


def verdict(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """files(path) with ignored: true, false or null (no opinion), by the last match of the deepest
    scope. What lies in an ignored folder is ignored whatever rules say of it. The rules are a constant of
    the plan; no join."""
    if not rules:
        return files.withColumn("ignored", F.lit(None).cast("boolean"))
    parts = P.segments(F.col("path"))
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    pruned = F.exists(folders, lambda d: F.coalesce(_opinion(d, rules, True), F.lit(False)))
    return files.withColumn("ignored", F.when(pruned, True).otherwise(_opinion(F.col("path"), rules, False)))


def drop_denied(files: DataFrame) -> DataFrame:
    """Files with no folder of the denylist anywhere in their path."""
    denied = F.array(*[F.lit(d) for d in DENYLIST_DIRS])
    return files.filter(~F.arrays_overlap(P.segments(F.col("path")), denied))


def with_size_bucket(files: DataFrame, limit: int) -> DataFrame:
    return files.withColumn("bucket", F.when(F.col("size") > limit, "oversize").otherwise("kept"))
