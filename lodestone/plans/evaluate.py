"""Evaluation of delivered packages against answer keys."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(keys: DataFrame, delivered: DataFrame, group: list[str], on: tuple = ("path",)) -> DataFrame:
    """keys(group..., path) -> per group: keys, keys among delivered(path), their ratio."""
    hit = delivered.select(*on).distinct().withColumn("_hit", F.lit(1))
    out = keys.join(hit, list(on), "left").groupBy(*group).agg(F.count("*").alias("n_keys"), F.count("_hit").alias("n_found"))
    return out.withColumn("recall", F.round(F.col("n_found") / F.col("n_keys"), 9))


def excerpt_recall(anchors: DataFrame, excerpts: DataFrame) -> DataFrame:
    """anchors(path, anchor) with found: an excerpt(path, text) of the file contains the anchor."""
    have = excerpts.groupBy("path").agg(F.collect_list("text").alias("_texts"))
    return anchors.join(have, "path", "left").withColumn("found", F.coalesce(F.exists("_texts", lambda t: t.contains(F.col("anchor"))), F.lit(False))).drop("_texts")


def validate_keys(entries: list[dict]) -> None:
    """Reject malformed answer keys: fields, empty files, anchors outside files or empty, duplicates."""
    seen = set()
    for e in entries:
        missing = {"repo", "group", "task", "files"} - set(e)
        if missing:
            raise ValueError(f"missing {sorted(missing)}")
        if not e["files"]:
            raise ValueError("an entry needs files")
        for path, anchors in e.get("anchors", {}).items():
            if path not in e["files"] or not anchors:
                raise ValueError(f"anchors of {path} must be some, of a file in the entry")
        if (e["repo"], e["task"]) in seen:
            raise ValueError("a repository has the task twice")
        seen.add((e["repo"], e["task"]))


#: Shapes of secrets that no package may show.
LEAKS = r"\bsk-[A-Za-z0-9_]{10,}\b|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b"


def run_cases(entries: list[dict], run, top: int = 8) -> list[dict]:
    """Run every entry's task and its variants twice by run(repo, task) -> package: recall of the key
    files in the package and in its first `top`, anchors found in excerpts, determinism, leaks."""
    validate_keys(entries)
    out = []
    for e in entries:
        for phrasing, task in {"task": e["task"], **e.get("task_variants", {})}.items():
            package, again = run(e["repo"], task), run(e["repo"], task)
            paths = [x["path"] for x in package["included"]]
            shown = {x["path"]: [y["text"] for y in x["excerpts"]] for x in package["included"]}
            anchors = [(p, a) for p, many in e.get("anchors", {}).items() for a in many]
            found = sum(any(a in t for t in shown.get(p, [])) for p, a in anchors)
            text = json.dumps(package, sort_keys=True)
            out.append({
                "repo": e["repo"], "group": e["group"], "phrasing": phrasing, "keys": len(e["files"]), "in_package": sum(f in paths for f in e["files"]), "in_top": sum(f in paths[:top] for f in e["files"]),
                "anchors": len(anchors), "anchors_found": found, "deterministic": text == json.dumps(again, sort_keys=True), "leaks": len(re.findall(LEAKS, text)),
            })
    return out


def totals(cases: list[dict]) -> dict[str, dict]:
    """Sums per group, and over all."""
    out: dict[str, dict] = {}
    for c in cases:
        for group in (c["group"], "all"):
            sums = out.setdefault(group, dict.fromkeys(("keys", "in_package", "in_top", "anchors", "anchors_found", "leaks"), 0))
            for k in sums:
                sums[k] += c[k]
    return out
