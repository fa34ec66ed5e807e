"""Files of a directory tree as a DataFrame.

The driver walks names and sizes only (pruning denied and ignored folders); contents are read on the
executors, which must see the root. Pass a DataFrame of files where the corpus is a table."""

from __future__ import annotations

import configparser
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT, DENYLIST_DIRS, Config
from ..functions import paths as P
from ..operators import dedupe
from . import ignore

OWN_IGNORE = ".contextignore"


def _lines(path: Path) -> list[str]:
    try:
        return path.read_text(errors="replace").splitlines()
    except OSError:
        return []


def global_excludes(root: Path) -> Path | None:
    """core.excludesFile of the repository, the user or XDG, else the default global ignore file."""
    home, xdg = Path.home(), Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    for where in (root / ".git/config", home / ".gitconfig", xdg / "git/config"):
        parser = configparser.RawConfigParser(strict=False, allow_no_value=True, inline_comment_prefixes=("#", ";"))
        try:
            parser.read_string("\n".join(line.strip() for line in _lines(where)))
            value = parser.get("core", "excludesfile", fallback=None)
        except configparser.Error:
            continue
        if value:
            return Path(os.path.expanduser(value.strip().strip('"')))
    return xdg / "git/ignore"


def root_rules(root: Path) -> list[ignore.Rule]:
    """Rules of the root scope, low to high precedence."""
    lines: list[str] = []
    for where in (global_excludes(root), root / ".git/info/exclude", root / ".gitignore", root / OWN_IGNORE):
        lines += _lines(where) if where else []
    return ignore.compile_rules("", lines)


def _inside(path: Path, root: Path) -> bool:
    try:
        return path.resolve().is_relative_to(root)
    except (OSError, RuntimeError):
        return False


def _count(top: Path, root: Path) -> int:
    n = 0
    for where, dirs, names in os.walk(top):
        dirs[:] = [d for d in dirs if d not in DENYLIST_DIRS and _inside(Path(where, d), root)]
        n += sum(_inside(Path(where, x), root) for x in names)
    return n


def walk(root: Path, cfg: Config = DEFAULT) -> tuple[list[tuple[str, int]], dict[str, int]]:
    """(path, size) of the files to read, and how many were ignored or oversize. Rules inside ignored
    folders are never read; links out of the root are skipped."""
    root = root.resolve()
    rules, kept, counts = root_rules(root), [], {"ignored": 0, "oversize": 0}
    for where, dirs, names in os.walk(root):
        here = Path(where).relative_to(root).as_posix()
        here = "" if here == "." else here
        if here and ".gitignore" in names:
            rules += ignore.compile_rules(here, _lines(Path(where, ".gitignore")))
        keep = []
        for d in sorted(dirs):
            if d in DENYLIST_DIRS or not _inside(Path(where, d), root):
                continue
            if ignore.match(rules, f"{here}/{d}".lstrip("/"), True):
                counts["ignored"] += _count(Path(where, d), root)
            else:
                keep.append(d)
        dirs[:] = keep
        for name in sorted(names):
            full, path = Path(where, name), f"{here}/{name}".lstrip("/")
            if not _inside(full, root):
                continue
            if ignore.match(rules, path, False):
                counts["ignored"] += 1
                continue
            try:
                size = full.stat().st_size
            except OSError:
                continue
            if size > cfg.max_file_bytes:
                counts["oversize"] += 1
            else:
                kept.append((path, size))
    return kept, counts


def discover_files(spark: SparkSession, root: str, cfg: Config = DEFAULT, hold=DataFrame.persist) -> tuple[DataFrame, dict[str, int]]:
    """(files(path, role, size, content, duplicate_count), counts by reason)."""
    top = str(Path(root).resolve())
    found, counts = walk(Path(root), cfg)
    listed = spark.createDataFrame(found, "path string, size long")
    sniff = cfg.sniff_bytes

    def read(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    data = Path(top, path).read_bytes()
                except OSError:
                    data = b"\0"
                binary = b"\0" in data[:sniff]
                text = None if binary else data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([text], pa.string())], ["path", "size", "content"])

    n = max(1, min(len(found) // 64, 4 * spark.sparkContext.defaultParallelism))
    read_ = hold(listed.repartition(n).mapInArrow(read, "path string, size long, content string"))
    total = read_.count()
    text = read_.filter("content is not null").withColumn("role", P.role(F.col("path")))
    one = hold(dedupe.dedupe_locales(dedupe.dedupe_content(text)))
    kept = one.count()
    binary = total - text.count()
    return one, {**counts, "binary": binary, "duplicate": total - binary - kept}
