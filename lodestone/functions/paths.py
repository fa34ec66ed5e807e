"""Path expressions: segments, roles, penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import words


def _in(c: Column, values) -> Column:
    return c.isin(list(values))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda s: s != "")


def directories(path: Column) -> Column:
    s = segments(path)
    return F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    """The lower-case suffix; a dotfile without another dot is all suffix when it is a config name."""
    name = F.lower(basename(path))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when((suffix == "") & name.startswith("."), name).otherwise(suffix)


def stem_of(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def segments_and_stems(path: Column) -> Column:
    """Every segment, and its stem where it has an extension."""
    return F.flatten(F.transform(segments(path), lambda s: F.when(s.rlike(r"^.+\.[^.]+$"), F.array(s, stem_of(s))).otherwise(F.array(s))))


def path_words(path: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(segments_and_stems(path), words)))


def is_data_segment(s: Column) -> Column:
    inner = F.split(F.lower(s), "[^a-z0-9]+")
    return _in(F.lower(s), K.DATA_DIRS) | F.arrays_overlap(inner, F.array(F.lit("fixture"), F.lit("fixtures")))


def in_data(path: Column) -> Column:
    return F.exists(directories(path), is_data_segment)


def in_example(path: Column) -> Column:
    return F.exists(directories(path), lambda s: _in(F.lower(s), K.EXAMPLE_DIRS))


def in_legacy(path: Column) -> Column:
    return F.exists(directories(path), lambda s: _in(F.lower(s), K.LEGACY_DIRS) | F.lower(s).rlike(r"^v\d+$"))


def is_history(path: Column) -> Column:
    return _in(F.lower(stem_of(basename(path))), K.HISTORY_STEMS) | F.exists(directories(path), lambda s: _in(F.lower(s), K.HISTORY_DIRS))


def role(path: Column) -> Column:
    name, ext, dirs = basename(path), extension(path), directories(path)
    test = F.array_contains(dirs, "tests") | name.startswith("test_") | name.endswith("_test.py")
    source = _in(ext, K.SOURCE_EXTENSIONS)
    return (
        F.when(test, "test")
        .when(in_data(path) & ~source, "other")
        .when(_in(ext, K.CONFIG_EXTENSIONS) | F.array_contains(dirs, "config"), "config")
        .when(_in(ext, K.DOCS_EXTENSIONS) | F.array_contains(dirs, "docs"), "docs")
        .when(source, "source")
        .otherwise("other")
    )


def average_line(content: Column) -> Column:
    breaks = F.regexp_count(content, F.lit("\n"))
    lines = breaks + F.when(content.endswith("\n"), 0).otherwise(1)
    return F.when(F.length(content) == 0, 0.0).otherwise((F.length(content) - breaks) / F.greatest(lines, F.lit(1)))


def asset_like(path: Column, content: Column, limit: int = K.DEFAULT.asset_avg_line) -> Column:
    name = F.lower(basename(path))
    return (
        _in(name, K.LOCKFILES)
        | _in(extension(path), (".svg", ".map"))
        | name.endswith(".min.js")
        | name.endswith(".min.css")
        | F.exists(directories(path), lambda s: _in(F.lower(s), K.ASSET_DIRS))
        | (average_line(content) > limit)
    )


def looks_generated(content: Column) -> Column:
    return F.lower(F.left(content, F.lit(4096))).rlike("|".join(m.replace("-", "\\-") for m in K.GENERATED_MARKERS))


def large_penalty(path: Column, size: Column, content: Column, asset: Column, defs: Column, parse_ok: Column, cfg: K.Config = K.DEFAULT) -> Column:
    """The factor on the content signal of large files."""
    ext = extension(path)
    dense = (ext == ".py") & parse_ok & (defs / (size / 1000.0) >= cfg.defs_per_kb)
    prose = _in(ext, K.SOURCE_EXTENSIONS) & (ext != ".py") & (average_line(content) <= cfg.weak_avg_line)
    return F.when(size <= cfg.large_file_bytes, 1.0).when(asset, cfg.large_data).when(dense, 1.0).when(prose, cfg.large_weak).otherwise(cfg.large_data)


def path_penalty(path: Column, content: Column, cfg: K.Config = K.DEFAULT) -> Column:
    one = lambda flag, x: F.when(flag, x).otherwise(1.0)
    return one(in_data(path), cfg.data_penalty) * one(looks_generated(content), cfg.generated_penalty) * one(in_example(path), cfg.example_penalty) * one(is_history(path), cfg.history_penalty) * one(in_legacy(path), cfg.legacy_penalty)
