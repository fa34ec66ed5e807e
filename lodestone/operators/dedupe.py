"""Duplicate files: equal content, and locale mirrors of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TOOLING_DIRS
from ..functions import paths as P

LOCALE = "^[a-z]{2,3}(-[a-z0-9]{2,4})?$"


def dedupe_content(files: DataFrame) -> DataFrame:
    """Of files of equal size and SHA-256 (empty files are kept) one stays: outside tooling folders
    first, then fewest folders, then least path. duplicate_count counts the copies dropped.

    Keys are aggregated before the join, so a hot content is one row per map task."""
    tooling = F.exists(P.directories(F.col("path")), lambda s: s.isin(list(TOOLING_DIRS)))
    keyed = files.withColumn("_sha", F.when(F.col("size") > 0, F.sha2(F.col("content").cast("binary"), 256)).otherwise(F.col("path")))
    order = F.struct(tooling.alias("t"), F.size(P.segments(F.col("path"))).alias("d"), F.col("path").alias("p"))
    best = keyed.groupBy(F.col("_sha").alias("_k"), F.col("size").alias("_s")).agg(F.min(order).alias("_o"), (F.count("*") - 1).alias("duplicate_count"))
    return keyed.join(best, (F.col("path") == F.col("_o.p")) & (F.col("_sha") == F.col("_k")) & (F.col("size") == F.col("_s"))).drop("_sha", "_k", "_s", "_o")


def locale_roots(files: DataFrame, siblings: int = 3) -> DataFrame:
    """(parent, n): folders with at least `siblings` children named like locales. The first segment
    is never a locale."""
    segs = files.select(P.segments(F.col("path")).alias("s"))
    rows = segs.select("s", F.posexplode("s").alias("i", "seg")).filter((F.col("i") > 0) & F.col("seg").rlike(LOCALE))
    pairs = rows.select(F.array_join(F.slice("s", F.lit(1), F.col("i")), "/").alias("parent"), "seg").distinct()
    return pairs.groupBy("parent").agg(F.count("*").alias("n")).filter(F.col("n") >= siblings)


def dedupe_locales(files: DataFrame, siblings: int = 3, preferred: str = "en") -> DataFrame:
    """Of the mirrors of one path under a locale root, the preferred locale or else the first stays;
    duplicate_count adds up."""
    base = files if "duplicate_count" in files.columns else files.withColumn("duplicate_count", F.lit(0).cast("long"))
    roots = locale_roots(files, siblings).select(F.col("parent").alias("_parent"))
    rows = base.select("path", P.segments(F.col("path")).alias("s")).select("path", "s", F.posexplode("s").alias("i", "seg")).filter((F.col("i") > 0) & F.col("seg").rlike(LOCALE))
    rows = rows.withColumn("_parent", F.array_join(F.slice("s", F.lit(1), F.col("i")), "/")).join(roots, "_parent")
    family = rows.withColumn("_rest", F.array_join(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0))), "/"))
    family = family.groupBy("path").agg(F.min_by(F.struct("_parent", "_rest", "seg"), "i").alias("f")).select("path", "f.*")
    w = Window.partitionBy("_parent", "_rest")
    ranked = family.withColumn("_rn", F.row_number().over(w.orderBy(F.col("seg") != preferred, "seg", "path"))).withColumn("_n", F.count("*").over(w))
    out = base.join(ranked.select("path", "_rn", "_n"), "path", "left").filter("_rn is null or _rn = 1")
    return out.withColumn("duplicate_count", F.col("duplicate_count") + F.coalesce(F.col("_n") - 1, F.lit(0))).drop("_rn", "_n")
