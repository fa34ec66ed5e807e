"""Consistency checks: configuration against documentation, concepts against tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def typed_mismatches(config: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of config(key, kind, value) and docs(key, kind, value) of one normalised key and kind
    whose values differ by more than 1e-9 (relative or absolute)."""
    a, b = config.alias("a"), docs.alias("b")
    far = F.abs(F.col("a.value") - F.col("b.value")) > F.greatest(F.lit(1e-9) * F.greatest(F.abs("a.value"), F.abs("b.value")), F.lit(1e-9))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.kind") == F.col("b.kind")) & far)


def unreferenced(concepts: DataFrame, test_words: DataFrame) -> DataFrame:
    """concepts(concept, words) with a stem that no test word has."""
    stems = test_words.select(T.stem(F.col("word")).alias("s")).distinct()
    need = concepts.select("concept", F.explode("words").alias("w")).select("concept", T.stem(F.col("w")).alias("s")).distinct()
    return concepts.join(need.join(stems, "s", "left_anti").select("concept").distinct(), "concept", "left_semi")
