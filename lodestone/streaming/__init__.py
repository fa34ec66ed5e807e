"""Scoring of a stream of files. The ranking model is defined on a whole corpus; the parts of it that
need one file only (word counts, content scores, roles) run on a stream as they do on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT, Config
from ..functions import paths as P
from ..operators import scoring


def content_scores(files: DataFrame, terms: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """files(path, content), streaming or not -> (path, role, term, cnt, score) of the terms found."""
    rows = scoring.content_signals(files.withColumn("role", P.role(F.col("path"))), terms, ("path", "role"))
    return rows.filter("cnt > 0").select("path", "role", "term", "cnt", scoring.content_score(F.col("cnt"), cfg).alias("score"))
