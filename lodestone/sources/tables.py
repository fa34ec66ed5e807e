"""Reading tables for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than there are cores (a small file of one
    row group is one task, however many cores wait). A table of more partitions is left as it is, so
    nothing is shuffled at scale; a stream is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
