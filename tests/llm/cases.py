"""Rows that every operator must bear: nulls, empties, long texts, ties, repeats, foreign columns."""

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today."),
    (3, None),
    (4, ""),
    (5, "   \t\n "),
    (6, LONG),
    (6, LONG),
    (7, "Été ça où ÀÉ ﬁne Ⅷ 日本語 \U0001f600 x"),
    (8, "a"),
    (9, "x" * 5000),
    (None, "a row without an id"),
]


def frame(spark, rows=ROWS):
    """documents with columns that clash with the operators' own names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "unit", "bucket", "fp", "norm", "f", "side", "score", "lang", "source", "owner", "n", "word", "token", "cell", "own", "of_id", "of_text", "_sha", "_own", "_found", "found", "made", "deviation", "sig", "trie"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(3)


def empty(spark):
    return frame(spark, [])
