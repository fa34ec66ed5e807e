"""Token counts of flat token files by a separator scan.

A token file is a plain run of fixed-width little-endian ids; each document ends with the
end-of-document id and nothing indexes it. Files are cut into blocks of equal size that are searched
independently (vectorised comparison); a block keeps only the places of its separators. Documents
that cross blocks are stitched by a prefix scan over the blocks: the running number of separators
gives ordinals, the last separator before a block gives the start of its first document. The scan
has two levels (inside runs of RUN blocks, then over runs), so no task sees all blocks of a file.

Edge cases: adjacent separators are documents of no tokens; tokens after the last separator are an
unterminated document; an empty file has no documents; a file whose size is no multiple of the id
width is an error. write_tokens: null and empty texts are documents of no tokens; repeated rows and
null ids are kept; an empty table writes no file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialise, new_path, partitions, slices, spread_documents

BLOCK = 1 << 20
RUN = 1024
WIDTH = {"uint16": 2, "uint32": 4}


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def write_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, eod: int, dtype: str, folder: str) -> DataFrame:
    """Encode docs(doc_id, text) into one flat file per task under `folder` (a shared URI) and return
    (file, ordinal, doc_id). A retried task writes into another folder; only files named in the returned,
    materialised rows count. A file is named by its partition, so names repeat from run to run."""
    vocabulary = bpe.read_ranks(vocabulary_path)
    if max(len(vocabulary) - 1, eod) >= 1 << (8 * WIDTH[dtype]) or eod < len(vocabulary):
        raise ValueError("the ids do not fit, or the separator is a token")
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, bpe.serialise_model(vocabulary)))

    def run(batches):
        context = TaskContext.get()
        codec, out, ordinal = None, None, 0
        end = np.array([eod], dtype).tobytes()
        try:
            for batch in batches:
                for part in slices(batch, 1, 256):
                    if out is None:
                        pieces, model = shared.value
                        codec = bpe.Codec(pieces, pattern, model)
                        filesystem, root = _filesystem(folder)
                        name = f"{context.taskAttemptId()}/{context.partitionId():06d}.tokens"
                        filesystem.create_dir(f"{root}/{context.taskAttemptId()}", recursive=True)
                        out = filesystem.open_output_stream(f"{root}/{name}")
                    for text in part.column(1).to_pylist():
                        out.write(np.frombuffer(codec.encode_packed(text or ""), np.uint32).astype(dtype).tobytes() + end)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{folder}/{name}"] * n), pa.array(np.arange(ordinal, ordinal + n)), part.column(0).cast(pa.int64())], ["file", "ordinal", "doc_id"]
                    )
                    ordinal += n
        finally:
            if out is not None:
                out.close()

    return docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long")


def _sizes(files: DataFrame, dtype: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = []
            for name in names:
                filesystem, path = _filesystem(name)
                size = filesystem.get_file_info(path).size
                if size is None or size % WIDTH[dtype]:
                    raise ValueError(f"{name}: no token file of {dtype}")
                sizes.append(size // WIDTH[dtype])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["file", "size"])

    return files.select("file").distinct().mapInArrow(run, "file string, size long")


def search_blocks(files: DataFrame, eod: int, dtype: str, block: int) -> DataFrame:
    """files(file, size in tokens) -> (file, block, places): the separators' places in the file."""
    spark = files.sparkSession
    blocks = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))

    def run(batches):
        width, opened = WIDTH[dtype], (None, None)
        for batch in batches:
            for name, size, number in zip(*(c.to_pylist() for c in batch.columns)):
                if opened[0] != name:
                    if opened[1] is not None:
                        opened[1].close()
                    filesystem, path = _filesystem(name)
                    opened = (name, filesystem.open_input_file(path))
                start = number * block
                data = opened[1].read_at(min(block, size - start) * width, start * width)
                places = np.flatnonzero(np.frombuffer(data, dtype) == eod) + start
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([places], pa.list_(pa.int64()))], ["file", "block", "places"])
        if opened[1] is not None:
            opened[1].close()

    return blocks.repartition(partitions(spark), "file", "block").mapInArrow(run, "file string, block long, places array<long>")


def prefix_scan(found: DataFrame, run: int = RUN) -> DataFrame:
    """(file, block, before, last): separators before the block, and the place of the last of them."""
    parts = found.select("file", "block", F.floor(F.col("block") / run).alias("run"), F.size("places").cast("long").alias("n"), F.when(F.size("places") > 0, F.element_at("places", -1)).alias("end"))
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("end").alias("end"))
    runs = runs.select("file", "run", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("n0"), F.max("end").over(outer).alias("end0"))
    inside = parts.select("file", "run", "block", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("n1"), F.max("end").over(inner).alias("end1"))
    return inside.join(runs, ["file", "run"]).select("file", "block", (F.col("n0") + F.col("n1")).alias("before"), F.coalesce(F.greatest("end0", "end1"), F.lit(-1).cast("long")).alias("last"))


def count_tokens(files: DataFrame, eod: int, dtype: str = "uint16", block: int = BLOCK, run: int = RUN) -> DataFrame:
    """files(file) -> one row per document: file, ordinal, start, n_tokens, terminated."""
    sized, _ = materialise(_sizes(files, dtype), "sizes")
    found, _ = materialise(search_blocks(sized, eod, dtype, block), "separators")
    stitched = found.join(prefix_scan(found, run), ["file", "block"])
    rows = F.transform(
        "places",
        lambda x, i: F.struct((F.col("before") + i).alias("ordinal"), (F.when(i == 0, F.col("last")).otherwise(F.element_at("places", F.greatest(i, F.lit(1)))) + 1).alias("start"), x.alias("end")),
    )
    done = stitched.select("file", F.explode(rows).alias("d")).select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    ends = found.groupBy("file").agg(F.sum(F.size("places")).alias("ordinal"), F.max(F.when(F.size("places") > 0, F.element_at("places", -1))).alias("end"))
    start = F.coalesce(F.col("end"), F.lit(-1).cast("long")) + 1
    rest = sized.join(ends, "file").filter(F.col("size") > start).select("file", "ordinal", start.alias("start"), (F.col("size") - start).alias("n_tokens"), F.lit(False).alias("terminated"))
    return done.union(rest)


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: texts are written as flat token files, then counted by the scan."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = write_tokens(spread_documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN, 50256, "uint16", new_path(spark, "tokens"))
    manifest, _ = materialise(rows, "manifest")
    counted = count_tokens(manifest.select("file"), 50256)
    return manifest.join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens", F.element_at(F.split("file", "/"), -1).alias("file"), "ordinal", "start", "terminated")
