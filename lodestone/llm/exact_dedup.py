"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each input partition (a unit) sends its sorted distinct fingerprints, range-split by owner and
Rice-coded; an owner answers with a bitmap of those that another unit also sent; the unit adds the
fingerprints it holds twice itself. Only the suspects' texts are then shuffled and compared byte by
byte. Texts are equal when they are identical after lower-casing A-Z.

A hot text costs one fingerprint per unit; its copies collapse map-side before the byte comparison.
Edge cases: null text counts as empty, and empty texts are equal to each other; of equal texts the
row with the largest doc_id stays (null is least); of rows with equal doc_id and text the one read
first in the lowest partition stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fits_broadcast, materialise
from .hashing import U, rice_decode, rice_encode

#: Fingerprint bits beyond log2 of the number of rows: 2**-MARGIN of the rows are false suspects.
MARGIN = 16
#: A unit is at most 2**UNIT_BITS rows of one input partition.
UNIT_BITS = 20
#: Rows whose fingerprints an owner judges at once, about; sets the number of owners.
OWNER_ROWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text="text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def send(rows: DataFrame, bits: int, owners: int) -> DataFrame:
    """rows(unit, fp) -> (owner, unit, n, code): each unit's sorted distinct fingerprints per owner."""
    width = (1 << bits) // owners + 1

    def coded(unit, held):
        own = np.unique(np.concatenate(held))
        cuts = np.searchsorted(own, np.arange(owners + 1, dtype=U) * U(width))
        rows = [(o, unit, b - a, rice_encode(own[a:b] - U(o * width), bits)) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["owner", "unit", "n", "code"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            unit = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U) >> U(64 - bits)
            for part in np.split(np.arange(len(unit)), np.flatnonzero(np.diff(unit)) + 1):
                if not len(part):
                    continue
                if held and unit[part[0]] != now:
                    yield coded(now, held)
                    held = []
                now = int(unit[part[0]])
                held.append(fp[part])
        if held:
            yield coded(now, held)

    return rows.mapInArrow(run, "owner int, unit long, n int, code binary")


def answer(sent: DataFrame, bits: int) -> DataFrame:
    """Owners: (unit, owner, n, code, twice): the bitmap marks the fingerprints of the slice that
    two units sent."""

    def run(key, table):
        table = table.combine_chunks()
        units, sizes, codes = (table[c].to_pylist() for c in ("unit", "n", "code"))
        slices = [rice_decode(c, n) for c, n in zip(codes, sizes)]
        values, counts = np.unique(np.concatenate(slices), return_counts=True)
        maps = [np.packbits(counts[np.searchsorted(values, s)] > 1).tobytes() for s in slices]
        return pa.table({"unit": pa.array(units, pa.int64()), "owner": table["owner"], "n": table["n"], "code": table["code"], "twice": pa.array(maps, pa.binary())})

    return sent.groupBy("owner").applyInArrow(run, "unit long, owner int, n int, code binary, twice binary")


def suspects(rows: DataFrame, replies: DataFrame, bits: int, owners: int) -> DataFrame:
    """rows(unit, row, fp) that share their fingerprint with another row, judged unit by unit."""
    width = (1 << bits) // owners + 1

    def run(key, left, right):
        row, fp = left["row"].to_numpy(), left["fp"].to_numpy().view(U) >> U(64 - bits)
        found = [np.zeros(0, U)]
        for owner, n, code, twice in zip(*(right[c].to_pylist() for c in ("owner", "n", "code", "twice"))):
            found.append(rice_decode(code, n)[np.unpackbits(np.frombuffer(twice, np.uint8))[:n] > 0] + U(owner * width))
        _, at, counts = np.unique(fp, return_inverse=True, return_counts=True)
        hit = (counts[at] > 1) | np.isin(fp, np.concatenate(found))
        return pa.table({"row": pa.array(row[hit], pa.int64())})

    return rows.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(run, "row long")


def dedup_exact(docs: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """One row per row of docs(doc_id, text): keep_id, group_size, kept and text_sha256."""
    norm = normalised()
    base = docs.select(F.col(row_id).cast("long").alias("doc_id"), norm.alias("norm"))
    # row: place in the scan, the only handle on repeated rows; fp and sha come with it from one pass
    keyed = base.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    keyed = keyed.withColumn("unit", F.shiftright("row", UNIT_BITS))
    keyed, _ = materialise(keyed, "keys")
    n_rows = keyed.count()
    owners = n_rows // OWNER_ROWS + 1
    bits = min(62, max(16, n_rows.bit_length() + MARGIN))
    replies = answer(send(keyed.select("unit", "fp"), bits, owners), bits)
    rows, _ = materialise(suspects(keyed.select("unit", "row", "fp"), replies, bits, owners), "suspects")
    doubtful = keyed.join(rows, "row", "left_semi")
    # per digest: the row that would stay, the largest doc_id and of equal ones the first row
    classes = doubtful.groupBy("fp", "sha").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("top"))
    classes, _ = materialise(classes, "suspect-classes")
    n = classes.count()
    # byte verification: suspects' texts only, copies collapsed before the shuffle
    ids = classes.select("fp").distinct()
    texts = base.withColumn("fp", F.xxhash64("norm")).join(F.broadcast(ids) if fits_broadcast(n, 32) else ids.hint("merge"), "fp", "left_semi")
    groups = texts.groupBy("fp", "norm").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    groups, _ = materialise(groups.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size"), "groups")
    if not groups.groupBy("fp", "sha").count().filter("count > 1").isEmpty():
        raise ArithmeticError("different texts share xxHash64 and SHA-256")
    # written first: the last join is then one of two plain shuffles, which Spark splits at a hot class
    facts, _ = materialise(groups.join(classes, ["fp", "sha"]), "facts")
    out = keyed.join(facts, ["fp", "sha"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == -F.col("top.back"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(documents(spark, sf_dir))


OP6_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
  from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""
