"""Document fingerprints: a canonical exact digest.

Canonical form: Unicode NFKC, case folding, white space runs folded to one space, ends trimmed.
Digest: xxh3 of 128 bits over its UTF-8 bytes. Digests that occur more than once are verified by
comparing the canonical bytes inside the bucket; where bytes differ, the fingerprint gets the
number of its class within the bucket, so equal fingerprints mean equal canonical texts. The
likeness of two exact fingerprints is 1 when they are equal, else 0.

Edge cases: null text is empty; texts without visible characters are all equal; rows of equal
doc_id are ordered by text; a null doc_id sorts after all others; an empty table gives no rows.
The next document is found by bucketing on doc_id (bounded quantiles), one shuffle of the texts,
and a copy of each bucket's first row in the bucket before it.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fits_broadcast, materialise, partitions, slices

LAST = (1 << 63) - 1


def canonical(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


def digest(canon: str, bits: int = 128) -> str:
    import xxhash

    whole = xxhash.xxh3_128_intdigest(canon.encode("utf-8", "surrogatepass"))
    return f"{whole >> (128 - bits):0{bits // 4}x}"


def edit(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


SCHEMA = "doc_id long, next_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, changed boolean"


def _bounds(rows: DataFrame, n: int) -> list[int]:
    """At most n - 1 ascending bounds that split doc_id evenly, from a quantile sketch."""
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def _bucket(doc_id, bounds: list[int]):
    """How many bounds lie below doc_id, by bisection; nulls go last."""
    if not bounds:
        return F.lit(0)
    array = F.lit(bounds).cast("array<long>")

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.element_at(array, F.least(mid, F.lit(len(bounds) - 1)) + 1) < doc_id
        narrowed = F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).otherwise(narrowed)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda s: s["lo"])
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(found)


def with_next(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Rows of SCHEMA, one per document: its digest and those of its edited and the next text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = F.coalesce("doc_id", F.lit(LAST))
    keyed = rows.withColumn("bucket", _bucket(F.col("doc_id"), _bounds(rows, 4 * partitions(spark))))
    firsts = keyed.groupBy("bucket").agg(F.min(order).alias("first")).orderBy("bucket").collect()  # a row per bucket
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    heads = [(r["bucket"], r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]  # the first wraps to the last
    heads = F.broadcast(spark.createDataFrame(heads, "bucket int, first long, prior int"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail"))
    ahead = F.struct(F.col("prior").alias("bucket"), F.lit(1).alias("tail"))
    dealt = (
        keyed.join(heads, "bucket")
        .withColumn("to", F.explode(F.when(order == F.col("first"), F.array(own, ahead)).otherwise(F.array(own))))
        .select("to.bucket", "to.tail", "doc_id", "text")
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "text")
    )
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string()] * 4 + [pa.bool_()]

    def pair(held, now):
        _, doc_id, text, mine, canon = held
        edited = edit(text, now[2])
        second = canon if edited == text else canonical(edited)
        other = mine if second == canon else digest(second, bits)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, now[1], len(text), sha, mine, other, now[3], second != canon

    def run(batches):
        held = used = None  # the row that waits for its successor; the bucket whose tail has come
        for batch in batches:
            for part in slices(batch, 3):
                part, out = part.to_pydict(), []
                for bucket, tail, doc_id, text in zip(part["bucket"], part["tail"], part["doc_id"], part["text"], strict=True):
                    if tail and used == bucket:
                        continue  # further rows of the same first id
                    canon = canonical(text)
                    now = (bucket, doc_id, text or "", digest(canon, bits), canon)
                    if held is not None and held[0] == bucket:
                        out.append(pair(held, now))
                    held, used = (None, bucket) if tail else (now, used)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return dealt.mapInArrow(run, SCHEMA)


def classes_of_clashes(found: DataFrame, docs: DataFrame, bits: int = 128) -> DataFrame | None:
    """Byte comparison inside buckets of equal digests.

    Only texts whose digest occurs twice are read again (by a broadcast of their ids where its
    size allows, else by a shuffled join), and equal texts collapse before the shuffle. Returns
    (doc_id, side, class) of the rows in buckets that hold different canonical texts, class 0 being
    the least text; None when no digest occurs twice.
    """
    mine = found.select(F.col("fingerprint").alias("f"), "doc_id", F.lit(None).cast("long").alias("next_id"), F.lit(0).alias("side"))
    edits = found.filter("changed").select("edited_fingerprint", "doc_id", "next_id", F.lit(1))
    sides = mine.union(edits)
    suspects = sides.join(sides.groupBy("f").count().filter("count > 1"), "f", "left_semi")
    wanted = suspects.select("doc_id").union(suspects.filter("side = 1").select("next_id")).filter("doc_id is not null").distinct().checkpoint()
    n = wanted.count()
    if n == 0:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(wanted) if fits_broadcast(n, 32) else wanted.hint("merge"), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 256):
                canon = [canonical(t if u is None else edit(t, u)) for t, u in zip(part["text"].to_pylist(), part["following"].to_pylist(), strict=True)]
                f = pa.array([digest(c, bits) for c in canon], pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["side"], f, pa.array(canon, pa.string())], ["doc_id", "side", "f", "canon"])

    pairs = suspects.filter("side = 1").select("doc_id", "next_id").distinct()
    edited = texts.join(pairs, "doc_id").join(texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("following")), "next_id")
    both = texts.select("doc_id", F.lit(0).alias("side"), "text", F.lit(None).cast("string").alias("following")).union(edited.select("doc_id", F.lit(1), "text", "following"))
    both = both.mapInArrow(run, "doc_id long, side int, f string, canon string")
    classes = both.groupBy("f", "canon").agg(F.count("*").alias("n"))
    clashes = classes.join(classes.groupBy("f").count().filter("count > 1"), "f", "left_semi")
    ranked = clashes.select("f", "canon", (F.row_number().over(Window.partitionBy("f").orderBy("canon")) - 1).alias("class"))
    ranked = ranked.checkpoint()
    if ranked.isEmpty():
        return None
    return both.join(ranked, ["f", "canon"]).select("doc_id", "side", "class").distinct()


def fingerprint_documents(docs: DataFrame, bits: int = 128) -> DataFrame:
    """The digest query: fingerprints of each text and of its edited text, verified, with likeness.

    Documents are told apart by doc_id; of a repeated doc_id with different texts inside one
    clashing bucket the least class is taken.
    """
    found, _ = materialise(with_next(docs, bits), "fingerprints")
    clashes = classes_of_clashes(found, docs, bits)
    if clashes is not None:
        by_side = lambda side, key, name: clashes.filter(F.col("side") == side).groupBy(F.col("doc_id").alias(key)).agg(F.min("class").alias(name))
        tag = lambda f, c: F.when(F.col(c) > 0, F.concat(F.col(f), F.lit("-"), F.col(c).cast("string"))).otherwise(F.col(f))
        found = (
            found.join(by_side(0, "doc_id", "c0"), "doc_id", "left")
            .join(by_side(1, "doc_id", "c1"), "doc_id", "left")
            .join(by_side(0, "next_id", "c2"), "next_id", "left")
            .withColumn("fingerprint", tag("fingerprint", "c0"))
            .withColumn("edited_fingerprint", F.when(F.col("changed"), tag("edited_fingerprint", "c1")).otherwise(F.col("fingerprint")))
            .withColumn("next_fingerprint", tag("next_fingerprint", "c2"))
        )
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next")
    )


def op7_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
