"""Substring deduplication by level-wise doubling of repeated windows.

A window is a run of consecutive words of one document. Only windows that repeat at one length are
extended towards twice that length: a window of 2n words can repeat only where both its halves do.
Levels go START, 2 * START, ... up to the wanted length (the last step overlaps its halves), or, in
`longest_repeats`, until no candidate survives.

Documents are packed once into units of about UNIT_BYTES (one row each, compressed, in the shared
folder). At a level every unit sends the sorted distinct fingerprints of its candidate windows,
range-split over owners and Rice-coded; an owner answers each slice with a bitmap. A passage that
many documents share therefore costs one fingerprint per unit, and no row per window or per pair is
ever shuffled. Units without candidates drop out; of the others only documents with candidates are
carried on. The filter levels use short fingerprints (false matches only cost work); the last level
compares 128-bit hashes of the words and the least doc_id of each window.

Edge cases: null text has no words; a document shorter than a window keeps all its words; windows
repeated inside one document only are kept; rows of equal doc_id do not remove each other's windows;
a null doc_id counts as larger than all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, materialise
from .hashing import U, distinct, double, find_words, hash_words, rice_decode, rice_encode, text_buffer

LENGTH = 13
START = 7
UNIT_BYTES = 4 << 20
#: Windows an owner judges at once, about; sets the number of owners.
OWNER_WINDOWS = 2_000_000
#: Bits of a filter fingerprint beyond log2 of the number of windows.
MARGIN = 10
LAST = np.iinfo(np.int64).max

UNIT = "unit long, n_docs int, n_words long, ids binary, at binary, sizes binary, texts binary, alive binary"


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def pack_units(docs: DataFrame, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """docs(doc_id, text) -> units: UNIT and per document its word count and digest (`counts`, `shas`).
    A null id is stored as the largest integer with its place in `nulls`."""
    schema = UNIT + ", counts binary, shas binary, nulls binary"

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        part, seq = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def unit():
            buf = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.array([len(t) for t in texts], np.int64)
            counts, shas = [], []
            for t in texts:
                words = t.split()  # bytes: splits on 0x20 and 0x09-0x0D alone
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
            null = np.array([i is None for i in ids])
            row = {
                "unit": part << 32 | seq, "n_docs": len(ids), "n_words": sum(counts), "ids": _pack(np.array([LAST if i is None else i for i in ids], np.int64)), "at": _pack(np.arange(len(ids), dtype=np.int32)), "sizes": _pack(sizes), "texts": press.compress(buf.tobytes()), "alive": None,
                "counts": _pack(np.array(counts, np.int64)), "shas": b"".join(shas), "nulls": np.packbits(null).tobytes(),
            }
            return _batch([row], schema)

        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids.append(doc_id)
                texts.append(buf[offsets[k] : offsets[k + 1]].tobytes())
                size += len(texts[-1])
                if size >= unit_bytes:
                    yield unit()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield unit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_KIND = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KIND[k]) for n, k in fields], [n for n, _ in fields])


class Unit:
    """A decoded unit: its documents, words and candidate windows of `length` words."""

    def __init__(self, row: dict, levels: list[int], seeds=(11,)):
        import zstandard

        self.id = row["unit"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.at = np.frombuffer(row["at"], np.int32)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]) if sizes.sum() else b"", np.uint8)
        self.starts, self.ends = find_words(self.buf, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)  # of each document's words
        n = len(self.starts)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.length = length = levels[-1]
        m = max(0, n - length + 1)
        candidate = doc[:m] == doc[length - 1 :] if m else np.zeros(0, bool)
        if row["alive"] is not None:
            before = np.unpackbits(np.frombuffer(row["alive"], np.uint8))[: max(0, n - levels[-2] + 1)].astype(bool)
            candidate &= before[:m] & before[length - levels[-2] :][:m]
        self.places = np.flatnonzero(candidate)
        self.doc = doc[self.places] if m else np.zeros(0, np.int64)
        self.hashes = []
        if len(self.places):
            step = np.zeros(n + 1, np.int32)  # words inside a candidate window
            step[self.places] += 1  # places are distinct
            step[self.places + length] -= 1
            inside = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            for seed in seeds:
                h, size = np.zeros(n, U), 1
                h[inside] = self._hash(inside, seed)
                for level in levels:
                    while size < level:
                        to = min(2 * size, level)
                        h, size = double(h, size, to), to
                self.hashes.append(h[self.places])
        else:
            self.hashes = [np.zeros(0, U) for _ in seeds]


    def _hash(self, inside: np.ndarray, seed: int) -> np.ndarray:
        """Hashes of some words; where they are few, their bytes are first brought together."""
        starts, ends = self.starts[inside], self.ends[inside]
        if 2 * len(inside) > len(self.starts):
            return hash_words(self.buf, starts, ends, seed)
        size = ends - starts
        moved = np.cumsum(size) - size
        bytes_ = self.buf[np.repeat(starts - moved, size) + np.arange(int(size.sum()))]
        return hash_words(bytes_, moved, moved + size, seed)


def _slices(values: np.ndarray, bits: int, owners: int):
    """(owner, from, to, base) of the ranges of ascending values; owners split 2**bits evenly."""
    width = (1 << bits) // owners + 1
    cuts = np.searchsorted(values, np.array([o * width for o in range(owners)] + [(1 << bits) - 1], U), side="left")
    cuts[-1] = len(values)
    return [(o, int(a), int(b), U(o * width)) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _groups(keys: list[np.ndarray]):
    """(order, start of each group in that order, group of each element) for equal key tuples."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    starts = np.flatnonzero(new)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, starts, group


def _filter_send(units: DataFrame, levels: list[int], bits: int, owners: int) -> DataFrame:
    schema = "owner int, unit long, n int, code binary"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, levels)
                own = distinct(unit.hashes[0] >> U(64 - bits))
                rows = [{"owner": o, "unit": unit.id, "n": b - a, "code": rice_encode(own[a:b] - base, bits)} for o, a, b, base in _slices(own, bits, owners)]
                if rows:
                    yield _batch(rows, schema)

    return units.mapInArrow(run, schema)


def _filter_answer(sent: DataFrame) -> DataFrame:
    """A bitmap for each slice: which of its fingerprints came from two units."""
    schema = "unit long, owner int, bits binary"

    def run(key, table):
        rows = table.select(["unit", "owner", "n", "code"]).to_pylist()
        slices = [rice_decode(r["code"], r["n"]) for r in rows]
        whole = np.sort(np.concatenate(slices))
        twice = distinct(whole[1:][whole[1:] == whole[:-1]])
        for r, s in zip(rows, slices):
            r["bits"] = np.packbits(_among(s, twice)).tobytes()
        return pa.Table.from_batches([_batch(rows, schema)])

    return sent.groupBy("owner").applyInArrow(run, schema)


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def _flags(slices, replies: dict, n: int) -> np.ndarray:
    flag = np.zeros(n, bool)
    for o, a, b, _ in slices:
        flag[a:b] = np.unpackbits(np.frombuffer(replies[o], np.uint8))[: b - a]
    return flag


def _survive(units: DataFrame, replies: DataFrame, levels: list[int], bits: int, owners: int) -> DataFrame:
    """Units cut down to the documents whose windows survive the level, with those windows in `alive`."""

    def run(key, left, right):
        import zstandard

        out = []
        answers = dict(zip(right["owner"].to_pylist(), right["bits"].to_pylist()))
        for row in left.to_pylist():
            unit = Unit(row, levels)
            fp = unit.hashes[0] >> U(64 - bits)
            if not len(fp):
                continue
            order, starts, group = _groups([fp])
            docs = unit.doc[order]
            several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
            own = fp[order][starts]
            live = (several | _flags(_slices(own, bits, owners), answers, len(own)))[group]
            if not live.any():
                continue
            places = unit.places[live]
            kept = np.unique(unit.doc[live])
            size = np.diff(unit.first)
            new_first = np.concatenate([[0], np.cumsum(size[kept])])
            moved = places - unit.first[unit.doc[live]] + new_first[np.searchsorted(kept, unit.doc[live])]
            total = int(new_first[-1])
            alive = np.zeros(max(0, total - unit.length + 1), np.uint8)
            alive[moved] = 1
            parts = [unit.buf[unit.offsets[d] : unit.offsets[d + 1]].tobytes() for d in kept]
            out.append({
                "unit": unit.id, "n_docs": len(kept), "n_words": len(places), "ids": _pack(unit.ids[kept]), "at": _pack(unit.at[kept]), "sizes": _pack(np.array([len(p) for p in parts], np.int64)), "texts": zstandard.ZstdCompressor(level=1).compress(b"".join(parts)), "alive": np.packbits(alive).tobytes(),
            })
        return pa.Table.from_batches([_batch(out, UNIT)])

    return units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(run, UNIT)


def _size(units: DataFrame) -> int:
    return units.agg(F.sum("n_words")).first()[0] or 0


def narrow(units: DataFrame, levels: list[int]) -> tuple[DataFrame, str]:
    """One filter level: units with the windows of levels[-1] words that some other document repeats."""
    total = _size(units)
    owners = max(1, -(-total // OWNER_WINDOWS))
    bits = min(62, max(20, total.bit_length() + MARGIN))
    columns = units.select(*[x.split()[0] for x in UNIT.split(", ")])
    replies = _filter_answer(_filter_send(columns, levels, bits, owners))
    return materialise(_survive(columns, replies, levels, bits, owners), f"repeats-{levels[-1]}")


def _exact_send(units: DataFrame, levels: list[int], owners: int) -> DataFrame:
    schema = "owner int, unit long, n int, code binary, rest binary, ids binary"

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, levels, (11, 12))
                if not len(unit.places):
                    continue
                order, starts, _ = _groups(unit.hashes)
                one, two = (h[order][starts] for h in unit.hashes)
                least = np.minimum.reduceat(unit.ids[unit.doc][order], starts)
                rows = [
                    {"owner": o, "unit": unit.id, "n": b - a, "code": rice_encode(one[a:b] - base, 64), "rest": _pack(two[a:b]), "ids": press.compress(_pack(least[a:b]))}
                    for o, a, b, base in _slices(one, 64, owners)
                ]
                yield _batch(rows, schema)

    return units.mapInArrow(run, schema)


def _exact_answer(sent: DataFrame) -> DataFrame:
    """A bitmap for each slice: whose windows are not the first, by least doc_id of all units."""
    schema = "unit long, owner int, bits binary"

    def run(key, table):
        import zstandard

        press = zstandard.ZstdDecompressor()
        rows = table.to_pylist()
        one = np.concatenate([rice_decode(r["code"], r["n"]) for r in rows])
        two = np.concatenate([np.frombuffer(r["rest"], U) for r in rows])
        ids = np.concatenate([np.frombuffer(press.decompress(r["ids"]), np.int64) for r in rows])
        order, starts, group = _groups([one, two])
        later = ids > np.minimum.reduceat(ids[order], starts)[group]
        at = 0
        for r in rows:
            r["bits"] = np.packbits(later[at : at + r["n"]]).tobytes()
            at += r["n"]
        return pa.Table.from_batches([_batch(rows, schema)])

    return sent.groupBy("owner").applyInArrow(run, schema)


def _remove(units: DataFrame, replies: DataFrame, levels: list[int], owners: int) -> DataFrame:
    """(unit, at, n_removed, sha, kept): documents that lose words, with the digest of what is left."""
    schema = "unit long, at int, n_removed long, sha binary, kept binary"

    def run(key, left, right):
        out = []
        answers = dict(zip(right["owner"].to_pylist(), right["bits"].to_pylist()))
        for row in left.to_pylist():
            unit = Unit(row, levels, (11, 12))
            if not len(unit.places):
                continue
            order, starts, group = _groups(unit.hashes)
            one = unit.hashes[0][order][starts]
            ids = unit.ids[unit.doc]
            later = _flags(_slices(one, 64, owners), answers, len(one))[group] | (ids > np.minimum.reduceat(ids[order], starts)[group])
            step = np.zeros(len(unit.starts) + 1, np.int32)
            step[unit.places[later]] += 1
            step[unit.places[later] + unit.length] -= 1
            gone = np.cumsum(step[:-1]) > 0
            for d in np.unique(unit.doc[later]):
                a, b = unit.first[d], unit.first[d + 1]
                keep = ~gone[a:b]
                words = unit.buf[unit.offsets[d] : unit.offsets[d + 1]].tobytes().split()
                text = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                out.append({"unit": unit.id, "at": int(unit.at[d]), "n_removed": int((~keep).sum()), "sha": hashlib.sha256(text).digest(), "kept": text})
        return pa.Table.from_batches([_batch(out, schema)])

    return units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(run, schema)


def levels_to(length: int, start: int = START) -> list[int]:
    levels = [min(start, length)]
    while levels[-1] < length:
        levels.append(min(2 * levels[-1], length))
    return levels


def remove_repeats(docs: DataFrame, length: int = LENGTH, start: int = START, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of `length` words that also starts in a document of
    smaller doc_id. One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and, with
    `with_text`, kept_text: null where nothing is removed)."""
    spark = docs.sparkSession
    base, _ = materialise(pack_units(docs), "units", codec="none")
    plain = base.select("unit", "n_docs", "ids", "counts", "shas", "nulls")
    levels = levels_to(length, start)
    units, used = base, None
    for i in range(1, len(levels)):
        units, new = narrow(units, levels[:i])
        if used:
            discard(spark, used)
        used = new
    owners = max(1, -(-_size(units) // OWNER_WINDOWS))
    units = units.select(*[x.split()[0] for x in UNIT.split(", ")])
    removed = _remove(units, _exact_answer(_exact_send(units, levels, owners)), levels, owners)
    removed = removed if with_text else removed.drop("kept")

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n_docs"]
                null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8))[:n].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["unit"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(r["ids"], np.int64), mask=null), pa.array(np.frombuffer(r["counts"], np.int64)), pa.array([r["shas"][32 * i : 32 * i + 32] for i in range(n)], pa.binary())],
                    ["unit", "at", "doc_id", "n_words", "whole"],
                )

    every = plain.mapInArrow(rows, "unit long, at int, doc_id long, n_words long, whole binary")
    out = every.join(removed, ["unit", "at"], "left")
    kept = [F.col("kept").cast("string").alias("kept_text")] if with_text else []
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("sha", "whole"))).alias("kept_sha256"), *kept)


def longest_repeats(docs: DataFrame, start: int = LENGTH) -> DataFrame:
    """(doc_id, length): for documents that share windows with another, the greatest of start,
    2 * start, 4 * start, ... words at which they still do (up to false matches of 2**-MARGIN)."""
    base, _ = materialise(pack_units(docs), "units", codec="none")
    units, levels, found = base, [start], None

    def ids(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], np.int64))], ["doc_id"])

    while True:
        units, _ = narrow(units, levels)
        if units.isEmpty():
            break
        rows = units.select("ids").mapInArrow(ids, "doc_id long").select("doc_id", F.lit(levels[-1]).alias("length"))
        found = rows if found is None else found.union(rows)
        levels = levels + [2 * levels[-1]]
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, length int")
    return found.groupBy("doc_id").agg(F.max("length").alias("length"))


def op4_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


OP4_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), g as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)
), m as (select s, min(doc_id) as least from g group by s),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from g join m using (s) where doc_id > least
), n as (select doc_id, count(*) as n_removed, list(p) as ps from gone group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(array_to_string(case when ps is null then ws else
         list_transform(list_filter(range(1, len(ws) + 1), lambda k: not list_contains(ps, k)), lambda k: ws[k]) end, ' ')) as kept_sha256
from w left join n using (doc_id)
"""
