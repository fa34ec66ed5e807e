import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import exact_dedup as ed
from lodestone.llm.hashing import rice_decode, rice_encode

from .cases import empty, frame


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, (1 << 50) - 1), max_size=200), st.sampled_from([50, 56, 62]))
def test_rice_round_trip(values, bits):
    v = np.array(sorted(values), np.uint64)
    assert (rice_decode(rice_encode(v, bits), len(v)) == v).all()


def brute(rows):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(low(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        at = ids.index(keep)
        out += [(i, keep, len(ids), k == at, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def same(df, got):
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_documents(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"), ed.op6_golomb_exchange(spark, sf))


def test_edges(spark):
    same(frame(spark), ed.dedup_exact(frame(spark)))
    assert ed.dedup_exact(empty(spark)).count() == 0


def test_narrow_fingerprints_only_add_suspects(spark, sf, monkeypatch):
    monkeypatch.setattr(ed, "MARGIN", 0)
    same(spark.read.parquet(f"{sf}/documents.parquet"), ed.op6_golomb_exchange(spark, sf))


def test_shuffled_join_where_ids_are_too_many(spark, sf, monkeypatch):
    monkeypatch.setattr(ed, "fits_broadcast", lambda *a: False)
    same(spark.read.parquet(f"{sf}/documents.parquet"), ed.op6_golomb_exchange(spark, sf))
