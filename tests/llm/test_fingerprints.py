import hashlib

from lodestone.llm import fingerprints as fp

from .cases import empty, frame

ORDER = lambda r: (r[0] is None, r[0] or 0, r[1] or "")


def brute(rows):
    rows = sorted(rows, key=ORDER)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        t, u = text or "", rows[(i + 1) % len(rows)][1] or ""
        e = fp.edit(t, u)
        c = [fp.canonical(x) for x in (t, e, u)]
        out.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), float(c[0] == c[1]), float(c[0] == c[2])))
    return sorted(out, key=str)


def same(df, got):
    got = got.collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    canon = {(r["doc_id"], r["text"] or ""): fp.canonical(r["text"]) for r in df.collect()}
    by_id = {}
    for (doc_id, _), c in canon.items():
        by_id.setdefault(doc_id, c)
    prints = {}
    for r in got:
        assert prints.setdefault(by_id[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_documents(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"), fp.op7_canonical_digest(spark, sf))


def test_edges(spark):
    same(frame(spark), fp.fingerprint_documents(frame(spark)))
    assert fp.fingerprint_documents(empty(spark)).count() == 0
    one = frame(spark, [(1, "alone in the table")])
    same(one, fp.fingerprint_documents(one))


def test_clashing_digests_are_told_apart_by_bytes(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    same(df, fp.fingerprint_documents(df, bits=4))


def test_equal_after_canonical_form():
    assert fp.digest(fp.canonical("Ａ  b\n")) == fp.digest(fp.canonical("a B"))
