import hashlib
import random
import re

from lodestone.llm import substring_dedup as sd

from .cases import empty, frame


def brute(rows, length=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            s = tuple(w[p : p + length])
            least[s] = min(least.get(s, key(i)), key(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if least[tuple(w[p : p + length])] < key(i):
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def same(df, got, length=13):
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()], length)


def test_documents(spark, sf):
    same(spark.read.parquet(f"{sf}/documents.parquet"), sd.op4_level_doubling(spark, sf))


def test_random_texts_at_many_lengths_and_units(spark, monkeypatch):
    monkeypatch.setattr(sd, "OWNER_WINDOWS", 50)
    monkeypatch.setattr(sd.pack_units, "__defaults__", (300,))
    rng = random.Random(5)
    parts = [" ".join(rng.choice("ab é cde") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    rows = [(rng.randint(0, 30), rng.choice(["\n", " ", "\t "]).join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length, start in ((1, 1), (2, 1), (5, 7), (9, 2), (13, 7)):
        same(df, sd.remove_repeats(df, length, start), length)


def test_edges(spark):
    same(frame(spark), sd.remove_repeats(frame(spark)))
    assert sd.remove_repeats(empty(spark)).count() == 0
    assert sd.longest_repeats(empty(spark)).count() == 0


def test_kept_text_and_longest_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"start {passage} end"), (2, f"other {passage} tail here"), (3, "nothing in common")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in sd.remove_repeats(df, with_text=True).collect()}
    assert got == {1: None, 2: "other tail here", 3: None}
    assert {tuple(r) for r in sd.longest_repeats(df).collect()} == {(1, 52), (2, 52)}
