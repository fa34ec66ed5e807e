import hashlib

from pyspark.sql import functions as F

from lodestone.llm import mixing as mx

from .cases import empty, frame


def brute_rake(cells, goals, sweeps):
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}
    for _ in range(sweeps):
        for i in range(3):
            sums = {}
            for c, x in w.items():
                sums[c[i]] = sums.get(c[i], 0) + x
            w = {c: x * goals[i].get(c[i], 0) / sums[c[i]] if sums[c[i]] else 0 for c, x in w.items()}
    return w


def test_raking_and_calibration(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mx.mix(docs).collect()
    cells = {}
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        cells[c] = cells.get(c, 0) + r["n_tokens"]
        assert r["n_tokens"] == len((r["text"] or "").encode().split())
    goals = []
    for i, d in enumerate(mx.DIMENSIONS):
        have = {}
        for c, t in cells.items():
            have[c[i]] = have.get(c[i], 0) + t
        raw = {v: t ** mx.TARGETS[d] for v, t in have.items() if t}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    want = brute_rake(cells, goals, mx.SWEEPS)
    by_cell = {(r["source"], r["lang"], r["topic"]): r for r in rows}
    for c, r in by_cell.items():
        assert abs(r["weight"] - want[c]) < 1e-9
    for i in (2,):  # the last dimension raked is exact
        for v, g in goals[i].items():
            assert abs(sum(r["weight"] for c, r in by_cell.items() if c[i] == v) - g) < 1e-9
    expected = sum(by_cell[c]["keep_prob"] * t for c, t in cells.items())
    assert abs(expected / sum(cells.values()) - mx.BUDGET) < 1e-9
    for r in rows:
        u = int(hashlib.md5(f"{mx.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r["sampled"] == (u < r["keep_prob"])


def test_explicit_targets(spark):
    rows = [(i, "w " * 10, "a" if i % 4 else "b", "x" if i % 3 else "y") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    share = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("absent", 5.0)], "value string, share double")
    got = mx.mix(docs, {"source": share, "lang": 1.0, "topic": 1.0}).groupBy("source").agg(F.max("weight").alias("w"), F.sum(F.lit(0)))
    sums = {r["source"]: r["s"] for r in mx.mix(docs, {"source": share, "lang": 1.0, "topic": 1.0}).select("source", "lang", "weight").distinct().groupBy("source").agg(F.sum("weight").alias("s")).collect()}
    assert abs(sums["b"] - 0.75) < 1e-9 and abs(sums["a"] - 0.25) < 1e-9
    assert got.count() == 2


def test_edges(spark):
    got = mx.mix(frame(spark)).collect()
    assert len(got) == 11 and {r["source"] for r in got} == {None}
    assert all(r["keep_prob"] is not None for r in got)
    assert mx.mix(empty(spark)).count() == 0
    blank = frame(spark, [(1, None), (2, "")])
    assert [r["sampled"] for r in mx.mix(blank).collect()] == [True, True]
