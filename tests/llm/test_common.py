import random

import pyarrow as pa
import pytest

from lodestone.llm import common


def brute(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    label = {}
    for i in sorted(near):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = i
                stack += near[x]
    return label


def graphs():
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(1000)]
    star = [(0 if i % 2 else 5000, i) for i in range(1, 1200)]
    several = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    circle = [(i, (i + 1) % 600) for i in range(600)] + [(3, 3)]
    return {"path": path, "star": star, "random": several, "circle": circle}


@pytest.mark.parametrize("name", ["path", "star", "random", "circle"])
def test_components(spark, monkeypatch, name):
    edges = graphs()[name]
    want = brute([e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    rounds = []
    real = common.materialise
    monkeypatch.setattr(common, "materialise", lambda d, n, *a: (rounds.append(n), real(d, n, *a))[1])
    assert {r["node"]: r["label"] for r in common.components(df, local_edges=30).collect()} == want
    assert 1 <= rounds.count("edges") - 1 <= 12  # logarithmic
    rounds.clear()
    assert {r["node"]: r["label"] for r in common.components(df).collect()} == want
    assert rounds.count("edges") == 1


def test_components_without_edges(spark):
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert common.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_slices():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c" * 3, "d" * 3, "e" * 3])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [p.column(0).to_pylist() for p in common.slices(batch, 0, rows=3, size=12)]
    assert [x for p in parts for x in p] == texts.to_pylist()
    assert all(len(p) == 1 or (len(p) <= 3 and sum(len(x or "") for x in p) <= 12) for p in parts)
    assert list(common.slices(batch.slice(0, 0), 0)) == []


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session())
