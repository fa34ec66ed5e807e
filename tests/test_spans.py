"""Merging of spans dealt by ranges, against the plain definition and SQL."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from lodestone.operators import bounding
from lodestone.operators.spans import merge_sorted

LAST = lambda x: (x is None, x or 0)


def brute(rows):
    """rows of (group, s, e, weight); null s and e last, as in SQL."""
    out, group, far = [], None, None
    for g, s, e, w in sorted(set(rows), key=lambda r: (str(r[0]), *map(LAST, r[1:]))):
        if not out or g != group:
            far = None
        if not out or g != group or far is None or (s is not None and s > far + 1):
            out.append([g, s, e, w])
        else:
            out[-1][2] = max((x for x in (out[-1][2], e) if x is not None), default=None)
            out[-1][3] += w
        group, far = g, max((x for x in (far, e) if x is not None), default=None)
    return sorted(map(tuple, out), key=str)


def random_rows(seed, groups, n, wide):
    r = random.Random(seed)
    end = lambda s: s + r.randint(-3, 9) + (200 if r.random() < 0.01 else 0)
    rows = [(r.choice(groups), s, end(s), r.randint(1, 2)) for s in (r.randint(0, wide) for _ in range(n))]
    rows += [(g, s, e, 1) for g in groups[:2] for s, e in ((None, None), (5, None), (None, 7), (7, 7))]
    return rows + [(groups[-1], s, None, w) for s in (None, 1, 2) for w in (1, 2)] + rows[:20]


@pytest.mark.parametrize("seed", range(30))
def test_one_pass_equals_brute_force(seed):
    rows = random_rows(seed, [None, 1, 2, 3, 99], 150, random.Random(seed).choice([30, 400, 4000]))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(LAST, r[1:])))
    step = random.Random(seed).choice([1, 2, 7, 50, 1000])
    schema = pa.schema([("_p", pa.int32()), ("g", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("weight", pa.int64())])
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip(schema.names, (0, *r))) for r in part], schema)
    got = [tuple(r[c] for c in ("g", "s", "e", "weight")) for b in merge_sorted([batch(ordered[i : i + step]) for i in range(0, len(ordered), step)], ["g"]) for r in b.to_pylist()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("seed,size,wide", [(1, 5, 40), (2, 20, 300), (3, 60, 5000), (4, 400, 1000)])
def test_ranges_change_nothing(spark, monkeypatch, seed, size, wide):
    """Groups and spans that run over many ranges, giants that cover whole ranges, nulls, ends before starts."""
    rows = random_rows(seed, ["a", "a", "a", None, "b", "c", "d"], 400, wide) + [("e", 3, 10**6, 1), ("e", 10**6 + 2, 10**6 + 3, 1)] + [("e", i, i, 2) for i in range(0, 1000, 5)]
    monkeypatch.setattr(bounding, "SPAN_ROWS", size)
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, g string, s int, e int, weight int").repartition(3)
    out = bounding.merge_spans(df, ["k", "g"], rows=len(rows))
    assert dict(out.dtypes) == {"k": "int", "g": "string", "s": "int", "e": "int", "weight": "bigint"}
    assert sorted([tuple(r)[1:] for r in out.collect()], key=str) == brute(rows)
    assert bounding.merge_spans(df.limit(0), ["g"]).collect() == []


def test_nulls_stand_last_as_in_sql(spark, tmp_path):
    """l_quantity or l_orderkey missing: the query against its SQL."""
    from lodestone.plans import queries as core

    rows = [(1, 5, None), (1, 5, 2.0), (1, None, 3.0), (1, 20, 1.0), (2, None, None), (2, 8, None), (2, 9, None), (None, 1, 1.0), (None, 2, 1.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = duckdb.sql(core.oracle_sql()["merge_spans"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, core.queries()["merge_spans"](spark, str(tmp_path)).select("g", "s", "e", "weight").collect()), key=str) == sorted(want, key=str)


def test_one_large_group_is_dealt_over_many_tasks(spark, monkeypatch):
    held = []
    monkeypatch.setattr(bounding, "SPAN_ROWS", 1000)
    df = spark.range(40_000).selectExpr("1 as g", "id * 3 as s", "id * 3 as e", "1 as weight")
    out = bounding.merge_spans(df, ["g"], rows=40_000, hold=lambda d: held.append(d.persist()) or held[-1])
    assert out.count() == 40_000 and out.agg({"weight": "sum"}).first()[0] == 40_000
    sizes = [r["count"] for r in DataFrame.groupBy(held[0], "_p").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 3000
