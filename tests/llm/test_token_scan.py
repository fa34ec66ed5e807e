import numpy as np
import public_tokenizers as P
import pytest

from lodestone.llm import bpe
from lodestone.llm import token_scan as ts

from .cases import empty, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def brute(ids, eod):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == eod:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("dtype", ["uint16", "uint32"])
@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_files_equal_brute_force(spark, tmp_path, dtype, block):
    rng = np.random.default_rng(block)
    files = {}
    for name, ids in {"a": rng.integers(0, 9, 500), "none": np.zeros(0), "only": np.full(5, 7), "without": np.zeros(300), "tail": np.r_[np.zeros(200), 7, np.zeros(90)], "end": np.r_[np.zeros(130), 7]}.items():
        path = f"file://{tmp_path}/{name}"
        ids.astype(dtype).tofile(f"{tmp_path}/{name}")
        files[path] = brute(ids.tolist(), 7)
    got = ts.count_tokens(spark.createDataFrame([(f,) for f in files], "file string"), 7, dtype, block, run=4).collect()
    want = sorted((f, *x) for f, rows in files.items() for x in rows)
    assert sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in got) == want


def test_a_cut_file_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="no token file"):
        ts.count_tokens(spark.createDataFrame([(f"file://{tmp_path}/x",)], "file string"), 7).collect()


def test_documents(spark, sf):
    codec = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in ts.op3_separator_scan(spark, sf).collect()}
    assert got == {r["doc_id"]: len(codec.encode(r["text"] or "")) for r in docs}


def test_edges(spark, tmp_path):
    rows = ts.write_tokens(frame(spark), PATH, P.PATTERN, 50256, "uint16", f"file://{tmp_path}/t")
    rows, _ = ts.materialise(rows, "manifest")
    got = rows.join(ts.count_tokens(rows.select("file"), 50256), ["file", "ordinal"], "left").collect()
    codec = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    want = sorted(((r["doc_id"], len(codec.encode(r["text"] or ""))) for r in frame(spark).collect()), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == want
    rows, _ = ts.materialise(ts.write_tokens(empty(spark), PATH, P.PATTERN, 50256, "uint16", f"file://{tmp_path}/e"), "manifest")
    assert ts.count_tokens(rows.select("file"), 50256).count() == 0
