import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe

from .cases import empty, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = bpe.read_ranks(PATH)
PEER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(VOCABULARY)}, special_tokens={})
CODEC = bpe.Codec(VOCABULARY, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_codec_equals_peer_and_round_trips(text):
    assert CODEC.encode(text) == PEER.encode_ordinary(text)
    assert CODEC.decode_packed(CODEC.encode_packed(text)) == text.encode()


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec = bpe.Codec(VOCABULARY, P.PATTERN)
    for text in ("one two three four five six", "one two", "seven eight"):
        assert codec.encode(text) == PEER.encode_ordinary(text)
        assert len(codec.cache) <= 6


def check(df, got):
    want = []
    for r in df.collect():
        ids = PEER.encode_ordinary(r["text"] or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), bpe.op5_bpe_codec(spark, sf))


def test_edges(spark):
    df = frame(spark)
    check(df, bpe.encode_documents(df, PATH, P.PATTERN))
    assert bpe.encode_documents(empty(spark), PATH, P.PATTERN).count() == 0
    row = bpe.encode_documents(df.filter("doc_id = 7"), PATH, P.PATTERN, with_ids=True).first()
    assert PEER.decode(row["ids"]) == bytes(row["decoded"]).decode()
