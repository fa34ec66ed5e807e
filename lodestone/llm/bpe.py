"""Byte-level BPE through a sentencepiece model serialised directly from the rank vocabulary.

Each byte becomes one private character (U+0100 + byte), each vocabulary entry one piece of such
characters scored by its negative rank, so that the sentencepiece merge order (highest score
first, leftmost on ties) is the rank order. Normalisation is the identity. Texts are split by the
tokenizer's pattern and each pre-token is encoded alone; decoding maps ids back to piece bytes.

Edge cases: null and empty texts encode to no ids and decode to no bytes; a lone pre-token of any
length is encoded whole; repeated rows and ids give repeated results; other columns are ignored.
Memory: the model (the vocabulary file, about 1 MB) is broadcast; a worker keeps at most
CACHE_ENTRIES encoded pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, spread_documents

CACHE_ENTRIES = 150_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file in rank order."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0..n-1")
    return [ranks[i] for i in range(len(ranks))]


def as_chars(data: bytes) -> str:
    return "".join(map(_CHAR.__getitem__, data))


_CHAR = [chr(0x100 + b) for b in range(256)]
NORMAL, UNKNOWN = 1, 2


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is vocabulary[i], and one unknown piece follows the last
    (every byte is in the vocabulary, so it never occurs)."""
    missing = {bytes([b]) for b in range(256)} - set(vocabulary)
    if missing:
        raise ValueError(f"{len(missing)} bytes are not in the vocabulary")
    out = bytearray()
    for rank, token in enumerate(vocabulary):
        out += _field(1, _field(1, as_chars(token).encode()) + _field(2, float(-rank)) + _field(3, NORMAL))
    n = len(vocabulary)
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, vocabulary: list[bytes], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.pieces = vocabulary
        self.split = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model or serialise_model(vocabulary))
        self.cache: dict[str, bytes] = {}

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = list(dict.fromkeys(words))
            for w, ids in zip(new, self.sp.encode([as_chars(w.encode("utf-8", "replace")) for w in new], num_threads=1), strict=True):
                cache[w] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join(map(cache.__getitem__, words))
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        return out

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(packed).cast("I")))


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): token count, digests of the ids and of the decoded
    bytes, and with `with_ids` the ids and decoded text themselves. A map without a shuffle."""
    spark = docs.sparkSession
    vocabulary = read_ranks(vocabulary_path)
    shared = spark.sparkContext.broadcast((vocabulary, serialise_model(vocabulary)))
    schema = SCHEMA + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches):
        pieces, model = shared.value
        codec = Codec(pieces, pattern, model)
        for batch in batches:
            for part in slices(batch, 1, 256):
                cols = [[] for _ in range(6)]
                for text in part.column(1).to_pylist():
                    packed = codec.encode_packed(text or "")
                    decoded = codec.decode_packed(packed)
                    row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded))
                    for col, value in zip(cols, row):
                        col.append(value)
                    if with_ids:
                        cols[4].append(memoryview(packed).cast("I").tolist())
                        cols[5].append(decoded)
                arrays = [part.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
                if with_ids:
                    arrays += [pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spread_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
