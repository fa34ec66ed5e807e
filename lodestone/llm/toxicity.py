"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(bias + sum of the weights
of its words and of their heads of 4, 5 and 6 bytes, so that inflected forms share what is learned);
a document is toxic unless no sentence is (noisy-or: 1 - prod(1 - p)). The weights are
learned from document labels alone through that noisy-or, so that the fitted sentence model also
locates the offending sentences. Words are runs of ASCII letters, digits and non-ASCII bytes, ASCII
lower-cased, hashed to 2**BITS weights (2**BITS * 4 bytes are broadcast, whatever the corpus).

Training rows: labelled rows whose crc32(doc_id as text) mod 4 is not 2, at most TRAIN_POSITIVE and
TRAIN_NEGATIVE of them, in the order of a hash of doc_id, with texts of at most TRAIN_CHARS
characters; the classes are weighted back to their shares among all training rows. Of these, the rows
whose remainder is 3 calibrate the score (logistic). Labels, language, source and doc_id are no
inputs of a score. Every whole text is scored.

Edge cases: null and empty texts have no sentence and get the score of a bag without evidence; of
several labels of one doc_id the largest counts, null labels none; without labels of both classes
every score is 0; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, spread_documents
from .hashing import U, find_words, hash_words, mix, text_buffer

BITS = 18
TRAIN_POSITIVE = 4_000
TRAIN_NEGATIVE = 8_000
TRAIN_CHARS = 8_000
FEATURES = 4_096
MIN_DOCS = 4
HEADS = (4, 5, 6)
PREDICT = 0.3
#: A sentence is reported as offending from this probability on.
OFFENDING = 0.5

_SEP = np.ones(256, bool)
_SEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


class Bags:
    """Words and heads of some texts as feature numbers, and their sentences."""

    def __init__(self, texts: pa.Array):
        buf, offsets = text_buffer(texts)
        starts, ends = find_words(buf, offsets, _SEP)
        first = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        ended = np.cumsum(_END[buf])[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (ended[1:] != ended[:-1])
        word_sentence = np.cumsum(new) - 1
        low = _LOWER[buf]
        feature, sentence = [hash_words(low, starts, ends)], [word_sentence]
        for k in HEADS:
            long = np.flatnonzero(ends - starts > k)
            feature.append(mix(hash_words(low, starts[long], starts[long] + k) + U(k)))
            sentence.append(word_sentence[long])
        self.feature = (np.concatenate(feature) & U((1 << BITS) - 1)).astype(np.int32)
        self.sentence = np.concatenate(sentence)  # of each feature
        at = np.flatnonzero(new)
        self.doc = doc[at]  # of each sentence
        self.n_docs = len(offsets) - 1
        last = (np.append(at[1:], len(starts)) - 1)[: len(at)]
        self.spans = starts[at] - offsets[self.doc], ends[last] - offsets[self.doc]  # bytes in the text


class Weights:
    def __init__(self, word: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.word, self.bias, self.slope, self.shift = word, bias, slope, shift

    def sentences(self, feature, sentence, n):
        return self.bias + np.bincount(sentence, weights=self.word[feature], minlength=n)

    def clean(self, z, doc, n):
        """log prod(1 - p) of each document."""
        return -np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)

    def score(self, log_clean):
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(log_clean) + self.shift, -30, 30)))


def _logit(log_clean: np.ndarray) -> np.ndarray:
    """logit of 1 - exp(log_clean), bounded so that an empty bag has a finite value."""
    log_clean = np.clip(log_clean, -30, -1e-6)
    return np.log(-np.expm1(log_clean)) - log_clean


def select(k1: np.ndarray, k0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The features most tied to toxic documents, at most FEATURES, ascending; k1 and k0 count the
    toxic and clean documents of the sample that have each feature."""
    share = (k1 + k0) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nan_to_num(k1 * np.log(k1 / (n1 * share))) + np.nan_to_num(k0 * np.log(k0 / (n0 * share)))
    g[(k1 + k0 < MIN_DOCS) | (k1 / n1 <= 1.5 * k0 / n0)] = 0
    best = np.argsort(-g, kind="stable")[:FEATURES]
    return np.sort(best[g[best] > 0])


def fit(used, small, sentence, doc, label, weight, steps: int = 150, rate: float = 0.1, l2: float = 1e-5, l1: float = 3e-5) -> Weights:
    """Full-batch Adam on the weighted noisy-or likelihood, with proximal L1 on the features. small
    (an index into used) and sentence per occurrence, doc per sentence, label and weight per document."""
    n_s, n_d = len(doc), len(label)
    weight = weight / weight.sum()
    w, bias = np.zeros(len(used)), -5.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(sentence, weights=w[small], minlength=n_s)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = -np.bincount(doc, weights=np.logaddexp(0, z), minlength=n_d)
        toxic = -np.expm1(np.minimum(clean, -1e-9))
        # d loss / d z: p for clean documents, -p (1 - P) / P for toxic ones
        share = np.where(label > 0, -np.exp(clean) / toxic, 1.0) * weight
        g = share[doc] * p
        gw = np.bincount(small, weights=g[sentence], minlength=len(used)) + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        step = rate * scale / (np.sqrt(v) + 1e-6)
        w = w - step * m
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias -= rate * scale * mb / (np.sqrt(vb) + 1e-6)
    word = np.zeros(1 << BITS, np.float32)
    word[used] = w
    return Weights(word, float(bias))


def _sample(docs: DataFrame, labels: DataFrame):
    """The bounded sample (text, label, fold), and the classes' sizes among all training rows."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    rows = rows.withColumn("fold", (key % 4).cast("int")).filter("fold <> 2").withColumn("label", (F.col("label") > 0).cast("int"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(1), "doc_id")
    chosen = rows.filter("label = 1").orderBy(order, "doc_id").limit(TRAIN_POSITIVE).union(rows.filter("label = 0").orderBy(order, "doc_id").limit(TRAIN_NEGATIVE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")
    return materialise(texts.select("text", "label", "fold"), "toxicity-sample")[0], sizes


def _document_counts(sample: DataFrame) -> dict:
    """(fold is 3, label) -> documents per feature; a task adds up its documents first."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0):
                bags = Bags(part.column(0))
                pairs = np.unique(bags.doc[bags.sentence].astype(np.int64) << BITS | bags.feature)
                of, feature = pairs >> BITS, pairs & ((1 << BITS) - 1)
                kind = np.array([2 * (f == 3) + y for y, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist())])
                for k in np.unique(kind):
                    table = sums.setdefault(int(k), np.zeros(1 << BITS, np.int64))
                    table += np.bincount(feature[kind[of] == k], minlength=1 << BITS)
        for k, table in sums.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[at])], ["kind", "feature", "n"])

    got = sample.mapInArrow(run, "kind int, feature int, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = {k: np.zeros(1 << BITS) for k in range(4)}  # at most 4 * 2**BITS rows came
    kind, feature, n = (got[c].to_numpy() for c in ("kind", "feature", "n"))
    for k in counts:
        counts[k][feature[kind == k]] = n[kind == k]
    return counts


def train(docs: DataFrame, labels: DataFrame) -> Weights | None:
    sample, sizes = _sample(docs, labels)
    have = {(r["held"], r["label"]): r["n"] for r in sample.groupBy((F.col("fold") == 3).alias("held"), "label").agg(F.count("*").alias("n")).collect()}
    of = lambda held: [have.get((held, y), 0) for y in (0, 1)]
    if not all(a + b for a, b in zip(of(True), of(False))):
        return None
    counts = _document_counts(sample)
    split = all(of(True)) and all(of(False))
    n0, n1 = of(False) if split else [a + b for a, b in zip(of(True), of(False))]
    used = select(counts[1] + (0 if split else counts[3]), counts[0] + (0 if split else counts[2]), n1, n0)
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    shared = sample.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        number = shared.value
        for batch in batches:
            for part in slices(batch, 0):
                bags = Bags(part.column(0))
                small = number[bags.feature]
                small, sentence = small[small >= 0], bags.sentence[small >= 0]
                order = np.argsort(sentence, kind="stable")
                small, sentence = small[order], sentence[order]
                cut = np.searchsorted(bags.doc[sentence], np.arange(bags.n_docs + 1))
                first = np.searchsorted(bags.doc, np.arange(bags.n_docs + 1))
                cols = [[small[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], [(sentence[a:b] - f).astype(np.int32).tobytes() for a, b, f in zip(cut[:-1], cut[1:], first)]]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(np.diff(first).astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], ["label", "fold", "n", "small", "sentence"])

    # ordered, so that float sums and thus the weights do not depend on arrival
    got = sorted(tuple(r.values()) for r in sample.mapInArrow(run, "label int, fold int, n int, small binary, sentence binary").toArrow().to_pylist())
    label, fold = np.array([float(r[0]) for r in got]), np.array([r[1] for r in got])

    def bag(which):
        sentences = np.array([got[i][2] for i in which])
        base = np.cumsum(sentences) - sentences
        small = np.concatenate([np.frombuffer(got[i][3], np.int32) for i in which])
        sentence = np.concatenate([np.frombuffer(got[i][4], np.int32) + b for i, b in zip(which, base)])
        return small, sentence, np.repeat(np.arange(len(which)), sentences)

    def weights(which):
        share = {c: sizes[c] / max(1, (label[which] == c).sum()) for c in (0, 1)}
        return np.where(label[which] > 0, share[1], share[0])

    every = np.arange(len(label))
    learn, tune = (np.flatnonzero(fold != 3), np.flatnonzero(fold == 3)) if split else (every, every)
    model = fit(used, *bag(learn), label[learn], weights(learn))
    small, sentence, doc = bag(tune)
    x = _logit(model.clean(model.sentences(used[small], sentence, len(doc)), doc, len(tune)))
    model.slope, model.shift = _logistic(x, label[tune], weights(tune))
    return model


def _logistic(x, y, weight) -> tuple[float, float]:
    w, weight = np.array([1.0, 0.0]), weight * len(weight) / weight.sum()
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-2 * (w - [1.0, 0.0])
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.05)), float(w[1])


def score_documents(docs: DataFrame, model: Weights | None, with_spans: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): score, and the place of the worst sentence (its bytes
    start to stop in the text, its probability, how many sentences offend); with `with_spans` all
    offending sentences. A map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, n_offending int, worst_start long, worst_stop long, worst_p double"
    schema += ", offending array<struct<start: long, stop: long, p: double>>" if with_spans else ""

    def run(batches):
        model = shared.value or Weights(np.zeros(1 << BITS, np.float32), -30.0, 1.0, -30.0)
        for batch in batches:
            for part in slices(batch, 1):
                bags = Bags(part.column(1))
                n = len(bags.doc)
                z = model.sentences(bags.feature, bags.sentence, n)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                score = model.score(model.clean(z, bags.doc, bags.n_docs))
                counts = np.bincount(bags.doc, weights=p >= OFFENDING, minlength=bags.n_docs).astype(np.int32)
                worst = np.full(bags.n_docs, -1)
                order = np.lexsort((-np.arange(n), p, bags.doc))
                worst[bags.doc[order]] = order  # the last of a document is its most probable, first on ties
                none = worst < 0
                at = np.where(none, 0, worst)
                pick = lambda x: pa.array(x[at] if n else np.zeros(len(at), x.dtype), mask=none)  # noqa: B023, E731
                arrays = [part.column(0), pa.array(score), pa.array(counts), pick(bags.spans[0].astype(np.int64)), pick(bags.spans[1].astype(np.int64)), pick(p)]
                names = ["doc_id", "score", "n_offending", "worst_start", "worst_stop", "worst_p"]
                if with_spans:
                    lists = [[] for _ in range(bags.n_docs)]
                    for s in np.flatnonzero(p >= OFFENDING):
                        lists[bags.doc[s]].append({"start": int(bags.spans[0][s]), "stop": int(bags.spans[1][s]), "p": float(p[s])})
                    arrays.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_documents(docs: DataFrame, model: Weights | None, threshold: float = PREDICT) -> DataFrame:
    """The rows of docs(text, ...) whose score is below the threshold, all columns as they are; a
    filter in place, without a shuffle."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, place):
                bags = Bags(part.column(place))
                z = model.sentences(bags.feature, bags.sentence, len(bags.doc))
                score = model.score(model.clean(z, bags.doc, bags.n_docs))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(key % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_stop", "worst_p")


def op1_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spread_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
