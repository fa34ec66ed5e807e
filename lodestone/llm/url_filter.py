"""URL filtering: domain and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over URL bytes, one of accepted and one of rejected URLs,
are counted over every URL that a rule judges. Each byte is predicted from its contexts of 0 to ORDER
bytes, interpolated with an escape mass of 1 + sqrt(count), so an unseen context backs off to the
longest seen one. A URL no rule judges is accepted when the calibrated probability of its length-normalised
log-likelihood difference reaches 1/2.

Counts of contexts and of context-byte pairs live in a table under exact keys (the order and the bytes
themselves, at most 58 bits), which grows with the corpus; nothing is hashed, so no two contexts are
added together. Counts cover every judged URL; partial counts are combined map-side before the
shuffle. For scoring, URLs are dealt into blocks of about BLOCK_BYTES; a block asks for the distinct
keys it needs, these are joined with the table and meet their block again, so no task, broadcast or
driver holds more of the model than one block's keys. Calibration uses the URLs that a hash puts in
one of FOLDS folds, whose counts are left out of the calibrating model, as a bounded sample of
CALIBRATION distinct URLs, each weighted by its rows.

Edge cases: a null url, or one without "://", has empty host and path, matches no rule and is judged
by the model on its (empty or whole) string; where only one class has URLs every other URL takes that
class; where none has, every URL is allowed. Repeated rows are counted and judged as often as they
occur. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices
from .hashing import text_buffer

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: An exact key has room for five bytes of context.
ORDER = 5
FOLDS = 10
CALIBRATION = 50_000
#: Keys that a counting task holds before it passes them on, URL bytes of a scored block, and URLs at once.
PENDING = 1 << 20
BLOCK_BYTES = 1 << 18
SLICE = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url="url"):
    """(host, path) columns of a URL column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def judge_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and by_rule: the rule of the longest host and path (host first
    on equal total length, then the later one) that fits."""
    host, path = host_and_path()
    out = pages.withColumns({"host": host, "path": path})
    ranked = sorted(enumerate(rules), key=lambda x: (-len(x[1][0]) - len(x[1][1]), -len(x[1][0]), -x[0]))
    rule = verdict = None
    for _, (h, p, v) in ranked:
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "by_rule": none if verdict is None else verdict})


def _contexts(buf: np.ndarray, offsets: np.ndarray, order: int):
    """Per order 0..ORDER: exact keys of each byte's context and of the context with the byte; a context
    never reaches back over the start of its URL (it is padded by a start mark)."""
    n = len(buf)
    value = buf.astype(np.int64) + 1
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(n, np.int64)
    for k in range(order + 1):
        if k:
            back = np.zeros(n, np.int64)
            back[k:] = value[:-k]
            back[place < k] = 0
            context = context << 9 | back
        key = context << 3 | k
        yield key, key << 9 | value


def _add_up(parts) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a list of such pairs, each key once."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return keys, counts


def count_cells(urls: DataFrame) -> DataFrame:
    """urls(url, label, held) -> (kind, cell, n): kind = 4 * held + 2 * label + (0 context, 1 pair), cell
    the exact key. Each task adds up its cells, PENDING at a time, before anything is shuffled."""

    def run(batches):
        sums: dict[int, list] = {}

        def rows():
            for kind, parts in sums.items():
                keys, counts = _add_up(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], ["kind", "cell", "n"])

        for batch in batches:
            for part in slices(batch, 0, SLICE):
                label = np.asarray(part.column(1).to_pylist(), bool)
                held = np.asarray(part.column(2).to_pylist(), bool)
                for kind in range(4):
                    want = (label == bool(kind & 1)) & (held == bool(kind & 2))
                    if not want.any():
                        continue
                    buf, offsets = text_buffer(part.column(0).filter(pa.array(want)))
                    for context, pair in _contexts(buf, offsets, ORDER):
                        for both, cells in ((0, context), (1, pair)):
                            sums.setdefault(2 * kind + both, []).append(np.unique(cells, return_counts=True))
                if sum(len(k) for parts in sums.values() for k, _ in parts) > PENDING:
                    sums = {kind: [_add_up(parts)] for kind, parts in sums.items()}
                    if sum(len(parts[0][0]) for parts in sums.values()) > PENDING // 2:
                        yield from rows()
                        sums = {}
        yield from rows()

    return urls.mapInArrow(run, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))


def count_table(urls: DataFrame) -> DataFrame:
    """urls(url, label, held) -> (key, n0, n1, h0, h1): counts of both classes, over all URLs and over
    those not held out. key = 2 * cell + (0 context, 1 pair)."""
    cells = count_cells(urls)
    of = lambda c, most: F.sum(F.when((F.col("kind") < most) & (F.col("kind").bitwiseAND(2) == 2 * c), F.col("n")).otherwise(0))
    key = (F.col("cell") * 2 + F.col("kind") % 2).alias("key")
    return cells.groupBy(key).agg(of(0, 8).alias("n0"), of(1, 8).alias("n1"), of(0, 4).alias("h0"), of(1, 4).alias("h1"))


def keys_of(urls) -> np.ndarray:
    """The distinct keys that a column of URLs needs."""
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(urls), SLICE):
        buf, offsets = text_buffer(urls.slice(i, SLICE))
        for context, pair in _contexts(buf, offsets, ORDER):
            found += [np.unique(context << 1), np.unique(pair << 1 | 1)]
    return np.unique(np.concatenate(found))


class Counts:
    """The counts of both classes for some keys; other keys were never seen."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = np.argsort(keys)
        # a last column of zeros stands for the unseen keys
        self.keys, self.n = keys[order], np.stack([np.append(n[order], 0) for n in (n0, n1)])

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        seen = np.append(self.keys, -1)[at] == keys
        return self.n[:, np.where(seen, at, len(self.keys))].astype(float)


class Model:
    """The corpus's table of counts: over all URLs (n) or over those not held out (h)."""

    def __init__(self, table: DataFrame, counts: str = "n"):
        self.table = table.select("key", F.col(f"{counts}0").alias("n0"), F.col(f"{counts}1").alias("n1"))

    def counts(self, urls: pa.Array) -> Counts:
        """What a bounded array of URLs needs, on the driver."""
        want = self.table.sparkSession.createDataFrame(pa.table({"key": keys_of(urls)}))
        return Counts(*(c.to_numpy() for c in self.table.join(want, "key").select("key", "n0", "n1").toArrow().columns))


def log_likelihoods(counts: Counts, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per class, the mean log probability per byte of each URL, interpolated over the orders."""
    p = np.full((2, len(buf)), 1 / 256)
    for context, pair in _contexts(buf, offsets, ORDER):
        seen, both = counts.of(context << 1), counts.of(pair << 1 | 1)
        escape = np.minimum(seen, 1 + np.sqrt(seen))
        total = seen + escape
        mixed = (both + escape * p) / np.maximum(total, 1)
        p = np.where(seen > 0, mixed, p)
    sums = np.concatenate([np.zeros((2, 1)), np.cumsum(np.log(p), axis=1)], axis=1)
    return (sums[:, offsets[1:]] - sums[:, offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def ratio(models: Model | Counts, urls: pa.Array) -> np.ndarray:
    """Length-normalised log-likelihood difference, accepted less rejected; 0 for empty URLs."""
    counts = models.counts(urls) if isinstance(models, Model) else models
    out = [np.zeros(0)]
    for i in range(0, len(urls), SLICE):
        buf, offsets = text_buffer(urls.slice(i, SLICE))
        rejected, accepted = log_likelihoods(counts, buf, offsets)
        out.append(accepted - rejected)
    return np.concatenate(out)


def with_ratio(urls: DataFrame, model: Model) -> DataFrame:
    """urls, which has a column url, with the column ratio."""
    size = urls.agg(F.sum(F.coalesce(F.octet_length("url"), F.lit(0)) + 16)).first()[0] or 0
    dealt = urls.withColumn("block", F.pmod(F.xxhash64(*urls.columns), F.lit(size // BLOCK_BYTES + 1)).cast("int"))

    def ask(key, rows):
        keys = keys_of(rows["url"].combine_chunks())
        return pa.table({"block": pa.array(np.full(len(keys), key[0].as_py(), np.int32)), "key": keys})

    def score(rows, found):
        counts = Counts(*(found[c].to_numpy() for c in ("key", "n0", "n1")))
        return rows.drop_columns("block").append_column("ratio", pa.array(ratio(counts, rows["url"].combine_chunks())))

    asked = dealt.select("block", "url").groupBy("block").applyInArrow(ask, "block int, key long")
    found = asked.join(model.table, "key").select("block", "key", "n0", "n1")
    schema = ", ".join(f"`{n}` {t}" for n, t in urls.dtypes) + ", ratio double"
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic a * x + b by Newton steps with a weak prior on a > 0."""
    scale = max(float(np.sqrt(np.cov(x, aweights=weight, ddof=0))), 1e-6)
    z, w = x / scale, np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-2 * (w - [1.0, 0.0])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(judged: DataFrame):
    """(model, (a, b)) from judged(url, by_rule); (None, the one score) when a class has no URLs."""
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    urls = judged.filter("by_rule is not null and url is not null").select("url", (F.col("by_rule") == "allow").alias("label"), held.alias("held"))
    table, _ = materialise(count_table(urls), "counts")
    bytes_seen = table.filter("key = 0").first()  # the context of order 0
    full = [bytes_seen is not None and bytes_seen[f"n{c}"] > 0 for c in (0, 1)]
    if not all(full):
        return None, (1.0 if full[1] or not full[0] else 0.0)
    distinct = urls.filter("held").groupBy("url", "label").agg(F.count("*").alias("weight"))
    sample, _ = materialise(distinct.orderBy(F.xxhash64(F.lit(7), "url"), "url", "label").limit(CALIBRATION), "calibration")
    rows = with_ratio(sample, Model(table, "h")).select("ratio", "label", "weight").toArrow()
    x, y = rows["ratio"].to_numpy(), np.asarray(rows["label"].to_pylist(), float)
    return Model(table), calibrate(x, y, rows["weight"].to_numpy().astype(float)) if len(set(y)) == 2 else (1.0, 0.0)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages(page_id, url): host, path, rule, verdict, and the model's score (the
    calibrated probability of acceptance; null where a rule decides)."""
    judged = judge_by_rules(pages.select("page_id", "url"), rules)
    model, rest = fit(judged)
    rest_of = judged.filter("by_rule is null").drop("by_rule")
    if model is None:
        scored = rest_of.withColumn("score", F.lit(float(rest)))
    else:
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), rest[0] * F.col("ratio") + rest[1]))
        scored = with_ratio(rest_of, model).withColumn("score", 1 / (1 + F.exp(-z)))
    verdict = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    scored = scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
    given = judged.filter("by_rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return given.union(scored)


def op2_char_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
