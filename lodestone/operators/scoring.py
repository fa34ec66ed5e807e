"""Relevance of files to task terms. files: path, role, size, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT, Config
from ..functions import paths as P
from ..functions import text as T


def content_signals(files: DataFrame, terms: list[str], keep: tuple = ("path",)) -> DataFrame:
    """(keep..., pos, term, cnt): occurrences of each term in each file. The content is scanned once
    per term and never multiplied by them; persist the result before using it twice."""
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term"), T.count_word(F.col("content"), t).cast("long").alias("cnt")) for i, t in enumerate(terms)])
    return files.select(*keep, F.explode(rows).alias("s")).select(*keep, "s.pos", "s.term", "s.cnt")


def signal_rows(files: DataFrame, keep: list, signals: list[Column]) -> DataFrame:
    """(keep..., t): the array of a file's signals, one struct per term, on the file's own row. The
    generator of one element holds later filters off the signals, which would else be computed for the
    filter and again for its result."""
    return files.select(*keep, F.explode(F.array(F.array(*signals))).alias("t"))


def content_score(cnt: Column, cfg: Config = DEFAULT) -> Column:
    return F.least(F.lit(cfg.content_cap), F.lit(cfg.content_mult) * F.log1p(cnt))


def path_word_counts(files: DataFrame) -> DataFrame:
    """(word, n_files): files with the word in a path segment."""
    return files.select("path", F.explode(P.path_words(F.col("path"))).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n_files"))


def rarity(n: Column) -> Column:
    return F.when(n <= 1, 1.0).otherwise(1.0 / (1.0 + F.log(n)))


def fragment_weight(n: Column, total: Column, rare: float = DEFAULT.fragment_rare) -> Column:
    return F.when(n / total <= rare, 1.0).otherwise(rare / (n / total))


def is_hit(x: Column) -> Column:
    return (x["cnt"] > 0) | (x["fn"] > 0) | (x["n_defs"] > 0)


def score_files(signals: DataFrame, n_terms: int, cfg: Config = DEFAULT) -> DataFrame:
    """One row per file from signals(path, role, size, damp, penalty, t), t an array in the order of
    terms of struct(term, cnt, fn, n_defs, first_def, first_seq, weight): its score, leading reason and
    matched terms. Sums run in the order of terms; no shuffle."""
    total = lambda f: F.aggregate("t", F.lit(0.0), lambda a, x: a + f(x))
    test = F.when(F.col("role") == "test", cfg.test_damping).otherwise(1.0)
    content = total(lambda x: content_score(x["cnt"], cfg) * x["weight"]) * F.col("damp") * test
    symbol = total(lambda x: cfg.weight_symbol * x["n_defs"] * x["weight"]) * test
    name = total(lambda x: cfg.weight_filename * x["fn"] * x["weight"])
    matched = F.array_distinct(F.transform(F.filter("t", is_hit), lambda x: x["term"]))
    bonus = F.when((F.size("matched") > 0) & F.col("role").isin("config", "docs"), cfg.role_bonus).otherwise(0.0)
    by_name = F.filter("t", lambda x: x["fn"] > 0)
    by_def = F.array_sort(F.transform(F.filter("t", lambda x: x["n_defs"] > 0), lambda x: F.struct(x["first_seq"].alias("seq"), x["first_def"].alias("name"))))
    best = F.aggregate("t", F.struct(F.lit(0).cast("long").alias("cnt"), F.lit("").alias("term")), lambda a, x: F.when(x["cnt"] > a["cnt"], F.struct(x["cnt"].alias("cnt"), x["term"].alias("term"))).otherwise(a))
    reason = (
        F.when(F.size(by_name) > 0, F.concat(F.lit("filename matches '"), F.get(by_name, F.lit(0))["term"], F.lit("'")))
        .when(F.size(by_def) > 0, F.concat(F.lit("defines "), F.get(by_def, F.lit(0))["name"]))
        .when(best["cnt"] > 0, F.concat(F.lit("mentions "), best["term"]))
        .otherwise("matches task terms")
    )
    scored = signals.withColumn("matched", matched).withColumn("reason", reason)
    scaled = (symbol + content + bonus) * F.size("matched") / F.lit(float(max(n_terms, 1)))
    score = F.when(F.size("matched") > 0, (name + scaled) * F.col("penalty")).otherwise(0.0)
    return scored.select("path", "role", "size", score.alias("score"), "reason", F.col("matched").alias("matched_terms"))


def top_ranked(scored: DataFrame, cfg: Config = DEFAULT, decimals: int = 9) -> DataFrame:
    """Files above the threshold, best first, at most discovery_limit; ties by path."""
    kept = scored.withColumn("score", F.round("score", decimals)).filter(F.col("score") > cfg.score_threshold)
    top = kept.orderBy(F.col("score").desc(), "path").limit(cfg.discovery_limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "path")))


def weak_terms(term_facts: DataFrame, total: Column, cfg: Config = DEFAULT) -> DataFrame:
    """term_facts(term, n_paths, n_files) with weak: terms too common in names or, in none, too rare
    or too common in files."""
    ratio = F.col("n_files") >= cfg.weak_common_ratio * total
    weak = (F.col("n_paths") >= cfg.weak_common_paths) | ((F.col("n_paths") == 0) & ((F.col("n_files") <= cfg.weak_rare_files) | ratio))
    return term_facts.withColumn("weak", weak)
