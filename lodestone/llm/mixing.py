"""Mixing sources to target weights by iterative proportional fitting, with native functions only.

Documents fall into cells (source, language, topic). The cells' token sums are raked: in turn each
dimension's weights are scaled to its target marginal, SWEEPS times and further until no marginal
is off by more than TOLERANCE or more sweeps do not help (targets that contradict the cells that occur);
the remaining distance is reported as `deviation`. A document of cell c is then kept with probability min(1, k * w_c / t_c),
w_c the raked weight, t_c the cell's tokens and k calibrated so that the expected tokens equal the
budget. The draw is a keyed hash of doc_id, so it repeats on any cluster.

Only the cell table is iterated on (one row per combination that occurs, pre-aggregated map-side, so
a source with a third of all rows is a handful of rows). A cell table of at most LOCAL_CELLS rows is one
partition, where marginals are window sums without a shuffle, PLANNED sweeps a plan; a larger one is
aggregated by dimension and joined back (by broadcast where the marginals' checked size allows), a sweep
a plan. Each plan's result is written to the shared folder, which cuts lineage.

Targets: per dimension an exponent a (the target share of a value is its token share to the power a,
normalised) or a table (value, share); values a table does not list get no weight, listed values
without documents are left out and the rest normalised.

Edge cases: null source, language and topic are the value ''; null and empty texts have no tokens and
are kept when their cell is; a cell without tokens has probability 1 if it has weight by an exponent
target; rows of one doc_id share their draw, a null doc_id draws as ''; an empty table gives no rows.
The operator overwrites columns of its own output names and ignores others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, join_small, materialise, unused

DIMENSIONS = ("source", "lang", "topic")
TARGETS = {"source": 0.5, "lang": 0.3, "topic": 0.7}
BUDGET = 0.6
SWEEPS = 20
TOLERANCE = 1e-10
#: Up to so many cells are raked inside one partition.
LOCAL_CELLS = 100_000
#: Sweeps of one such plan.
PLANNED = 5
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def surface_topic(text: str = "text") -> Column:
    """A topic from the text's surface, where the table brings none."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains("@") | t.contains("://") | t.contains(' = "'), "technical")
        .when(t.contains("!!") | t.contains("###") | t.contains("$$$"), "noisy")
        .when(F.length(t) < 400, "brief")
        .otherwise("prose")
    )


def uniform(seed: str, key: str = "doc_id") -> Column:
    """A number in [0, 1) of 52 bits, drawn by a keyed hash."""
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_cell(docs: DataFrame, topic: Column | None) -> DataFrame:
    columns = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS if d != "topic"}
    columns["topic"] = F.coalesce((surface_topic() if topic is None else topic).cast("string"), F.lit(""))
    return docs.withColumns({**columns, "n_tokens": word_count()})


def cells_of(keyed: DataFrame) -> DataFrame:
    cells = keyed.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("n_docs"))
    return materialise(cells, "cells")[0]


def target_table(cells: DataFrame, dimension: str, target) -> DataFrame:
    """(value, goal): goals add up to 1 over the values that have tokens."""
    have = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("have")).filter("have > 0")
    if isinstance(target, DataFrame):
        raw = have.join(target.select("value", F.col("share").cast("double").alias("raw")), "value", "left").select("value", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    else:
        raw = have.select("value", F.pow("have", F.lit(float(target))).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return materialise(raw.select("value", (F.col("raw") / total).alias("goal")), "goals")[0]


def _sweep(now: DataFrame) -> DataFrame:
    """One sweep inside one partition; `now` has a goal per dimension."""
    for d in DIMENSIONS:
        total = F.sum("weight").over(Window.partitionBy(d))
        now = now.withColumn("weight", F.when(total > 0, F.col("weight") * F.coalesce(f"goal_{d}", F.lit(0.0)) / total).otherwise(0.0))
    return now


def _wide_sweep(now: DataFrame, goals: dict, sizes: dict) -> DataFrame:
    """One sweep of a large cell table: marginals are aggregated and joined back."""
    for d in DIMENSIONS:
        sums = now.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("sum"))
        factor = goals[d].join(sums, "value").select(F.col("value").alias(d), F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
        now = join_small(now, factor, d, "left", sizes[d], 64).withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
    return now


def rake(cells: DataFrame, targets: dict, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with `weight`, whose sums over each dimension are its goals (sum 1), and `deviation`, by
    which the worst marginal still misses its goal."""
    spark = cells.sparkSession
    goals = {d: target_table(cells, d, targets[d]) for d in DIMENSIONS}
    sizes = {d: g.count() for d, g in goals.items()}
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    now = cells.withColumn("weight", F.col("tokens") / (total or 1.0))
    local = n <= LOCAL_CELLS
    if local:
        for d in DIMENSIONS:
            now = join_small(now, goals[d].select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}")), d, "left", sizes[d], 64)
        now = now.coalesce(1)
    missed, old = None, None
    while True:
        for done in range(1, sweeps + 1):
            now = _sweep(now) if local else _wide_sweep(now, goals, sizes)
            if done == sweeps or not local or done % PLANNED == 0:
                now, path = materialise(now, "raked")
                now = now.coalesce(1) if local else now
                if old:
                    discard(spark, old)
                old = path
        before, missed = missed, deviation(now, goals)
        if missed <= tolerance or (before is not None and missed > 0.99 * before):
            return now.select(*cells.columns, "weight", F.lit(missed).alias("deviation"))


def deviation(cells: DataFrame, goals: dict) -> float:
    """The largest distance of a marginal from its goal; the last dimension raked is exact."""
    worst = 0.0
    for d in DIMENSIONS[:-1]:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("sum"))
        worst = max(worst, goals[d].join(sums, "value", "left").agg(F.max(F.abs(F.col("goal") - F.coalesce("sum", F.lit(0.0))))).first()[0] or 0.0)
    return worst


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with keep_prob: min(1, k * weight / tokens), k such that the expected tokens are
    budget * all tokens (or as many as the weighted cells have)."""
    total, live = cells.agg(F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens")))).first()
    wanted = min(budget * (total or 0.0), live or 0.0)
    k, capped = None, -1
    while True:  # k grows and cells stay capped, so this ends; each round is one small aggregate
        full = F.lit(False) if k is None else F.col("weight") * F.lit(k) >= F.col("tokens")
        row = cells.filter("weight > 0 and tokens > 0").agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("t"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")
        ).first()
        if (row["n"] or 0) == capped or not row["w"]:
            break
        capped = row["n"] or 0
        k = (wanted - row["t"]) / row["w"]
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(k or 0.0) / F.col("tokens"))).otherwise(1.0)
    return cells.withColumn("keep_prob", p)


def mix(docs: DataFrame, targets: dict = TARGETS, budget: float = BUDGET, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """docs with topic (unless it has one), n_tokens, weight (of the document's cell), keep_prob,
    deviation (of the raked marginals) and sampled; the columns of docs keep their values, nulls included."""
    own = [d for d in DIMENSIONS if d in docs.columns]
    if topic is None and "topic" in own:
        topic = F.col("topic")
    held = unused(docs, "own")
    keyed = with_cell(docs.withColumn(held, F.struct(F.lit(0).alias("none"), *own)), topic)
    cells, _ = materialise(calibrate(rake(cells_of(keyed), targets), budget), "calibrated")
    out = _attach(keyed, cells, cells.count(), seed)
    return out.withColumns({d: F.col(held)[d] for d in own}).drop(held)


def _attach(keyed: DataFrame, cells: DataFrame, n: int, seed: str) -> DataFrame:
    facts = cells.select(*DIMENSIONS, "weight", "keep_prob", "deviation")
    out = join_small(keyed.drop("weight", "keep_prob", "deviation", "sampled"), facts, list(DIMENSIONS), "left", n, 160)
    return out.withColumn("sampled", uniform(seed) < F.col("keep_prob"))


def op8_ipf_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; texts are read once, for their tokens and topic."""
    keyed, _ = materialise(with_cell(documents(spark, sf_dir), None).select("doc_id", *DIMENSIONS, "n_tokens"), "keyed")
    cells, _ = materialise(calibrate(rake(cells_of(keyed), TARGETS)), "calibrated")
    out = _attach(keyed, cells, cells.count(), SEED)
    return out.select("doc_id", *DIMENSIONS, "n_tokens", F.round("weight", 9).alias("weight"), F.round("keep_prob", 9).alias("keep_prob"), F.round("deviation", 6).alias("deviation"), "sampled")


def _oracle() -> str:
    steps = []
    last = "w0"
    for i in range(SWEEPS):
        for d in DIMENSIONS:
            name = f"w{i + 1}_{d}"
            steps.append(f"{name} as materialized (select source, lang, topic, tokens, g_source, g_lang, g_topic, weight * g_{d} / sum(weight) over (partition by {d}) as weight from {last})")
            last = name
    goals = ", ".join(f"pow(sum(tokens) over (partition by {d}), {TARGETS[d]}) as r_{d}" for d in DIMENSIONS)
    sums = ", ".join(f"(select sum(r) from (select distinct {d}, r_{d} as r from r)) as s_{d}" for d in DIMENSIONS)
    shares = ", ".join(f"r_{d} / s_{d} as g_{d}" for d in DIMENSIONS)
    return rf"""
with d as materialized (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
    case when contains(t, '@') or contains(t, '://') or contains(t, ' = "') then 'technical'
         when contains(t, '!!') or contains(t, '###') or contains(t, '$$$') then 'noisy'
         when length(t) < 400 then 'brief' else 'prose' end as topic,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint as n_tokens
  from (select *, coalesce(text, '') as t from documents)
), c as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all),
r as materialized (select *, {goals} from c where tokens > 0),
s as (select {sums}),
w0 as materialized (select source, lang, topic, tokens, {shares}, tokens / sum(tokens) over () as weight from r, s),
{", ".join(steps)},
o as (
  select *, row_number() over (order by weight / tokens desc, source, lang, topic) as rn, weight / tokens as ratio,
    {BUDGET} * sum(tokens) over () as wanted from {last}
), k as (
  select *, (wanted - coalesce(sum(tokens) over (order by rn rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by rn rows between current row and unbounded following) as k from o
), f as (select k from k where k * ratio <= 1 order by rn limit 1),
miss as (select max(greatest(abs(s1 - g_source), abs(s2 - g_lang))) as deviation from (
  select g_source, g_lang, sum(weight) over (partition by source) as s1, sum(weight) over (partition by lang) as s2 from {last}))
select d.doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 9) as weight,
  round(least(1.0, weight * f.k / tokens), 9) as keep_prob, round(deviation, 6) as deviation,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < least(1.0, weight * f.k / tokens) as sampled
from d join {last} using (source, lang, topic), f, miss
"""


OP8_SQL = _oracle()
