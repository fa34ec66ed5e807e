"""From a task in plain words and a corpus of files to a small, explained package of files.

Stages: select (score, relate, rank), follow (imports and calls, two hops), bound (diverse delivery,
excerpts within a byte budget, redaction), check (configuration against documents, concepts against
tests), explain. Wide stages are DataFrames over all files; what is collected is bounded by the
package's limits (60 ranked files, 8 followed ones, the excerpts of 18)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..constants import DEFAULT, Config
from ..functions import paths as P
from ..functions import text as T
from ..operators import bounding, checks, graph, scoring
from ..sources import discovery, facts, tables


def _defs_per_term(code: DataFrame, terms: list[str]) -> DataFrame:
    """(path, defs): by term's position, the definitions whose name has the term."""
    defs = code.filter("kind = 'def'")
    hits = F.array_compact(F.array(*[F.when(T.has_word(F.col("name"), t), F.lit(i)) for i, t in enumerate(terms)]))
    rows = defs.select("path", "name", "seq", F.explode(hits).alias("pos"))
    found = rows.groupBy("path", "pos").agg(F.count("*").alias("n_defs"), F.min_by("name", "seq").alias("first_def"), F.min("seq").alias("first_seq"))
    return found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("n_defs", "first_def", "first_seq")))).alias("defs"))  # an entry a term


def path_counts_of(files: DataFrame, terms: list[str]) -> dict[str, int]:
    return {r["word"]: r["n_files"] for r in scoring.path_word_counts(files).filter(F.col("word").isin(terms)).collect()}


def signal_table(files: DataFrame, code: DataFrame, terms: list[str], path_counts: dict, weights: dict | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """One row per file with every term's signals; the only wide scan of contents."""
    path, content, size = F.col("path"), F.col("content"), F.col("size")
    density = code.groupBy("path").agg(F.sum((F.col("kind") == "def").cast("int")).alias("n_all"), F.lit(True).alias("parsed"))
    base = files.join(density, "path", "left").join(_defs_per_term(code, terms), "path", "left").withColumn("asset", P.asset_like(path, content, cfg.asset_avg_line))
    damp = P.large_penalty(path, size, content, F.col("asset"), F.coalesce("n_all", F.lit(0)), F.coalesce("parsed", F.lit(False)), cfg)
    named = P.segments_and_stems(path)

    def row(i: int, term: str) -> Column:
        rare = F.round(scoring.rarity(F.lit(float(path_counts.get(term, 1)))), 15)
        hit = F.exists(named, lambda s: T.has_word(s, term))
        count = F.when(F.col("asset"), 0).otherwise(T.count_word(content, term)).cast("long")
        of = F.try_element_at(F.col("defs"), F.lit(i))
        return F.struct(
            F.lit(term).alias("term"), count.alias("cnt"), F.when(hit, rare).otherwise(0.0).alias("fn"), F.coalesce(of["n_defs"], F.lit(0)).alias("n_defs"),
            of["first_def"].alias("first_def"), F.coalesce(of["first_seq"], F.lit(0)).alias("first_seq"), F.lit(float((weights or {}).get(term, 1.0))).alias("weight"),
        )

    kept = ["path", "role", "size", damp.alias("damp"), P.path_penalty(path, content, cfg).alias("penalty")]
    return scoring.signal_rows(base, kept, [row(i, t) for i, t in enumerate(terms)])


def score_file(spark: SparkSession, path: str, content: str, terms: list[str], path_counts: dict | None = None, weights: dict | None = None, cfg: Config = DEFAULT) -> float:
    """The score of one file by itself. Without `path_counts` (files by word of their paths) every word of
    its path counts as unique; without `weights` every term counts in full."""
    files = spark.createDataFrame([(path, content)], "path string, content string")
    files = files.select("*", F.octet_length("content").cast("long").alias("size"), P.role(F.col("path")).alias("role"))
    rows = signal_table(files, facts.code_facts(files), terms, path_counts or {}, weights, cfg) if terms else None
    return scoring.score_files(rows, len(terms), cfg).first()["score"] if terms else 0.0


def _reweigh(signals: DataFrame, terms: list[str], compounds: dict, n_files: int, cfg: Config):
    """(signals, files per term): fragments of a compound that are common count less."""
    hits = signals.select(F.explode(F.array_distinct(F.transform(F.filter("t", scoring.is_hit), lambda x: x["term"]))).alias("term"))
    seen = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}
    fragments = {f for parts in compounds.values() for f in parts} - set(compounds)
    weights = {f: min(1.0, cfg.fragment_rare * n_files / seen[f]) for f in fragments if seen.get(f, 0) / max(n_files, 1) > cfg.fragment_rare}
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        signals = signals.withColumn("t", F.transform("t", lambda x: x.withField("weight", F.coalesce(F.try_element_at(table, x["term"]), F.lit(1.0)))))
    return signals, {t: seen.get(t, 0) for t in terms}


def _module(parts: Column) -> Column:
    return F.array(F.concat(parts, F.lit(".py")), F.concat(parts, F.lit("/__init__.py")))


def import_edges(files: DataFrame, code: DataFrame) -> DataFrame:
    """(src, dst, name, direct): imports that resolve to a file, from the root or relative; name is
    what a from-import takes of the module itself (null for submodules and plain imports)."""
    plain = code.filter("kind = 'import'").select("path", F.replace("name", F.lit("."), F.lit("/")).alias("base"), F.lit(None).cast("string").alias("taken"))
    dirs = P.directories(F.col("path"))
    level = F.col("level")
    up = F.size(dirs) - level + 1
    package = F.array_join(F.slice(dirs, F.lit(1), F.greatest(up, F.lit(0))), "/")
    inner = F.replace("name", F.lit("."), F.lit("/"))
    start = F.when(level == 0, inner).when(up < 0, F.lit(None).cast("string")).otherwise(F.array_join(F.filter(F.array(package, inner), lambda x: x != ""), "/"))
    taken = code.filter("kind = 'from'").select("path", start.alias("base"), F.explode("names").alias("taken")).filter("base is not null")
    sub = taken.filter("taken <> '*'").select("path", F.array_join(F.filter(F.array("base", "taken"), lambda x: x != ""), "/").alias("base"), F.lit(None).cast("string").alias("taken"))
    wanted = plain.union(taken).union(sub).filter("base <> ''")
    options = wanted.select(F.col("path").alias("src"), "base", "taken", F.posexplode(_module(F.col("base"))).alias("o", "dst"))
    found = options.join(files.select(F.col("path").alias("dst")), "dst")
    first = found.groupBy("src", "base", "taken").agg(F.min_by("dst", "o").alias("dst"))
    return first.filter("src <> dst").select("src", "dst", F.col("taken").alias("name")).distinct()


def _expand(spark, seeds: list, scored: DataFrame, edges: DataFrame, verified: DataFrame, cfg: Config) -> list[dict]:
    """Breadth-first over imports in both directions: at most max_expanded files in max_depth hops. A
    candidate belongs to the first frontier file that reaches it, importees before importers."""
    base = lambda p: p.rsplit("/", 1)[-1]
    frontier = [(r["path"], i, []) for i, r in enumerate(seeds)]
    seen, out = [r["path"] for r in seeds], []
    checked = verified.withColumn("called", F.lit(True))
    links = edges.select("src", "dst").distinct().join(checked, ["src", "dst"], "left").withColumn("called", F.coalesce("called", F.lit(False))).persist()
    both = links.select(F.col("src").alias("near"), F.col("dst").alias("far"), F.lit(0).alias("inward"), "called").union(links.select("dst", "src", F.lit(1), "called"))
    for hop in range(1, cfg.max_depth + 1):
        room = cfg.max_expanded - len(out)
        if not frontier or not room:
            break
        near = F.broadcast(spark.createDataFrame([(p, i) for p, i, _ in frontier], "near string, at int"))
        new = both.join(near, "near").join(F.broadcast(spark.createDataFrame([(p,) for p in seen], "far string")), "far", "left_anti")
        claimed = new.groupBy("far").agg(F.min(F.struct("at", "inward", "near", "called")).alias("c")).select("far", "c.*")
        gain = F.when(F.col("called"), cfg.call_bonus).otherwise(cfg.relation_bonus) * cfg.decay ** (hop - 1)
        ranked = claimed.join(scored.select(F.col("path").alias("far"), "role", "score"), "far").withColumn("score", F.round(F.col("score") + gain, 9))
        admitted = ranked.orderBy(F.col("score").desc(), "far").limit(room).collect()
        provenance = {p: prov for p, _, prov in frontier}
        frontier = []
        for i, r in enumerate(admitted):
            src, dst = (r["far"], r["near"]) if r["inward"] else (r["near"], r["far"])
            verb = ("calls" if r["called"] else "imports") if r["inward"] else ("called by" if r["called"] else "imported by")
            chain = [*provenance[r["near"]], f"{src} imports {dst}"]
            out.append({"path": r["far"], "role": r["role"], "score": r["score"], "reason": f"{verb} {base(r['near'])}", "provenance": chain, "matched_terms": []})
            seen.append(r["far"])
            frontier.append((r["far"], i, chain))
    links.unpersist()
    return out


# excerpts


def _spans(spark, included: DataFrame, code: DataFrame, edges: DataFrame, terms: list[str], cfg: Config) -> DataFrame:
    """included(path, role, importer, content, asset) -> (path, s, e, weight)."""
    cap = cfg.excerpt_lines
    any_word = lambda c: T.has_word(c, terms[0]) if len(terms) == 1 else F.exists(F.array(*[T.has_word(c, t) for t in terms]), lambda x: x)
    defs = code.filter("kind = 'def'").join(F.broadcast(included.select("path", "importer")), "path")
    span = [F.col("line").alias("s"), F.least("end_line", F.col("line") + cap - 1).alias("e")]
    by_name = defs.filter(any_word(F.col("name"))).select("path", *span, F.lit(50).alias("weight"))
    taken = edges.filter("name is not null").select(F.col("src").alias("importer"), F.col("dst").alias("path"), "name").distinct()
    imported = defs.join(taken, ["importer", "path", "name"]).select("path", *span, F.lit(100).alias("weight"))
    lines = included.select("path", "role", "asset", F.posexplode(T.lines_of(F.col("content"))).alias("i", "text")).withColumn("line", F.col("i") + 1)
    one = [F.col("line").alias("s"), F.col("line").alias("e")]
    config = lines.filter((F.col("role") == "config") & F.col("text").rlike(r"^\s*[^#\s][^:=]*[:=]") & any_word(F.col("text"))).select("path", *one, F.lit(40).alias("weight"))
    heading = F.col("text").rlike(r"^\s{0,3}#{1,6}\s")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    under = lines.filter("role = 'docs'").withColumn("inside", F.last(F.when(heading, any_word(F.col("text"))), ignorenulls=True).over(w))
    docs = under.filter(F.col("inside") & (F.trim("text") != "")).select("path", *one, F.lit(30).alias("weight"))
    strong = by_name.union(imported).union(config).union(docs)
    plain = lines.filter(~F.col("asset") & any_word(F.col("text"))).select("path", *one, F.lit(1).alias("weight"))
    return strong.union(plain.join(strong.select("path").distinct(), "path", "left_anti"))


def excerpts_of(included: DataFrame, code: DataFrame, edges: DataFrame, terms: list[str], cfg: Config = DEFAULT, hold=DataFrame.persist) -> DataFrame:
    """(path, score, start_line, end_line, text), redacted; at most excerpts_per_file a file."""
    if not terms:
        return included.sparkSession.createDataFrame([], "path string, score double, start_line int, end_line int, text string")
    merged = bounding.merge_spans(_spans(included.sparkSession, included, code, edges, terms, cfg), ["path"], cfg.excerpt_lines, hold=hold)
    top = bounding.top_per_group(merged, ["path"], [F.col("weight").desc(), "s"], cfg.excerpts_per_file).drop("rn")
    rows = top.join(included.select("path", "score", "content"), "path")
    body = F.array_join(F.slice(T.lines_of(F.col("content")), F.col("s"), F.col("e") - F.col("s") + 1), "\n")
    config = P.extension(F.col("path")).isin(list(K.CONFIG_EXTENSIONS))
    return rows.select("path", "score", F.col("s").alias("start_line"), F.col("e").alias("end_line"), T.redact_text(T.truncate_chars(body, cfg.excerpt_chars), config).alias("text"))


# checks


def _typed(entries: DataFrame, strict: bool) -> DataFrame:
    """entries(path, key, raw, line) with their normalised key, kind and value; with `strict` only
    whole numbers of keys with two words besides units count."""
    units = F.create_map(*[F.lit(x) for kv in K.UNIT_SECONDS.items() for x in kv])
    raw = F.regexp_replace(F.trim("raw"), "^[\"']+|[\"']+$", "")
    unit, bare = T.unit_from_key(F.col("key")), raw.rlike(r"^-?\d+(?:\.\d+)?$")
    number = raw.cast("double")
    made = F.when(bare & unit.isNotNull(), F.struct(F.lit("duration").alias("kind"), (number * F.element_at(units, unit)).alias("value"))).when(bare, F.struct(F.lit("number").alias("kind"), number.alias("value")))
    if strict:
        words = F.array_distinct(F.filter(F.split(F.lower("key"), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(list(K.UNIT_SECONDS))))
        entries = entries.filter(~T.secret_key(F.col("key")) & (F.size(words) >= 2) & bare)
    else:
        made = F.coalesce(made, T.line_value(raw))
    shown = raw if strict else F.when(bare, raw).otherwise(F.coalesce(F.nullif(F.regexp_extract(raw, K.DURATION, 0), F.lit("")), F.regexp_extract(raw, r"\b\d+(?:\.\d+)?\b", 0)))
    return entries.select("path", F.col("key").alias("setting"), "line", shown.alias("shown"), unit.alias("unit"), T.normalise_key(F.col("key")).alias("key"), made.alias("t")).filter("t is not null").select("*", "t.kind", "t.value").drop("t")


def discrepancies(files: DataFrame, included: list[str], terms: list[str]) -> list[dict]:
    """Settings that a configuration file and a document state differently, one of them in the package
    or named by the task."""
    pairs = checks.typed_mismatches(_typed(facts.config_entries(files), True), _typed(facts.doc_entries(files), False))
    near = lambda c: c.isin(included) | F.exists(P.segments_and_stems(c), lambda s: F.exists(F.array(*[T.has_word(s, t) for t in terms]), lambda x: x) if terms else F.lit(False))
    rows = pairs.filter(near(F.col("a.path")) | near(F.col("b.path"))).select(F.col("a.path").alias("cp"), F.col("a.line").alias("cl"), F.col("a.shown").alias("cv"), "a.setting", "a.unit", F.col("b.path").alias("dp"), F.col("b.line").alias("dl"), F.col("b.shown").alias("dv"))
    out = []
    for r in rows.distinct().orderBy("cp", "cl", "dp", "dl").collect():
        unit = f" {r['unit']}" if r["unit"] else ""
        message = f"{r['setting']}: {r['cp']}:{r['cl']} declares {r['cv']}{unit}, but {r['dp']}:{r['dl']} says {r['dv']}"
        out.append({"rule": "configuration_discrepancy", "setting": r["setting"], "config": {"path": r["cp"], "line": r["cl"], "value": r["cv"]}, "doc": {"path": r["dp"], "line": r["dl"], "value": r["dv"]}, "message": message})
    return out


def reference_gaps(files: DataFrame, code: DataFrame, items: list[dict], conflicts: list[dict], cfg: Config = DEFAULT) -> list[dict]:
    """Concepts of the package that no test mentions and that something corroborates: a conflicting
    setting, or a guard in another, directly matched file."""
    tests = files.filter("role = 'test'")
    if tests.isEmpty():
        return []
    place = {x["path"]: i for i, x in enumerate(items)}
    direct = [x["path"] for x in items if x["role"] == "source" and not x["provenance"]]
    idents = code.join(tests.select("path"), "path", "left_semi").filter("kind = 'ident'").select(F.explode(T.words(F.col("name"))).alias("word"))
    raw = tests.join(code.filter("kind = 'parsed'").select("path"), "path", "left_anti").select(F.explode(T.words(F.col("content"))).alias("word"))
    within = lambda df, roles: df.filter(F.col("path").isin([x["path"] for x in items if x["role"] in roles]))
    concept = lambda name, kind: [F.col("path"), F.col("line"), F.col(name).alias("name"), T.meaningful(T.words(F.col(name))).alias("words"), F.lit(kind).alias("kind")]
    symbols = within(code.filter("kind = 'def'").filter(~F.col("name").startswith("_")), ["source"]).select(*concept("name", "symbol"))
    settings = within(facts.config_entries(files).filter(~T.secret_key(F.col("key"))), ["config"]).select(*concept("key", "setting"))
    found = symbols.union(settings).filter(F.size("words") >= 2).withColumn("concept", F.array_join(F.array_sort("words"), " "))
    guards = code.filter("kind = 'gate'").filter(F.col("path").isin(direct)).select(F.col("path").alias("gp"), "name").distinct()
    gated = symbols.select("path", "name").distinct().join(guards, "name").filter("gp <> path").select("path", "name", F.lit(True).alias("gated")).distinct()
    named = [c["setting"] for c in conflicts]
    backed = F.when(F.col("kind") == "setting", F.col("name").isin(named)).otherwise(F.coalesce("gated", F.lit(False)))
    order = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    w = Window.partitionBy("concept").orderBy(F.element_at(order, F.col("path")), "line", "name")
    first = found.join(gated, ["path", "name"], "left").withColumn("rn", F.row_number().over(w)).filter("rn = 1").filter(backed)
    gaps = checks.unreferenced(first, idents.union(raw)).orderBy("path", "line", "name").limit(cfg.max_gaps).collect()
    return [{"rule": "test_reference_gap", "term": " ".join(g["words"]), "path": g["path"], "line": g["line"], "message": f"no test references {' '.join(g['words'])} ({g['path']}:{g['line']})"} for g in gaps]


def weak_signal(items: list[dict], terms: list[str], path_counts: dict, file_counts: dict, n_files: int, cfg: Config = DEFAULT) -> dict | None:
    """The matched terms and all terms' file counts when every match is of a weak term; else None."""
    used = list(dict.fromkeys(terms))
    if len(used) < 2 or not items:
        return None

    def weak(t):
        n, files = path_counts.get(t, 0), file_counts.get(t, 0)
        return n >= cfg.weak_common_paths or (n == 0 and (files <= cfg.weak_rare_files or files >= cfg.weak_common_ratio * n_files))

    matched = {t for x in items for t in x["matched_terms"]}
    if any(sum(not weak(t) for t in x["matched_terms"]) >= 2 for x in items) or not matched or not all(map(weak, matched)):
        return None
    return {"matched_terms": {t: path_counts.get(t, 0) for t in used if t in matched}, "term_file_counts": {t: file_counts.get(t, 0) for t in used}}


def get_context(spark: SparkSession, task: str, root: str | None = None, files: DataFrame | None = None, cfg: Config = DEFAULT) -> dict:
    """The package for a task over a directory, or over files(path, content[, role, size]). Tables that
    the call keeps in memory are released before it returns."""
    if not isinstance(task, str) or not task.strip():
        raise ValueError("the task is empty")
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        return _context(spark, task, root, files, cfg, hold)
    finally:
        for df in reversed(held):
            df.unpersist()


def _context(spark, task, root, files, cfg, hold) -> dict:
    counts: dict[str, int] = {}
    if files is None:
        if root is None or not Path(root).is_dir():
            raise NotADirectoryError(root)
        files, counts = discovery.discover_files(spark, root, cfg, hold)
    for name, value in (("size", F.octet_length("content").cast("long")), ("role", P.role(F.col("path"))), ("duplicate_count", F.lit(0).cast("long"))):
        files = files if name in files.columns else files.withColumn(name, value)
    files = hold(tables.spread(files))
    n_files = files.count()
    compounds = T.compounds(task)
    terms = T.tokenize_task(task, cfg.min_token_len)
    terms = terms + [c for c in compounds if c not in terms]
    code = hold(facts.code_facts(files))
    edges = hold(import_edges(files, code))
    items, excluded, weak, dropped = [], 0, None, 0
    below = over = empty = cut = 0
    if terms and n_files:
        path_counts = path_counts_of(files, terms)
        table = hold(signal_table(files, code, terms, path_counts, None, cfg))
        signals, file_counts = _reweigh(table, terms, compounds, n_files, cfg)
        scored = scoring.score_files(signals, len(terms), cfg)
        copies = F.col("duplicate_count")
        note = F.when(copies > 0, F.concat(F.lit(" ("), copies.cast("string"), F.when(copies == 1, F.lit(" duplicate copy collapsed)")).otherwise(F.lit(" duplicate copies collapsed)")))).otherwise("")
        scored = scored.join(files.select("path", "duplicate_count"), "path").withColumn("reason", F.concat("reason", note)).drop("duplicate_count")
        verified = hold(graph.call_verified(edges, code.filter("kind = 'call'"), code.filter("kind = 'def'")))
        callers = verified.join(scored.filter(F.col("score") > cfg.score_threshold).select(F.col("path").alias("src")), "src", "left_semi")
        owner = callers.groupBy(F.col("dst").alias("path")).agg(F.min("src").alias("caller"))
        lifted = scored.join(owner, "path", "left").withColumn("_own", F.col("caller").isNotNull() & (F.size("matched_terms") > 0))
        lifted = lifted.withColumn("score", F.col("score") + F.when(F.col("_own"), cfg.call_bonus).otherwise(0.0)).withColumn("reason", F.when(F.col("_own"), F.concat(F.lit("called by "), P.basename(F.col("caller")))).otherwise(F.col("reason")))
        lifted = lifted.withColumn("score", F.round("score", 9)).drop("_own", "caller")
        lifted = hold(lifted)
        seeds = [r.asDict() | {"provenance": []} for r in lifted.filter(F.col("score") > cfg.score_threshold).orderBy(F.col("score").desc(), "path").limit(cfg.discovery_limit).collect()]
        followed = _expand(spark, seeds, scored, edges, verified, cfg) if seeds else []
        merged = sorted(seeds + followed, key=lambda x: (-x["score"], x["path"]))
        chosen = bounding.diversify(merged, cfg)
        above = lifted.filter(F.col("score") > cfg.score_threshold).count()
        inside = {x["path"] for x in chosen}
        above_in = lifted.filter((F.col("score") > cfg.score_threshold) & F.col("path").isin(list(inside))).count() if inside else 0
        over, below = above - above_in, n_files - above - (len(chosen) - above_in)
        items, empty, cut, dropped = _attach(spark, chosen, files, code, edges, T.tokenize_task(task, cfg.min_token_len), cfg, hold)
        weak = weak_signal(items, terms, path_counts, file_counts, n_files, cfg) if seeds else None
    else:
        below = n_files
    conflicts = missing = []
    if items:
        conflicts = discrepancies(files, [x["path"] for x in items], terms)
        missing = reference_gaps(files, code, items, conflicts, cfg)
    reasons = {**dict.fromkeys(K.REASONS, 0), **counts, "below_threshold": below, "over_cap": over, "no_excerpt": empty, "over_budget": cut}
    excluded = sum(reasons.values())
    for x in items:
        x["matched_terms"] = list(x["matched_terms"])
    keep = ("path", "role", "reason", "score", "provenance", "excerpts", "matched_terms")
    rules = ["configuration_discrepancy", "test_reference_gap"] if items else []
    return {
        "task": task, "included": [{k: x[k] for k in keep} for x in items], "conflicts": conflicts, "missing": missing, "excluded_count": excluded, "excluded_by_reason": reasons,
        "trace": {"rules_run": rules, "excerpts_dropped_over_budget": dropped}, "weak_signal": weak,
    }


def _attach(spark, chosen, files, code, edges, terms, cfg, hold):
    """Items with excerpts; how many have none, how many lost theirs to the budget, excerpts dropped."""
    if not chosen:
        return [], 0, 0, 0
    importer = [next((e.split(" imports ")[0] for e in reversed(x["provenance"]) if e.split(" imports ")[1] == x["path"]), None) for x in chosen]
    rows = F.broadcast(spark.createDataFrame([(x["path"], float(x["score"]), i) for x, i in zip(chosen, importer)], "path string, score double, importer string"))
    included = files.join(rows, "path").withColumn("asset", P.asset_like(F.col("path"), F.col("content"), cfg.asset_avg_line))
    made = hold(excerpts_of(included, code, edges, terms, cfg, hold).coalesce(1))
    kept = bounding.within_budget(made, F.octet_length("text"), ["score", "path", "start_line"], cfg.package_bytes, hold).collect()
    had = {r["path"] for r in made.select("path").distinct().collect()}
    dropped = made.count() - len(kept)
    by: dict[str, list] = {}
    for r in sorted(kept, key=lambda r: (r["path"], r["start_line"])):
        by.setdefault(r["path"], []).append({"start_line": r["start_line"], "end_line": r["end_line"], "text": r["text"]})
    items = [x | {"excerpts": by[x["path"]]} for x in chosen if x["path"] in by]
    cut = sum(x["path"] in had and x["path"] not in by for x in chosen)
    return items, len(chosen) - len(items) - cut, cut, dropped


def to_json(package: dict) -> str:
    return json.dumps(package, ensure_ascii=False)


def package_frame(spark: SparkSession, package: dict) -> DataFrame:
    """The package's items as a DataFrame."""
    schema = "path string, role string, reason string, score double, provenance array<string>, excerpts array<struct<start_line: int, end_line: int, text: string>>, matched_terms array<string>"
    return spark.createDataFrame(package["included"], schema)
