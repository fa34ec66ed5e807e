"""The engine's operators as queries over the harness tables, each with SQL for the same result.

`documents` stands for a corpus of files (docs/<source>/<doc_id>.md) and `pages.url` for paths.
Operators on code have no such input in the tables; their queries run on literal rows here and on
mini-repositories in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P
from ..functions import text as T
from ..operators import bounding, checks, dedupe, graph, scoring
from ..sources import ignore
from ..sources.tables import spread

TERMS = ["thention", "tion", "erber", "schen", "wh"]
N = len(TERMS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a corpus of files."""
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    content = F.coalesce("text", F.lit(""))
    return spread(table(spark, sf, "documents")).select(path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"), F.lit("docs").alias("role"))


FILES = "f as (select 'docs/' || coalesce(source, '') || '/' || doc_id || '.md' as path, coalesce(text, '') as content, octet_length(encode(coalesce(text, '')))::bigint as size from documents)"


def _sql_count(term: str) -> str:
    """Occurrences with identifier boundaries, in a dialect without look-around: every delimiter is
    doubled, so that neighbours do not share one."""
    u, r = term[0].upper(), term[1:]
    return (
        r"len(regexp_extract_all(regexp_replace(content, '([^\p{L}\p{N}])', '\1\1', 'g'), "
        rf"'(?:(?:^|[^\p{{L}}\p{{N}}])(?i:{term})(?:$|[^\p{{L}}\p{{N}}])|(?:^|[^\p{{L}}\p{{N}}]|[\p{{Ll}}\p{{Nd}}]){u}(?i:{r})(?:$|[^\p{{L}}\p{{N}}]|\p{{Lu}}))'))::bigint"
    )


SIGNALS = "s as materialized (" + " union all ".join(f"select path, {i} as pos, '{t}' as term, {_sql_count(t)} as cnt from f" for i, t in enumerate(TERMS)) + ")"
BASE = f"with {FILES}, {SIGNALS}"


def signals(spark, sf):
    return scoring.content_signals(files(spark, sf), TERMS)


def full_signals(spark, sf):
    one = lambda t: F.struct(
        F.lit(t).alias("term"), T.count_word(F.col("content"), t).cast("long").alias("cnt"), F.lit(0.0).alias("fn"), F.lit(0).alias("n_defs"),
        F.lit("").alias("first_def"), F.lit(0).alias("first_seq"), F.lit(1.0).alias("weight"),
    )
    return scoring.signal_rows(files(spark, sf), ["path", "role", "size", F.lit(1.0).alias("damp"), F.lit(1.0).alias("penalty")], [one(t) for t in TERMS])


def scored(spark, sf):
    return scoring.score_files(full_signals(spark, sf), N)


SCORED = f"""{BASE}, q as (
  select path, case when count(*) filter (cnt > 0) = 0 then 0.0 else
    (sum(least(6.0, 2.0 * ln(1 + cnt))) + 2.0) * count(*) filter (cnt > 0) / {N}.0 end as raw,
    count(*) filter (cnt > 0) as n_matched from s group by path), sc as (select path, round(raw, 9) as score, n_matched from q)"""

#: Signals of every kind, made from columns that each document has: a role by language, damping by size,
#: a path penalty by source, file names by the text's first letter, definitions by counts.
MIXED = f"""{BASE}, m as (
  select s.path, pos, term, cnt, case lang when 'en' then 'source' when 'fr' then 'test' when 'de' then 'config' else 'docs' end as role,
    case when size > 3000 then 0.25 else 1.0 end::double as damp, case when source like '%7' then 0.3 else 1.0 end::double as penalty,
    case when lower(left(content, 1)) = left(term, 1) then 1.0 / (1 + pos) else 0.0 end::double as fn,
    case when pos % 2 = 0 then least(cnt, 3) else 0 end as n_defs, 1.0 / (1 + pos) as weight
  from s join f using (path) join (select 'docs/' || coalesce(source, '') || '/' || doc_id || '.md' as path, lang, source from documents) using (path)
), g as (
  select path, any_value(role) as role, any_value(damp) as damp, any_value(penalty) as penalty, any_value(role) = 'test' as test,
    count(*) filter (cnt > 0 or fn > 0 or n_defs > 0) as n_matched,
    sum(least({K.DEFAULT.content_cap}, {K.DEFAULT.content_mult} * ln(1 + cnt)) * weight) as content, sum({K.DEFAULT.weight_symbol} * n_defs * weight) as symbol,
    sum({K.DEFAULT.weight_filename} * fn * weight) as name, min(pos) filter (fn > 0) as by_name, max(pos) filter (n_defs > 0) as by_def, max(cnt) as most
  from m group by path
)"""


def mixed_signals(spark, sf):
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    content = F.coalesce("text", F.lit(""))
    rows = spread(table(spark, sf, "documents")).select(path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"), "lang", "source")
    counted = rows.select("*", F.explode(F.array(F.array(*[T.count_word(F.col("content"), t).cast("long") for t in TERMS]))).alias("counts"))

    def one(i, term):
        cnt = F.get("counts", F.lit(i))
        defs = F.least(cnt, F.lit(3)).cast("int") if i % 2 == 0 else F.lit(0)
        return F.struct(
            F.lit(term).alias("term"), cnt.alias("cnt"), F.when(F.lower(F.left("content", F.lit(1))) == term[0], 1.0 / (1 + i)).otherwise(0.0).alias("fn"), defs.alias("n_defs"),
            F.when(defs > 0, f"about_{term}").otherwise("").alias("first_def"), F.lit(100 - i).alias("first_seq"), F.lit(1.0 / (1 + i)).alias("weight"),
        )

    role = F.when(F.col("lang") == "en", "source").when(F.col("lang") == "fr", "test").when(F.col("lang") == "de", "config").otherwise("docs")
    damp = F.when(F.col("size") > 3000, 0.25).otherwise(1.0)
    penalty = F.when(F.col("source").endswith("7"), 0.3).otherwise(1.0)
    return scoring.signal_rows(counted, ["path", role.alias("role"), "size", damp.alias("damp"), penalty.alias("penalty")], [one(i, t) for i, t in enumerate(TERMS)])


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"{BASE} select path, term, cnt from s where cnt > 0")
def word_match_count(spark, sf):
    return signals(spark, sf).filter("cnt > 0").select("path", "term", "cnt")


@query(f"{BASE} select path, term, round(least(6.0, 2.0 * ln(1 + cnt)), 9) as score from s where cnt > 0")
def content_tf_score(spark, sf):
    return signals(spark, sf).filter("cnt > 0").select("path", "term", F.round(scoring.content_score(F.col("cnt")), 9).alias("score"))


@query(f"{SCORED} select path, score, n_matched from sc")
def coverage_scaled_score(spark, sf):
    return scored(spark, sf).select("path", F.round("score", 9).alias("score"), F.size("matched_terms").cast("long").alias("n_matched"))


@query(f"{BASE} select term, count(*) as n_files from s where cnt > 0 group by term")
def term_document_frequency(spark, sf):
    return signals(spark, sf).filter("cnt > 0").groupBy("term").agg(F.count("*").alias("n_files"))


@query(f"{BASE} select path, 'mentions ' || arg_max(term, cnt * 100 - pos) as reason from s where cnt > 0 group by path")
def leading_reason(spark, sf):
    return scored(spark, sf).filter(F.size("matched_terms") > 0).select("path", "reason")


@query(f"{SCORED} select row_number() over (order by score desc, path)::int as rank, path, score from sc where score > 2.0 qualify rank <= 60")
def threshold_topk(spark, sf):
    return scoring.top_ranked(scored(spark, sf)).select("rank", "path", "score")


_STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
_CAMEL = r"regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"


@query(f"select item_id, array_to_string(list_filter(string_split_regex(lower({_CAMEL}), '[^a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({_STOP})), ' ') as terms from benchmark")
def tokenize(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.tokenize(F.col("text")), " ").alias("terms"))


# paths from pages: the url's host as the root, with folders and endings that exercise every rule
FOLDERS = ["src", "tests", "data", "config", "docs", "examples", "legacy", "v2", "vendor", "releases", ".git", "node_modules"]
ENDINGS = [".py", ".md", ".json", ".txt", ".js", "/.env", ".csv", "/changelog.md", "_test.py"]


def url_paths(spark, sf):
    """(page_id, path): host/locale/number of every page."""
    rest = F.regexp_extract("url", r"://([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(rest, "/+$", "").alias("path"))


def made_paths(spark, sf):
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (F.col("page_id") % len(FOLDERS)).cast("int") + 1)
    ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("page_id") % len(ENDINGS)).cast("int") + 1)
    return url_paths(spark, sf).select("page_id", F.concat(folder, F.lit("/"), "path", ending).alias("path"))


URLS = r"u as (select page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') as path from pages)"
MADE = f"{URLS}, p as (select page_id, {FOLDERS}[page_id % {len(FOLDERS)} + 1] || '/' || path || {ENDINGS}[page_id % {len(ENDINGS)} + 1] as path from u)"
PARTS = f"with {MADE}, d as (select page_id, path, string_split(path, '/')[:-2] as dirs, string_split(path, '/')[-1] as name, case when string_split(path, '/')[-1] = '.env' then '.env' else lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1)) end as ext from p)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_DATA = f"len(list_filter(dirs, lambda s: list_contains({_list(K.DATA_DIRS)}, lower(s)))) > 0"


@query(f"""{PARTS} select page_id, path, case
  when list_contains(dirs, 'tests') or name like 'test\\_%' escape '\\' or name like '%\\_test.py' escape '\\' then 'test'
  when {_DATA} and not list_contains({_list(K.SOURCE_EXTENSIONS)}, ext) then 'other'
  when list_contains({_list(K.CONFIG_EXTENSIONS)}, ext) or list_contains(dirs, 'config') then 'config'
  when list_contains({_list(K.DOCS_EXTENSIONS)}, ext) or list_contains(dirs, 'docs') then 'docs'
  when list_contains({_list(K.SOURCE_EXTENSIONS)}, ext) then 'source' else 'other' end as role from d""")
def classify_role(spark, sf):
    return made_paths(spark, sf).select("page_id", "path", P.role(F.col("path")).alias("role"))


@query(f"""{PARTS} select page_id, {_DATA} as in_data,
  len(list_filter(dirs, lambda s: list_contains({_list(K.EXAMPLE_DIRS)}, lower(s)))) > 0 as in_example,
  len(list_filter(dirs, lambda s: list_contains({_list(K.LEGACY_DIRS)}, lower(s)) or regexp_matches(lower(s), '^v[0-9]+$'))) > 0 as in_legacy,
  name = 'changelog.md' or len(list_filter(dirs, lambda s: list_contains({_list(K.HISTORY_DIRS)}, lower(s)))) > 0 as is_history from d""")
def path_penalty_flags(spark, sf):
    p = F.col("path")
    return made_paths(spark, sf).select("page_id", P.in_data(p).alias("in_data"), P.in_example(p).alias("in_example"), P.in_legacy(p).alias("in_legacy"), P.is_history(p).alias("is_history"))


# a segment's words are among its own words or its stem's
WORDS = rf"""with {URLS}, w as (select distinct path, unnest(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda w: w <> '')) as word from u)"""


@query(f"{WORDS} select word, count(*) as n_files from w group by word")
def path_word_df(spark, sf):
    return scoring.path_word_counts(url_paths(spark, sf).select("path"))


@query(f"{WORDS} select word, round(case when count(*) <= 1 then 1.0 else 1.0 / (1.0 + ln(count(*))) end, 9) as weight from w group by word")
def rarity_weight(spark, sf):
    return scoring.path_word_counts(url_paths(spark, sf).select("path")).select("word", F.round(scoring.rarity(F.col("n_files")), 9).alias("weight"))


@query(f"""{BASE} select term, n_files, round(case when n_files / total <= 0.05 then 1.0 else 0.05 / (n_files / total) end, 9) as weight
  from (select term, count(*) as n_files from s where cnt > 0 group by term), (select count(*)::double as total from f)""")
def fragment_weight(spark, sf):
    total = files(spark, sf).count()
    return term_document_frequency(spark, sf).select("term", "n_files", F.round(scoring.fragment_weight(F.col("n_files"), F.lit(float(total))), 9).alias("weight"))


_LINES = "(len(content) - len(replace(content, chr(10), '')))"
_AVG = f"case when content = '' then 0.0 else (len(content) - {_LINES})::double / greatest({_LINES} + case when content like '%' || chr(10) then 0 else 1 end, 1) end"


@query(f"with {FILES} select path, round({_AVG}, 9) as average_line, {_AVG} > 500 as asset from f")
def asset_like_avg_line(spark, sf):
    c = F.col("content")
    return files(spark, sf).select("path", F.round(P.average_line(c), 9).alias("average_line"), P.asset_like(F.col("path"), c).alias("asset"))


@query(f"""with {FILES}, g as (select case when size % 3 = 0 then replace(path, '.md', '.go') else path end as path, size, {_AVG} as a from f)
  select path, (case when size <= 5000 then 1.0 when a > 500 then 0.3 when path like '%.go' and a <= 200 then 0.6 else 0.3 end)::double as factor from g""")
def large_content_penalty(spark, sf):
    rows = files(spark, sf).withColumn("path", F.when(F.col("size") % 3 == 0, F.replace("path", F.lit(".md"), F.lit(".go"))).otherwise(F.col("path")))
    p, c = F.col("path"), F.col("content")
    cfg = K.Config(large_file_bytes=5000)
    return rows.select("path", P.large_penalty(p, F.col("size"), c, P.asset_like(p, c), F.lit(0), F.lit(False), cfg).alias("factor"))


@query(f"""{BASE} select term, 0::bigint as n_paths, n_files, n_files <= 5 or n_files >= 0.15 * total as weak
  from (select term, count(*) filter (cnt > 0) as n_files from s group by term), (select count(*) as total from f)""")
def weak_signal(spark, sf):
    total = files(spark, sf).count()
    facts = signals(spark, sf).groupBy("term").agg(F.sum((F.col("cnt") > 0).cast("long")).alias("n_files")).withColumn("n_paths", F.lit(0).cast("long"))
    return scoring.weak_terms(facts, F.lit(total)).select("term", "n_paths", "n_files", "weak")


@query(f"""with w as (select unnest(list_filter(string_split_regex(lower({_CAMEL}), '[^a-z0-9]+'), lambda w: w <> '')) as word from benchmark)
  select case when length(word) >= 6 then left(word, 5) else word end as stem, count(*) as n, count(distinct word) as n_words from w group by 1""")
def prefix_stem_counts(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word"))
    return rows.groupBy(T.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_words"))


@query(f"""with {FILES} select path, count(*) over w - 1 as duplicate_count from f
  window w as (partition by size, case when size > 0 then sha256(content) else path end) qualify row_number() over (w order by len(string_split(path, '/')), path) = 1""")
def dedupe_exact(spark, sf):
    return dedupe.dedupe_content(files(spark, sf)).select("path", "duplicate_count")


LOCALE_ROWS = f"""with {URLS}, x as (select page_id, path, string_split(path, '/') as s from u),
  l as (select page_id, path, s, i, array_to_string(s[:i], '/') as parent, s[i + 1] as seg from x, unnest(range(1, len(s))) as t(i) where regexp_matches(s[i + 1], '^[a-z]{{2,3}}(-[a-z0-9]{{2,4}})?$')),
  r as (select parent, count(distinct seg) as n from l group by parent having count(distinct seg) >= 3)"""


@query(f"{LOCALE_ROWS} select parent, n from r")
def locale_roots(spark, sf):
    return dedupe.locale_roots(url_paths(spark, sf))


@query(f"""{LOCALE_ROWS}, b as (select page_id, path, parent, seg, array_to_string(s[i + 2:], '/') as rest from l join r using (parent) qualify row_number() over (partition by page_id order by i) = 1),
  k as (select page_id, count(*) over (partition by parent, rest) - 1 as dropped, row_number() over (partition by parent, rest order by seg <> 'en', seg, path) as rn from b)
  select u.path, coalesce(dropped, 0) as duplicate_count from u left join k using (page_id) where rn is null or rn = 1""")
def dedupe_locale_mirror(spark, sf):
    return dedupe.dedupe_locales(url_paths(spark, sf).select("path").distinct()).select("path", "duplicate_count")


SQL["dedupe_locale_mirror"] = SQL["dedupe_locale_mirror"].replace(URLS, "u as (select row_number() over (order by path) as page_id, path from (select distinct regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') as path from pages))")


@query(f"{PARTS} select page_id, path from d where not list_has_any(string_split(path, '/'), {_list(K.DENYLIST_DIRS)})")
def scan_denylist(spark, sf):
    return ignore.drop_denied(made_paths(spark, sf)).select("page_id", "path")


@query(f"with {FILES} select case when size > 20000 then 'oversize' else 'kept' end as bucket, count(*) as n, sum(size)::bigint as bytes from f group by 1")
def scan_oversize(spark, sf):
    rows = ignore.with_size_bucket(files(spark, sf), 20_000)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


RULES = ["*.html", "!/*/en/*.html", "de/", "!fr", "/*/es/1*"]


def _rule(x: str) -> str:
    """The number of the last of RULES that fits x, a path or a folder with its slash."""
    fits = [r"\.html($|/)", r"^[^/]*/en/[^/]*\.html($|/)", r"(^|/)de/", r"(^|/)fr($|/)", r"^[^/]*/es/1[^/]*($|/)"]
    return "greatest(" + ", ".join(f"case when regexp_matches({x}, '{p}') then {i + 1} end" for i, p in enumerate(fits)) + ")"


@query(f"""with {URLS}, m as (select page_id, path, string_split(path, '/') as s from u),
  v as (select page_id, path, {_rule("path")} as own, list_transform(range(1, len(s)), lambda i: array_to_string(s[:i], '/') || '/') as folders from m)
  select page_id, path, coalesce(own in (1, 3, 5), false) or len(list_filter(folders, lambda d: coalesce({_rule("d")} in (1, 3, 5), false))) > 0 as ignored from v""")
def ignore_last_match_wins(spark, sf):
    return ignore.verdict(url_paths(spark, sf), ignore.compile_rules("", RULES)).select("page_id", "path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


@query(f"""with {FILES}, l as (select path, unnest(string_split(content, chr(10))) as content, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from f)
  select path, line::int as line from l where {_sql_count("thention")} > 0""")
def matched_lines(spark, sf):
    rows = files(spark, sf).select("path", F.posexplode(T.lines_of(F.col("content"))).alias("i", "text"))
    return rows.filter(T.has_word(F.col("text"), "thention")).select("path", (F.col("i") + 1).alias("line"))


_SPANS = "x as (select distinct l_suppkey as g, l_orderkey as s, l_orderkey + l_quantity::bigint as e from lineitem)"


@query(f"""with {_SPANS}, y as (select *, max(e) over (partition by g order by s, e rows between unbounded preceding and 1 preceding) as far from x),
  z as (select *, sum(case when far is null or s > far + 1 then 1 else 0 end) over (partition by g order by s, e) as k from y)
  select g, min(s) as s, max(e) as e, count(*) as weight from z group by g, k""")
def merge_spans(spark, sf):
    end = F.col("l_orderkey") + F.col("l_quantity").cast("long")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("s"), end.alias("e"), F.lit(1).cast("long").alias("weight"))
    return bounding.merge_spans(rows, ["g"], rows=rows.count())


@query("select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::int as rn from documents qualify rn <= 3")
def topk_per_group(spark, sf):
    return bounding.top_per_group(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), "doc_id"], 3).select("source", "doc_id", "rn")


@query(r"select doc_id, sha256(case when length(text) > 2000 then regexp_replace(left(text, 2000), '\s+$', '') || ' …[truncated]' else text end) as sha from documents")
def truncate_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.truncate_chars(F.col("text")), 256).alias("sha"))


@query(f"""with {FILES}, b as (select path, size, sum(size) over () as total, coalesce(sum(size) over (order by size, path rows between unbounded preceding and 1 preceding), 0) as run from f)
  select path, size from b where total - run <= 1000000""")
def byte_budget_eviction(spark, sf):
    rows = files(spark, sf).select("path", "size")
    return bounding.within_budget(rows, F.col("size"), ["size", "path"], 1_000_000)


_RUN = K.LONG_RUN


@query(f"""with x as (select doc_id, string_split_regex(text, '{_RUN}') as p, regexp_extract_all(text, '{_RUN}') as r from documents where regexp_matches(text, '{_RUN}'))
  select doc_id, len(list_filter(r, lambda y: regexp_matches(y, '[0-9]')))::bigint as n_masked,
    sha256(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || case when i > len(r) then '' when regexp_matches(r[i], '[0-9]') then '{T.MASK}' else r[i] end), '')) as sha from x""")
def redact_entropy(spark, sf):
    rows = table(spark, sf, "documents").filter(F.col("text").rlike(_RUN))
    runs = F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))
    return rows.select("doc_id", F.size(F.filter(runs, lambda x: x.rlike("[0-9]"))).cast("long").alias("n_masked"), F.sha2(T.mask_entropy(F.col("text")), 256).alias("sha"))


@query(f"""{MIXED}, term_of as (select distinct pos, term from s), t as (
    select g.path, min(m.pos) as first_most from g join m on m.path = g.path and m.cnt = g.most and g.most > 0 group by g.path)
  select path, role, round(case when n_matched = 0 then 0.0 else penalty * (name + n_matched / {N}.0 * (
      symbol * case when test then {K.DEFAULT.test_damping} else 1.0 end + content * damp * case when test then {K.DEFAULT.test_damping} else 1.0 end
      + case when role in ('config', 'docs') then {K.DEFAULT.role_bonus} else 0.0 end)) end, 6) as score, n_matched::int as n_matched,
    case when by_name is not null then 'filename matches ' || chr(39) || a.term || chr(39) when by_def is not null then 'defines about_' || b.term
      when most > 0 then 'mentions ' || c.term else 'matches task terms' end as reason
  from g left join t using (path) left join term_of a on a.pos = by_name left join term_of b on b.pos = by_def left join term_of c on c.pos = first_most""")
def mixed_signal_score(spark, sf):
    rows = scoring.score_files(mixed_signals(spark, sf), N)
    return rows.select("path", "role", F.round("score", 6).alias("score"), F.size("matched_terms").alias("n_matched"), "reason")


@query(f"{SCORED}, two as (select path, score from sc where score > 4 union all select path, round(score / 2, 9) from sc where score > 2 and score <= 4) select path, score, row_number() over (order by score desc, path)::int as rank from two qualify rank <= 60")
def union_rank(spark, sf):
    s = scored(spark, sf).withColumn("score", F.round("score", 9))
    both = s.filter("score > 4").unionByName(s.filter("score > 2 and score <= 4").withColumn("score", F.round(F.col("score") / 2, 9)))
    top = both.orderBy(F.col("score").desc(), "path").limit(60)
    return top.select("path", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "path")).alias("rank"))


@query(f"""{SCORED}, r as (select *, row_number() over (order by score desc, path) as rank from sc)
  select case when score > 2 and rank <= 18 then 'included' when score > 2 then 'over_cap' else 'below_threshold' end as bucket, count(*) as n from r group by 1""")
def exclusion_buckets(spark, sf):
    s = scored(spark, sf).withColumn("score", F.round("score", 9))
    included = s.filter("score > 2").orderBy(F.col("score").desc(), "path").limit(18).select("path", F.lit(True).alias("top"))
    bucket = F.when(F.col("top"), "included").when(F.col("score") > 2, "over_cap").otherwise("below_threshold")
    return s.join(included, "path", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""with e as (select distinct l_partkey as src, l_suppkey as dst from lineitem),
  c as (select distinct l_partkey as src, l_returnflag || l_linenumber as name from lineitem where l_quantity > 45),
  d as (select distinct l_suppkey as dst, l_returnflag || l_linenumber as name from lineitem where l_discount > 0.09)
  select src, count(distinct dst) as n_dst from e join c using (src) join d using (dst, name) group by src""")
def call_verified_edges(spark, sf):
    rows = table(spark, sf, "lineitem")
    name = F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name")
    edges = rows.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    calls = rows.filter("l_quantity > 45").select(F.col("l_partkey").alias("path"), name)
    defs = rows.filter("l_discount > 0.09").select(F.col("l_suppkey").alias("path"), name)
    return graph.call_verified(edges, calls, defs).groupBy("src").agg(F.count("*").alias("n_dst"))


@query("""with recursive e as (select distinct 'p' || l_partkey as a, 's' || l_suppkey as b from lineitem), g as (select a, b from e union all select b, a from e),
  w(node, depth) as (select 'p1', 0 union select g.b, w.depth + 1 from w join g on g.a = w.node where w.depth < 2)
  select node, min(depth) as depth from w group by node""")
def bounded_bfs_2hop(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return graph.bounded_bfs(edges, spark.createDataFrame([("p1",)], "node string"), 2)


_CONFIG = [("session.timeout_minutes", "60"), ("cache.ttl", "300"), ("retry.max-count", "3"), ("http.timeout", "30 seconds")]
_DOCS = [("session.timeout_minutes", "30"), ("cache/ttl", "300"), ("retry.max_count", "5"), ("http.timeout", "1 minute"), ("absent.key", "1")]


def _typed(spark, rows):
    df = spark.createDataFrame(rows, "raw_key string, raw string")
    v = T.line_value(F.col("raw"))
    unit = T.unit_from_key(F.col("raw_key"))
    units = F.create_map(*[F.lit(x) for kv in K.UNIT_SECONDS.items() for x in kv])
    bare = F.col("raw").rlike(r"^-?\d+(?:\.\d+)?$")
    number = F.col("raw").cast("double")
    typed = F.when(bare & unit.isNotNull(), F.struct(F.lit("duration").alias("kind"), (number * F.element_at(units, unit)).alias("value"))).when(bare, F.struct(F.lit("number").alias("kind"), number.alias("value"))).otherwise(v)
    return df.select(T.normalise_key(F.col("raw_key")).alias("key"), typed.alias("t")).select("key", "t.kind", "t.value")


@query("""with c(key, kind, value) as (values ('session.timeout_minutes', 'duration', 60 * 60.0), ('cache.ttl', 'number', 300.0), ('retry.max_count', 'number', 3.0), ('http.timeout', 'duration', 30.0)),
  d(key, kind, value) as (values ('session.timeout_minutes', 'duration', 30 * 60.0), ('cache.ttl', 'number', 300.0), ('retry.max_count', 'number', 5.0), ('http.timeout', 'duration', 60.0), ('absent.key', 'number', 1.0))
  select c.key as key, c.kind as kind, c.value::double as config_value, d.value::double as doc_value from c join d using (key, kind) where abs(c.value - d.value) > 1e-9 * greatest(c.value, d.value)""")
def typed_key_mismatch_join(spark, sf):
    out = checks.typed_mismatches(_typed(spark, _CONFIG), _typed(spark, _DOCS))
    return out.select("a.key", "a.kind", F.col("a.value").alias("config_value"), F.col("b.value").alias("doc_value"))


@query("""with c(concept, w) as (values ('session timeout', 'session'), ('session timeout', 'timeout'), ('token refresh', 'token'), ('token refresh', 'refresh')),
  t(word) as (values ('sessions'), ('timeouts'), ('tokens')), s as (select distinct case when length(word) >= 6 then left(word, 5) else word end as s from t)
  select distinct concept from c where case when length(w) >= 6 then left(w, 5) else w end not in (select s from s)""")
def stem_anti_join(spark, sf):
    concepts = spark.createDataFrame([("session timeout", ["session", "timeout"]), ("token refresh", ["token", "refresh"])], "concept string, words array<string>")
    return checks.unreferenced(concepts, spark.createDataFrame([("sessions",), ("timeouts",), ("tokens",)], "word string")).select("concept")


_VALUES = ["waits 30 minutes", "1.5h", "250 ms", "10 secs then 3", "port 8080", "none", "2 hrs", "7 monkeys"]
_DUR = r"(?i)(\d+(?:\.\d+)?)\s*(milliseconds?|minutes?|seconds?|hours?|mins?|secs?|hrs?|ms|m|s|h)\b"
_UNITS = "case " + " ".join(f"when u = '{u}' then {x}" for u, x in K.UNIT_SECONDS.items()) + " end"


@query(f"""with v(line) as (values {", ".join(f"('{x}')" for x in _VALUES)}), x as (select line, regexp_extract(line, '{_DUR}', 1) as n, lower(regexp_extract(line, '{_DUR}', 2)) as u, regexp_extract(line, '\\b(\\d+(?:\\.\\d+)?)\\b', 1) as p from v)
  select line, case when n <> '' then 'duration' when p <> '' then 'number' end as kind, case when n <> '' then n::double * {_UNITS} when p <> '' then p::double end as value from x""")
def duration_normalize(spark, sf):
    rows = spark.createDataFrame([(x,) for x in _VALUES], "line string").withColumn("v", T.line_value(F.col("line")))
    return rows.select("line", "v.kind", "v.value")


_HEADINGS = ["# Session timeout", "It is long.", "", "## Other", "text", "# The session", "more", "last"]


def heading_lines(lines: DataFrame, term: str) -> DataFrame:
    """lines(path, line, text) under a heading with the term: the heading and its non-blank lines up
    to the next heading (a forward fill of the last heading's verdict)."""
    heading = F.col("text").rlike(r"^\s{0,3}#{1,6}\s")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(heading, T.has_word(F.col("text"), term)), ignorenulls=True).over(w)
    return lines.withColumn("_in", inside).filter(F.col("_in") & (F.trim("text") != "")).drop("_in")


@query(f"""with l(line, text) as (values {", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(_HEADINGS))}),
  h as (select *, last_value(case when text like '#%' then lower(text) like '%session%' end ignore nulls) over (order by line) as inside from l) select line, text from h where inside and text <> ''""")
def heading_scoped_lines(spark, sf):
    rows = spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(_HEADINGS)], "path string, line int, text string")
    return heading_lines(rows, "session").select("line", "text")


_PICK = "list_position(list_transform(waiting, lambda x: {}), true)"


@query(f"""{SCORED.replace("with ", "with recursive ", 1)}, roles as (
    select path, score, case regexp_extract(path, '([0-9]+)\\.md$', 1)::bigint % 5 when 0 then 'source' when 1 then 'test' else 'docs' end as role from sc where score > 2.0),
  top as (select *, row_number() over (order by score desc, path) as n from roles qualify n <= {K.DEFAULT.discovery_limit + K.DEFAULT.max_expanded}),
  w(k, waiting, pick, docs) as (
    select 0, list({{'path': path, 'role': role, 'score': score}} order by n), null::struct(path varchar, role varchar, score double), 0 from top
    union all
    select k + 1, list_concat(waiting[:p - 1], waiting[p + 1:]), waiting[p], docs + (waiting[p].role = 'docs')::int from (
      select *, case when waiting[1].role = 'docs' and docs >= ceil((k + 1) * 2 / 3.0 - 1e-9)
        then coalesce(nullif({_PICK.format("x.role in ('source', 'test')")}, 0), nullif({_PICK.format("x.role <> 'docs'")}, 0), 1) else 1 end as p
      from w where len(waiting) > 0 and k < {K.DEFAULT.max_included}))
  select k::int as position, pick.path as path, pick.role as role, pick.score as score from w where k > 0""")
def diversified_topk(spark, sf):
    number = F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("long") % 5
    role = F.when(number == 0, "source").when(number == 1, "test").otherwise("docs")
    return bounding.diversified(scored(spark, sf).withColumn("score", F.round("score", 9)).filter("score > 2").withColumn("role", role))


@query(f"""{SCORED}, k as (select source, 'docs/' || source || '/' || d.doc_id || '.md' as path from documents d join labels l using (doc_id) where quality = 1 and toxic = 1),
  t as (select path from sc where score > 2.0 order by score desc, path limit 60)
  select source, count(*) as n_keys, count(t.path) as n_found, round(count(t.path) / count(*), 9) as recall from k left join t using (path) group by source""")
def recall_at_k(spark, sf):
    from .evaluate import recall

    keys = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1 and toxic = 1").select("doc_id"), "doc_id")
    keys = keys.select("source", F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return recall(keys, scoring.top_ranked(scored(spark, sf)).select("path"), ["source"])


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
