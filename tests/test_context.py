"""Whole packages over small corpora; the first has the shape of an authentication demo."""

import json

import pytest

from lodestone import __main__ as cli
from lodestone.constants import Config
from lodestone.operators import bounding
from lodestone.plans import context, evaluate, render

AUTH = {
    "src/auth/guard.py": "from src.users.session import is_session_expired\n\n\nclass AuthenticationError(Exception):\n    pass\n\n\ndef check(s):\n    if is_session_expired(s):\n        raise AuthenticationError('authentication: authentication; authentication, authentication. authentication')\n    return s\n",
    "src/users/session.py": "def is_session_expired(s):\n    return s is None\n\n\ndef unrelated():\n    return 1\n",
    "tests/test_auth.py": "# authentication\nfrom src.auth.guard import check\n\n\ndef test_check():\n    assert check(1) == 1\n",
    "config/auth.yaml": "# authentication\nsession:\n  timeout_minutes: 60\n  api_key: abcdefgh\n",
    "docs/security.md": "# Authentication\n\nDefault values:\n\n```yaml\nsession:\n  timeout_minutes: 30\n```\n",
    "docs/style.md": "Nothing to see.\n",
    "src/billing/invoice.py": "def total(x):\n    return x\n",
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


@pytest.fixture(scope="module")
def package(spark):
    return context.get_context(spark, "fix the authentication bug", files=frame(spark, AUTH))


def test_package(package):
    by = {x["path"]: x for x in package["included"]}
    assert list(by)[0] == "src/auth/guard.py" and by["src/auth/guard.py"]["reason"] == "defines AuthenticationError"
    assert by["src/users/session.py"]["reason"] == "called by guard.py" and by["src/users/session.py"]["score"] == 6.0
    assert by["src/users/session.py"]["provenance"] == ["src/auth/guard.py imports src/users/session.py"]
    assert by["tests/test_auth.py"]["reason"] == "calls guard.py"
    assert "src/billing/invoice.py" not in by and package["excluded_by_reason"]["below_threshold"] == 2
    assert len(package["excluded_by_reason"]) == 8 and package["excluded_count"] + len(by) == len(AUTH)
    assert by["src/users/session.py"]["excerpts"][0]["start_line"] == 1
    assert "abcdefgh" not in json.dumps(package)


def test_findings(package):
    (conflict,) = package["conflicts"]
    assert conflict["setting"] == "session.timeout_minutes" and (conflict["config"]["line"], conflict["doc"]["line"]) == (3, 7)
    assert {(g["term"], g["path"]) for g in package["missing"]} == {("session timeout minutes", "config/auth.yaml"), ("session expired", "src/users/session.py")}


def test_the_same_for_any_partitioning(spark, package):
    again = context.get_context(spark, "fix the authentication bug", files=frame(spark, dict(reversed(AUTH.items()))).repartition(5))
    assert context.to_json(again) == context.to_json(package)


def test_rendering(package):
    text = render.render(package, width=100, unicode_ok=False)
    assert "src/auth/guard.py" in text and "<- via guard.py" in text and "declares 60 minutes" in text
    assert all(len(line) <= 100 for line in text.splitlines())
    assert "lines 1-2" in render.render(package, verbose=True, show_all=True, width=60)
    narrow = render.columns(["a" * 80], 40)
    assert narrow[2] and render.columns(["a" * 20], 100) == (20, 76, False)


def test_expansion_is_bounded(spark):
    chain = {"a.py": "import b\nzebra = 1\ndef zebra_one(): pass\n", "b.py": "import c\n", "c.py": "import d\n", "d.py": "x = 1\n"}
    got = context.get_context(spark, "zebra zebra", files=frame(spark, chain))
    reached = [x["path"] for x in got["included"]]
    assert "d.py" not in reached


def test_relative_and_package_imports(spark):
    files = {"p/__init__.py": "", "p/m.py": "from . import n\nfrom .q import f\nfrom .. import z\nimport p\n", "p/n.py": "", "p/q.py": "def f(): pass\n", "z.py": ""}
    from lodestone.sources import facts

    df = frame(spark, files)
    rows = {(r["src"], r["dst"], r["name"]) for r in context.import_edges(df, facts.code_facts(df)).collect()}
    assert rows == {("p/m.py", "p/n.py", None), ("p/m.py", "p/__init__.py", "n"), ("p/m.py", "p/q.py", "f"), ("p/m.py", "z.py", None), ("p/m.py", "p/__init__.py", None)}


def test_bad_input(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        context.get_context(spark, "  ", root=str(tmp_path))
    with pytest.raises(NotADirectoryError):
        context.get_context(spark, "x", root=str(tmp_path / "none"))
    assert cli.main(["task", "--root", str(tmp_path / "none")]) == 2 == cli.main([" ", "--root", str(tmp_path)]) == cli.main(["-json", "x"])
    empty = context.get_context(spark, "zebra", root=str(tmp_path))
    assert empty["included"] == [] and "No relevant context" in render.render(empty)


def test_diversity():
    rows = [{"role": "docs", "i": i} for i in range(10)] + [{"role": "other", "i": 10}, {"role": "source", "i": 11}]
    got = [r["i"] for r in bounding.diversify(rows, Config(max_included=6))]
    assert got == [0, 1, 11, 2, 3, 10]


def test_budget(spark):
    df = spark.createDataFrame([("a", 1, 40), ("b", 2, 30), ("c", 3, 30)], "p string, s int, n int")
    kept = lambda budget: sorted(r["p"] for r in bounding.within_budget(df, df["n"], ["s", "p"], budget).collect())
    assert kept(100) == ["a", "b", "c"] and kept(99) == ["b", "c"] and kept(59) == ["c"] and kept(10) == []


def test_answer_keys():
    good = {"repo": "r", "group": "g", "task": "t", "files": {"a": "why"}}
    evaluate.validate_keys([good])
    for bad in ({"files": {}}, {"anchors": {"b": ["x"]}}, {"anchors": {"a": []}}):
        with pytest.raises(ValueError):
            evaluate.validate_keys([good | bad])
    with pytest.raises(ValueError):
        evaluate.validate_keys([good, good])


def test_stream(spark, tmp_path):
    from lodestone.streaming import content_scores

    df = frame(spark, AUTH)
    df.write.parquet(f"{tmp_path}/in")
    stream = content_scores(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["authentication"])
    q = stream.writeStream.format("memory").queryName("scores").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(spark.table("scores").collect()) == key(content_scores(df, ["authentication"]).collect())


def test_cases_and_totals(package):
    entry = {"repo": "demo", "group": "g", "task": "t", "files": {"src/auth/guard.py": "x", "absent.py": "y"}, "anchors": {"src/auth/guard.py": ["AuthenticationError", "nowhere"]}, "task_variants": {"short": "u"}}
    cases = evaluate.run_cases([entry], lambda repo, task: package)
    assert len(cases) == 2 and cases[0]["deterministic"] and cases[0]["leaks"] == 0
    assert evaluate.totals(cases)["all"] == {"keys": 4, "in_package": 2, "in_top": 2, "anchors": 4, "anchors_found": 2, "leaks": 0}


def test_server():
    import io

    from lodestone.server import Server

    def run(task, root):
        if not task:
            raise ValueError("the task is empty")
        return {"task": task, "root": root}

    call = lambda i, arguments, name="get_context": {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": arguments}}
    sent = [{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, call(3, {"task": "t"}), call(4, {}), call(5, {}, "other")]
    out = io.StringIO()
    Server(run).serve([json.dumps(m) for m in sent] + ["", "{"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["get_context"]
    assert json.loads(got[2]["result"]["content"][0]["text"]) == {"task": "t", "root": "."} and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601


def test_score_of_one_file(spark):
    body = "def login(user):\n    return user\n"
    alone = context.score_file(spark, "src/login.py", body, ["login"])
    assert alone > 0
    assert context.score_file(spark, "src/login.py", body, ["login"], {"login": 50}) < alone
    assert context.score_file(spark, "src/login.py", body, ["login"], weights={"login": 0.5}) < alone
    assert context.score_file(spark, "src/login.py", body, ["absent"]) == 0.0 == context.score_file(spark, "src/login.py", body, [])


def test_nothing_stays_in_memory(spark):
    spark.catalog.clearCache()
    kept = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = kept()
    context.get_context(spark, "fix the authentication bug", files=frame(spark, AUTH))
    assert kept() <= before


def test_long_options_with_one_dash(capsys):
    assert cli.main(["task", "-json"]) == 2 and "usage" in (said := capsys.readouterr().err) and "--json" in said
    assert cli.main(["task", "-root=x"]) == 2 and "--root=x" in capsys.readouterr().err
