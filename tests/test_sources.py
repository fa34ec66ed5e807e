import pytest

from lodestone.sources import discovery, facts, ignore

RULES = [
    ("*.log", ["a.log", "x/b.log"], ["a.logs"]),
    ("/top.txt", ["top.txt"], ["a/top.txt"]),
    ("build/", ["build/x", "a/build/x"], ["build", "builds/x"]),
    ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["z", "b/a/z"]),
    ("doc/*.md", ["doc/a.md"], ["doc/x/a.md", "x/doc/a.md"]),
    ("**/cache", ["cache", "a/cache/x"], ["caches"]),
    ("x/**", ["x/a", "x/a/b"], ["x", "y/x/a"]),
    ("[ab]?.py", ["ac.py", "q/bz.py"], ["cc.py", "a.py"]),
    ("[!a].py", ["b.py"], ["a.py"]),
    (r"\#odd", ["#odd"], ["odd"]),
]


@pytest.mark.parametrize(("line", "yes", "no"), RULES)
def test_one_rule_per_feature(spark, line, yes, no):
    rules = ignore.compile_rules("", [line])
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    got = {r["path"]: r["ignored"] for r in ignore.verdict(df, rules).collect()}
    assert got == {**dict.fromkeys(yes, True), **dict.fromkeys(no, None)}
    assert all(ignore.match(rules, p, False) for p in yes) and not any(ignore.match(rules, p, False) for p in no)


def test_what_lies_in_an_ignored_folder_stays_ignored(spark):
    rules = ignore.compile_rules("", ["de/", "!fr", "*.tmp", "!keep"]) + ignore.compile_rules("sub", ["out"])
    want = {"h/de/fr/1": True, "h/fr/de": False, "h/fr": False, "de": None, "a.tmp": True, "keep/a.tmp": False, "x.tmp/keep": True, "sub/out/fr": True, "sub": None, "sub/x": None}
    got = {r["path"]: r["ignored"] for r in ignore.verdict(spark.createDataFrame([(p,) for p in want], "path string"), rules).collect()}
    assert got == want


def test_last_match_and_deeper_scope_win():
    rules = ignore.compile_rules("", ["*.log", "!keep.log", "!", "# c", ""]) + ignore.compile_rules("sub", ["keep.log"])
    assert ignore.match(rules, "a.log", False) and ignore.match(rules, "keep.log", False) is False
    assert ignore.match(rules, "sub/keep.log", False) is True and ignore.match(rules, "x.txt", False) is None


def test_discovery(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    root = tmp_path / "root"
    put = lambda p, data="x = 1\n": ((root / p).parent.mkdir(parents=True, exist_ok=True), (root / p).write_bytes(data if isinstance(data, bytes) else data.encode()))
    put(".gitignore", "out/\n*.tmp\n!keep.tmp\n")
    put("src/a.py", "a = 1\r\nb = 2\r")
    put("vendor/a.py", "a = 1\r\nb = 2\r")
    put("out/x.py")
    put("out/y/z.py")
    put("out/.gitignore", "!x.py")
    put("q.tmp")
    put("keep.tmp", "kept")
    put("node_modules/m.js")
    put("bin.dat", b"a\0b")
    put("big.txt", "y" * 600_000)
    put("docs/.gitignore", "secret.md")
    put("docs/secret.md", "s")
    put("docs/_x.md", "underscore")
    for lang in ("en", "de", "fr"):
        put(f"site/{lang}/page.md", f"page {lang}")
    (root / "link").symlink_to(tmp_path)
    files, counts = discovery.discover_files(spark, str(root))
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == {".gitignore", "src/a.py", "keep.tmp", "docs/.gitignore", "docs/_x.md", "site/en/page.md"}
    assert counts == {"ignored": 5, "oversize": 1, "binary": 1, "duplicate": 3}
    assert rows["src/a.py"]["content"] == "a = 1\nb = 2\n" and rows["src/a.py"]["duplicate_count"] == 1
    assert rows["site/en/page.md"]["duplicate_count"] == 2


def test_config_readers():
    yaml = "session:\n  timeout_minutes: 60  # long\n  deep:\n    x: '1 # 2'\nlist:\n  - a: 1\ntop: 5\nblock: |\n  text\n"
    assert facts.config_entries_of("a.yaml", yaml) == [("session.timeout_minutes", "60", 2), ("session.deep.x", "'1 # 2'", 4), ("top", "5", 7)]
    assert facts.config_entries_of("a.ini", "[s]\na = 1 ; c\n# x\nb=\n[t.u]\nc = 2") == [("s.a", "1", 2), ("t.u.c", "2", 6)]
    assert facts.config_entries_of(".env", "A=1\nB: 2\n") == [("A", "1", 1)]
    assert facts.config_entries_of("a.json", '{"a": {"b": 1,\n "c": null}, "l": [1]}') == [("a.b", "1", 1), ("a.c", "", 2)]
    assert facts.config_entries_of("a.json", "{") == facts.config_entries_of("a.txt", "a: 1") == []


def test_document_readers():
    text = "Default settings:\n\n```yaml\na:\n  b: 1\n```\nFor example, default:\n```yaml\nc: 2\n```\n| Setting | Other | Default |\n|---|---|---|\n| `x.y` | z | 3 |\n| short | 4 |\nRequired\n~~~ini\nq = 5\n"
    assert facts.doc_entries_of("d.md", text) == [("a.b", "1", 5), ("q", "5", 17), ("x.y", "3", 13)]


def test_code_facts():
    code = "import a.b\nfrom ..p import q as r, *\ndef f(x):\n    if g(x) and h.k():\n        raise E\n    if m():\n        n()\n"
    rows = facts.code_facts_of(code.replace(", *", ""))
    kinds = lambda k: [r[1] for r in rows if r[0] == k]
    assert kinds("import") == ["a.b"] and kinds("def") == ["f"] and sorted(kinds("gate")) == ["g", "k"]
    assert [(r[1], r[4], r[5]) for r in rows if r[0] == "from"] == [("p", 2, ["q"])]
    assert facts.code_facts_of("def (") == [] == facts.code_facts_of("\0")
