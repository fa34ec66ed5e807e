import random
import re

import numpy as np
import pyarrow as pa

from lodestone.llm import jaccard_join as jj

from .cases import empty, frame


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    links = {i: set() for i in sets}
    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in sets.items():
        seen = {}
        for g in s:
            for j in index[g]:
                seen[j] = seen.get(j, 0) + 1
        links[i] = {j for j, c in seen.items() if j != i and c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9}
    label = {}
    for i in sorted(sets):
        stack = [i] if i not in label else []
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = i
                stack += links[x]
    return {i: (label[i], len(links[i])) for i in sets}


def result(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_documents(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    got = result(jj.op10_lsh_forest(spark, "/root/testdata/sf0.01"))
    assert set(got) == set(want)
    found = sum(got[i][1] for i in want)
    total = sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)  # only true links
    assert total > 100 and found >= 0.995 * total


def test_tiles_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # one dense group of near copies, one of exact copies
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base)) for i in range(7)] + [(300 + i, " ".join(rng.choice(base) for _ in range(50))) for i in range(20)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for tile in (256, 8):
        monkeypatch.setattr(jj, "TILE", tile)
        assert result(jj.join_near(df)) == want


def test_shortest_prefix_meets_the_target():
    assert jj.shortest_prefix(0.8, 0.5) == jj.DEPTH
    d = jj.shortest_prefix()
    assert 1 - (1 - 0.8**d) ** jj.TREES >= jj.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jj.TREES


def test_revision_chains(spark):
    """Each text is the one before, shifted by some words: long paths of links in the order of the ids."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(100 + 10 * 800)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(800)]  # Jaccard 0.81 with the next
    words = [f"v{rng.randrange(10**9)}" for _ in range(200 + 8 * 300)]
    rows += [(1000 + i, " ".join(words[8 * i : 8 * i + 200])) for i in range(300)]  # with the next two
    want = brute(rows)
    got = result(jj.join_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert len(set(label for label, _ in want.values())) == 2
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)


def test_boilerplate_forms_no_chains(spark):
    """Texts that share 40 % of their grams meet in trees, but are no candidates of each other."""
    rng = random.Random(6)
    shared = [f"b{i}" for i in range(140)]
    rows = [(i, " ".join(shared + [f"u{rng.randrange(10**9)}" for _ in range(100)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    reps = jj.sketch(df).withColumnRenamed("doc_id", "rep_id")
    assert jj.candidates(reps, 0.8, 0.999).count() == 0
    assert all(n == 0 for _, n in result(jj.join_near(df)).values())


def test_walk_finds_the_pairs_that_share_a_prefix():
    """Against brute force over all pairs, with and without tiles; rows whose recall is reached stop."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, jj.TREES * jj.DEPTH).astype(np.uint16)
    sigs = np.repeat(base[None], 40, axis=0)
    for i in range(40):
        sigs[i, rng.choice(sigs.shape[1], 30 if i < 30 else 90, replace=False)] = i
    paths = sigs.reshape(40, jj.TREES, jj.DEPTH)[:, 0]
    for side in (None, np.arange(40) % 2):
        edges = jj.walk(np.zeros(40, np.int64), paths, sigs, side, 2, 0.8, 1.1)  # a recall that is never reached
        if side is not None:  # the sides' own edges come from their own tiles
            assert len(edges) <= 3
            for x in (0, 1):
                rows = np.flatnonzero(side == x)
                edges = edges + [(int(rows[i]), int(rows[j])) for i, j in jj.walk(np.zeros(20, np.int64), paths[rows], sigs[rows], None, 2, 0.8, 1.1)]
        group = list(range(40))
        for i, j in edges:
            group = [group[i] if g == group[j] else g for g in group]
        want = {}
        for i in range(40):
            for j in range(i):
                prefix = (paths[i] == paths[j])[:2].all()
                if prefix and (sigs[i] == sigs[j]).mean() >= 0.8 - jj.SLACK:
                    want.setdefault(i, set()).add(j)
                    assert group[i] == group[j]
        assert len(edges) <= 39 and all((sigs[i] == sigs[j]).mean() >= 0.8 - jj.SLACK and (paths[i] == paths[j])[:2].all() for i, j in edges) and want


def test_edges(spark):
    got = jj.join_near(frame(spark)).collect()
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_links"] == 1 and by[6]["class_id"] == 6
    assert all(by[i]["n_links"] == 0 for i in (3, 4, 5, 8, 9)) and by[3]["class_id"] == 3
    assert by[None]["n_links"] == 0
    assert jj.join_near(empty(spark)).count() == 0


def test_shuffled_join_where_members_are_too_many(spark, monkeypatch):
    from lodestone.llm import common

    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i j k l m n o p q r s t"), (4, "a b c d e f g h i j k l m n o p q r s u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "fits_broadcast", lambda *a: False)
    assert result(jj.join_near(df)) == brute(rows)


def test_verified_links_need_no_shared_prefix(spark, monkeypatch):
    """Near copies that meet through others only: every pair at the threshold is a link all the same."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(150)], w[rng.randrange(150)] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    sets, trees = [grams(t) for _, t in rows], [jj.signature(s).reshape(jj.TREES, jj.DEPTH) for s in jj.gram_sets(pa.array([t for _, t in rows]))]
    unmet = [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and not (trees[i] == trees[j]).all(axis=1).any()]
    assert unmet
    for tile in (256, 8):
        monkeypatch.setattr(jj, "TILE", tile)
        assert result(jj.join_near(df, recall=0.0)) == want
