"""Near-duplicate join: MinHash LSH forest over word 5-grams, then exact Jaccard verification.

Each document is the set of its 5-grams of words (a document of 1 to 4 words is one gram of all its
words). Documents of equal sets form one class, represented by its least doc_id. A representative has
TREES paths of DEPTH minhashes (16 bits each); a tree is the trie of these paths.

The forest is walked from the leaves up. Subtrees at the shortest prefix that may be needed
(`shortest_prefix`, from the target recall at the threshold) are dealt out by hash; in a task the paths
of a subtree are sorted, and the runs of neighbours whose longest common prefix reaches d are the trie's
nodes of depth d. Starting at the whole path, each representative compares itself with the others of its
node and shortens its matched prefix by one until its own recall, estimated from the partners found
(each stands for 1/p of its likeness, p = 1 - (1 - s**d)**TREES), reaches the target; without partners it
goes down to the shortest prefix. Candidates are compared by their whole signatures (TREES * DEPTH
minhashes), and go on when their estimated Jaccard is at most SLACK below the threshold (five standard
errors), so unlike texts that share some boilerplate form no chains. Subtrees of more than TILE paths
are cut into hashed tiles, and pairs of tiles are walked where they meet.

What is left of the candidates is followed to components, so each representative's grams are sent once,
to its component, and every pair inside one is verified exactly, whether or not it met in a tree.
Components are cut into tiles in the same way, of about the square root of their size (up to TILE), so
that the copies sent and the work of a task grow alike. Candidate pairs are counted by a matrix product
over shared grams; only link counts and a spanning forest leave a task, never pairs. Copies are not
expanded: a class counts with its size.

Result, one row per row of docs: doc_id, class_id (least doc_id of the connected documents of the
verified links), rep_id (least doc_id with the same grams), n_links (other documents of similarity
>= threshold, copies included).

Edge cases: words are the runs of characters outside white space, unchanged; null, empty and blank
texts have no grams and are linked to nothing, each its own class; rows without doc_id are returned
unlinked; rows of one doc_id with different texts share their links and their class; an empty table gives no
rows; other columns are ignored; texts are read SLICE_BYTES at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, documents, join_small, materialise, slices
from .hashing import U, find_words, hash_words, mix, text_buffer

GRAM = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.999
#: Five standard errors of a likeness of 0.8 estimated from TREES * DEPTH minhashes.
SLACK = 5 * (0.8 * 0.2 / (TREES * DEPTH)) ** 0.5
#: Documents and grams of a tile, at most.
TILE = 2048
TILE_GRAMS = 2_000_000
#: Paths that a task walks at once, about.
BUNDLE = 1024

_RNG = np.random.default_rng(2024)
_MULTIPLY = _RNG.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def chance(s, depth: int, trees: int = TREES):
    """Probability that a pair of likeness s shares a prefix of `depth` in some tree."""
    return 1 - (1 - s**depth) ** trees


def shortest_prefix(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The prefix at which even pairs at the threshold are met with the target recall."""
    depth = DEPTH
    while depth > 1 and chance(threshold, depth) < recall:
        depth -= 1
    return depth


def gram_sets(texts: pa.Array, gram: int = GRAM) -> list[np.ndarray]:
    """The ascending distinct 64-bit gram hashes of each text."""
    buf, offsets = text_buffer(texts)
    starts, ends = find_words(buf, offsets)
    words = hash_words(buf, starts, ends)
    first = np.searchsorted(starts, offsets)
    whole = np.zeros(max(0, len(words) - gram + 1), U)
    for j in range(gram if len(whole) else 0):
        whole = mix(whole * U(0x9E3779B97F4A7C15) + words[j : j + len(whole)])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= gram:
            out.append(np.unique(whole[a : b - gram + 1]))
        elif b > a:
            h = np.zeros(1, U)
            for j in range(a, b):
                h = mix(h * U(0x9E3779B97F4A7C15) + words[j : j + 1])
            out.append(mix(h + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhashes of 16 bits, tree after tree."""
    low = (grams >> U(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    times, plus = _MULTIPLY[:, None], _ADD[:, None]
    for i in range(0, len(low), 512):
        np.minimum(least, (times * low[None, i : i + 512] + plus).min(axis=1), out=least)
    return (mix(least.astype(U)) >> U(48)).astype(np.uint16)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id -> set_id (128-bit hash of the gram set), n_grams and sig, the big-endian signature."""
    import xxhash  # noqa: F401  (fails early on the driver where it is missing)

    def run(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch, 1):
                sets = gram_sets(part.column(1))
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [signature(s).astype(">u2").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "set_id", "n_grams", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, set_id binary, n_grams long, sig binary")


class Groups:
    """Connected groups of 0..n-1 and the edges that joined them."""

    def __init__(self, n: int):
        self.of, self.parent, self.edges = np.arange(n), list(range(n)), []

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, left: np.ndarray, right: np.ndarray, note: bool = True) -> None:
        """Link left[k] with right[k]; pairs already in one group cost a comparison. `note`: keep the edges."""
        new = self.of[left] != self.of[right]
        if not new.any():
            return
        for i, j in zip(left[new].tolist(), right[new].tolist()):
            a, b = self._root(i), self._root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                if note:
                    self.edges.append((i, j))
        of = np.array(self.parent)
        while (of[of] != of).any():
            of = of[of]
        self.of = of


def walk(tries: np.ndarray, paths: np.ndarray, sigs: np.ndarray, side: np.ndarray | None, shortest: int, threshold: float, recall: float) -> list[tuple[int, int]]:
    """A spanning forest of the candidates of some subtrees: tries (n) tells the subtrees apart, paths
    are (n, DEPTH) and sigs (n, TREES * DEPTH). With `side` (0 or 1 per row) only the edges that join
    what the pairs inside the two sides leave apart are returned (two dense tiles: one edge). Rows i and
    i + k of the sorted paths are compared for all i at once."""
    if side is not None:
        inside = [(np.flatnonzero(side == x), walk(*(v[side == x] for v in (tries, paths, sigs)), None, shortest, threshold, recall)) for x in (0, 1)]
    order = np.lexsort([*paths.T[::-1], tries])
    tries, paths, sigs = tries[order], paths[order], sigs[order]
    side = None if side is None else side[order]
    n, places = sigs.shape
    same = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1)  # longest common prefix with the row before
    same[tries[1:] != tries[:-1]] = 0
    likeness = np.arange(places + 1) / places
    seen = np.flatnonzero(likeness >= max(threshold - SLACK, 0.5 / places))  # likenesses of candidates
    partners = np.zeros((n, len(seen)), np.int32)  # of each row, by the number of equal minhashes
    active, groups, inner = np.ones(n, bool), Groups(n), None
    if side is not None:
        place = np.argsort(order)
        for rows, edges in inside:
            if edges:
                u, v = place[rows[np.array(edges).T]]
                groups.join(u, v, note=False)
    for depth in range(DEPTH, max(1, shortest) - 1, -1):
        node = np.concatenate([[0], np.cumsum(same < depth)])
        stop = np.append(np.flatnonzero(np.diff(node)) + 1, n)[node]  # where each row's node ends
        rows, k = np.arange(n), 0
        while True:
            k += 1
            rows = rows[rows + k < stop[rows]]
            if not len(rows):
                break
            use = active[rows] | active[rows + k]
            if inner is not None:
                use &= inner[rows] != inner[rows + k]  # the others were compared at a longer prefix
            if side is not None:
                use &= side[rows] != side[rows + k]
            left = rows[use]
            equal = (sigs[left] == sigs[left + k]).sum(axis=1)
            near = equal >= seen[0]
            left, equal = left[near], equal[near] - seen[0]
            groups.join(left, left + k)
            partners[left, equal] += 1
            partners[left + k, equal] += 1
        found = partners.sum(axis=1)
        expected = (partners / chance(likeness[seen], depth)).sum(axis=1)
        active &= (found == 0) | (found < recall * expected)
        inner = node
    return [(int(order[i]), int(order[j])) for i, j in groups.edges]


def _tiled(rows: DataFrame, key: str) -> DataFrame:
    """rows(..., doc_id, tiles) dealt to (key, a, b): every pair of tiles meets; `side` tells them apart."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    dealt = rows.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    columns = [c for c in rows.columns if c not in (key, "tiles")]
    return dealt.select(key, F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") > F.col("other")).cast("int").alias("side"), *columns)


def _tiles(n, grams=None, least: int = 48, times: int = 2):
    """Into how many tiles n documents (of `grams` grams) are cut: about times * sqrt(n) documents each."""
    size = F.least(F.lit(TILE), F.greatest(F.lit(least), F.ceil(times * F.sqrt(n))))
    parts = F.when(n <= min(128, TILE), 1).otherwise(F.ceil(n / size))
    if grams is not None:
        parts = F.greatest(parts, F.ceil(grams / TILE_GRAMS))
    return parts.cast("int")


def candidates(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """reps(rep_id, sig) -> edges (u, v): a spanning forest of the candidates of every subtree. Small
    subtrees are walked some thousand paths at a time, large ones a pair of tiles at a time."""
    shortest = shortest_prefix(threshold, recall)
    trees = F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(sig, t * {2 * DEPTH} + 1, {2 * shortest})))")
    leaves = reps.select("rep_id", F.posexplode(trees).alias("tree", "trie"))
    tries = leaves.groupBy("trie").agg(F.count("*").alias("n")).filter("n > 1").select("trie", _tiles(F.col("n"), least=128, times=3).alias("tiles"))
    leaves, path = materialise(leaves.join(tries, "trie"), "leaves")
    bundles = leaves.count() // BUNDLE + 1
    several = reps.join(leaves.select("rep_id").distinct(), "rep_id", "left_semi").select("rep_id", "sig")
    dealt = leaves.join(several.hint("merge"), "rep_id").withColumn("bundle", F.when(F.col("tiles") == 1, F.pmod("trie", F.lit(bundles))).otherwise(F.col("trie")))

    def run(key, table):
        table = table.combine_chunks()
        ids, tree = table["doc_id"].to_numpy(), table["tree"].to_numpy()
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), ">u2").astype(np.uint16).reshape(len(ids), -1)
        paths = sigs.reshape(len(ids), TREES, DEPTH)[np.arange(len(ids)), tree]
        side = None if key[1].as_py() == key[2].as_py() else table["side"].to_numpy()
        edges = walk(table["trie"].to_numpy(), paths, sigs, side, shortest, threshold, recall)
        return pa.table({"u": pa.array([int(ids[i]) for i, _ in edges], pa.int64()), "v": pa.array([int(ids[j]) for _, j in edges], pa.int64())})

    met = _tiled(dealt.withColumnRenamed("rep_id", "doc_id"), "bundle").groupBy("bundle", "a", "b").applyInArrow(run, "u long, v long")
    edges, _ = materialise(met.distinct(), "candidates")
    discard(reps.sparkSession, path)
    return edges


def verify_tile(ids, sizes, sets, side, threshold, same_tile):
    """Link counts and a spanning forest of one tile (same_tile) or between the two sides of a pair."""
    n = len(ids)
    counts = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), counts)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.empty(len(values), bool)
    new[0], new[1:] = True, values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # grams of one document meet nothing
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    width = int(column[-1]) + 1 if len(column) else 0
    left, right = (np.arange(n), np.arange(n)) if same_tile else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    common = np.zeros((n, n), np.float32)
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        block = np.zeros((n, min(4096, width - a)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        common += block @ block.T
    need = threshold * (counts[:, None] + counts[None, :]) / (1 + threshold)
    whole = (common.astype(np.float64) >= need - 1e-6) & (ids[:, None] != ids[None, :])
    link = whole[np.ix_(left, right)]
    links = np.zeros(n, np.int64)
    links[left] += (link * sizes[right][None, :]).sum(axis=1)
    if not same_tile:
        links[right] += (link * sizes[left][:, None]).sum(axis=0)
    groups = Groups(n)
    if not same_tile:  # what links inside the sides join is known from their own tiles
        for rows in (left, right):
            for i, row in zip(rows, whole[np.ix_(rows, rows)]):
                groups.join(np.full(int(row.sum()), i), rows[row], note=False)
    for i, row in zip(left, link):
        groups.join(np.full(int(row.sum()), i), right[row])
    return links, [(int(ids[i]), int(ids[j])) for i, j in groups.edges]


def verify(members: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """members(doc_id, set_id, size, component, tiles) -> (u, v, links): v null: u has so many links;
    else an edge of the spanning forest."""
    spark = docs.sparkSession
    n = members.count()
    texts = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), members, "doc_id", "inner", n, 96)

    def load(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch, 1):
                sets = gram_sets(part.column(1))
                fits = pa.array([len(s) > 0 and xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, part.column(2).to_pylist())])
                rows = [part.column(0), part.column(3), part.column(4), part.column(5), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([r.filter(fits) for r in rows], ["doc_id", "size", "component", "tiles", "grams"])

    loaded = texts.select("doc_id", "text", "set_id", "size", "component", "tiles").mapInArrow(load, "doc_id long, size long, component long, tiles int, grams binary")
    dealt = _tiled(loaded, "component")

    def run(key, table):
        rows = table.combine_chunks()
        ids, grams = rows["doc_id"].to_numpy(), rows["grams"].to_pylist()
        first = {(int(d), g): i for i, (d, g) in reversed(list(enumerate(zip(ids, grams))))}  # repeated rows
        once = np.array(sorted(first.values()))
        ids, sizes, side = ids[once], rows["size"].to_numpy()[once], rows["side"].to_numpy()[once]
        sets = [np.frombuffer(grams[i], U) for i in once]
        same = key[1].as_py() == key[2].as_py()
        if len(ids) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        links, edges = verify_tile(ids, sizes, sets, side, threshold, same)
        hit = np.flatnonzero(links)
        u = [*ids[hit].tolist(), *(e[0] for e in edges)]
        v = [*[None] * len(hit), *(e[1] for e in edges)]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array([*links[hit].tolist(), *[0] * len(edges)], pa.int64())})

    return dealt.groupBy("component", "a", "b").applyInArrow(run, "u long, v long, links long")


def join_near(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id, rep_id, n_links."""
    spark = docs.sparkSession
    sketches, _ = materialise(sketch(docs), "sketches")
    known = sketches.filter("set_id is not null and doc_id is not null")
    # documents of equal gram sets: one representative with the class's size
    classes = known.groupBy("set_id").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("size"), F.first("n_grams").alias("n_grams"), F.first("sig").alias("sig"))
    reps, _ = materialise(classes, "classes")
    classes = reps.select("set_id", "rep_id", "size")
    # representatives of several sets (repeated ids) share a node
    groups = components(candidates(reps, threshold, recall))
    members = reps.select("rep_id", "set_id", "size", "n_grams").join(groups, F.col("rep_id") == F.col("node")).select(F.col("rep_id").alias("doc_id"), "set_id", "size", "n_grams", F.col("label").alias("component"))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g"))
    members = members.drop("n_grams").join(sizes.select("component", _tiles(F.col("n"), F.col("g")).alias("tiles")), "component")
    members, path = materialise(members, "members")
    found, found_path = materialise(verify(members, docs, threshold), "links")
    discard(spark, path)
    links = found.filter("v is null").groupBy(F.col("u").alias("rep_id")).agg(F.sum("links").alias("links"))
    # repeated ids with different texts join their classes
    twins = known.groupBy("doc_id").agg(F.countDistinct("set_id").alias("k")).filter("k > 1").join(known, "doc_id").join(classes, "set_id").select(F.col("doc_id").alias("u"), F.col("rep_id").alias("v"))
    linked = components(found.filter("v is not null").select("u", "v").union(twins)).select(F.col("node").alias("rep_id"), F.col("label"))
    facts = classes.join(links, "rep_id", "left").join(linked, "rep_id", "left")
    facts = facts.select("set_id", "rep_id", F.coalesce("label", "rep_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    facts, _ = materialise(facts, "facts")
    discard(spark, found_path)
    return sketches.select("doc_id", "set_id").join(facts, "set_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep_id", "doc_id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(documents(spark, sf_dir))
