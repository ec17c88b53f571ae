import random
import re

import numpy as np
import pytest

from clinloom.llm import ngram_jaccard as g
from clinloom.llm import queries
from clinloom.llm.components import components


def shingles(text, w):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    x = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not x:
        return frozenset()
    return frozenset([tuple(x)]) if len(x) < w else frozenset(tuple(x[i : i + w]) for i in range(len(x) - w + 1))


def brute(docs, w, num, den):
    """(id, set size, component) of every row; rows are vertices, and those without an id have no links."""
    sets = [(d, shingles(t, w)) for d, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            if s and t and a is not None and b is not None and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(None if d is None else least[find(i)])) for i, (d, s) in enumerate(sets))


def corpus(seed, n_groups=12, copies=8, noise=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = [r.choice(vocab) for _ in range(60)]
    docs, key = [], 0
    for _ in range(n_groups):
        base = [r.choice(vocab) for _ in range(r.choice([4, 9, 12, 25, 60, 200]))]
        if r.random() < 0.4:
            base += shared
        for _ in range(copies):
            x = list(base)
            for _ in range(r.randint(0, 1 + len(x) // 20)):
                i = r.randrange(len(x))
                x[i : i + r.randint(0, 1)] = [r.choice(vocab)]
            docs.append((key, " ".join(x) if r.random() < 0.8 else "  ".join(x).upper()))
            key += 1
    docs += [(key + i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 90)))) for i in range(noise)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("words", [1, 3, 5])
def test_shingles(words):
    texts = [None, "", " \n", "a", "A b", "a B c", "a b c d e f g a b c d e", "é É x y z", "tab\there\x0bnow\x0cand then", "x " * 3000]
    for t, s in zip(texts, g.shingle_sets(texts, words), strict=True):
        assert len(s) == len(shingles(t, words)) and (np.diff(s.astype(object)) > 0).all()
    a, b = g.shingle_sets(["Some words HERE", "some\twords  here "], words)
    assert g.node_of(a) == g.node_of(b) and g.node_of(np.zeros(0, np.uint64)) is None


def test_slabs_do_not_matter(monkeypatch):
    texts = [t for _, t in corpus(1)]
    want = [g.node_of(s) for s in g.shingle_sets(texts, 3)]
    monkeypatch.setattr(g, "SLAB_BYTES", 50)
    assert [g.node_of(s) for s in g.shingle_sets(texts, 3)] == want


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (9999, 10000), (50, 100), (95, 100)])
def test_linked_sets_share_a_key(num, den):
    c, r = g.classes(num, den), np.random.default_rng(num)
    checked = 0
    for _ in range(1500):
        n = int(r.choice([1, 2, 3, 5, 9, 10, 18, 24, 25, 26, 30, 31, 60, 150, 700]))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        most = int(2 * n * (den - num) / (den + num)) + 1
        k = int(r.integers(0, most + 1))
        drop = int(r.integers(0, min(k, n - 1) + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 1 << 63, k - drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both):
            checked += 1
            assert set(g.keys_of(a, c).tolist()) & set(g.keys_of(b, c).tolist()), (len(a), len(b), both)
    assert checked > 200


def test_classes_are_made_as_far_as_needed():
    for num, den in [(1, 1), (100, 100), (999999, 1000000), (80, 100)]:
        c = g.classes(num, den)
        grams = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64))
        assert (len(g.keys_of(grams, c)) == 0) == (num == den)
        assert len(c.top) < 3200


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (50, 100)])
def test_sketches_lose_no_link(num, den):
    c, r = g.classes(num, den), np.random.default_rng(num)
    base = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 40, 62, 64, 65, 130, 500, 520)]
    sets = []
    for b in base:
        for _ in range(12):
            k = int(r.integers(0, max(1, len(b) // 4) + 1))
            sets.append(np.unique(np.concatenate([r.permutation(b)[min(k, len(b) - 1) :], r.integers(0, 1 << 63, int(r.integers(0, k + 1)), dtype=np.uint64)])))
    sketches, every = g.Sketches([g.sketch_of(s) for s in sets], [len(s) for s in sets]), np.arange(len(sets))
    linked = near = 0
    for i, a in enumerate(sets):
        got = set(sketches.near(i, every, c).tolist())
        want = {j for j, b in enumerate(sets) if den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))}
        assert want <= got
        linked, near = linked + len(want), near + len(got)
    assert linked > 100 and (near < len(sets) ** 2 / 4 or num < 80)


def test_equal_sets_link_at_one(spark):
    docs = corpus(5) + [(900, None), (901, "a b"), (902, "A  b")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string")
    for links in (False, True):
        got = g.join_components(df, 3, 1, 1, links=links).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(docs + docs[:3], 3, 1, 1)


def test_block_product():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    block = g.Block(sets)
    for rows in (np.arange(20), np.array([3]), np.array([1, 5, 19])):
        for i in range(20):
            assert block.overlaps(i, rows).tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in rows]


@pytest.mark.parametrize(("seed", "group", "words", "num"), [(1, 256, 3, 90), (2, 4, 3, 90), (3, 4, 5, 80), (4, 2, 2, 80)])
def test_components_equal_brute_force(spark, monkeypatch, seed, group, words, num):
    monkeypatch.setattr(g, "GROUP", group)
    monkeypatch.setattr(g, "CHUNK", 2)
    monkeypatch.setattr(g, "LEAVES", 3)
    docs = corpus(seed) + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in g.join_components(df, words, num, 100).collect())
    assert got == brute(docs, words, num, 100)


@pytest.mark.parametrize(("seed", "group", "words", "num"), [(1, 1024, 3, 90), (2, 4, 3, 90), (3, 3, 5, 80), (4, 2, 2, 80)])
def test_links_equal_brute_force(spark, monkeypatch, seed, group, words, num):
    monkeypatch.setattr(g, "GROUP", group)
    docs = corpus(seed) + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a"), (None, "a b")]
    docs += [docs[0], docs[1], (None, "only without an id"), (docs[2][0], "another text of this id, of its own"), (docs[3][0], docs[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = g.join_components(df, words, num, 100, links=True).collect()
    sets = [(d, shingles(t, words)) for d, t in docs]
    want = [(str(d), sum(1 for j, (e, u) in enumerate(sets) if j != i and None not in (d, e) and s and u and 100 * len(s & u) >= num * len(s | u))) for i, (d, s) in enumerate(sets)]
    assert sorted(map(str, want)) == sorted(str((str(r["doc_id"]), r["n_links"])) for r in got)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(docs, words, num, 100)


def test_many_copies_of_few_texts(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('one two three four five six ', if(id % 3 = 0, 'x', 'y')) as text")
    got = g.join_components(df, 3, 90, 100).groupBy("component_id").count().collect()
    assert sorted((r["component_id"], r["count"]) for r in got) == [(0, 1000), (1, 2000)]


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in g.join_components(odd, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)
    assert g.join_components(empty).count() == 0
    assert g.keep_one(empty).count() == 0


def test_keep_one(odd):
    kept = g.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["None", *[str(i) for i in range(14) if i != 7]])


def test_no_component_goes_through_a_row_without_an_id(spark):
    w = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(w)), (None, " ".join(w[:36])), (2, " ".join(w[:31]))]
    got = g.join_components(spark.createDataFrame(docs, "doc_id long, text string"), 1, 80, 100).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == ["(1, 1)", "(2, 2)", "(None, None)"]
    kept = g.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), 1)
    assert kept.count() == 3


def test_keep_one_with_repeated_ids(spark):
    """Each text of an id is judged by itself: copies of lower ids go, a text of its own stays."""
    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    docs = [(1, t[0]), (3, t[0]), (3, t[1]), (4, t[2]), (4, t[2].upper()), (4, t[3]), (5, None), (5, ""), (6, t[3])]
    kept = g.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect())
    # Of one id's rows with one set, one stays; rows of one id with different sets are different documents.
    assert got == sorted([(1, t[0]), (3, t[1]), (4, t[2]), (4, t[3]), (5, ""), (5, "")])


@pytest.mark.parametrize("seed", range(4))
def test_components_of_graphs(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([0, 20, 45, 80]))] + ([(i, i + 1) for i in range(100, 140)] if seed % 2 else [])
    up = list(range(200))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges or [(0, 0)], "a long, b long")
    got = {x["node"]: x["root"] for x in components(df).collect()}
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]}


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in queries.op9_ngram_jaccard(spark, sf_dir).collect())
    assert got == brute(docs, 3, 90, 100)


def test_nodes_of_a_key_meet_what_is_known_of_it_in_one_join(spark, monkeypatch):
    """Of a key's figures, its least node and whether it is the first of its list, each was a join of all nodes of all keys before."""
    plans, real = [], g.materialize
    seen = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(g, "materialize", lambda df, *a: (seen(df), real(df, *a))[1])
    monkeypatch.setattr(g, "GROUP", 4)
    shared = [(key, node, key) for key in (100, 200) for node in range(1, 9)] + [(300, node, 300) for node in range(1, 4)] + [(400, 7, 8)]
    roots = {**{v: 1 for v in range(1, 6)}, 300: 1}
    nodes = sorted({v for _, *pair in shared for v in pair})
    of = lambda rows, names: spark.createDataFrame(rows, names)
    blocks = g._second_blocks(of(shared, "key long, node long, peer long"), of(list(roots.items()), "node long, root long"), of([(v, 9) for v in nodes], "node long, n_shingles long"))
    seen(blocks)
    assert sum(line.count("Join ") for p in plans for line in p.splitlines() if "(key#" in line.split("Join ")[-1] and "Join " in line) == 1
    met = {}
    for r in blocks.collect():
        met.setdefault(r["block"], {}).setdefault(r["role"], set()).add(r["node"])
    pairs = {frozenset((a, b)) for m in met.values() for x, y in ((4, 4), (2, 3)) for a in m.get(x, ()) for b in m.get(y, ()) if a != b}
    apart = lambda a, b: roots.get(a, a) != roots.get(b, b)
    for key in (100, 200):
        group = [*range(1, 9), key]
        assert all(frozenset((a, b)) in pairs for a in group for b in group if apart(a, b))


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (9999, 10000), (50, 100), (95, 100)])
def test_linked_sets_share_as_many_keys_of_a_family_as_both_need(num, den):
    c, r = g.classes(num, den), np.random.default_rng(num)
    checked = needed = 0
    for _ in range(1500):
        n = int(r.choice([1, 2, 5, 18, 24, 25, 26, 30, 31, 60, 150, 256, 700, 2000]))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        k = int(r.integers(0, int(2 * n * (den - num) / (den + num)) + 2))
        drop = int(r.integers(0, min(k, n - 1) + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 1 << 63, k - drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if den * both < num * (len(a) + len(b) - both):
            continue
        checked += 1
        met = [(len(np.intersect1d(x, y)), max(f >> 2, h >> 2)) for f, x in g.keys_by_family(a, c) for h, y in g.keys_by_family(b, c)]
        assert any(held and held >= need for held, need in met), (len(a), len(b), both)
        needed = max(needed, *(need for _, need in met))
    assert checked > 200 and (needed > 1 or num == 9999)


def test_a_few_keys_by_chance_make_no_candidates(spark, monkeypatch):
    """Each text has a line of the one before: a few keys in common, far from a link. All were one candidate component before."""
    seen = []
    monkeypatch.setattr(g, "_labels", lambda rows, shared, pairs, *a: (seen.append((pairs.collect(), shared.count())), (None, None))[1])
    line = lambda i: [f"l{i}x{j}" for j in range(45)]
    texts = [" ".join([*line(i), *(f"t{i}x{j}" for j in range(170)), *line(i + 1)]) for i in range(60)]
    c, sets = g.classes(80, 100), g.shingle_sets(texts, 5)
    assert sum(bool(np.intersect1d(g.keys_of(a, c), g.keys_of(b, c)).size) for a, b in zip(sets, sets[1:], strict=False)) > 10
    copies = [texts[0] + " more", texts[7].replace("t7x80", "other")]
    df = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").repartition(3)
    g.join_components(df, 5, 80, 100).count()
    (pairs, _), = seen
    node = [g.node_of(s) for s in g.shingle_sets(texts + copies, 5)]
    assert {frozenset(p) for p in pairs} == {frozenset((node[0], node[60])), frozenset((node[7], node[61]))}


def join_rows(spark, by, kind, after):
    """Rows that the joins of one kind by ``by`` on both sides made, over the executions from ``after`` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(after, store.executionsList().size()):
        ran = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(ran), store.planGraph(ran).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(rf"Join \[{by}#\d+L?\], \[{by}#\d+L?\], {kind}", node.desc()):
                made = [m for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows"]
                total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in made if values.contains(m.accumulatorId()))
    return total


def test_a_node_of_many_keys_meets_what_is_known_of_it_as_one_row(spark, monkeypatch):
    """Near copies share some forty keys each: a join by node had a row for each of them before, not one."""
    monkeypatch.setattr(g, "GROUP", 4)
    nodes, keys = range(1, 81), range(1000, 1040)
    shared = spark.createDataFrame([(key, node, 1) for key in keys for node in nodes if node > 1 and (key + node) % 7], "key long, node long, peer long")
    sizes = spark.createDataFrame([(v, 90) for v in nodes], "node long, n_shingles long")
    labels = spark.createDataFrame([(v, 1) for v in nodes if v % 10], "node long, root long")
    after = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    blocks = g._second_blocks(shared, labels, sizes)
    assert 0 < join_rows(spark, "node", "Inner", after) <= 2 * len(nodes)
    met = {}
    for r in blocks.collect():
        met.setdefault(r["block"], {}).setdefault(r["role"], set()).add(r["node"])
    pairs = {frozenset((a, b)) for m in met.values() for x, y in ((4, 4), (2, 3)) for a in m.get(x, ()) for b in m.get(y, ()) if a != b}
    assert all(frozenset((a, b)) in pairs for a in nodes for b in nodes if a < b and (a % 10 == 0 or b % 10 == 0))
