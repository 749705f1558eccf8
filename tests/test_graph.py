import random
from collections import Counter

import numpy as np
import pytest

from plumbline.operators import graph


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("plan:a", "plan", "a", "A"), ("plan:b", "plan", "b", "B"), ("doc:a/1", "document", "a", "one"), ("doc:b/2", "document", "b", "two"), ("apl:1", "apl", "state", "L1"), ("apl:2", "apl", "state", "L2")]
    edges = [("doc:a/1", "apl:1", "implements", 2.0), ("doc:b/2", "apl:2", "implements", 1.0), ("apl:2", "apl:1", "supersedes", 3.0)]
    return spark.createDataFrame(nodes, "id string, kind string, plan_id string, label string"), spark.createDataFrame(edges, "source string, target string, relationship_type string, weight double")


def test_relational_queries(small):
    nodes, edges = small
    assert [tuple(r) for r in graph.adoption(nodes, edges, "apl:1").collect()] == [("A", 1), ("B", 0)]
    assert [tuple(r) for r in graph.stale_citations(edges).collect()] == [("doc:a/1", "apl:1", "apl:2")]
    status = {r.letter: (r.replaced, r.old_only) for r in graph.citation_status(nodes, edges).collect()}
    assert status == {"apl:1": (True, True), "apl:2": (False, False)}


def test_lineages_that_are_cycles(spark):
    """All letters of a cycle are later than each other, and later than what leads into it."""
    rng = random.Random(3)
    letters = [f"apl:{k:02}" for k in range(30)]
    by = {x: rng.choice(letters) for x in letters if rng.random() < 0.85} | {"apl:00": "apl:00", "apl:28": "apl:29", "apl:29": "apl:28"}
    cites = {(f"doc:{k % 12}", rng.choice(letters)) for k in range(60)}

    def after(x):
        seen = set()
        while x in by and by[x] not in seen:
            x = by[x]
            seen.add(x)
        return seen

    edges = [(v, k, "supersedes") for k, v in by.items()] + [(d, x, "implements") for d, x in cites]
    nodes = spark.createDataFrame([(f"doc:{k}", "document", "p") for k in range(12)], "id string, kind string, plan_id string")
    got = {(r.document, r.letter): (r.replaced, r.old_only) for r in graph.citation_status(nodes, spark.createDataFrame(edges, "source string, target string, relationship_type string")).collect()}
    assert got == {(d, x): (x in by, x in by and not any((d, y) in cites for y in after(x))) for d, x in cites}


def test_status_in_lines_takes_few_rounds(spark, monkeypatch):
    """Lines of 300 letters beside a fork, a letter with two superseders and loops, dealt in order and at random, against a walk."""
    rng, writes, write = random.Random(5), [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, *a: writes.append(1) or write(df, *a))
    lines = [[f"apl:{c}{k:03}" for k in rng.sample(range(1000), 300)] for c in range(3)]
    links = [(y, x) for of in lines for x, y in zip(of, of[1:])]
    nodes = spark.createDataFrame([(f"doc:{k}", "document", "p") for k in range(60)], "id string, kind string, plan_id string")
    more = [("apl:f2", "apl:f0"), ("apl:f2", "apl:f1"), ("apl:f3", "apl:f2"), ("apl:s1", "apl:s0"), ("apl:s2", "apl:s0"), ("apl:s3", "apl:s1"), ("apl:l", "apl:l"), ("apl:r1", "apl:r0"), ("apl:r0", "apl:r1")]
    for every, parts, most in ((links, 1, 9), (links + more, 5, 99)):
        by = {}
        for y, x in every:
            by[x] = max(y, by.get(x, y))
        letters = sorted({x for pair in every for x in pair} | {"apl:none"})
        cites = {(f"doc:{rng.randrange(60)}", rng.choice(letters)) for _ in range(500)} | {(f"doc:{k % 60}", x) for k in range(90) for _, x in more[k % 9 :][:1]}

        def after(x):
            seen = set()
            while x in by and by[x] not in seen:
                x = by[x]
                seen.add(x)
            return seen

        edges = spark.createDataFrame([(*e, "supersedes") for e in every] + [(d, x, "implements") for d, x in cites], "source string, target string, relationship_type string")
        edges = edges.coalesce(1) if parts == 1 else edges.repartition(parts)
        writes.clear()
        got = {(r.document, r.letter): (r.replaced, r.old_only) for r in graph.citation_status(nodes, edges).collect()}
        assert got == {(d, x): (x in by, x in by and not any((d, y) in cites for y in after(x))) for d, x in cites}
        assert len(writes) <= most


def test_supersession_directions(spark):
    rows = [("apl", "APL 31-407", "APL 31-407: Rides, supersedes APL 07-119"), ("apl", "", "APL 33-050 on nights, superseded by APL 61-204"), ("policy", "", "Supersedes APL 52-330")]
    got = {(r.source, r.target) for r in graph.supersede_edges(spark.createDataFrame(rows, "doc_kind string, policy_number string, title string")).collect()}
    assert got == {("apl:31-407", "apl:07-119"), ("apl:61-204", "apl:33-050")}


def catalog(spark):
    rows = [("a", "1.pdf", "Timetables of Night Rides", "UM"), ("b", "2.pdf", "Timetables of Night Rides", ""), ("a", "3.pdf", "Timetables of Night Rides", "")]
    return spark.createDataFrame(rows, "plan_id string, filename string, title string, department string")


def test_builders(spark):
    c = catalog(spark)
    assert Counter(r.relationship_type for r in graph.structural_edges(c).collect()) == {"published_by": 3, "owned_by": 1}
    nodes = graph.catalog_nodes(c, spark.createDataFrame([("a", "A"), ("b", "B")], "plan_id string, name string"))
    assert nodes.count() == 6
    docs = c.selectExpr("concat_ws('/', plan_id, filename) id", "plan_id", "title")
    pairs = graph.shared_terms(docs, band=(2, 60))
    assert {(r.a, r.b) for r in pairs.collect()} == {("a/1.pdf", "b/2.pdf"), ("a/3.pdf", "b/2.pdf")}


def test_mining_and_assembly(spark, small):
    chunks = spark.createDataFrame([("a", "x", "by APL 61-204"), ("a", "x", "APL 61-204 too"), ("state", "y", "APL 61-204"), ("b", "z", "APLs 07-119 alone")], "plan_id string, filename string, text string")
    assert [(r.source, r.target, r.weight) for r in graph.mined_edges(chunks).collect()] == [("doc:a/x", "apl:61-204", 2.0)]
    nodes, edges = small
    e = edges.unionByName(edges).unionByName(spark.createDataFrame([("doc:zz", "apl:9", "implements", 1.0)], edges.schema))
    n, kept, dangling = graph.assembled(nodes, e)
    assert dangling == 1 and kept.count() == 3 and n.where("id = 'apl:9'").count() == 1


def test_greedy_cap_equals_sequential(spark):
    import random

    rng = random.Random(4)
    pairs = list({(min(a, b), max(a, b)): rng.randint(2, 5) for a, b in ((rng.randint(0, 14), rng.randint(0, 14)) for _ in range(90)) if a != b}.items())
    used, want = Counter(), set()
    for (a, b), _ in sorted(pairs, key=lambda x: (-x[1], f"{x[0][0]:02d}", f"{x[0][1]:02d}")):
        if used[a] < 3 and used[b] < 3:
            want.add((f"{a:02d}", f"{b:02d}"))
            used[a] += 1
            used[b] += 1
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", w) for (a, b), w in pairs], "a string, b string, shared bigint")
    assert {(r.a, r.b) for r in graph.capped(df, 3).collect()} == want


def test_lineage_and_chains(spark):
    s = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "a")], "source string, target string")
    seeds = spark.createDataFrame([("c",), ("a",)], "id string")
    assert {tuple(r) for r in graph.lineage(s, seeds).collect()} == {("c", "c", 0), ("c", "b", 1), ("c", "a", 2), ("a", "a", 0)}
    assert {tuple(r) for r in graph.longest_chains(s).collect()} == {("c", 3, "c>b>a"), ("x", 2, "x>a")}


def test_chains_have_no_cap(spark):
    s = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(102)] + [("b00", "095")], "source string, target string").coalesce(1)
    path = [f"{k:03d}" for k in range(103)]
    assert {tuple(r) for r in graph.longest_chains(s).collect()} == {("000", 103, ">".join(path)), ("b00", 9, ">".join(["b00", *path[95:]]))}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, write = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, *a: rounds.append(1) or write(df, *a))
    s = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(300)], "source string, target string").coalesce(1)
    assert {tuple(r) for r in graph.longest_chains(s).collect()} == {("000", 301, ">".join(f"{k:03d}" for k in range(301)))}
    assert len(rounds) < 24  # not one a letter


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    links = {(f"{min(a, b):02d}", f"{max(a, b):02d}") for a, b in rng.integers(0, 40, (45, 2)).tolist() if a != b}
    below = {}
    for a, b in links:
        below.setdefault(a, []).append(b)

    def ways(x):
        return [[x, *w] for y in below.get(x, []) for w in ways(y)] or [[x]]

    want = {(h, len(w), ">".join(w)) for h in below if h not in {b for _, b in links} for w in [min(ways(h), key=lambda w: (-len(w), w))]}
    links |= {("y1", "y2"), ("y2", "y1"), ("z0", "z1"), ("z1", "z2"), ("z2", "z3"), ("z3", "z1")}  # cycles, without a way to it and with one
    got = {tuple(r) for r in graph.longest_chains(spark.createDataFrame(sorted(links), "source string, target string")).collect()}
    assert got == want | {("z0", 4, "z0>z1>z2>z3")}


def test_mean_path_has_no_cap(spark):
    line = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(66)], "a string, b string").coalesce(1)
    r = graph.mean_path(line, sources=spark.createDataFrame([("000",)], "id string")).first()
    assert (r.pairs, r.mean_path) == (66, pytest.approx(67 / 2))


def ring(n, near):
    return [(i, (i + k) % n) for i in range(n) for k in range(1, near + 1)]


def test_topology(spark):
    pairs = [(f"{min(a, b):03d}", f"{max(a, b):03d}") for a, b in ring(40, 3)]
    df = spark.createDataFrame(pairs, "a string, b string")
    c = graph.clustering(df).first()
    small = graph.small_metrics(pairs)
    assert c.clustering == pytest.approx(small[0]) == pytest.approx(0.6)
    assert graph.mean_path(df).first().mean_path == pytest.approx(small[1])
    assert graph.ring_clustering(6) == pytest.approx(0.6)
    found = graph.components(df)
    assert {r.component for r in found.collect()} == {"000"} and graph.reachable_share(found).first().reach == 1.0
    far = spark.createDataFrame([("000", "001", 0.9), ("000", "020", 0.8)], "a string, b string, sim double")
    assert [(r.a, r.b) for r in graph.shortcut_candidates(far, df, 4).collect()] == [("000", "020")]
    shorter = graph.small_metrics([*pairs, ("000", "020"), ("010", "030")])
    assert shorter[1] < small[1]


def test_neighbours_are_typed(spark, small):
    _, edges = small
    got = {(r.id, r.kind, r.hops) for r in graph.neighbours(edges, spark.createDataFrame([("doc:a/1",)], "id string"), 2).collect()}
    assert got == {("apl:1", "apl", 1), ("apl:2", "apl", 2)}


def test_null_model_keeps_size(spark):
    rows = graph.null_model(spark, [(min(p), max(p)) for p in ring(20, 2)], 2).collect()
    assert len(rows) == 2 and all(r.mean_path > 1 and 0 <= r.clustering <= 1 for r in rows)
    assert graph.verdict(0.4, 2) == "fragmented" and graph.verdict(0.9, 2) == "small-world"


def test_budget(spark):
    cost, share, n = graph.bridging({"components": 5}, 100)
    assert (cost, n) == (0.04, 5) and share == pytest.approx(0.052)
    edges = spark.createDataFrame([("x", "y", 1.0, "shortcut"), ("x", "z", 1.0, "implements")], "source string, target string, weight double, relationship_type string")
    new = graph.augmented(edges, spark.createDataFrame([("p", "q", 0.7), ("p", "r", 0.9)], "a string, b string, sim double"), 1)
    assert {(r.source, r.target) for r in new.collect()} == {("x", "z"), ("p", "r")}


@pytest.mark.parametrize("words", [1, 16])
def test_hops_by_masks_equal_a_walk(spark, monkeypatch, words):
    """From 150 nodes at once, in rows of 64 or 1024 starts, against a breadth-first walk."""
    monkeypatch.setattr(graph, "WORDS", words)
    rng = random.Random(words)
    name = lambda k: f"n{k}"
    lines = [(k, k + 1) for k in range(0, 12)] + [(rng.randrange(61, 140), rng.randrange(61, 140)) for _ in range(70)] + [(141, 142)]
    near = {}
    for a, b in lines:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    far = {}
    for s in range(150):
        dist, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in near.get(x, ()) if y not in dist and not dist.update({y: dist[x] + 1})]
        far[s] = dist
    pairs = spark.createDataFrame(sorted({(min(name(a), name(b)), max(name(a), name(b))) for a, b in lines if a != b}), "a string, b string")
    m = graph.mean_path(pairs).first()
    all_ = [d for s in near for t, d in far[s].items() if t != s]
    assert m["pairs"] == len(all_) and abs(m["mean_path"] - sum(all_) / len(all_)) < 1e-12
    asked = [(a, b) for a in range(0, 150, 3) for b in range(0, 150, 7)]
    df = spark.createDataFrame([(name(a), name(b), 0.5) for a, b in asked], "a string, b string, sim double")
    assert {(r.a, r.b): r.hops for r in graph.with_hops(df, pairs).collect()} == {(name(a), name(b)): far[a].get(b) for a, b in asked}
    assert {(r.a, r.b) for r in graph.shortcut_candidates(df, pairs, 4).collect()} == {(name(a), name(b)) for a, b in asked if far[a].get(b, 99) >= 4}


def test_a_chunk_of_starts_meets_few_components(spark, monkeypatch):
    """20 components of 32 nodes whose names alternate: 640 starts in rows of 64, of which a node needs one or two, not ten."""
    monkeypatch.setattr(graph, "WORDS", 1)
    name = lambda c, k: f"{k:02}-{c:02}"
    pairs = spark.createDataFrame([(name(c, 0), name(c, k)) for c in range(20) for k in range(1, 32)], "a string, b string").repartition(5).localCheckpoint()
    starts = graph.both_ways(pairs).selectExpr("a as id")
    rows = [(new.count(), n) for _, new, n in graph.reached(pairs, graph.numbered(starts, pairs))]
    assert sum(n for _, n in rows) == 20 * 32 * 31 and max(r for r, _ in rows) <= 2 * 640


def test_chains_that_lie_together_need_no_rounds(spark, monkeypatch):
    """Chains in one partition each are stars after one pass, repeated pairs or not; dealt at random they end at the same stars."""
    rng, writes, write = random.Random(4), [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, *a: writes.append(1) or write(df, *a))
    names = {c: rng.sample(range(1000 * c, 1000 * c + 1000), 300) for c in range(4)}
    rows = [(f"{x:04}", f"{y:04}") for c, of in names.items() for x, y in zip(of, of[1:]) for _ in range(1 + x % 2)]
    want = {f"{x:04}": f"{min(of):04}" for of in names.values() for x in of}
    edges = spark.createDataFrame(rows, "source string, target string").coalesce(1)
    assert {r.id: r.component for r in graph.components(graph.undirected(edges, once=False)).collect()} == want
    assert len(writes) == 1
    assert {r.id: r.component for r in graph.components(graph.undirected(edges.repartition(7), once=False)).collect()} == want
    assert len(writes) > 2


def test_shortcuts_tell_what_they_bridge(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, "implements", True, "text"), ("a", "c", 1.0, "shortcut", False, "was 5 hops")], "source string, target string, weight double, relationship_type string, directed boolean, evidence string")
    found = spark.createDataFrame([("a", "d", 0.9, None), ("b", "d", 0.8, 4)], "a string, b string, sim double, hops int")
    got = {(r.source, r.target): (r.relationship_type, r.directed, r.evidence) for r in graph.augmented(edges, found, 2).collect()}
    assert got == {("a", "b"): ("implements", True, "text"), ("a", "d"): ("shortcut", False, "was unreachable"), ("b", "d"): ("shortcut", False, "was 4 hops")}


def test_swaps_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    pairs = np.array(sorted({tuple(sorted(p)) for p in rng.integers(0, 2000, (20_000, 2)).tolist() if p[0] != p[1]}))
    tracemalloc.start()
    made = graph.swapped(pairs, np.random.default_rng(42))
    most = tracemalloc.get_traced_memory()[1] / len(pairs)
    tracemalloc.stop()
    assert len({tuple(p) for p in made.tolist()}) == len(pairs) and sorted(Counter(made.ravel().tolist()).items()) == sorted(Counter(pairs.ravel().tolist()).items())
    assert most < 600  # bytes a pair


@pytest.mark.parametrize("held", [1000, 40, 0])
@pytest.mark.parametrize("asked", [False, True])
def test_mean_path_keeps_masks_within_tasks(spark, monkeypatch, held, asked):
    rng = random.Random(6)
    lines = {(a, b) for a, b in ((rng.randrange(0, 150), rng.randrange(0, 150)) for _ in range(190)) if a != b} | {(k, k + 1) for k in range(200, 212)} | {(300 + 2 * k, 301 + 2 * k) for k in range(90)}
    near = {}
    for a, b in lines:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    starts, hops = [k for k in range(500) if not asked or k % 3 == 0], []
    for s in starts:
        dist, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in near.get(x, ()) if y not in dist and not dist.update({y: dist[x] + 1})]
        hops += [d for d in dist.values() if d]
    rows, reached = [], graph.reached
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(graph, "SHARE", 5000)
    monkeypatch.setattr(graph, "reached", lambda *a: (rows.append(1), reached(*a))[1])
    pairs = spark.createDataFrame(sorted({(f"n{min(a, b)}", f"n{max(a, b)}") for a, b in lines}), "a string, b string")
    m = graph.mean_path(pairs, spark.createDataFrame([(f"n{k}",) for k in starts], "id string") if asked else None).first()
    assert m["pairs"] == len(hops) and abs(m["mean_path"] - sum(hops) / len(hops)) < 1e-12
    assert len(rows) == (held < 1000)  # only components of more pairs go through shuffles of masks
    empty = graph.mean_path(pairs.limit(0)).first()
    assert (empty.pairs, empty.mean_path) == (0, None)
