import random

import numpy as np
import pytest

from finscan.llm import chosen_path as J


def brute(rows, threshold=0.8):
    sets = {i: frozenset(J.grams(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (root(i), links[i]) for i in ids}


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        out[rng.randrange(len(out))] = rng.choice("abcdefgh") * 3
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))] + (passage if i % 2 else [])
        for _ in range(rng.randint(1, 5)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 0.005, 0.02, 0.1]))))
    rng.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, class_id string, sig int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.class_id, r.n_links) for r in J.join(df, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"small": 4}])
def test_equals_brute_force(spark, options, monkeypatch):
    rows = corpus(1) + [(1001, None), (1003, ""), (1005, " \n"), (1007, "one two"), (1009, "One, two"), (1011, "!!! ???"), (1013, "w " * 100_000)]
    assert run(spark, rows, **options) == brute(rows)


def test_large_groups_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(J, "EXACT_BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.015))) for i in range(120)]
    assert run(spark, rows, small=8) == brute(rows)


def test_repeated_rows_empty_tables_and_representatives(spark):
    text = " ".join(f"word{i}" for i in range(80))
    near = text.replace("word40", "other")
    df = spark.createDataFrame([(5, text), (5, text), (7, near), (9, "alone in the world of texts"), (11, None), (12, ""), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in J.join(df).collect()), key=str)
    assert (5, 5, 5, 2, 2) in got and (7, 5, 7, 1, 2) in got and (9, 9, 9, 1, 0) in got and (11, 11, 11, 1, 0) in got and (None, None, None, 1, 0) in got
    kept = sorted(((r.doc_id, r.text) for r in J.representatives(df).collect()), key=str)
    assert kept == sorted([(5, text), (9, "alone in the world of texts"), (11, None), (12, ""), (None, text)], key=str)
    assert J.join(df.limit(0)).count() == 0 and J.representatives(df.limit(0)).count() == 0


def test_parts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, 20).astype(np.uint64)) for _ in range(12)]
    both = J.shared_counts(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)
    assert len(J.sketch(sets[0])) == J.BINS and J.runs_for(0.9999, 2.0) == 6
    assert len(J.grams("a b c")) == 1 and len(J.grams("a b c d e f")) == 2 and len(J.grams(None)) == 0


def test_recall_on_pairs_at_the_threshold(spark):
    """Pairs of exactly the threshold's similarity, each alone in the corpus."""
    rows = []
    for i in range(150):
        a = [f"p{i}x{k}" for k in range(84)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:68]))]  # 64 of 80 grams
    got = run(spark, rows)
    assert sum(1 for i in range(150) if got[2 * i + 1] == (2 * i, 1)) >= 149


def test_paths_reach_the_stated_recall_at_any_depth():
    """Of thousands of pairs at exactly the threshold, paths of one to four steps miss no more than the bound says."""
    rng = np.random.default_rng(3)
    pairs = []
    for i in range(4000):
        t = np.unique(rng.integers(1, 2**63, 80).astype(np.uint64))
        pairs.append((t, np.sort(rng.choice(t, 64, replace=False))) if i % 2 else (t[:72], t[8:]))
    met = lambda x, y: set(x.tolist()) & set(y.tolist())
    one = J.miss(2.0)
    missed = {depth: 0 for depth in range(1, 5)}
    for a, b in pairs:
        common = met(J.paths(a, range(1), 0.8, 2.0), J.paths(b, range(1), 0.8, 2.0))
        for depth in missed:
            missed[depth] += not common
            common = {c for p in common for c in met(J.steps(a, p, 0.8, 2.0), J.steps(b, p, 0.8, 2.0))}
    assert abs(one - 0.2032) < 1e-3 and missed[1] < missed[4]
    assert all(m / len(pairs) < one + 4 * (one / len(pairs)) ** 0.5 for m in missed.values())
    assert one ** J.runs_for(0.9999, 2.0) <= 1e-4


def test_recall_with_split_buckets(spark):
    """Thousands of pairs at the threshold that all share a frequent passage, so that their buckets are split again."""
    passage = [f"q{k}" for k in range(44)]
    rows = []
    for i in range(1500):
        a = passage + [f"p{i}x{k}" for k in range(40)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[16:]))]  # 64 of 80 grams
    got = run(spark, rows, small=2)
    assert sum(1 for i in range(1500) if got[2 * i + 1][0] == 2 * i and got[2 * i][1] == 1) >= 1499


def test_hot_buckets_and_many_steps(spark, monkeypatch):
    """Buckets dealt apart from the first step on, and split until near copies alone are left."""
    monkeypatch.setattr(J, "HOT_ROWS", 8)
    monkeypatch.setattr(J, "MOST_HOT", 10**9)
    rows = corpus(2)
    assert run(spark, rows, small=3) == brute(rows)


def test_chained_clusters_are_verified_in_buckets(spark, monkeypatch):
    """A long chain of texts, each like the next ones only: one component, links counted once each."""
    monkeypatch.setattr(J, "EXACT_BLOCK", 8)
    monkeypatch.setattr(J, "LARGE_BLOCKS", 2)
    words = [f"w{k}" for k in range(1000)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(200)]
    dealt = []
    blocked = J._blocked
    monkeypatch.setattr(J, "_blocked", lambda rows, key, size: dealt.append(key) or blocked(rows, key, size))
    got = run(spark, rows)
    assert dealt.count("part") == 2  # the chain was not compared in blocks of all pairs
    assert got == brute(rows) and got[100][1] == 4 and len({c for c, _ in got.values()}) == 1
    sets = [[1, 5, 9], [5, 9], [9], [2, 9]]
    shared = J._earlier(sets, 9)
    assert [(i, j) for i in range(4) for j in range(i) if shared[i, j]] == [(1, 0)]


def test_sets_that_share_a_number_are_told_apart(spark):
    rows = corpus(3)
    assert run(spark, rows, node_bits=5) == brute(rows)


def test_rows_of_one_id_in_several_components(spark):
    """Two groups whose smallest id is the same: one document of each stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, a.replace("a40", "z")), (3, b.replace("b40", "z"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in J.representatives(df).collect()) == sorted(rows[:2])


def test_recall_on_a_whole_table(spark):
    """Against the exact similarity of all pairs of the small table's documents."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.op9_chosen_path_join(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


def test_components_within_a_dense_bucket(spark, monkeypatch):
    """Chains of near copies that one set alone does not reach: what is outside its component is compared with all."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        k = i % 3 * 11
        words = [f"x{k}{j}" for j in range(k)] + base[k:]
        rows.append((i, " ".join(edited(rng, words, 0.004))))
    monkeypatch.setattr(J, "DENSE", 0.05)
    got = run(spark, rows, small=20)
    assert got == brute(rows)


def test_edges_of_overlapping_buckets_do_not_add_up():
    """Buckets of one group of near copies tie its sets to the same one, in whatever order rows come: one edge a set, not one a set and bucket."""
    nodes, rng = np.random.default_rng(1).integers(-(2**62), 2**62, 200), np.random.default_rng(2)
    found = set()
    for _ in range(30):
        order = rng.permutation(len(nodes))
        a, b = J._tree(nodes[order], np.ones((len(nodes), len(nodes)), bool))
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert found == {(x, nodes.min()) for x in nodes.tolist() if x != nodes.min()}


def test_rounds_of_components_keep_only_open_edges(spark, monkeypatch):
    """Components equal those of plain code; an edge whose ends have met is not read again."""
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(5000, i) for i in range(2000, 2100)]
    edges = [*chain, *star, *((rng.randrange(300), rng.randrange(300)) for _ in range(250)), (9, 9)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    counts, settled = [], J.settled
    monkeypatch.setattr(J, "settled", lambda df, what: (out := settled(df, what), what == "edges" and counts.append(out.count()))[0])
    got = {r.node: r.label for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: root(x) for x in parent if x not in alone}
    assert counts[0] <= len(edges) and counts[-1] == 0 and all(y < x for x, y in zip(counts, counts[1:], strict=False))
