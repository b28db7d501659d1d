import itertools
import random

import numpy as np

from caseloom.llm.components import components
from caseloom.llm.minhash import _rest, near_duplicates


def brute(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        if i is not None:
            w = (text or "").encode().lower().split()
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(seed, copies, words=60, most=14):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(copies):
        own = list(base)
        for at in rng.sample(range(words), rng.randrange(most)):
            own[at] = rng.choice(["alpha", "beta", f"x{rng.randrange(10**6)}"])
        yield " ".join(own)


def check(spark, rows, k):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()
    want = brute(rows, k)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_families_against_brute_force(spark):
    texts = [t for seed, n in ((1, 120), (2, 40), (3, 3)) for t in family(seed, n)] + ["same text here again"] * 30
    random.Random(5).shuffle(texts)
    check(spark, list(enumerate(texts)), 4)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b c d"), (6, "a b c d"), (6, "a b c d"), (None, "a b c d"), (7, "b " * 5000), (8, "B " * 4000)], 4)


def test_empty_table_and_extra_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string, bucket int, rep int")).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 160)}, 200: 200, 201: 200}


def test_far_copies_of_a_bucket_make_no_pairs(spark):
    rng = np.random.default_rng(3)
    base, own = rng.integers(0, 1 << 62, 120), {}
    for i in range(100):
        own[i] = np.sort(np.delete(base, rng.choice(120, 20, replace=False)))
    own[100] = np.sort(np.append(own[7], 5))
    sets = spark.createDataFrame([(i, x.tobytes()) for i, x in own.items()], "doc_id long, shingles binary")
    members = spark.createDataFrame([(i, len(x), i) for i, x in own.items()], "rep long, n long, component long")
    buckets = members.selectExpr("1L as bucket", "rep", "n")
    got = _rest(members, buckets, sets, 80, []).collect()
    alike = {(a, b) for a, b in itertools.combinations(own, 2) if 100 * (both := len(np.intersect1d(own[a], own[b]))) >= 80 * (len(own[a]) + len(own[b]) - both)}
    assert (7, 100) in alike and alike <= {tuple(sorted(r)) for r in got}
    assert len(got) < 500
