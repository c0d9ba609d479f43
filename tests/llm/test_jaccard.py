import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import components, jaccard, queries
from wayfold.llm.common import Scratch


def shingles(text, n):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    """[(key, size, class)] in the order of rows; classes by row number."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else min(least[r], k) if k is not None else least[r]
    return [(k, len(s), (least[find(i)] if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))], [find(i) for i in range(len(rows))]


def test_query_equals_brute_force(spark, small):
    got = sorted(map(tuple, queries.op5_jaccard(spark, small).collect()))
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted(brute(docs, 4, 85, 100)[0])
    assert any(r[0] != r[2] for r in got)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(repr, map(tuple, jaccard.near_duplicates(odd, 4, 85, 100).collect())))
    assert got == sorted(map(repr, brute(rows, 4, 85, 100)[0]))
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    words = [(i, t) for i, t in rows if shingles(t, 5)]
    assert kept.count() == len(rows) - len(words) + len(set(brute(words, 5, 80, 100)[1]))
    assert jaccard.one_of_each(none).count() == 0


def near_copies(seed, groups, copies, edits):
    rng = random.Random(seed)
    out, k = [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(edits * len(base) // 100 + 1)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            out.append((k, " ".join(t)))
            k += 1
    return out


def test_borderline_families(spark, monkeypatch):
    """Copies at about the threshold, in groups that one pivot can't settle."""
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rows = near_copies(3, 6, 40, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, num in ((4, 85), (5, 80)):
        assert sorted(map(tuple, jaccard.near_duplicates(df, n, num, 100).collect())) == sorted(brute(rows, n, num, 100)[0])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.sampled_from([(85, 100), (80, 100), (50, 100), (95, 100)]))
def test_similar_sets_share_a_key(seed, size, ratio):
    rng = np.random.default_rng(seed)
    num, den = ratio
    plan = jaccard.Plan(4, num, den)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
    gone = rng.integers(0, max(1, (den - num) * len(a) // den) + 1)
    more = max(0, (den * (len(a) - gone)) // num - len(a))
    b = np.union1d(rng.permutation(a)[gone:], rng.integers(0, 2**63, rng.integers(0, more + 1)).astype(np.uint64))
    shared = len(np.intersect1d(a, b))
    if shared * den >= num * (len(a) + len(b) - shared) and not np.array_equal(a, b):
        assert len(np.intersect1d(plan.keys(a), plan.keys(b)))


def test_a_set_gives_no_more_keys_than_can_differ():
    """Keys are what fills the disk: per band one more than the shingles in which a set may differ from one that it is linked with."""
    rng = np.random.default_rng(4)
    for n, num in ((4, 85), (5, 80)):
        plan = jaccard.Plan(n, num, 100)
        for size in (60, 246, 484, 960, 5100):
            most = (100 - num) * (size + size * 100 // num) // (100 + num) + 1
            keys = plan.keys(np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)))
            assert len(keys) <= most * len(plan.bands(size)) and int(keys.max()) < 2**48


def shuffled(spark, since):
    """Highest stage number, and bytes that stages after `since` shuffled."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    own = [stages.apply(i) for i in range(stages.size())]
    return max(s.stageId() for s in own), sum(s.shuffleWriteBytes() for s in own if s.stageId() > since)


def test_later_pairs_move_only_their_own_sets(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(2000))) for i in range(300)]
    plan = jaccard.Plan(4, 85, 100)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        with Scratch(spark) as scratch:
            df = scratch.stored(spark.createDataFrame(rows, "doc_id long, text string"))
            marked = scratch.stored(jaccard.sized(df.select("doc_id", "text", jaccard._spot("text")), plan))
            sids = sorted(r.sid for r in marked.collect())
            exact = jaccard.Sets(df, marked, plan, scratch, "text")
            pairs = [(a, b) for a, b in zip(sids, sids[1:])]
            assert scratch.stored(exact.linked(scratch.stored(spark.createDataFrame(pairs, "a long, b long")))).count() == 0
            last, _ = shuffled(spark, -1)
            near = scratch.stored(spark.createDataFrame(pairs[:2], "a long, b long"))
            assert scratch.stored(exact.linked(near)).count() == 0
            assert shuffled(spark, last)[1] < 1_000_000  # all sets have 4.8 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 201), (203, 201), (203, 204)]
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert components.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 130)} | {i: 201 for i in (201, 203, 204, 205)}


def unlike(n, words=16, seed=1):
    """Members of one group that are unlike but for a close pair at every hundredth place."""
    rng = np.random.default_rng(seed)
    sketches = rng.integers(-(2**63), 2**63 - 1, (n, words))
    sketches[100::100] = sketches[99:-1:100] ^ 1
    return [(7, i + 1, n, 10 * i, 10 * i, 30 * words, sketches[i].tolist()) for i in range(n)]


MEMBERS = "key long, place int, size long, sid long, root long, n_shingles long, sketch array<long>"


def test_pivots_are_held_in_blocks(spark, monkeypatch):
    """Memory of the comparing function in a group of unlike sets, and its pairs."""
    rows, seen = unlike(1200), []
    df = spark.createDataFrame(rows, MEMBERS)

    def held(self, run, schema):
        seen.append((self.coalesce(1).toArrow().to_batches(max_chunksize=10_000), run))
        return self.sparkSession.createDataFrame([], schema)

    monkeypatch.setattr(type(df), "mapInArrow", held)
    jaccard.pivot_pairs(df, 0, 1 << 12, jaccard.Plan(4, 85, 100))
    batches, run = seen[0]
    tracemalloc.start()
    got = [(a, b) for out in run(iter(batches)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got) == [(10 * (i - 1), 10 * i) for i in range(100, 1200, 100)]
    assert peak < 20_000_000, peak


def test_blocks_and_shares_meet_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7, raising=False)
    monkeypatch.setattr(jaccard, "SHARE", 50)
    rng, rows = random.Random(5), []
    for key, n in ((1, 2), (2, 3), (3, 90), (4, 170)):
        for i in range(n):
            words = rng.choice((1, 2, 4))
            rows.append((key, i + 1, n, 1000 * key + i, rng.randrange(5), 20 * words, [(rng.getrandbits(1) << 62) - (rng.getrandbits(1) << 3)] * words))
    df, plan = spark.createDataFrame(rows, MEMBERS).repartition(3), jaccard.Plan(4, 85, 100)

    def fold(s, to):
        return [int(np.bitwise_xor.reduce(np.array(s[i::to], np.int64))) & (2**64 - 1) for i in range(to)]

    for low, high in ((0, 5), (1, 16), (16, 100), (100, 256)):
        want = set()
        for x in rows:
            for y in rows:
                if x[0] == y[0] and low < x[1] <= high and x[1] < y[1] and x[4] != y[4]:
                    to = min(len(x[6]), len(y[6]))
                    # at the smallest size of the block a bound may be weaker, so more pairs may pass, never fewer
                    if sum((p ^ q).bit_count() for p, q in zip(fold(x[6], to), fold(y[6], to), strict=True)) * 185 <= 15 * (x[5] + y[5]):
                        want.add((min(x[3], y[3]), max(x[3], y[3])))
        got = [tuple(r) for r in jaccard.pivot_pairs(df, low, high, plan).collect()]
        allowed = {(min(x[3], y[3]), max(x[3], y[3])) for x in rows for y in rows if x[0] == y[0] and low < x[1] <= high and x[1] < y[1] and x[4] != y[4]}
        assert len(got) == len(set(got)) and want <= set(got) <= allowed
