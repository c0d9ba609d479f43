import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from wayfold.llm import queries, suffix_dedup
from wayfold.llm.common import Scratch


def brute(rows):
    n = suffix_dedup.LENGTH
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    out = []
    for k, b in data:
        gone, runs = bytearray(len(b)), 0
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_query_equals_brute_force(spark, small):
    got = sorted(map(tuple, queries.op3_suffix_dedup(spark, small).collect()), key=repr)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == brute(docs)
    assert sum(r[2] for r in got)


def test_pieces_cover_every_string_once(monkeypatch):
    text = passages()[0][1].encode() * 40
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1 << 12)
    seen = Counter()
    for group in suffix_dedup.pieces([b"short", text, text[:300]]):
        assert sum(len(p) for _, _, p in group) <= 1 << 12
        number, head, _, at = suffix_dedup.picked(group)
        for i, a in zip(number.tolist(), at.tolist(), strict=True):
            for s in range(a >> 16, (a >> 16) + (a & 255) + 1):
                seen[i, s] += 1
    assert seen == Counter({(1, s): 1 for s in range(len(text) - 199)} | {(2, s): 1 for s in range(101)})


def test_odd_rows(odd, none):
    small_texts = odd.filter("text IS NULL OR length(text) < 20000")
    got = suffix_dedup.remove_repeats(small_texts)
    assert got.columns.count("spans") == 1 and "tid" in got.columns
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == brute([(r.doc_id, r.text) for r in small_texts.collect()])
    assert suffix_dedup.remove_repeats(none).count() == 0


def passages(seed=5):
    """Texts that share passages of about LENGTH bytes at shifted places, periodic runs, copies within a text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(m)) for m in (199, 200, 201, 260, 420, 900)]
    rows = []
    for k in range(60):
        t = []
        for _ in range(rng.randrange(1, 5)):
            t.append(" ".join(word() for _ in range(rng.randrange(0, 60))))
            t.append(rng.choice(shared)[rng.randrange(0, 30) :] if rng.random() < 0.7 else "xy" * rng.randrange(0, 150))
        rows.append((k, "".join(t)))
    return rows


def test_passages_and_hot_heads(spark, monkeypatch):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df, batches=3).select(*COLUMNS).collect()), key=repr) == want
    monkeypatch.setattr(suffix_dedup, "MOST_TOGETHER", 3)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).select(*COLUMNS).collect()), key=repr) == want


def removed_bytes(rows):
    """{text number: set of removed positions} of (tid, removed) rows."""
    return {r.tid: {i for s in r.removed for i in range(s.start, s.stop)} for r in rows}


def test_batches_added_one_by_one(spark):
    """After every addition the matches found so far are those of all texts so far; levels stay between additions."""
    rows, batches = passages(11), 5
    df = spark.createDataFrame([(k, t.encode()) for k, t in rows], "tid long, data binary").repartition(3)
    with Scratch(spark) as scratch:
        family, met = suffix_dedup.IndexFamily(scratch), None
        for b in range(batches):
            own = df.filter(F.col("tid") % batches == b)
            found = family.add(suffix_dedup._suffixes(own))
            met = found if met is None else met.unionByName(found)
            assert [n for n, _ in family.levels] == [2**i for i in range(3, -1, -1) if (b + 1) >> i & 1]
            so_far = [(k, t) for k, t in rows if k % batches <= b]
            got = removed_bytes(suffix_dedup.spans_of(df.filter(F.col("tid") % batches <= b), scratch.stored(family.kinds(met.distinct())), scratch).collect())
            want = {r[0]: r[2] for r in brute(so_far)}
            assert {k: len(got.get(k, ())) for k, _ in so_far} == want
            for _, level in family.levels:
                for part in level.select("head", "ctx").rdd.glom().collect():
                    assert part == sorted(part)


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1 << 12)
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, part + "x" * 700 + part[:3000]), (2, "other text " * 5 + part[2000:2500]), (3, "".join(rng.choice("abcd") for _ in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).select(*COLUMNS).collect()), key=repr) == brute(rows)
