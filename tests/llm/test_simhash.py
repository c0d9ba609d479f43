"""Fingerprints and components against plain versions, on every way that long posting lists take."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import simhash
from wayfold.llm.common import Scratch, table
from wayfold.llm.components import components


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int]) -> dict[int, int]:
    """Fingerprint -> smallest linked one, by comparing all pairs."""
    distinct = np.array(sorted(set(prints)), np.uint64)
    root = {int(x): int(x) for x in distinct}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x in distinct:
        for y in distinct[(np.bitwise_count(distinct ^ x) <= 3) & (distinct > x)]:
            a, b = sorted((find(int(x)), find(int(y))))
            root[b] = a
    return {x: find(x) for x in root}


def flipped(x: int, n: int, rng: random.Random) -> int:
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def planted(rng: random.Random) -> list[int]:
    """Random fingerprints, and pairs, chains and balls around some."""
    out = [rng.getrandbits(64) for _ in range(300)]
    out += [flipped(x, n, rng) for x in out[:120] for n in (3, 4)]
    x = rng.getrandbits(64)
    for _ in range(40):
        x = flipped(x, 3, rng)
        out.append(x)
    ball = rng.getrandbits(64)
    return out + [flipped(ball, rng.randint(0, 6), rng) for _ in range(300)] + [0, (1 << 64) - 1, 7]


def test_fingerprints_and_components_equal_plain(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    prints = [plain_fingerprint(r["text"]) for r in odd.collect()]
    roots, least = plain_components(prints), defaultdict(list)
    for r, p in zip(odd.collect(), prints, strict=True):
        least[roots[p]].append(r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{p:016x}", min(i for i in least[roots[p]] if i is not None)) for r, p in zip(odd.collect(), prints, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want


def test_query_equals_plain(spark, small):
    got = simhash.near_duplicates(table(spark, small, "documents")).collect()
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    roots, least = plain_components(list(prints.values())), {}
    for i, p in sorted(prints.items()):
        least.setdefault(roots[p], i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


@pytest.mark.parametrize("most", [1 << 14, 30, 3])
def test_long_lists_lose_no_link(spark, most):
    """Lists compared at once, by five bytes, and through neighbours give the same components."""
    prints = planted(random.Random(5))
    df = spark.createDataFrame([(simhash.signed(x),) for x in set(prints)], "fp long")
    with Scratch(spark) as scratch:
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, scratch, most), scratch).collect()}
    want, classes = plain_components(prints), defaultdict(set)
    for x in set(prints):
        classes[roots.get(simhash.signed(x), simhash.signed(x))].add(want[x])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(want.values()))


def test_links_are_true_and_few(spark):
    prints = planted(random.Random(6))
    df = spark.createDataFrame([(simhash.signed(x),) for x in set(prints)], "fp long")
    with Scratch(spark) as scratch:
        pairs = simhash.links(df, scratch).collect()
    assert pairs and all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3 for r in pairs)
    assert len(pairs) <= 8 * len(set(prints))


def test_tally_of_bytes():
    x = np.array([0, 1, 0x8000000000000000, 0x0101010101010101, 0xFF00FF00FF00FF00, 0x10], np.uint64)
    assert simhash.shared_bytes(x).tolist() == [8, 7, 7, 0, 4, 7]


def test_empty_table_and_types(none):
    got = simhash.near_duplicates(none)
    assert got.count() == 0 and got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]


def test_all_null_keys(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id long, text string").withColumn("fp", F.lit(1)))
    assert [r["component_id"] for r in got.collect()] == [None, None]
