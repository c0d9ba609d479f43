"""Divergences against a plain version on the full grid of sources and terms, and the sketch's promise."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import divergence
from wayfold.llm.common import table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 10**9


def plain(rows: list[tuple], at_least: int = 3, most: int = 200) -> list[tuple]:
    """rows: (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= at_least]

        def shares(count, kept=kept):
            below = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + UNIT * (count[t] + 1) // below for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= most]
    return sorted(out)


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_awkward_documents(odd):
    rows = [tuple(r) for r in odd.select("lang", "source", "text").collect()]
    assert rows_of(divergence.divergence(odd, at_least=1)) == plain(rows, 1)
    assert rows_of(divergence.divergence(odd, at_least=3)) == plain(rows, 3)


@pytest.mark.parametrize("width_bits", [22, 6])
def test_random_documents(spark, width_bits):
    """Also with a sketch so small that it rules out nearly nothing: results are the same."""
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Été", "ÜBER", "a1b", "x_y", "東京"]
    rows = [(f"l{i % 3}" if i % 11 else None, f"s{rng.integers(7)}" if i % 13 else None, " ".join(words[j] for j in rng.zipf(1.4, rng.integers(0, 40)) % len(words))) for i in range(200)]
    rows += [("only", "a", "12 34"), ("only", "b", None), ("lone", "a", "x x x"), ("bare", "z", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit(1), "term": F.lit("t"), "docs": F.lit(2)}).repartition(5)
    assert rows_of(divergence.divergence(df, most=5, width_bits=width_bits)) == plain(rows, most=5)


def test_small_table(spark, small):
    docs = table(spark, small, "documents")
    assert rows_of(divergence.divergence(docs)) == plain([tuple(r) for r in docs.select("lang", "source", "text").collect()])


def test_sketch_drops_rare_terms_and_no_other(spark, small):
    docs = divergence.groups_of(table(spark, small, "documents").repartition(4), "lang", "source", "text")
    possible = divergence.possible_cells(docs)
    left = {(r["lang"], r["term"]) for r in divergence.counted(docs, possible).collect()}
    exact = defaultdict(Counter)
    for r in docs.collect():
        exact[r["lang"]].update(set(TERM.findall(r["text"].lower() if r["text"].isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))))
    common = {(lang, t) for lang, c in exact.items() for t, n in c.items() if n >= 3}
    every = sum(map(len, exact.values()))
    assert common <= left and len(left) - len(common) < 0.01 * every < every - len(common)


def test_tally_splits_without_loss(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "a"]), pa.array([b"x y X", b"", b"y y y y y y y"])], ["lang", "text"])
    found = Counter()
    for groups, group, terms, term, n, docs in divergence.tallied(iter([batch, batch])):
        for g, t, x, d in zip(group, term, n, docs, strict=True):
            found[groups[g][0], terms[int(t)].as_py(), "n"] += int(x)
            found[groups[g][0], terms[int(t)].as_py(), "docs"] += int(d)
    assert found == {("a", b"x", "n"): 4, ("a", b"x", "docs"): 2, ("a", b"y", "n"): 16, ("a", b"y", "docs"): 4}


def test_empty(none):
    got = divergence.divergence(none)
    assert got.count() == 0 and got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
