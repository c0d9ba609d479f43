import glob
import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import PASSAGE
from wayfold.llm import decontam, queries
from wayfold.llm.common import shared_folder

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    found |= windows[k]
                    hit[i : i + n] = [True] * n
        n_hit = sum(hit)
        out.append((doc, len(w), n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, small):
    got = sorted(map(tuple, queries.op2_decontamination(spark, small).collect()), key=repr)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("cast(item_id as string)", "text").collect()
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


def test_odd_rows(spark, odd, none):
    items = [("1", PASSAGE.upper()), ("1", "one two"), (None, "déjà vu"), ("4", None), ("5", "")]
    frame = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.find_contamination(odd, frame)
    assert got.columns.count("n_words") == 1 and "sid" in got.columns
    rows = [(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got.collect()]
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [(i or "", t) for i, t in items])
    assert sorted(rows, key=repr) == sorted([w[:4] for w in want], key=repr)
    for r in got.collect():
        assert sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    assert decontam.find_contamination(none, frame).count() == 0
    assert decontam.find_contamination(odd, frame.filter("false")).agg({"n_hit": "sum"}).first()[0] == 0


def test_items_in_blocks(spark, odd, monkeypatch):
    frame = spark.createDataFrame([(str(i), f"passage{i} passage{i + 1}") for i in range(40)], "item_id string, text string")
    more = spark.createDataFrame([(f"p{i}", PASSAGE if i % 2 else "one two", i) for i in range(3)], "item_id string, text string, extra int").select("item_id", "text")
    frame = frame.unionByName(more)
    odd = odd.unionByName(odd.limit(2)).withColumn("text_key", F.lit("mine")).withColumn("__hit", F.lit(5))
    columns = ("doc_id", "text", "n_words", "n_hit", "items", "spans", "text_key", "__hit")
    whole = decontam.find_contamination(odd, frame).select(*columns).collect()
    assert sum(r.n_hit for r in whole) > 0
    tables = set(glob.glob(f"{shared_folder(spark)}/scratch-*"))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert len(decontam.phrase_blocks(frame)) > 3
    again = decontam.find_contamination(odd, frame)
    assert sorted(map(repr, again.select(*columns).collect())) == sorted(map(repr, whole))
    assert set(glob.glob(f"{shared_folder(spark)}/scratch-*")) == tables
    assert decontam.find_contamination(odd.limit(0), frame).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=5))
def test_index_finds_every_occurrence(text, phrases):
    codes = np.array([*text, 0], np.int64)
    index = decontam.FMIndex(codes, 4)
    rows = np.zeros((len(phrases), 4), np.int64)
    for i, p in enumerate(phrases):
        rows[i, 4 - len(p) :] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for i, p in enumerate(phrases):
        want = [j for j in range(len(text) - len(p) + 1) if text[j : j + len(p)] == p]
        assert sorted(index.locate(np.arange(low[i], max(low[i], high[i]))).tolist()) == want
