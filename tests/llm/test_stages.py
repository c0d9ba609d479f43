"""Every stage of the pipeline against a plain version of it, on the small tables and on awkward rows with clashing columns."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import secrets, toxicity
from wayfold.llm.common import table

CLASHING = ("label", "grade", "toxic", "items", "n_hit", "row", "text_2", "place", "first", "one", "turn", "__text_2", "__row", "__row0", "__row2", "__key", "__label")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def inputs(spark, small, odd):
    whole = spark.read.parquet(f"{small}/documents.parquet").select(COLUMNS)
    return {"small": whole, "odd": odd.withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})}


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)})) if text else []


def plain_toxic(spark, docs, small):
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, small, "labels")))
    return [r for r in docs.collect() if not model.judge(r.text)[2]]


def plain_one_of_each(spark, docs, small):
    rows = list(docs.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r.text)) else set() for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        at = find(i)
        if at not in best or (r.doc_id is None, r.doc_id or 0) < (rows[best[at]].doc_id is None, rows[best[at]].doc_id or 0):
            best[at] = i
    return [rows[i] for i in best.values()]


def plain_clean(spark, docs, small):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    low = {c: c + 32 for c in range(65, 91)}
    phrases = set()
    for item in table(spark, small, "benchmark").collect():
        w = re.findall(pattern, (item.text or "").translate(low))
        phrases |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    lengths, kept = {len(p) for p in phrases}, []
    for r in docs.collect():
        w, hit = re.findall(pattern, (r.text or "").translate(low)), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(r)
    return kept


def plain_redacted(spark, docs, small):
    models, out = secrets.train_models(docs), []
    for r in docs.collect():
        text, at, parts = r.text, 0, []
        gone = set()
        for s, _, e in secrets.scan(text, models) if text else []:
            gone |= set(range(s, e))
        # overlapping spans are one mark, adjacent ones are not
        for s, e in secrets.united([(s, 0, e) for s, _, e in sorted(secrets.scan(text, models))]) if text else []:
            parts += [text[at:s], None]
            at = e
        if parts:
            kept = "".join(c for i, c in enumerate(text) if i not in gone)
            text = ("".join(p or "" for p in [*parts, text[at:]]), kept)
            assert text[0] == text[1]
            out.append((r, kept))
        else:
            out.append((r, None))
    return out


PLAIN = {"toxicity": plain_toxic, "jaccard_join": plain_one_of_each, "decontamination": plain_clean}


@pytest.mark.parametrize("kind", ["small", "odd"])
@pytest.mark.parametrize("name", PLAIN)
def test_stage_keeps_what_the_plain_version_keeps(spark, small, inputs, name, kind):
    docs = inputs[kind]
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, small)
    assert got.columns == docs.columns
    want = Counter(tuple(r) for r in PLAIN[name](spark, docs, small))
    assert rows_of(got) == want
    assert kind == "odd" or 0 < sum(want.values()) < docs.count()


@pytest.mark.parametrize("kind", ["small", "odd"])
def test_redaction_takes_out_the_spans_and_nothing_else(spark, small, inputs, kind):
    docs = inputs[kind]
    got = corpus_pipeline.redact_secrets(spark, docs, small)
    assert got.columns == docs.columns
    place, length = docs.columns.index("text"), docs.columns.index("n_chars")
    want = Counter()
    for row, kept in plain_redacted(spark, docs, small):
        values = list(row)
        if kept is not None:
            values[place] = kept
        values[length] = None if kept is not None or row.text is not None else row.n_chars
        want[tuple(values)] += 1
    found = Counter()
    for row in got.collect():
        values = list(row)
        assert row.text is None or row.n_chars == len(row.text)
        if row.text is not None:
            values[place], values[length] = row.text.replace("[SECRET]", ""), None
        found[tuple(values)] += 1
    assert found == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, small, inputs, name):
    none = inputs["odd"].filter("false")
    got = dict(corpus_pipeline.STAGES)[name](spark, none, small)
    assert got.count() == 0 and (name == "mixing" or got.columns == none.columns)


def test_mixing_of_awkward_rows(spark, small, inputs):
    got = corpus_pipeline.mix_sources(spark, inputs["odd"], small).collect()
    sizes = Counter((r.doc_id, r.source, len(words(r.text))) for r in inputs["odd"].collect())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == sizes
    assert all(0 <= r.taken <= 2 * r.size for r in got)
