"""The methods of language identification and secret scanning against plain versions and on held-out kinds."""

import base64
import math
import random
import re
import string
import time
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import langid, quality, queries, secrets, toxicity


def plain_parse(reference, text):
    """Phrases of the greedy longest-match parse; all that is no letter counts as one symbol."""
    symbols = lambda s: "".join(c if c.isalpha() else " " for c in langid.folded(s))
    reference, text, at, n = symbols(reference), symbols(text), 0, 0
    while at < len(text):
        step = 1
        while at + step < len(text) and text[at : at + step + 1] in reference:
            step += 1
        at, n = at + step, n + 1
    return n


def test_phrases_of_long_texts_are_whole(monkeypatch):
    """Texts of several thousand characters, walked together and one by one, have the phrases of the plain parse."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghié", k=rng.randrange(2, 9))) for _ in range(300)]
    references = {k: " ".join(rng.choices(words[i * 60 : i * 60 + 160], k=700)) for i, k in enumerate("xyz")}
    texts = [" ".join(rng.choices(words, k=k)) for k in (1, 3, 40, 400, 900, 900, 1500)] + [references["y"][100:4000], "", "Ж漢" * 50]
    want = [[plain_parse(references[k], t) for k in "xyz"] for t in texts]
    parser = langid.CrossParser(references)
    assert parser.phrases(texts).tolist() == want
    monkeypatch.setattr(langid, "FEW", 2)
    assert langid.CrossParser(references).phrases(texts).tolist() == want
    assert parser.phrases([]).shape == (0, 3)


#: Scripts of 60 letters or more that have no case, and one that has.
SCRIPTS = {"am": 0x1200, "bo": 0x4E00, "hy": 0xAC00, "ja": 0x30A1, "ii": 0xA000, "va": 0xA500, "cr": 0x1401, "zh": 0x6000, "ko": 0xB000}


def test_many_scripts_of_unequal_references(spark):
    rng = random.Random(8)
    letters = {k: [c for c in map(chr, range(at, at + 90)) if c.isalpha()] for k, at in SCRIPTS.items()}
    letters["x1"] = letters["x2"] = list("abcdefghijklmnopqrstuvwxyzäöüßéèêçñ")  # one alphabet, other words
    assert all(len(v) > 60 for k, v in letters.items() if k[0] != "x")
    rows = []
    for i, (lang, own) in enumerate(letters.items()):
        words = ["".join(rng.choices(own, k=rng.randrange(2, 6))) for _ in range(200)]
        for j in range(60 if i % 2 else 12):  # labelled text of a fifth for every other language
            rows.append((len(rows), " ".join(rng.choices(words, k=60)), lang, j % 3 > 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, learn boolean").repartition(4)
    parser = langid.CrossParser(langid.reference_texts(df, F.col("learn")))
    assert len(parser.points) > 500
    got = langid.predict(df.filter("NOT learn"), parser).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert len(got) == len(letters) and all(r.right >= 0.9 for r in got)


# secrets


@pytest.fixture(scope="module")
def models(spark, small):
    return secrets.train_models(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet"))


ORDINARY = """AbstractSingletonProxyFactoryBean getElementsByTagNameAndClassName MAX_NUMBER_OF_CONNECTIONS_PER_HOST
src/main/java/org/example/ServiceImplementation XMLHttpRequestEventTargetImpl -------------------------------- ================
test_secrets_beside_a_pattern_in_one_run com/google/common/collect/ImmutableSortedMultiset 2024-01-15-daily-backup-report
application/vnd-openxmlformats-officedocument IllegalArgumentException2 utf8_general_ci_collation handleMouseDownEvent3D
node_modules/webpack/lib/Compiler wp-content/uploads/2021/08/header-image-1024x768 internationalization-i18n-support
sha256sum_of_file_v2 iso-8859-1-encoding-table kubernetes-dashboard-7d9f isEquivalentToIgnoringCaseAndWhitespace
4475383770160990 Donaudampfschifffahrtsgesellschaft""".split()


def test_precision_and_recall_on_kinds_without_labels(models):
    rng = random.Random(3)
    found = lambda strings: sum(bool(secrets.random_parts(x, models)) for x in strings) / len(strings)
    assert [x for x in ORDINARY if secrets.random_parts(x, models)] == []
    assert found([str(uuid.UUID(bytes=rng.randbytes(16), version=4)) for _ in range(50)]) == 0
    assert found(["".join(rng.choices(string.ascii_letters + string.digits, k=k)) for k in (16, 19, 24, 40) for _ in range(50)]) >= 0.95
    assert found([base64.b64encode(rng.randbytes(k)).decode() for k in (15, 24, 33) for _ in range(50)]) >= 0.95
    assert found(["".join(rng.choices("0123456789abcdef", k=k)) for k in (16, 19, 22) for _ in range(50)]) >= 0.95


def test_a_secret_inside_an_ordinary_path_is_cut_out(models):
    run = "source_of_the_data/named_after_the_station/q8Zr2LxV7mKp4TnW9sYb3JdH6f/and_other_tests_in_there"
    ((a, b),) = secrets.random_parts(run, models)
    assert "q8Zr2LxV7mKp4TnW9sYb3JdH6f" in run[a:b] and b - a < 34


def plain_ratio(models, run):
    """The ratio character by character, from the definition."""
    random_part, ordinary, last = 0.0, 0.0, 0
    for c in run:
        code = secrets.SYMBOLS.index(c) + 1
        random_part, last = random_part + models.random[last, code], code
    spaced = re.sub(r"[+/_=-]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", run))
    a = b = 0
    for c in spaced.lstrip():  # the start is a boundary already
        code = 0 if c == " " else 27 + int(c) if c.isdigit() else ord(c.lower()) - 96
        ordinary += models.ordinary[(a * secrets.M + b) * secrets.M + code]
        if c.isalpha() and b == 0:
            ordinary -= math.log(3)
        a, b = b, code
    return random_part - ordinary


def test_ratios_are_of_the_definition(models):
    for run in (*ORDINARY[:5], "a", "A1", "aBCd-eF", "__x--Y9", "XMLb", "q8Zr2LxV7mKp4TnW9sYb"):
        assert float(models.ratios(run).sum()) == pytest.approx(plain_ratio(models, run))
    rng = np.random.default_rng(1)
    pairs, three = rng.integers(0, 5, (secrets.N, secrets.N)), rng.integers(0, 5, secrets.M**3)
    made = secrets.models_of(pairs, three)
    assert np.exp(made.random).sum(1) == pytest.approx(np.ones(secrets.N))
    sums = np.exp(made.ordinary).reshape(-1, secrets.M).sum(1)
    assert ((sums > 0.19) & (sums < 1.000001)).all()


def test_very_long_texts_take_seconds(models):
    rng = random.Random(5)
    texts = [
        "".join(rng.choices("0123456789abcdef", k=2_000_000)),
        " ".join("".join(rng.choices("0123456789abcdef", k=40)) for _ in range(50_000)),
        "/".join(rng.choices([*ORDINARY, "deadbeef" * 4], k=60_000)),
    ]
    for text in texts:
        began = time.perf_counter()
        spans = secrets.scan(text, models)
        assert spans and time.perf_counter() - began < 20
        assert all(0 <= a < b <= len(text) for a, _, b in spans)


# toxicity


def plain_probabilities(x, t):
    above = [1.0, *(1 / (1 + math.exp(v - x)) for v in t), 0.0]
    return [a - b for a, b in zip(above, above[1:], strict=False)]


def test_gradients_are_of_the_likelihood():
    rng = np.random.default_rng(6)
    x, theta, y, weight = rng.normal(size=40), np.array([-0.4, 0.3, -0.7]), rng.integers(0, 4, 40), rng.uniform(0.5, 2, 40)
    t = toxicity.ordered(theta)
    assert list(t) == sorted(t)
    loss = lambda x, theta: -sum(w * math.log(plain_probabilities(v, toxicity.ordered(theta))[g]) for v, g, w in zip(x, y, weight, strict=True))
    gx, gtheta, value = toxicity.gradients(x, theta, y, weight)
    assert value == pytest.approx(loss(x, theta))
    e = 1e-6
    assert gx == pytest.approx([(loss(x + e * d, theta) - loss(x - e * d, theta)) / (2 * e) for d in np.eye(40)], abs=1e-5)
    assert gtheta == pytest.approx([(loss(x, theta + e * d) - loss(x, theta - e * d)) / (2 * e) for d in np.eye(3)], abs=1e-5)


def test_severity_is_the_calibrated_expectation():
    rng = np.random.default_rng(2)
    n, width = 6000, 30
    has = rng.random((n, width)) < 0.2
    true = rng.normal(0, 1.2, width)
    x = has @ true
    cuts = [2.0, 3.5]
    y = np.array([rng.choice(3, p=plain_probabilities(v, cuts)) for v in x])
    row, col = np.nonzero(has)
    w, t, c = toxicity.fit_cumulative_link(row, col, n, width, y, 400, 1e-5)
    model = toxicity.OrdinalModel({}, list(t), list(c))
    expected = np.array([sum(model.above(v, c)) for v in np.bincount(row, w[col], n)])
    assert expected.mean() == pytest.approx(y.mean(), abs=0.02)
    for low, high in ((0, 0.25), (0.25, 0.75), (0.75, 2.01)):
        own = (expected >= low) & (expected < high)
        assert own.sum() > 50 and expected[own].mean() == pytest.approx(y[own].mean(), abs=0.12)
    assert np.corrcoef(w, true)[0, 1] > 0.95


def test_the_labelled_sample_is_bounded_and_whole(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("x").alias("label"), F.lit(1).alias("toxic"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    assert toxicity.labelled_sample(docs, labels, most=500).count() == 500
    assert toxicity.labelled_sample(docs, labels, most=5000).count() == 3000
    got = toxicity.labelled_sample(docs, labels, most=500).collect()
    assert {r.label for r in got} == {0, 1} and all(r.label == r.doc_id % 2 for r in got)


# quality


def plain_kept(text):
    """The verdict from the rules' definitions, all of them measured."""
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    n, lines = len(words), t.split("\n")
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    again = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(set(windows)) < len(windows) else set()
    filled = [x for x in lines if re.search("[^\x20\x09-\x0d]", x)]
    twice = len(filled) - len(set(filled))
    share = lambda v, percent: 100 * v > percent * len(lines)
    cut = sum(x.rstrip().endswith(("...", "…")) for x in lines)
    bullets = sum(x.strip()[:1] in ("-", "*", "•", "‣", "·") for x in lines if x.strip())
    bad = [
        n < 20,
        100 * len(again) > 30 * n,
        10 * len(re.findall("[#*$%&|<>]", t)) > n,
        twice > 0 and share(twice, 30),
        not 2 * n <= sum(map(len, words)) <= 20 * n,
        2 * sum(w.isupper() for w in t.split()) > n,
        2 * sum(any(c.isalpha() for c in w) for w in t.split()) < n,
        cut > 2 and share(cut, 30),
        bullets > 2 and share(bullets, 90),
        len(t) >= 1000 and 12 * len(zlib.compress(t.encode(), 1)) < len(t),
    ]
    return not any(bad)


def test_verdicts_are_those_of_all_rules(spark, small, odd):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: (r.base_failed, r.kept) for r in queries.op8_quality(spark, small).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: plain_kept(t) for k, t in texts.items()}
    assert not any(a and b for a, b in got.values()) and 0 < sum(b for _, b in got.values()) < len(got)
    made = ["- item of a list here\n" * 3 + "\n".join(f"- point number {i} of this list" for i in range(40)), "\n".join(f"a line {i} that is cut off ..." for i in range(30)), "1 2 3 4 5 6 7 8 9 " * 5 + "ten " * 3, "ab " * 2000, "WORDS IN CAPITALS " * 4 + "are not " * 4]
    df = odd.select("text").filter("length(text) < 20000 OR text IS NULL").unionByName(spark.createDataFrame([(t,) for t in made], "text string")).withColumn("doc_id", F.monotonically_increasing_id())
    rows = df.collect()
    verdicts = {r.doc_id: r.kept for r in quality.quality_cascade(df).collect()}
    assert verdicts == {r.doc_id: plain_kept(r.text) for r in rows}


def test_the_cascade_saves_work(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    order = quality.cascade_order(quality.RULES, quality.profile_rules(df, quality.RULES))
    rows = quality.quality_cascade(df, order=order).collect()
    assert all(r.rules_run == len(quality.RULES) for r in rows if r.kept)
    assert all(r.rules_run < len(quality.RULES) for r in rows if not r.kept) or order[-1].name in {"n_words", "n_repeat_words"}
