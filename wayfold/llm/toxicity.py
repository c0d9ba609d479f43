"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Grades 0 < 1 < ... < K-1. One weight vector is shared by all thresholds: P(grade <= j) = sigmoid(t_j - w.x),
t_0 < t_1 < ...; the output is the expected grade, sum over j of P(grade > j).

Features of a text are its lower-cased words and the first 4, 5 and 6 letters of longer words, so inflected
forms share evidence; a feature's value is 1 if the text has it. The vocabulary is chosen from labelled rows:
document frequencies by grade are summed in Spark, and the `FEATURES` with the largest chi-square statistic
that at least `MIN_ROWS` labelled rows have are kept. The regression is fitted on at most `MOST_LABELLED`
labelled rows (chosen by a hash of the key; both bounds are parameters), by full-batch gradient steps with
momentum, grades weighted to equal shares. Then the thresholds alone are fitted again with the rows as they are:
the severity is the expectation under these calibrated thresholds. Scoring covers every row and whole texts.

`graded` turns binary labels into three grades: 0 is not toxic; toxic rows with fewer toxic-associated features
than the median of toxic rows are 1, the others 2.

Defined cases: null or empty text has no features and gets the intercepts' expectation; rows without a label are
scored too; null labels are left out of training; without any toxic label severity is 0 throughout; an empty
table gives no rows; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import arrow_map, map_texts

MOST_LABELLED, FEATURES, MIN_ROWS = 20_000, 4000, 4
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: A row is toxic if its expected severity, with classes balanced, reaches this.
TOXIC = 0.5


def features(text: str | None) -> set[str]:
    words = set(WORD.findall(text.lower())) if text else set()
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


@dataclass
class OrdinalModel:
    """Weights by feature and the ordered thresholds: with classes balanced, which decide, and calibrated, which give the severity."""

    weights: dict[str, float]
    thresholds: list[float]
    calibrated: list[float]

    def above(self, x: float, thresholds: list[float]) -> list[float]:
        """P(grade > j) for each threshold."""
        return [1.0 / (1.0 + np.exp(np.clip(t - x, -60.0, 60.0))) for t in thresholds]

    def judge(self, text: str | None) -> tuple[float, int, bool]:
        """Expected severity, the most probable grade, and whether the balanced expectation reaches TOXIC."""
        weights = self.weights
        if not self.thresholds:
            return 0.0, 0, False
        x = sum(weights[f] for f in sorted(features(text) & weights.keys()))
        above = self.above(x, self.thresholds)
        return float(sum(self.above(x, self.calibrated))), int(np.argmax(-np.diff([1.0, *above, 0.0]))), float(sum(above)) >= TOXIC


def labelled_sample(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """(key, label, text) of at most `most` labelled rows, one for each key, by a hash of the key."""
    tagged = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    n, turn = tagged.count(), F.xxhash64("__key")
    if n > most:  # a hash threshold leaves a little more than `most`, then the limit makes it a bound
        tagged = tagged.filter(F.pmod(turn, F.lit(1 << 62)) < min(1 << 62, ((1 << 62) * (most + 10 * math.isqrt(most) + 100)) // n)).orderBy(turn, "__key").limit(most)
    few = F.broadcast(tagged)  # at most `most` rows of two numbers
    one = Window.partitionBy("__key").orderBy(F.xxhash64("__text"), "__text")
    texts = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    first = texts.join(few, "__key").withColumn("__at", F.row_number().over(one)).filter("__at = 1")
    return first.select(F.col("__key").alias(key), F.col("__label").alias("label"), F.col("__text").alias("text"))


def fit(spark_rows: DataFrame, key: str = "doc_id", n_features: int = FEATURES, min_rows: int = MIN_ROWS, steps: int = 300, l2: float = 1e-3) -> OrdinalModel:
    """Fits on (key, label 0/1, text): feature counts are summed in Spark, the rows' feature numbers are gathered."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features(text):
                    tally.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())], ["feature", "n0", "n1"])

    rows = {r["label"]: r["n"] for r in spark_rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = rows.get(0, 0), rows.get(1, 0)
    if not n1 or not n0:
        return OrdinalModel({}, [], [])
    both = arrow_map(spark_rows.select("label", "text"), counted, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).filter(f"a + b >= {min_rows}")
    # chi-square of the 2 x 2 table feature x label
    n = n0 + n1
    chi = F.expr(f"{n} * pow(double(b) * ({n0} - a) - double(a) * ({n1} - b), 2) / (double(a + b) * ({n} - a - b + 1) * {n0} * {n1})")
    best = both.withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(n_features).collect()
    names = [r["feature"] for r in best]
    toxic_side = {r["feature"] for r in best if r["b"] * n0 > 4 * r["a"] * n1 and r["chi"] > 10}
    number = {f: i for i, f in enumerate(names)}

    def vectors(texts: list) -> dict[str, list]:
        found = [features(t) for t in texts]
        return {"x": [sorted(number[f] for f in fs & number.keys()) for fs in found], "hits": [len(fs & toxic_side) for fs in found]}

    data = map_texts(spark_rows.select("label", key, "text"), vectors, "x array<int>, hits int").orderBy(key).collect()
    y = graded(np.array([r["label"] for r in data]), np.array([r["hits"] for r in data]))
    row = np.repeat(np.arange(len(data)), [len(r["x"]) for r in data])
    col = np.fromiter((i for r in data for i in r["x"]), np.int64, len(row))
    w, t, c = fit_cumulative_link(row, col, len(data), len(names), y, steps, l2)
    return OrdinalModel({f: float(v) for f, v in zip(names, w, strict=True) if v}, t.tolist(), c.tolist())


def graded(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from binary labels and the number of toxic-associated features."""
    middle = np.median(hits[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, 1 + (hits >= max(middle, 1)), 0)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -40, 40)))


def ordered(theta: np.ndarray) -> np.ndarray:
    """Thresholds of a first one and the logarithms of the gaps, which keeps them in order."""
    return np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])


def gradients(x: np.ndarray, theta: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the weighted negative log-likelihood: by each row's x, by theta, and its value."""
    t = ordered(theta)
    grades = len(t) + 1
    edge = np.concatenate([[-np.inf], t, [np.inf]])
    hi, lo = _sigmoid(edge[y + 1] - x), _sigmoid(edge[y] - x)
    hi, lo = np.where(y + 1 < grades, hi, 1.0), np.where(y > 0, lo, 0.0)
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)
    p = np.maximum(hi - lo, 1e-12)
    gt = np.array([-(weight * dhi / p)[y == j].sum() + (weight * dlo / p)[y == j + 1].sum() for j in range(grades - 1)])
    gtheta = np.concatenate([[gt.sum()], [np.exp(theta[1 + j]) * gt[1 + j :].sum() for j in range(grades - 2)]])
    return weight * (dhi - dlo) / p, gtheta, float(-(weight * np.log(p)).sum())


def _descent(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Accelerated gradient steps of adapted length."""
    at, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for k in range(1, steps + 1):
        g = gradient(at)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return at


def fit_cumulative_link(row: np.ndarray, col: np.ndarray, n: int, width: int, y: np.ndarray, steps: int, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, thresholds, calibrated thresholds): the first two with classes balanced, the last for the rows as they are."""
    grades = int(y.max()) + 1
    share = np.bincount(y, minlength=grades) / n
    weight = np.minimum(1.0 / np.maximum(share * grades, 1e-9), 20.0)[y]
    weight /= weight.sum()
    base = np.cumsum(share)[:-1]
    start = np.log(base / np.maximum(1 - base, 1e-9))
    theta = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2))])

    def both(at: np.ndarray) -> np.ndarray:
        gx, gtheta, _ = gradients(np.bincount(row, at[:width][col], n), at[width:], y, weight)
        return np.concatenate([np.bincount(col, gx[row], width) + l2 * at[:width], gtheta])

    found = _descent(np.concatenate([np.zeros(width), theta]), both, steps)
    w, theta = found[:width], found[width:]
    x, even = np.bincount(row, w[col], n), np.full(n, 1.0 / n)
    return w, ordered(theta), ordered(_descent(theta, lambda at: gradients(x, at, y, even)[1], steps))


def severity(df: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """Adds severity (expected grade), grade (most probable) and toxic; drops the text column (and columns of these names)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list) -> dict[str, list]:
        got = [sent.value.judge(t) for t in texts]
        return {"severity": [round(s, 6) for s, _, _ in got], "grade": [g for _, g, _ in got], "toxic": [x for _, _, x in got]}

    return map_texts(df, judge, "severity double, grade int, toxic boolean", text)
