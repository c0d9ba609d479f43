"""Secret scanning: fixed patterns, and character Markov models compared by log-likelihood ratio.

Both models are trained on labelled samples that the patterns label. Random strings: the values that the
patterns found which hold digits and letters; a first-order model over token characters, mixed half and half with
the uniform source, so that alphabets without a sample count as random, too. Ordinary identifiers: all other
words and identifiers of three or more token characters (of those of `MIN_RUN` and more only the ones without
digits, since the rest may be secrets nobody labelled), each once in a slice of texts; a second-order model over
lower-cased letters and digits, in which an identifier is a chain of words: separators and changes of case are
word boundaries, and each word has one of three case patterns. The orders are interpolated with fixed weights.

What the pattern spans leave of a run of token characters is a piece. A piece of `MIN_RUN` or more characters that
has both digits and letters, or both cases, is a secret if its log-likelihood ratio random : ordinary is at least
`MIN_RATIO` nats and `MIN_RATIO_PER_CHAR` nats a character; if the whole isn't, its stretches of greatest ratio
are, if they reach `STRICTER` times these bounds. Identifiers of the form 8-4-4-4-12 hexadecimal digits (UUIDs) are ordinary by rule.
All steps are linear in the text's length.

Training gathers at most 37^3 + 67^2 counts, whatever the table's size; they are summed in Spark.
Defined cases: null is an empty text; an empty table gives no rows; spans are in code points, end exclusive;
without labelled random strings the random model is the uniform source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import arrow_map, map_texts

#: The patterns and least lengths (fixed values of the contract), in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words one of which every assignment holds, for a quick look before the pattern runs.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_RUN, MIN_RATIO, MIN_RATIO_PER_CHAR = 16, 12.0, 0.7
#: So many times these bounds are asked of a stretch within a run, as it is the best of very many.
STRICTER = 2.0
#: Share of the uniform source in the random model; weights of the orders 2, 1, 0 and of the uniform source in the ordinary one.
UNIFORM, ORDERS = 0.5, (0.7, 0.25, 0.03, 0.02)
#: Token characters; runs that may hold a key of a fixed pattern, pieces to be judged, samples of the ordinary model.
LONG_RUN, RUN, SAMPLE = (re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % n) for n in (20, MIN_RUN, 3))
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

#: Symbols of the random model: the token characters, and 0 for the start.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(SYMBOLS) + 1
CODE = np.zeros(256, np.int64)
CODE[[ord(c) for c in SYMBOLS]] = np.arange(1, N)
#: Symbols of the ordinary model: letters, digits, and 0 for a boundary; kinds: boundary, lower, upper, digit.
M = 37
PLAIN, KIND = np.zeros(256, np.int64), np.zeros(256, np.int8)
for _first, _count, _code, _kind in ((ord("a"), 26, 1, 1), (ord("A"), 26, 1, 2), (ord("0"), 10, 27, 3)):
    PLAIN[_first : _first + _count], KIND[_first : _first + _count] = np.arange(_code, _code + _count), _kind
#: Nats of the choice between a word's case patterns.
CASE = float(np.log(3))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    # an access key or hexadecimal run of the least length lies within a run of token characters
    for run in LONG_RUN.finditer(text):
        a, b = run.span()
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST["access"]]
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of an identifier's bytes as a chain of words, and the byte to which each belongs.

    A boundary symbol comes in before a capital that follows a lower-case letter or precedes one within capitals.
    Successive separators are one boundary.
    """
    code, kind = PLAIN[data], KIND[data]
    before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
    cut = (kind == 2) & ((before == 1) | ((before == 2) & (after == 1)))
    keep = ~((kind == 0) & (before == 0))
    place = np.repeat(np.arange(len(data)), cut.astype(np.int64) + keep)
    out = code[place]
    # of the two symbols of a cut place the first is the boundary
    twice = np.flatnonzero(np.concatenate([place[1:] == place[:-1], [False]]))
    out[twice] = 0
    return out, place


def triples(symbols: np.ndarray) -> np.ndarray:
    """Numbers of (symbol, the one before, the two before), with boundaries ahead of the first."""
    s = np.concatenate([[0, 0], symbols])
    return (s[:-2] * M + s[1:-1]) * M + s[2:]


def is_random_sample(value: str) -> bool:
    return any(map(str.isdigit, value)) and any(map(str.isalpha, value))


def samples(texts: list[str]) -> tuple[list[str], set[str]]:
    """Labelled samples of a slice of texts: random strings, and distinct ordinary words and identifiers."""
    random, ordinary = [], set()
    for t in texts:
        spans = base_spans(t)
        random += [v for s, _, e, at in spans if is_random_sample(v := t[at:e])]
        at = 0
        for s, e in [*united(spans), (len(t), len(t))]:
            ordinary.update(SAMPLE.findall(t, at, s))
            at = e
    return random, {v for v in ordinary if len(v) < MIN_RUN or not any(map(str.isdigit, v))}


@dataclass(frozen=True)
class Models:
    """Log probabilities: random by (symbol before, symbol), ordinary by (two before, one before, symbol)."""

    random: np.ndarray
    ordinary: np.ndarray

    def ratios(self, run: str) -> np.ndarray:
        """Of each character of a run its part in the log-likelihood ratio, random over ordinary."""
        data = np.frombuffer(run.encode("ascii"), np.uint8)
        raw = CODE[data]
        out = self.random[np.concatenate([[0], raw[:-1]]), raw]
        symbols, place = words_of(data)
        start = (symbols > 0) & (np.concatenate([[0], symbols[:-1]]) == 0) & (KIND[data[place]] != 3)
        cost = self.ordinary[triples(symbols)] - CASE * start
        return out - np.bincount(place, cost, len(data))


def models_of(random: np.ndarray, ordinary: np.ndarray) -> Models:
    """From counts of random pairs (N x N) and ordinary triples (M x M x M)."""
    share = lambda n: n / np.maximum(n.sum(-1, keepdims=True), 1)
    r = (1 - UNIFORM) * np.where(random.sum(1, keepdims=True) > 0, share(random), 1 / N) + UNIFORM / N
    o = ordinary.reshape(M, M, M)
    two, one, none, flat = ORDERS
    p = two * share(o) + one * share(o.sum(0)) + none * share(o.sum((0, 1))) + flat / M
    return Models(np.log(r), np.log(p).ravel())


def train_models(df: DataFrame, text: str = "text") -> Models:
    """Counts over all texts, summed in Spark; the driver gets one row for each pair or triple of symbols."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N * N + M**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                random, ordinary = samples([t for t in batch.column(0).slice(at, 512).to_pylist() if t])
                for value in random:
                    code = CODE[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)]
                    np.add.at(total, np.concatenate([[0], code[:-1]]) * N + code, 1)
                if ordinary:
                    data = np.frombuffer(("\n" + "\n".join(ordinary) + "\n").encode("ascii"), np.uint8)
                    total[N * N :] += np.bincount(triples(words_of(data)[0]), minlength=M**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    total = np.zeros(N * N + M**3)
    for cell, n in arrow_map(df.select(F.col(text).cast("string")), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[cell] = n
    return models_of(total[: N * N].reshape(N, N), total[N * N :])


def united(spans: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """(start, end) of overlapping spans together; spans are (start, kind, end, ...), by start."""
    out: list[tuple[int, int]] = []
    for s, _, e, *_ in spans:
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def pieces(text: str, base: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what the spans (by start) leave of each run, if it has the least length."""
    taken, i = united(base), 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        while i < len(taken) and taken[i][0] < end:
            if taken[i][0] - at >= MIN_RUN:
                yield at, taken[i][0]
            at = max(at, taken[i][1])
            if at > end:
                break  # this span may reach into the next run
            i += 1
        if end - at >= MIN_RUN:
            yield at, end


def enough(ratio: float, length: int) -> bool:
    return length >= MIN_RUN and ratio >= MIN_RATIO and ratio >= MIN_RATIO_PER_CHAR * length


def mixed_classes(run: str) -> bool:
    """Digits and letters, or letters of both cases beside more than an initial capital."""
    digit, letter = any(map(str.isdigit, run)), any(map(str.isalpha, run))
    return letter and (digit or (run[1:].lower() != run[1:] and run.upper() != run))


def random_parts(run: str, models: Models) -> list[tuple[int, int]]:
    """(start, end) of the secret in a run: all of it, or its stretches of greatest ratio."""
    if UUID.fullmatch(run) or not mixed_classes(run):
        return []
    d = models.ratios(run)
    if enough(float(d.sum()), len(d)):
        return [(0, len(d))]
    upto = np.concatenate([[0.0], np.cumsum(d)])
    if (upto - np.minimum.accumulate(upto)).max() < STRICTER * MIN_RATIO:
        return []
    out, low, high = [], 0, 0
    for i, x in enumerate(upto.tolist()):
        if x > upto[high]:
            high = i
        # a stretch ends where the sum has fallen by MIN_RATIO from its top, or below its start
        elif x < upto[low] or upto[high] - x >= MIN_RATIO:
            if enough(float(upto[high] - upto[low]) / STRICTER, high - low):
                out.append((low, high))
            low = high = i
    if enough(float(upto[high] - upto[low]) / STRICTER, high - low):
        out.append((low, high))
    return [(a, b) for a, b in out if mixed_classes(run[a:b])]


def scan(text: str, models: Models) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start and kind."""
    base = base_spans(text)
    found = [(s, k, e) for s, k, e, _ in base]
    for a, b in pieces(text, base):
        found += [(a + s, 3, a + e) for s, e in random_parts(text[a:b], models)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(df: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_markov, base_sha256 and spans; drops the text column."""

    def find(texts: list) -> dict[str, list]:
        all_spans = [scan(t, models) if t else [] for t in texts]
        out = {f"n_{name}": [sum(s[1] == k for s in spans) for spans in all_spans] for k, name in enumerate(KINDS)}
        out["base_sha256"] = [sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in all_spans]
        return out | {"spans": [joined(s) for s in all_spans]}

    return map_texts(df, find, "n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string", text)


def redact(df: DataFrame, models: Models, text: str = "text", mark: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """Replaces every span (overlapping ones together) by a mark; keeps the columns and their order.

    A column `length` of code points is brought up to date for the rows that change.
    """

    def change(texts: list) -> dict[str, list]:
        out = []
        for t in texts:
            spans = scan(t, models) if t else []
            if spans:
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])  # noqa: PLW2901
            out.append(t)
        return {"__new": out}

    new = map_texts(df, change, "__new string", text, keep=[c for c in df.columns if c != text])
    same = {text: F.col("__new")} | ({length: F.coalesce(F.length("__new").cast(df.schema[length].dataType), F.col(length))} if length else {})
    return new.select(*(same.get(c, F.col(c)).alias(c) for c in df.columns))
