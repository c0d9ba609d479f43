"""Quality rules as a short-circuit cascade.

`Rule(name, measure, rejects)` has a measure over a slice of texts and a predicate on the measured values.
`profile_rules` runs every rule on a random sample (about `sample_rows` rows, a documented parameter) and
returns each rule's cost in seconds per text and its rejection rate; `cascade_order` sorts by rejection per
cost, highest first, which is the best order for independent rules. `quality_cascade` then runs the rules in
that order and measures a text only until the first rule rejects it. The verdict is the conjunction of all
rules, so it doesn't depend on the order or on the sample; only the work does.

Rules listed in `report` are measured for every text after the verdict, because their values are asked for. So
the cascade saves the work of the other rules on rejected texts: rules_run says how many a text took.

Defined cases: a null text has no words and counts as empty; an empty table gives no rows and the listed order
of rules is kept; repeated rows are judged alike.
"""

from __future__ import annotations

import time
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import map_texts

WINDOW = 8


class Text:
    """A text and its words (ASCII white space separates them)."""

    __slots__ = ("raw", "words")

    def __init__(self, text: str | None):
        self.raw = text or ""
        self.words = self.raw.encode("utf-8").split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: Callable[[Text], float]
    rejects: Callable[[Text, float], bool]


def n_words(t: Text) -> int:
    return len(t.words)


_SPACES = str.maketrans("", "", " \t\n\v\f\r")


def word_chars(t: Text) -> int:
    return len(t.raw.translate(_SPACES)) if not t.raw.isascii() else sum(map(len, t.words))


def n_symbols(t: Text) -> int:
    count = t.raw.count
    return sum(count(c) for c in "#*$%&|<>")


def n_dup_lines(t: Text) -> int:
    if "\n" not in t.raw:
        return 0
    counts = Counter(t.raw.split("\n"))
    return sum(n - 1 for line, n in counts.items() if n > 1 and line.encode("utf-8").split())


def n_repeat_words(t: Text) -> int:
    """Words inside 8-word windows that occur twice or more in the text; exact, in O(n) expected time."""
    n = len(t.words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in t.words), np.int64, n + WINDOW - 1)
    if len(ids) == len(seq):
        return 0
    # names of windows of 2, 4 and 8 words: a window's name is that of the pair of its halves
    for half in (1, 2, 4):
        seq = np.unique(seq[:-half] * (int(seq.max()) + 1) + seq[half:], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(seq)[seq] > 1)
    edge = np.zeros(n + WINDOW, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def alpha_words(t: Text) -> int:
    """Words with a letter of any script."""
    return sum(1 for w in t.raw.split() if any(map(str.isalpha, w)))


def cut_lines(t: Text) -> int:
    """Lines that end in an ellipsis."""
    return sum(1 for line in t.raw.split("\n") if line.rstrip().endswith(("...", "…")))


def bullet_lines(t: Text) -> int:
    """Lines that begin with a bullet."""
    return sum(1 for line in t.raw.split("\n") if line.lstrip()[:1] in BULLETS and line.strip())


def packed_bytes(t: Text) -> int:
    """Bytes after fast compression of the whole text."""
    return len(zlib.compress(t.raw.encode("utf-8"), 1))


#: Marks that begin an item of a list, and bytes from which compressibility says something.
BULLETS, LEAST_PACKED = ("-", "*", "•", "‣", "·"), 1000

#: The rules of the query: the two of the contract, those on its other counts, then those of the method alone.
RULES = (
    Rule("n_words", n_words, lambda t, v: v < 20),
    Rule("n_repeat_words", n_repeat_words, lambda t, v: 100 * v > 30 * len(t.words)),
    Rule("n_symbols", n_symbols, lambda t, v: 10 * v > len(t.words)),
    Rule("n_dup_lines", n_dup_lines, lambda t, v: v > 0 and 100 * v > 30 * (t.raw.count("\n") + 1)),
    Rule("word_chars", word_chars, lambda t, v: not 2 * len(t.words) <= v <= 20 * len(t.words)),
    Rule("n_upper", lambda t: sum(map(str.isupper, t.raw.split())), lambda t, v: 2 * v > len(t.words)),
    Rule("alpha_words", alpha_words, lambda t, v: 2 * v < len(t.words)),
    Rule("cut_lines", cut_lines, lambda t, v: v > 2 and 100 * v > 30 * (t.raw.count("\n") + 1)),
    Rule("bullet_lines", bullet_lines, lambda t, v: v > 2 and 100 * v > 90 * (t.raw.count("\n") + 1)),
    Rule("packed_bytes", packed_bytes, lambda t, v: len(t.raw) >= LEAST_PACKED and 12 * v < len(t.raw)),
)


def profile_rules(df: DataFrame, rules: tuple[Rule, ...], sample_rows: int = 2000, seed: int = 17, text: str = "text") -> dict[str, tuple[float, float]]:
    """{rule: (seconds per text, rejection rate)} on a random sample of about `sample_rows` rows."""
    rows = df.count()
    if not rows:
        return {}

    def measure(texts: list) -> dict[str, list]:
        out: dict[str, list] = {}
        prepared = [Text(x) for x in texts]
        for i, rule in enumerate(rules):
            began = time.perf_counter()
            bad = [rule.rejects(t, rule.measure(t)) for t in prepared]
            out |= {f"cost{i}": [(time.perf_counter() - began) / len(texts)] * len(texts), f"bad{i}": bad}
        return out

    schema = ", ".join(f"cost{i} double, bad{i} boolean" for i in range(len(rules)))
    sample = df.select(text).sample(min(1.0, sample_rows / rows), seed)
    got = map_texts(sample, measure, schema, text).agg(*(F.avg(f"cost{i}").alias(f"cost{i}") for i in range(len(rules))), *(F.avg(F.col(f"bad{i}").cast("int")).alias(f"bad{i}") for i in range(len(rules)))).first()
    return {r.name: (got[f"cost{i}"] or 0.0, got[f"bad{i}"] or 0.0) for i, r in enumerate(rules)}


def cascade_order(rules: tuple[Rule, ...], profile: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first; ties keep the listed order."""

    def gain(rule: Rule) -> float:
        cost, rate = profile.get(rule.name, (1.0, 0.0))
        return rate / max(cost, 1e-9)

    return tuple(sorted(rules, key=gain, reverse=True))


def quality_cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = (), text: str = "text", order: tuple[Rule, ...] | None = None) -> DataFrame:
    """Adds kept, rules_run and, for each rule in `report`, its value (long); drops the text column."""
    order = cascade_order(rules, profile_rules(df, rules, text=text)) if order is None else order
    named = {r.name: r for r in rules}

    def judge(texts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("kept", "rules_run", *report)}
        for x in texts:
            t, seen, kept = Text(x), {}, True
            for rule in order:
                seen[rule.name] = v = rule.measure(t)
                if rule.rejects(t, v):
                    kept = False
                    break
            out["kept"].append(kept)
            out["rules_run"].append(len(seen))
            for k in report:
                out[k].append(int(seen[k] if k in seen else named[k].measure(t)))
        return out

    return map_texts(df, judge, "kept boolean, rules_run int" + "".join(f", {k} long" for k in report), text)
