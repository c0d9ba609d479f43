"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text (a bounded sample, see `reference_texts`).
A text is cut greedily into the longest phrases that occur in a language's reference (cross parsing): each
phrase is a walk in that automaton, and where no transition exists a new phrase begins. The text's language is
the one whose parse needs the fewest phrases. References have the same number of characters where a language
has that many; as phrases get longer with the logarithm of the reference's length, counts are multiplied by it
(relative to the longest), so that a language of little text is not at a disadvantage.

Every letter of every reference is a symbol of its own, whatever the script; everything that is no letter is one
symbol. The automata of all languages lie in one sparse table by row displacement: the transition of a state by
a symbol lies at base[state] + symbol, if that place names the state. The texts of a batch are walked in lockstep,
whole; the last few, very long ones are walked one by one.

Defined cases: null or a text without a letter is `und` with score 0; languages tie in code-point order; with
no labelled text at all everything is `und`; a letter that no reference has is a phrase by itself; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import checkpointed, map_texts

#: Bounds of the labelled sample: characters of each piece, of each language and of all; budgets drawn, as equal pieces count once.
CHARS, BUDGET, ALL, SPARE = 250, 30_000, 3_000_000, 4
#: Symbols of what is no letter, and of letters that no reference has.
NO_LETTER, NO_SYMBOL = 1, 0
#: Texts that are walked one by one when fewer than this are left.
FEW = 24


def reference_texts(df: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> dict[str, str]:
    """{language: text}: pieces of CHARS characters from all over the distinct texts of every language.

    A language gets BUDGET characters, or its part of ALL if there are very many languages; so what the driver
    gathers and all tasks get is bounded. Pieces are taken by a hash of text and place, about SPARE budgets of
    each language, and equal pieces once.
    """
    d = df.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sizes = checkpointed(d.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n")))
    share = checkpointed(sizes.groupBy("lang").agg(F.sum("n").alias("all")))
    budget = max(1, min(BUDGET, ALL // max(1, share.count())))
    share = share.select("lang", (F.lit(float(SPARE * budget)) / F.col("all")).alias("share"))
    places = sizes.join(share, "lang").select("lang", "h", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHARS))).alias("no"))
    places = places.withColumn("turn", F.xxhash64("h", "no")).filter(F.pmod("turn", F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("share")
    # SPARE * ALL / CHARS places are expected at most, so this broadcast is bounded by the sample
    parts = d.join(F.broadcast(checkpointed(places)), ["lang", "h"]).select("lang", "turn", F.expr(f"substring(text, CAST(no * {CHARS} + 1 AS INT), {CHARS})").alias("part"))
    found: dict[str, dict[str, int]] = {}
    for row in parts.groupBy("lang", "part").agg(F.min("turn").alias("turn")).collect():
        found.setdefault(row["lang"], {})[row["part"]] = row["turn"]
    return {k: "\n".join(sorted(v, key=lambda t: (v[t], t)))[:budget] for k, v in sorted(found.items())}


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class CrossParser:
    """The automata of all languages; picklable, of bounded size."""

    def __init__(self, references: dict[str, str]):
        self.langs = sorted(references)
        texts = {k: folded(v) for k, v in references.items()}
        logs = [math.log(len(texts[k]) + 1) for k in self.langs]
        self.weights = np.array([x / max(logs) for x in logs])
        letters = sorted({c for t in texts.values() for c in t if c.isalpha()})
        self.points = np.array([ord(c) for c in letters], np.int64)
        self.width = len(letters) + NO_LETTER + 1
        self.roots = np.zeros((len(self.langs), self.width), np.int32)
        parts, state, place = [], 1, 0  # state 0 has no transitions
        for i, lang in enumerate(self.langs):
            steps = suffix_automaton(self.codes(texts[lang]).tolist())
            for c, to in steps[0].items():
                self.roots[i, c] = to + state
            base, owner, to = displaced(steps, self.width)
            parts.append((base + place, np.where(owner < 0, -1, owner + state), to + state))
            state, place = state + len(steps), place + len(owner)
        none = np.zeros(1, np.int32)
        self.base, self.owner, self.to = (np.concatenate([x, *ps]).astype(np.int32) for x, ps in zip((none, none[:0], none[:0]), zip(*parts, strict=True) if parts else ((), (), ()), strict=True))

    def codes(self, text: str) -> np.ndarray:
        return self.symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def symbols(self) -> np.ndarray:
        """The symbol of every code point; made in each process once."""
        if "_symbols" not in self.__dict__:
            self._symbols = np.where(_letters(), NO_SYMBOL, NO_LETTER).astype(np.int32)
            self._symbols[self.points] = np.arange(len(self.points)) + NO_LETTER + 1
        return self._symbols

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_symbols", "_plain")}

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Texts x languages: phrases of the cross parse."""
        codes = [self.codes(folded(t)) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([*codes, np.zeros(0, np.int32)])
        start = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        k, n = len(self.langs), len(texts)
        count, state = np.zeros((k, n), np.int64), np.zeros((k, n), np.int32)
        t, m = 0, int((lengths > 0).sum())
        # all texts longer than t are walked together; a chunk of steps ends where the shortest of them does
        while m >= FEW:
            upto = int(lengths[m - 1])
            live, tally = state[:, :m].copy(), np.zeros((k, m), np.int64)
            for i in range(t, upto):
                c = flat[start[:m] + i]
                at = self.base[live] + c
                to = self.to[at]
                cut = self.owner[at] != live
                tally += cut
                # the next phrase begins with this character; one that the reference lacks is a phrase by itself
                live = np.where(cut, self.roots[:, c], to)
            state[:, :m] = live
            count[:, :m] += tally
            t = upto
            m = int((lengths > t).sum())
        for lane in range(m):
            rest = flat[start[lane] + t : start[lane] + lengths[lane]].tolist()
            for lang in range(k):
                count[lang, lane] += self.walked(lang, int(state[lang, lane]), rest)
        out = np.empty((n, k), np.int64)
        out[order] = count.T
        return out

    def walked(self, lang: int, state: int, rest: list[int]) -> int:
        """Phrases that begin in the rest of one text."""
        if "_plain" not in self.__dict__:
            self._plain = [array("i", x.astype(np.int32).tobytes()) for x in (self.base, self.owner, self.to)], self.roots.tolist()
        (base, owner, to), root, count = self._plain[0], self._plain[1][lang], 0
        for c in rest:
            at = base[state] + c
            if owner[at] == state:
                state = to[at]
            else:
                count += 1
                state = root[c]
        return count


def displaced(steps: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to) of the states' transitions: rows are laid into one another where their places are free.

    Widest rows come first, each at the first offset (from a moving start) where it fits; rows of one fill what is left.
    """
    size = sum(map(len, steps)) * 2 + 2 * width + 2
    used, base = bytearray(size), np.zeros(len(steps), np.int32)
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    start, tries, free = 0, 0, 0
    for s in sorted(range(len(steps)), key=lambda s: -len(steps[s])):
        row = list(steps[s])
        if len(row) > 1:
            b = start
            while b + width < len(used) and any(used[b + c] for c in row):
                b += 1
            tries += b - start
            if tries > 64 * width:
                start, tries = b, 0
        elif row:
            while used[free] or free < row[0]:
                free += 1
            b = free - row[0]
        else:
            b = 0
        if b + width >= len(used):
            used += bytearray(b + 2 * width - len(used))
            more = len(used) - len(owner)
            owner, to = np.concatenate([owner, np.full(more, -1, np.int32)]), np.concatenate([to, np.zeros(more, np.int32)])
        base[s] = b
        for c, target in steps[s].items():
            used[b + c] = 1
            owner[b + c], to[b + c] = s, target
    last = int(base.max()) + width + 1
    return base, owner[:last], to[:last]


def predict(df: DataFrame, parser: CrossParser, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (lead of the best over the second, 0 to 1) and phrases_per_char; drops the text."""
    sent = df.sparkSession.sparkContext.broadcast(parser)

    def judge(texts: list) -> dict[str, list]:
        p = sent.value
        has = [bool(t) and any(map(str.isalpha, t)) and bool(p.langs) for t in texts]
        pred, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        at = [i for i, x in enumerate(has) if x]
        if at:
            counts = p.phrases([texts[i] for i in at])
            weighted = counts * p.weights
            best = weighted.argmin(1)
            for i, row, own, b in zip(at, weighted, counts, best.tolist(), strict=True):
                second = min((float(x) for j, x in enumerate(row) if j != b), default=None)
                pred[i], rate[i] = p.langs[b], float(own[b]) / len(texts[i])
                score[i] = 1.0 if second is None else 1.0 - float(row[b]) / second
        return {"lang_pred": pred, "score": score, "phrases_per_char": rate}

    return map_texts(df, judge, "lang_pred string, score double, phrases_per_char double", text)
