"""Token counts by heap-and-linked-list byte-pair merging.

`token_counts(df, vocabulary)` adds the number of tokens of each text under a byte-level BPE vocabulary
file. Each pre-token starts as a doubly linked list of byte symbols; a heap holds the adjacent pairs that
have a merge rank; the lowest rank is popped again and again (leftmost first on ties), stale entries are
skipped, and the count is the number of initial symbols minus the number of merges. No token identifier is
emitted. A pre-token of n bytes costs O(n log n), so one very long run of letters stays cheap.

Defined cases: null or empty text has 0 bytes and 0 tokens; the vocabulary's special strings inside a text
count as one token each, as the tokenizer library treats them by default; repeated rows are counted each.
"""

from __future__ import annotations

import heapq
import json
import sys
from types import ModuleType

import regex
from pyspark.sql import DataFrame

from wayfold.llm.common import map_texts

#: Pre-token pattern of byte-level vocabularies (fixed value of the published tokenizer format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose counts a worker remembers at most; the memory is emptied when full.
REMEMBERED = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in shown else next(rest) for b in range(256)]


class MergeCounter(dict):
    """Maps a pre-token to its number of tokens; a missing one is merged and remembered."""

    def __init__(self, vocabulary: str):
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = {}

        def named(symbol: str) -> int:
            return ids.setdefault(symbol, len(ids))

        self.of_byte = [named(c) for c in byte_alphabet()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[named(a), named(b)] = rank, named(a + b)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PRE_TOKEN).findall

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.merged(word.encode("utf-8"))
        if len(word) <= 64:
            self[word] = n
        return n

    def merged(self, data: bytes) -> int:
        symbol = [self.of_byte[b] for b in data]
        n = len(symbol)
        if n < 2:
            return n
        merges, after, before = self.merges, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, symbol[i], symbol[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two was merged meanwhile
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            done += 1
            if k >= 0:
                before[k] = i
                if m := merges.get((new, symbol[k])):
                    heapq.heappush(heap, (m[0], i, new, symbol[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], new))):
                heapq.heappush(heap, (m[0], h, symbol[h], new, m[1]))
        return n - done

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)


def counter(vocabulary: str) -> MergeCounter:
    """One counter for each vocabulary in a Python process, kept from task to task."""
    kept = sys.modules.setdefault("_wayfold_counters", ModuleType("_wayfold_counters"))
    if vocabulary not in kept.__dict__:
        kept.__dict__[vocabulary] = MergeCounter(vocabulary)
    return kept.__dict__[vocabulary]


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit; drops the text column."""

    def count(texts: list) -> dict[str, list]:
        of = counter(vocabulary)
        n = [of.count(t) if t else 0 for t in texts]
        return {"n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(df, count, "n_bytes long, n_tokens long, over_limit boolean", text)
