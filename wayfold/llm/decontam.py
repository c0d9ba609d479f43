"""Benchmark decontamination with an FM-index for each training shard.

Test items are cut into phrases: `WINDOW` consecutive words, or the whole item if it is shorter. Documents are
taken in shards of bounded size. A shard's index covers those stretches of its documents that consist of
test-phrase words only and are at least as long as the shortest phrase (no phrase can occur elsewhere), with a
separator between stretches. Each phrase is found by backward search: the range of suffixes that begin with a
phrase's tail is narrowed by one word at a time, with ranks from a wavelet tree over the Burrows-Wheeler
transform; all phrases step together. Occurrences are located by walking back to a sampled suffix position,
and the hit words of a document are merged into spans.

Nothing is shuffled: the phrases go to all tasks. Items of more than about `BLOCK_BYTES` of text are taken in
blocks, one pass over the texts each, so the driver and a task hold one block at a time, however many items there
are. A pass writes the hit words and items of the texts that it hits, by the text's hash, and nothing else; these
tables are merged, deleted, and joined with the documents once.

Words are maximal runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII.
Defined cases: null or empty texts have no words and no hits; items without words have no phrases; a null item id
counts as the empty id; items that share an id count once; repeated documents are judged each; with no items
at all nothing is hit; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayfold.llm.common import Scratch, arrow_map, checkpointed

WINDOW = 13
#: Suffix positions that are kept: every one of so many, and those at which a stretch begins.
SAMPLED = 16
#: Bounds of a shard (documents, bytes of text) and of a block of items.
SHARD_ROWS, SHARD_BYTES, BLOCK_BYTES = 4096, 16 << 20, 4 << 20
#: The words of lower-cased UTF-8, and the same in text.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_TEXT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of all suffixes; zeros are separators, each smaller than any word and different from the others."""
    n = len(codes)
    key = codes.astype(np.int64)
    stops = np.flatnonzero(key == 0)
    key += len(stops)
    key[stops] = np.arange(len(stops))
    rank = np.unique(key, return_inverse=True)[1]
    step = 1
    while n and rank.max() < n - 1:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        rank = np.unique(key, return_inverse=True)[1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletTree:
    """Ranks of a symbol sequence, level by level from the highest bit (zeros go to the front of the next level)."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels = []
        for bit in range(width - 1, -1, -1):
            one = (symbols >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(1 - one)])))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `upto`."""
        start, end = np.zeros_like(upto), upto
        for bit, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            s, e = zeros[start], zeros[end]
            start, end = np.where(one, zeros[-1] + start - s, s), np.where(one, zeros[-1] + end - e, e)
        return end - start


class FMIndex:
    """Backward search and location over word codes from 1; 0 separates stretches and ends the sequence."""

    def __init__(self, codes: np.ndarray, n_codes: int):
        order = suffix_array(codes)
        self.last = codes[order - 1]  # the transform: the word before each suffix
        self.tree = WaveletTree(self.last, max(1, int(n_codes).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n_codes + 1))])
        begins = np.concatenate([[True], codes[:-1] == 0])
        kept = begins | (np.arange(len(codes)) % SAMPLED == 0)
        self.sample = np.where(kept[order], order, -1)
        self.n = len(codes)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the phrases (rows, filled up on the left with 0)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, -back]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back until a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(self.sample[at] < 0)
        while len(walking):
            c = self.last[at[walking]]
            at[walking] = self.first[c] + self.tree.rank(c, at[walking])
            steps[walking] += 1
            walking = walking[self.sample[at[walking]] < 0]
        return self.sample[at] + steps


class Phrases:
    """Distinct phrases of a block of items as word codes."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.code.setdefault(w, len(self.code) + 1) for w in WORD.findall((text or "").encode("utf-8").lower())]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.owners = [sorted(v) for v in owners.values()]
        self.lengths = np.array([len(k) for k in owners], np.int64)
        self.rows = np.zeros((len(owners), int(self.lengths.max()) if owners else 0), np.int64)
        for i, k in enumerate(owners):
            self.rows[i, self.rows.shape[1] - len(k) :] = k
        self.shortest = int(self.lengths.min()) if owners else 0

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, codes) of the stretches that may hold a phrase."""
        get = self.code.get
        codes = np.array([get(w, 0) for w in words], np.int64)
        stops = np.concatenate([[-1], np.flatnonzero(codes == 0), [len(codes)]])
        for i in np.flatnonzero(np.diff(stops) > self.shortest).tolist():
            yield int(stops[i]) + 1, codes[stops[i] + 1 : stops[i + 1]]


def shard_hits(docs: list[list[bytes]], phrases: Phrases, hit: list[np.ndarray | None], items: list[set[str]]) -> None:
    """Marks the hit words of each document (words already split) and adds the ids of the items that occur."""
    if not len(phrases.owners):
        return
    parts, doc_of, word_of, size = [], [], [], 0
    for d, words in enumerate(docs):
        if len(words) < phrases.shortest:
            continue
        for first, codes in phrases.stretches(words):
            parts += [codes, np.zeros(1, np.int64)]
            doc_of.append(d)
            word_of.append((size, first))
            size += len(codes) + 1
    if not parts:
        return
    index = FMIndex(np.concatenate(parts), len(phrases.code))
    low, high = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(low < high)
    count = (high - low)[found]
    phrase = np.repeat(found, count)
    rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    at = index.locate(rows)
    starts = np.array([s for s, _ in word_of], np.int64)
    stretch = np.searchsorted(starts, at, side="right") - 1
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[phrase], -1)
    inside = np.cumsum(edge) > 0
    for s in np.unique(stretch).tolist():
        d, (start, first) = doc_of[s], word_of[s]
        length = len(parts[2 * s])
        if hit[d] is None:
            hit[d] = np.zeros(len(docs[d]), bool)
        hit[d][first : first + length] |= inside[start : start + length]
    pairs = np.unique(np.array(doc_of, np.int64)[stretch] * len(phrases.owners) + phrase)
    for d, p in zip((pairs // len(phrases.owners)).tolist(), (pairs % len(phrases.owners)).tolist(), strict=True):
        items[d].update(phrases.owners[p])


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Merged spans of hit words: (start, end) in characters, end exclusive."""
    out: list[dict[str, int]] = []
    follows = False
    for m, h in zip(WORD_TEXT.finditer(text.translate(_LOWER)), hit.tolist(), strict=True):
        if h and follows:
            out[-1]["end"] = m.end()
        elif h:
            out.append({"start": m.start(), "end": m.end()})
        follows = h
    return out


def ranges(hit: np.ndarray | None) -> list[dict[str, int]]:
    """Runs of hit words: (start, end), end exclusive."""
    if hit is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
PART = "text_key binary, hit array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8").lower())


def _by_shards(batches: Iterator[pa.RecordBatch], place: int, flush) -> Iterator[pa.RecordBatch]:
    """flush(batches, texts, words) for each shard; column `place` holds the texts."""
    held, rows, size = [], 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        texts = [t or "" for b in held for t in b.column(place).to_pylist()]
        yield from flush(held, texts, [words_of(t) for t in texts])

    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            part = whole.slice(start, 256)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.column(place).get_total_buffer_size() * part.num_rows // max(1, whole.num_rows)
            if rows >= SHARD_ROWS or size >= SHARD_BYTES:
                yield from out()
                held, rows, size = [], 0, 0
    if held:
        yield from out()


def _searched(words: list[list[bytes]], phrases: Phrases) -> tuple[list, list[list[str]]]:
    """Hit words (null: none) and sorted items of each text of a shard."""
    hit: list[np.ndarray | None] = [None] * len(words)
    found: list[set[str]] = [set() for _ in words]
    shard_hits(words, phrases, hit, found)
    return hit, [sorted(f) for f in found]


def _judged(df: DataFrame, text: str, judge, told: int = 0) -> DataFrame:
    """Adds the columns of FOUND; judge(batches, words) gives the hit words and the items of a shard's texts.

    The last `told` columns are for the judge only.
    """
    added = df.sparkSession.createDataFrame([], FOUND).schema
    kept = df.columns[: len(df.columns) - told]
    schema = StructType([df.schema[c] for c in kept] + added.fields)
    target = to_arrow_schema(schema)

    def flush(held: list[pa.RecordBatch], texts: list[str], words: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        hit, items = judge(held, words)
        at = 0
        for b in held:
            n = b.num_rows
            own = hit[at : at + n]
            spans = [[] if h is None else spans_of(t, h) for t, h in zip(texts[at : at + n], own, strict=True)]
            made = [[len(w) for w in words[at : at + n]], [0 if h is None else int(h.sum()) for h in own], items[at : at + n], spans]
            arrays = [b.column(i).cast(target.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(v, target.field(f.name).type) for v, f in zip(made, added, strict=True)], schema=target)
            at += n

    place = kept.index(text)
    return arrow_map(df, lambda batches: _by_shards(batches, place, flush), schema)


def _part_hits(df: DataFrame, phrases: Broadcast, text: str) -> DataFrame:
    """(text_key, hit, items) of the texts that one block of items hits, each text once. Nothing of the texts is kept."""
    target = to_arrow_schema(df.sparkSession.createDataFrame([], PART).schema)

    def flush(held: list[pa.RecordBatch], texts: list[str], words: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        hit, items = _searched(words, phrases.value)
        some = [i for i, h in enumerate(hit) if h is not None and h.any()]
        keys = [hashlib.sha256(texts[i].encode("utf-8")).digest() for i in some]
        made = [keys, [ranges(hit[i]) for i in some], [items[i] for i in some]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, target, strict=True)], schema=target)

    return arrow_map(df.select(text), lambda batches: _by_shards(batches, 0, flush), PART).dropDuplicates(["text_key"])


def _told(held: list[pa.RecordBatch], words: list[list[bytes]]) -> tuple[list, list[list[str]]]:
    """Hit words and items that came by a join, in a batch's last two columns."""
    hit: list[np.ndarray | None] = []
    items: list[list[str]] = []
    for b in held:
        for parts, ids in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            own = np.zeros(len(words[len(hit)]), bool) if parts else None
            for r in parts or []:
                own[r["start"] : r["end"]] = True
            hit.append(own)
            items.append(sorted(ids or []))
    return hit, items


def phrase_blocks(items: DataFrame, item: str = "item_id", text: str = "text") -> list[DataFrame]:
    """(item, text) in blocks, each of about BLOCK_BYTES of text at most."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    blocks = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    return [rows.filter(F.col("block") == b).select("item", "text") for b in range(blocks)]


def find_contamination(df: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, items (sorted ids), and spans (characters) to the other columns (or replaces them); keeps the text."""
    df = df.drop("n_words", "n_hit", "items", "spans")
    spark = df.sparkSession
    blocks = phrase_blocks(items, item)
    sent = lambda block: spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in block.collect()], window))
    if len(blocks) == 1:
        phrases = sent(blocks[0])
        return _judged(df, text, lambda _, words: _searched(words, phrases.value))
    key, hit, ids = (f"__{n}_{uuid.uuid4().hex}" for n in ("key", "hit", "items"))  # unlike any column of the documents
    with Scratch(spark) as scratch:
        parts = []
        for block in blocks:
            phrases = sent(block)
            parts.append(scratch.stored(_part_hits(df, phrases, text)))
            phrases.destroy()
        hits = reduce(DataFrame.unionByName, parts).groupBy("text_key").agg(F.flatten(F.collect_list("hit")).alias(hit), F.array_distinct(F.flatten(F.collect_list("items"))).alias(ids))
        hits = checkpointed(hits.withColumnRenamed("text_key", key))
    joined = df.withColumn(key, F.unhex(F.sha2(F.col(text).cast("binary"), 256))).join(hits, key, "left").drop(key)
    return _judged(joined, text, _told, 2)


#: Share of hit words (percent) from which a document is contaminated.
CONTAMINATED_PERCENT = 5


def contaminated():
    """The verdict on the columns that find_contamination adds."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= CONTAMINATED_PERCENT * F.col("n_words"))
