"""Divergence audit of sources: how far the term shares of each source lie from those of others and of the language.

Counting is prefiltered by a sketch. A first pass over the texts keeps, in each task, a count-min sketch of document
frequencies by (language, term), with counters that stop at the frequency asked for; the tasks' sketches are merged
by adding. It never underestimates, so a term with an estimate below that frequency is impossible, and the second
pass drops it before anything is shuffled. What survives is counted exactly, by source, and filtered by its exact
document frequency.

A term that neither of two sources has gives each pair the same value, and a term that one of them has depends on
its count there only. So pairs of sources are compared by histograms of the counts (a row for each distinct count of
a source, not for each term), and only terms that both have are joined, as a correction.

Shares are integers, p = 1 + floor(unit * (count + 1) / (total + kept terms)), and so are values,
floor((p - q)^2 / q); all sums are exact. Null text, language and source are empty strings. Defined cases: texts
without terms count for no term, but their (language, source) group takes part in all pairs; a language without kept
terms has pairs of value 0 and no terms; repeated rows count as often as they are there; ids play no part; no rows
give no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch, arrow_map, stored
from wayfold.llm.jaccard import mixed

#: What a byte of UTF-8 becomes: A-Z lower-cased, a-z and all bytes beyond ASCII kept, the others white space.
BYTES = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if chr(b) in "abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in range(256))
UNIT = 1_000_000_000

#: The sketch: rows of counters, the logarithm of a row's counters, and counters of a block, in which sketches are merged.
DEPTH, WIDTH_BITS, BLOCK = 3, 22, 1 << 16
#: Words that a task counts before it hands them over.
HELD = 1 << 20

_U = np.uint64


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters and of characters beyond ASCII."""
    return text.translate(BYTES).split()


def cells(langs: list[str], lang: np.ndarray, terms: pa.Array, term: np.ndarray, width_bits: int) -> np.ndarray:
    """(DEPTH, pairs): the counters of pairs of a language and a term, given by their numbers."""
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in langs), _U, len(langs))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, terms.to_pylist()), _U, len(terms))
    h = mixed(own[term] ^ seeds[lang])
    step = (h >> _U(32)) | _U(1)
    return np.stack([((h + _U(i) * step) & _U((1 << width_bits) - 1)) + _U(i << width_bits) for i in range(DEPTH)]).astype(np.int64)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each is there."""
    x = np.sort(x)
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[begin], np.diff(begin, append=len(x))


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, group, terms, term, occurrences, documents) of some documents at a time.

    The last column is the text, the others are a document's group. Terms and groups are numbered; a row for each
    group and term. About HELD words are held at once, and one document.
    """
    groups: dict[tuple, int] = {}
    own, words = [], []

    def rows() -> tuple:
        coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
        kinds, lengths = max(1, len(coded.dictionary)), np.fromiter(map(len, words), np.int64, len(words))
        term, whose = coded.indices.to_numpy().astype(np.int64), np.array(own, np.int64)
        pair, n = runs(np.repeat(whose, lengths) * kinds + term)
        once, _ = runs(np.repeat(np.arange(len(words)), lengths) * kinds + term)
        _, docs = runs(whose[once // kinds] * kinds + once % kinds)  # of the same pairs
        return list(groups), pair // kinds, coded.dictionary, pair % kinds, n, docs

    held = 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for *group, text in zip(*columns, strict=True):
            own.append(groups.setdefault(tuple(group), len(groups)))
            words.append(terms_of(text))
            held += len(words[-1])
            if held >= HELD:
                yield rows()
                groups, own, words, held = {}, [], [], 0
    if held:
        yield rows()


def groups_of(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))


def sketched(docs: DataFrame, at_least: int, width_bits: int) -> DataFrame:
    """(block, cells, counts): each task's sketch of document frequencies, in blocks, without empty counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(DEPTH << width_bits, np.uint8)
        for groups, group, terms, term, _, n in tallied(batches):
            for at in cells([g[0] for g in groups], group, terms, term, width_bits):
                order = np.argsort(at)
                begin = np.flatnonzero(np.diff(at[order], prepend=-1))
                more = np.add.reduceat(np.minimum(n, at_least)[order], begin) if len(at) else begin
                at = at[order][begin]
                sketch[at] = np.minimum(sketch[at] + more, at_least)
        for block in range(-(-len(sketch) // BLOCK)):
            part = sketch[block * BLOCK : (block + 1) * BLOCK]
            if (at := np.flatnonzero(part)).size:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([part[at].tobytes()])], ["block", "cells", "counts"])

    return arrow_map(docs.select("lang", F.col("text").cast("binary")), run, "block int, cells binary, counts binary")


def possible_cells(docs: DataFrame, at_least: int = 3, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """The merged sketch, as one bit a counter: whether it reaches the frequency. DEPTH << width_bits bits, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = merged.setdefault(block, np.zeros(BLOCK, np.uint8))
                at, n = np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint8)
                part[at] = np.minimum(part[at].astype(np.int64) + n, at_least)
        yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([np.packbits(p >= at_least).tobytes() for p in merged.values()], pa.binary())], ["block", "bits"])

    out = np.zeros((DEPTH << width_bits) // 8 + BLOCK // 8, np.uint8)
    for block, bits in arrow_map(sketched(docs, at_least, width_bits).repartition("block"), run, "block int, bits binary").collect():
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)
    return out


def counted(docs: DataFrame, possible: np.ndarray, width_bits: int = WIDTH_BITS) -> DataFrame:
    """(lang, source, term, n, docs): exact occurrences and documents of every term that the sketch leaves possible."""
    bits = docs.sparkSession.sparkContext.broadcast(possible)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, group, terms, term, n, docs in tallied(batches):
            at = cells([g[0] for g in groups], group, terms, term, width_bits)
            left = np.flatnonzero(((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0))
            named = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(group[left])) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*named, terms.take(pa.array(term[left])).cast(pa.string()), pa.array(n[left]), pa.array(docs[left])], ["lang", "source", "term", "n", "docs"])

    found = arrow_map(docs.select("lang", "source", F.col("text").cast("binary")), run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, at_least: int = 3, width_bits: int = WIDTH_BITS) -> DataFrame:
    """(lang, source, term, n, all_n): terms in at least so many documents of their language, with counts in the source and in the language."""
    term = Window.partitionBy("lang", "term")  # a row for each source
    exact = counted(docs, possible_cells(docs, at_least, width_bits), width_bits)
    return exact.withColumns({"all_docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term)}).filter(F.col("all_docs") >= at_least).select("lang", "source", "term", "n", "all_n")


def share(n: str | Column, total: str, kept: str, unit: int = UNIT) -> Column:
    """1 + floor(unit * (n + 1) / (total + kept)), exact."""
    n = F.col(n) if isinstance(n, str) else n
    above = (F.lit(unit).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")).alias("x")
    below = (F.col(total) + F.col(kept)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below).cast("long")


def value(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, own, kept, all_total, zero): occurrences and number of kept terms of each group, of its
    language, and the share of a term that the group doesn't have."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    terms = kept.groupBy("lang", "term").agg(F.first("all_n").alias("all_n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    sizes = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "own", "kept", "all_total"])
    return sizes.withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(0), "total", "kept")))


def pair_values(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source against each other one of its language, summed over all kept terms."""
    a = sizes.select("lang", "source", "own", "kept", F.col("zero").alias("za"))
    b = sizes.select("lang", F.col("source").alias("item"), F.col("own").alias("other"), F.col("zero").alias("zb"))
    pairs = a.join(b, "lang").filter("source <> item")
    bare = pairs.select("lang", "source", "item", F.when(F.col("kept") > 0, (F.col("kept") - F.col("own") - F.col("other")) * value("za", "zb")).otherwise(F.lit(0)).alias("x"))
    counts = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    mine = counts.join(b, "lang").filter("source <> item").select("lang", "source", "item", (F.col("m") * value("p", "zb")).alias("x"))
    theirs = counts.withColumnRenamed("source", "item").join(a, "lang").filter("source <> item").select("lang", "source", "item", (F.col("m") * value("za", "p")).alias("x"))
    one = shares.select("lang", "term", "source", "p", F.col("zero").alias("za"))
    two = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("zb"))
    met = one.join(two, ["lang", "term"]).filter("source < item")
    over = lambda p, q, zp, zq: F.sum(value(p, q) - value(p, zq) - value(zp, q) + value(zp, zq))
    both = met.groupBy("lang", "source", "item").agg(over("p", "q", "za", "zb").alias("x"), over("q", "p", "zb", "za").alias("y"))
    out = bare
    for t in (mine, theirs):
        out = out.unionByName(t.groupBy("lang", "source", "item").agg(F.sum("x").alias("x")))
    sides = F.explode(F.array(F.struct("source", "item", "x"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("y").alias("x")))).alias("s")
    out = out.unionByName(both.select("lang", sides).select("lang", "s.*"))
    return out.groupBy("lang", "source", "item").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("long").alias("value"))


def divergence(df: DataFrame, at_least: int = 3, most: int = 200, lang: str = "lang", source: str = "source", text: str = "text", width_bits: int = WIDTH_BITS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: every other source of the language; part `term`: the
    terms whose share in the source is above that in the language, the `most` farthest."""
    docs = groups_of(df, lang, source, text)
    with Scratch(df.sparkSession) as scratch:
        kept = scratch.stored(kept_counts(docs, at_least, width_bits))
        sizes = scratch.stored(group_sizes(docs, kept))
        marked = kept.join(sizes, ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("all_n", "all_total", "kept")})
        shares = scratch.stored(marked.select("lang", "source", "term", "p", "q", "zero"))
        terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value("p", "q").alias("value"))
        pairs = pair_values(shares, sizes).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return stored(pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= most)))
