"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

A byte is removed if a `LENGTH`-byte string that covers it also starts anywhere else in the table. Texts are
UTF-8 bytes; matches never cross texts.

Sparse suffixes. Every LENGTH-byte string picks one position in itself, the last one whose `HEAD` bytes have the
smallest hash, so equal strings pick the same place and only suffixes at picked positions need an index
(about one in 60). A picked suffix serves an interval of strings; `ctx` is the hash of all their bytes.

Index family. A level is a suffix array of some batches: picked suffixes in order of their heads (first three
bytes, then a hash of the first HEAD bytes) and contexts, each distinct context once with its number of occurrences
and one place. A new batch gets its own array and is merge-scanned against every level kept so far: a head that
both have, or that the batch has twice, is a candidate for a long match. Equal-sized levels are then merged,
geometrically.

Matches. Of the candidates, suffixes with equal head and ctx cover their whole interval. Where contexts of one
head differ (the ends of a passage), one suffix of each distinct context is compared string by string.
A text that occurs in several rows is covered whole, and its suffixes are listed once by each task.

Everything that can be hot is aggregated before it is shuffled or is a join that Spark can split; groups of one
head beyond `MOST_TOGETHER` distinct contexts are compared by aggregating the hashes of their strings.

Defined cases: null text counts as empty; texts shorter than LENGTH bytes lose nothing; repeated rows get equal
results; a null key is carried along; an empty table gives no rows. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayfold.llm.common import Scratch, arrow_map, dropped, stored

LENGTH, HEAD = 200, 64
#: k-gram starts in a string of LENGTH bytes.
SPAN = LENGTH - HEAD + 1
#: Bytes that are hashed together; a longer text is cut into overlapping pieces, which changes no result.
BUFFER = 1 << 20
#: Batches of the query.
BATCHES = 4
#: Distinct contexts of a head that are compared in one task (about 20 MB).
MOST_TOGETHER = 50_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the hash base, of its inverse (modulo 2^64), and the values of bytes."""
    n = BUFFER + LENGTH + 8
    tables = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        powers = np.full(n, base, _U)
        powers[0] = 1
        tables.append(np.cumprod(powers))
    return tables[0], tables[1], _mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


class Hashes:
    """Hashes of all substrings of a buffer of at most BUFFER bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down, value = _powers()
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(value[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, _U)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` successive values."""
    n = len(v) - width + 1
    whole = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, _U)
    whole[: len(v)] = v
    rows = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes) of at most BUFFER bytes; pieces of a text overlap by LENGTH - 1."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        at = 0
        while at + LENGTH <= len(t):
            part = t[at : at + BUFFER // 2]
            if size + len(part) > BUFFER:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
            at += len(part) - LENGTH + 1
    if held:
        yield held


def picked(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of the strings in a group of pieces: text number, head, ctx, and `at` of each picked suffix.

    at packs the first string's start (from bit 16), the suffix' distance from it (8 bits) and the number of further strings (8 bits).
    """
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    h = Hashes(data)
    grams = h.windows(HEAD)
    low = _U((1 << 21) - 1)
    best = sliding_least((grams & ~low) | (low - np.arange(len(grams), dtype=_U)), SPAN)
    place = (low - (best & low)).astype(np.int64)  # of each string's suffix; the last one on ties
    ends = np.cumsum([len(p) for _, _, p in group])
    begins = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(group)), ends - begins)[: len(place)]
    valid = np.arange(len(place)) + LENGTH <= ends[owner]
    new = np.flatnonzero(valid & np.concatenate([[True], (place[1:] != place[:-1]) | ~valid[:-1]]))
    last = np.flatnonzero(valid & np.concatenate([(place[1:] != place[:-1]) | ~valid[1:], [True]]))
    own, suffix = owner[new], place[new]
    left, more = suffix - new, last - new
    lead = (data[suffix].astype(_U) << _U(16)) | (data[suffix + 1].astype(_U) << _U(8)) | data[suffix + 2].astype(_U)
    head = (lead << _U(40)) | (grams[suffix] >> _U(24))
    ctx = _mix(h.of(new, last + LENGTH) + _mix((left * 256 + more).astype(_U)))
    number = np.array([i for i, _, _ in group])[own]
    offset = np.array([o for _, o, _ in group], np.int64)[own]
    at = ((new - begins[own] + offset) << 16) | (left << 8) | more
    return number, head.view(np.int64), ctx.view(np.int64), at


def first(at: F.Column) -> F.Column:
    return F.shiftright(at, 16)


def end(at: F.Column) -> F.Column:
    return F.shiftright(at, 16) + at.bitwiseAND(F.lit(255)) + LENGTH


def _suffixes(docs: DataFrame) -> DataFrame:
    """(head, ctx, tid, at) of (tid, data); a task lists equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tids, texts = [], []
                for tid, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if len(t) >= LENGTH and tid not in seen:
                        seen.add(tid)
                        tids.append(tid)
                        texts.append(t)
                own = np.array(tids, np.int64)
                for group in pieces(texts):
                    number, head, ctx, at = picked(group)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (head, ctx, own[number], at)], ["head", "ctx", "tid", "at"])

    return arrow_map(docs.select("tid", "data"), run, "head long, ctx long, tid long, at long")


class IndexFamily:
    """Sparse suffix arrays of 1, 2, 4, ... batches in the shared folder, kept between additions.

    A level is a table (head, ctx, n, one) in the order of head and ctx: each distinct suffix context once, with the
    number of places where it occurs and one of them (tid, at), so a passage of very many copies is few rows.
    """

    def __init__(self, scratch: Scratch) -> None:
        self.scratch = scratch
        self.levels: list[tuple[int, DataFrame]] = []

    def suffix_array(self, suffixes: DataFrame) -> DataFrame:
        """The array of a batch. A text that several tasks listed counts as often, which is right: its copies repeat it."""
        return self._ordered(suffixes.groupBy("head", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at")).alias("one")))

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """One array of two; contexts that both have become one row."""
        both = self._ordered(a.unionByName(b).groupBy("head", "ctx").agg(F.sum("n").alias("n"), F.min("one").alias("one")))
        for level in (a, b):
            dropped(level)
        return both

    def _ordered(self, kinds: DataFrame) -> DataFrame:
        return self.scratch.stored(kinds.sortWithinPartitions("head", "ctx"))

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Adds a batch (head, ctx, tid, at); returns the heads of its long matches, with itself and with every level.

        The merge scans are sort-merge joins of the new array with each level on the head. Levels of equal size merge.
        """
        new = self.suffix_array(suffixes)
        heads = new.groupBy("head").agg(F.sum("n").alias("n"))
        met = heads.filter("n > 1").select("head")
        for _, level in self.levels:
            met = met.unionByName(heads.select("head").join(level, "head", "left_semi"))
        met = self.scratch.stored(met.distinct())
        size = 1
        while self.levels and self.levels[-1][0] == size:
            new = self.merge(self.levels.pop()[1], new)
            size *= 2
        self.levels.append((size, new))
        return met

    def kinds(self, met: DataFrame) -> DataFrame:
        """(head, ctx, n, one) of the whole family for some heads."""
        out = None
        for _, level in self.levels:
            own = level.join(met, "head", "left_semi")
            out = own if out is None else out.unionByName(own)
        return out if len(self.levels) == 1 else out.groupBy("head", "ctx").agg(F.sum("n").alias("n"), F.min("one").alias("one"))


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(head, tid, start, left, single, bytes) of the wanted suffixes (tid, list of (head, at, single))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(batch.num_rows):
                tid = batch.column(0)[i].as_py()
                if tid in seen:
                    continue
                seen.add(tid)
                t = batch.column(1)[i].as_py()
                w = batch.column(2).slice(i, 1).flatten()
                head, at, single = w.flatten()
                a = at.to_numpy()
                start, left = a >> 16, (a >> 8) & 255
                stop = start + (a & 255) + LENGTH
                cut = [t[s:e] for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([head, pa.array(np.full(len(a), tid)), pa.array(start), pa.array(left), single, pa.array(cut, pa.binary())], ["head", "tid", "start", "left", "single", "bytes"])

    return arrow_map(docs.join(wanted, "tid").select("tid", "data", "wanted"), run, "head long, tid long, start long, left long, single boolean, bytes binary")


def _strings(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of context rows: hash (with head and place), row number, place in the row."""
    out, n = [], 0
    for b in rows:
        head, left = b.column("head").to_numpy(), b.column("left").to_numpy()
        cuts = b.column("bytes").to_pylist()
        at = 0
        while at < len(cuts):
            upto, size = at, 0
            while upto < len(cuts) and size + len(cuts[upto]) <= BUFFER:
                size += len(cuts[upto])
                upto += 1
            part = cuts[at:upto]
            h = Hashes(np.frombuffer(b"".join(part), np.uint8)).windows(LENGTH)
            count = np.array([len(c) - LENGTH + 1 for c in part])
            begin = np.concatenate([[0], np.cumsum([len(c) for c in part])[:-1]])
            row = np.repeat(np.arange(at, upto), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            value = _mix(h[np.repeat(begin, count) + place] + _mix(head[row].view(_U) + (left[row] - place).astype(_U)))
            out.append((value, row + n, place))
            at = upto
        n += len(cuts)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(rows: list[pa.RecordBatch], row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """(tid, start, stop) of runs of repeated strings, given as (row, place) in order."""
    tid = np.concatenate([b.column("tid").to_numpy() for b in rows])
    start = np.concatenate([b.column("start").to_numpy() for b in rows])
    edge = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    a = np.flatnonzero(edge)
    z = np.concatenate([a[1:], [len(row)]])[: len(a)] - 1
    return pa.RecordBatch.from_arrays([pa.array(tid[row[a]]), pa.array(start[row[a]] + place[a]), pa.array(start[row[a]] + place[z] + LENGTH)], ["tid", "start", "stop"])


def _compared(contexts: DataFrame) -> DataFrame:
    """(tid, start, stop) covered by strings that two contexts of one head share; contexts arrive head by head."""

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, row, place = _strings(held)
        _, back, count = np.unique(value, return_inverse=True, return_counts=True)
        single = np.concatenate([b.column("single").to_numpy(zero_copy_only=False) for b in held])
        again = (count[back] > 1) & single[row]
        if again.any():
            yield _runs(held, row[again], place[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                head = part.column("head").to_numpy()
                if size >= 4000:
                    # up to the next change of head, the rows belong with those that are held
                    other = np.flatnonzero(head != held[-1].column("head")[-1].as_py())
                    if len(other):
                        if other[0]:
                            held.append(part.slice(0, other[0]))
                        yield from settle(held)
                        held, size = [], 0
                        part = part.slice(other[0])
                held.append(part)
                size += part.num_rows
        if held:
            yield from settle(held)

    return arrow_map(contexts.repartition("head").sortWithinPartitions("head"), run, "tid long, start long, stop long")


def _compared_hot(contexts: DataFrame) -> DataFrame:
    """The same for heads with very many contexts: the strings' hashes are counted by Spark."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                value, row, place = _strings([part])
                start = part.column("start").to_numpy()[row] + place
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(part.column("tid").to_numpy()[row]), pa.array(start), pa.array(part.column("single").to_numpy(zero_copy_only=False)[row])], ["value", "tid", "start", "single"])

    strings = arrow_map(contexts, spread, "value long, tid long, start long, single boolean")
    again = strings.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").select("value")
    return strings.filter("single").join(again, "value", "left_semi").select("tid", "start", (F.col("start") + LENGTH).alias("stop"))


def repeated(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """(tid, removed): for each text that loses bytes its maximal runs (start, stop); docs are (tid, data binary)."""
    family, met = IndexFamily(scratch), None
    for b in range(batches):
        found = family.add(_suffixes(docs.filter(F.pmod("tid", F.lit(batches)) == b)))
        met = found if met is None else met.unionByName(found)
    return spans_of(docs, scratch.stored(family.kinds(met.distinct())), scratch)


def spans_of(docs: DataFrame, kinds: DataFrame, scratch: Scratch) -> DataFrame:
    """The runs of `repeated` from the contexts (head, ctx, n, one) of all heads that occur twice or more."""
    copies = docs.groupBy("tid").agg(F.count("*").alias("n"), F.max(F.octet_length("data")).alias("size")).filter(f"n > 1 AND size >= {LENGTH}")
    found = _suffixes(docs).join(kinds.filter("n > 1").select("head", "ctx"), ["head", "ctx"], "left_semi")
    same = found.select("tid", first(F.col("at")).alias("start"), end(F.col("at")).alias("stop"))
    several = kinds.groupBy("head").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    asked = kinds.join(several, "head").select(F.col("one.tid").alias("tid"), F.struct("head", F.col("one.at").alias("at"), (F.col("n") == 1).alias("single")).alias("w"), (F.col("kinds") > MOST_TOGETHER).alias("hot"))
    asked = scratch.stored(asked)
    spans = same
    for hot, compare in ((False, _compared), (True, _compared_hot)):
        part = asked.filter(F.col("hot") == hot)
        if part.head(1):
            spans = spans.unionByName(compare(_contexts(docs, part.groupBy("tid").agg(F.collect_list("w").alias("wanted")))))
    spans = spans.unionByName(copies.select("tid", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop")))
    lists = spans.distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            runs = []
            for i in range(batch.num_rows):
                start, stop = batch.column(1).slice(i, 1).flatten().flatten()
                runs.append([{"start": s, "stop": e} for s, e in merged(start.to_numpy(), stop.to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind)], ["tid", "removed"])

    return arrow_map(lists, run, "tid long, removed array<struct<start:long,stop:long>>")


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by any of the spans."""
    order = np.argsort(start, kind="stable")
    out: list[tuple[int, int]] = []
    for s, e in zip(start[order].tolist(), stop[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def remove_repeats(df: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, spans (start, stop in bytes), kept (binary) and kept_sha256; drops the text (and columns of these names).

    kept is the text's remaining bytes; a cut may fall inside a character.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    added = df.sparkSession.createDataFrame([], "n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string").schema
    keep = [c for c in df.columns if c != text and c not in added.names]
    rows = df.select(F.struct(*keep).alias("row"), data.alias("data")).withColumn("tid", F.xxhash64("data"))
    with Scratch(df.sparkSession) as scratch:
        gone = stored(repeated(rows.select("tid", "data"), scratch, batches))
    schema = StructType([df.schema[c] for c in keep] + added.fields)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made: list[list] = [[] for _ in added]
                for i, t in enumerate(batch.column(1).to_pylist()):
                    spans, kept = [], t
                    if batch.column(2)[i].is_valid:
                        start, stop = batch.column(2).slice(i, 1).flatten().flatten()
                        spans = list(zip(start.to_pylist(), stop.to_pylist(), strict=True))
                        ends = [0, *(x for s in spans for x in s), len(t)]
                        kept = b"".join(t[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                    values = (len(t), len(t) - len(kept), len(spans), [{"start": s, "stop": e} for s, e in spans], kept, sha256(kept).hexdigest())
                    for column, v in zip(made, values, strict=True):
                        column.append(v)
                arrays = [c.cast(target.field(i).type) for i, c in enumerate(batch.column(0).flatten())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(v, target.field(f.name).type) for v, f in zip(made, added, strict=True)], schema=target)

    return arrow_map(rows.join(gone, "tid", "left").select("row", "data", "removed"), run, schema)
