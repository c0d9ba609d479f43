"""SimHash near-duplicates: a byte-position inverted index with count filtering, and the connected groups.

A fingerprint has eight bytes. Fingerprints that differ in at most three bits share at least five bytes at their
positions (the guaranteed minimum), so they share three bytes of the first or of the last four. Posting lists are
therefore looked up by three positional bytes of one half at once (eight lists a fingerprint; one byte alone would
list a 256th of everything). Where two fingerprints meet in a list, all positional bytes that they share are
tallied; pairs that reach five are retained, and their bits are verified.

No list is compared in full where it grows: one of more than GROUP fingerprints is looked up again by five
positional bytes (a pair that shares three shares two more of the other five), and fingerprints of lists that are
still longer meet through neighbours instead: one flips at most one bit, the other at most two, so all fingerprints
of one neighbour that somebody reaches with one flip are linked with that one. This is linear in the list and exact.
Within a list a search from each unreached fingerprint gives a spanning forest of the links, not all pairs.

Equal fingerprints are one node. Defined cases: null text, empty text and text without words have fingerprint
zero, linked like any other; fewer words than a shingle count as one shingle; repeated rows stay, each with its
result; a null key gets the smallest key of its component (null if all are); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from wayfold.llm.common import Scratch, arrow_map, stored
from wayfold.llm.components import components

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in, bytes that they share then.
WORDS, SEED, BITS = 3, 42, 3
SHARED = 8 - BITS
#: Fingerprints of a posting list that are compared in one task; longer lists are looked up otherwise.
GROUP = 1 << 14
#: Pairs that are compared at once, hashes whose bits are counted at once.
AT_ONCE, HASHES = 1 << 20, 1 << 16

_U = np.uint64


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask(places: tuple[int, ...]) -> int:
    """The bits of the bytes at these positions, as a signed number."""
    return signed(sum(0xFF << (8 * p) for p in places))


TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
ONE_FLIP = [signed(1 << i) for i in range(64)]
TWO_FLIPS = [signed(1 << i | 1 << j) for i, j in combinations(range(64), 2)]


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle, repeats included (A-Z lower-cased, ASCII white space between words)."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, _U)
    joined, k = b" ".join(parts), min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, digest = (ends - lengths)[: len(parts) - k + 1].tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), _U, len(starts))


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """A bit is set where more than half of the shingles' hashes have it; signed."""
    h = shingle_hashes(text, words) if text else np.zeros(0, _U)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), HASHES):
        votes += np.unpackbits(h[at : at + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])


def fingerprinted(df: DataFrame, words: int = WORDS, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint (long) and drops the text."""
    kept = df.select(*(c for c in df.columns if c != text))
    fields = list(to_arrow_schema(kept.schema))
    target = pa.schema([*fields, pa.field(name, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                prints = [fingerprint(t, words) for t in batch.column(len(fields)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(f.type) for i, f in enumerate(fields)), pa.array(prints, pa.int64())], schema=target)

    return arrow_map(df.select(*kept.columns, F.col(text).cast("binary").alias("__text")), run, StructType(kept.schema.fields[:]).add(name, LongType()))


def shared_bytes(apart: np.ndarray) -> np.ndarray:
    """How many positional bytes are equal, given the differing bits."""
    x = apart | (apart >> _U(4))
    x |= x >> _U(2)
    x |= x >> _U(1)
    return 8 - np.bitwise_count(x & _U(0x0101010101010101))


def forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among distinct fingerprints, as few as tie together all that are linked."""
    a, b = [], []
    while len(x) > 1:
        front, x = x[:1], x[1:]
        while len(front) and len(x):
            n = max(1, AT_ONCE // len(x))
            now, front = front[:n], front[n:]
            apart = now[:, None] ^ x[None, :]
            i, j = np.nonzero(shared_bytes(apart) >= SHARED)
            true = np.bitwise_count(apart[i, j]) <= BITS
            j, first = np.unique(j[true], return_index=True)
            a.append(now[i[true][first]])
            b.append(x[j])
            front, x = np.concatenate([front, x[j]]), np.delete(x, j)
    none = np.zeros(0, _U)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def posted(prints: DataFrame) -> DataFrame:
    """(wide, value, fp): each fingerprint in its eight lists; wide tells the positions, value their bytes."""
    wide = F.explode(F.array(*(F.lit(mask(t)).cast("long") for t in TRIPLES)))
    return prints.select(wide.alias("wide"), "fp").select("wide", F.col("fp").bitwiseAND(F.col("wide")).alias("value"), "fp")


def posted_finer(lists: DataFrame) -> DataFrame:
    """The same by five bytes: those of the list and each two of the other five positions."""
    wider = {mask(t): [mask(t + more) for more in combinations([p for p in range(8) if p not in t], SHARED - len(t))] for t in TRIPLES}
    table = F.create_map(*(x for k, v in wider.items() for x in (F.lit(k).cast("long"), F.array(*(F.lit(w).cast("long") for w in v)))))
    finer = lists.select(F.explode(F.element_at(table, F.col("wide"))).alias("wide"), "fp")
    return finer.select("wide", F.col("fp").bitwiseAND(F.col("wide")).alias("value"), "fp").distinct()


def compared(lists: DataFrame) -> DataFrame:
    """(a, b): links within each list, by a spanning forest. Lists hold distinct fingerprints, GROUP at most."""

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)
        begin = np.flatnonzero(np.concatenate([[True], new]))
        size = np.diff(np.concatenate([begin, [rows.shape[1]]]))
        x = rows[2].view(_U)
        two = begin[size == 2]
        apart = x[two] ^ x[two + 1]
        two = two[(shared_bytes(apart) >= SHARED) & (np.bitwise_count(apart) <= BITS)]
        a, b = [x[two]], [x[two + 1]]
        for i, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for side, found in zip((a, b), forest(x[i : i + n]), strict=True):
                side.append(found)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64)) for s in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            last = np.flatnonzero(np.any(rows[:2] != rows[:2, -1:], axis=0)) if rows.shape[1] else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
            if cut:
                yield links(rows[:, :cut])
            rest = rows[:, cut:]
        if rest.shape[1]:
            yield links(rest)

    return arrow_map(lists.repartition("wide", "value").sortWithinPartitions("wide", "value"), run, "a long, b long")


def neighbour_links(prints: DataFrame) -> DataFrame:
    """(a, b): links through neighbours: every fingerprint that reaches a neighbour by two flips or fewer, with the
    smallest one that reaches it by one or none. At most 2,081 fingerprints reach a neighbour."""
    flips = lambda masks: F.explode(F.array(*(F.lit(m).cast("long") for m in (0, *masks))))
    far = prints.select("fp", flips(ONE_FLIP + TWO_FLIPS).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("met"), F.col("fp").alias("a"))
    near = prints.select("fp", flips(ONE_FLIP).alias("flip")).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("met")).agg(F.min("fp").alias("b"))
    return far.join(near, "met").filter("a <> b").select("a", "b").distinct()


def links(prints: DataFrame, scratch: Scratch, most: int = GROUP) -> DataFrame:
    """(a, b): enough links among distinct fingerprints (column fp) to tie together all that are linked."""
    lists, found = posted(prints), []
    for finer in (posted_finer, None):
        crowded = scratch.stored(lists.groupBy("wide", "value").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("wide", "value"))
        if not crowded.head(1):
            return _all([*found, compared(lists)])
        found.append(compared(lists.join(crowded, ["wide", "value"], "left_anti").select("wide", "value", "fp")))
        lists = lists.join(crowded, ["wide", "value"], "left_semi").select("wide", "value", "fp")
        if finer:
            lists = scratch.stored(finer(lists))
    return _all([*found, neighbour_links(scratch.stored(lists.select("fp").distinct()))])


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_duplicates(df: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", most: int = GROUP) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key reachable over links of at most BITS differing bits."""
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.stored(fingerprinted(df.select(F.col(key).alias("id"), F.col(text).alias("text")), words))
        prints = scratch.stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
        roots = components(links(prints.select("fp"), scratch, most), scratch)
        rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        # one row for each fingerprint, so rows of a very frequent one are spread by adaptive execution
        classes = scratch.stored(rooted.join(least, "root").select("fp", "component_id"))
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
        return stored(rows.join(classes, "fp").select(F.col("id").alias(key), hexed, "component_id"))
