"""N-gram Jaccard self-join by parity sketches, and its connected groups.

A document's set holds the 64-bit hashes of its distinct word shingles. Sets are cut into K blocks by hash, and
each block has a parity sketch of 64 bits: every shingle flips a random half of them. A shingle that two sets don't
share changes at most one block's sketch, so the number of differing blocks is at most the symmetric difference.
A set of n shingles and one that it may be linked with in a size band differ in at most d shingles, where d follows
from n and from the largest size that the other one can have; the join key is (band, block, sketch), of K blocks.

Empty blocks agree for no reason, so they give no key: a set gives its first d + 1 blocks that aren't empty. Of two
sets the one whose last such block comes first has more of them than can differ, so one agrees, and both give it
(pigeonhole). A set with fewer gives all it has, which is enough for sets that have more, and is joined again under
further hash seeds; under the last one its empty blocks give keys, too. No pair at or above the threshold is lost.
Keys have 48 bits; keys that are equal by chance cost a comparison.

Sets of one key meet first within a task's chunk of keys, and of each chunk only the first set goes on to meet
those of other chunks, so a key that a third of all sets hold is no large group anywhere. Candidates are compared
by a sketch of the whole set first (the Hamming distance is a lower bound of the symmetric difference; a group's
members by half a sketch before that) and then by exact intersection. Within a key's group the members are compared with one or, by chunks, a few pivots; where a group's members still lie in different components, further pivots follow until every pair of
members in different components has been compared. So copies don't become all pairs, and no link between
components is missed.

Equal sets are one node (a 64-bit hash of the set), and a task emits the keys of equal sets once.

Defined cases: null text, empty text and text without words have an empty set, linked with nothing, so the row's
class is its own id; a row with a null key takes part and gets the smallest key of its class (null if there
is none); repeated rows and repeated keys are rows of one class if their sets are equal or linked; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from wayfold.llm.common import Scratch, arrow_map, dropped, stored
from wayfold.llm.components import components, merged_roots, rooted

#: Ratio of a size band's ends; hash seeds tried before empty blocks give keys; differences from which a band has spare blocks.
BAND_RATIO, SEEDS, LEAST_ROOM = 1.25, 6, 4
#: Pivots of the first extra round in groups that fall into several components; each round takes 16 times more.
PIVOTS = 16
#: Pivots that a task holds, and members of a group that one task compares with them.
BLOCK, SHARE = 1024, 4000
#: Bits of a join key.
KEY_BITS = 48
#: Rows that a task hands over at once, and keys among which it looks for equal ones.
EMIT, CHUNK = 1 << 17, 1 << 19

_U = np.uint64
#: Odd multipliers that mix hashes (any odd numbers do).
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@lru_cache
def _factors(n: int) -> list[np.uint64]:
    return [_U((_STEP * (2 * i + 1)) % 2**64 | 1) for i in range(n)]


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles (A-Z lower-cased, ASCII white space between words)."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i, f in enumerate(_factors(k)):
        total += h[i : len(h) - k + 1 + i] * f
    total = mixed(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a whole set, of a power of two of bits, at least twice its size; halves fold by XOR."""
    words = 1 << max(0, (len(s) // 32).bit_length())
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((s >> _U(6)) & _U(words - 1)).astype(np.int64), _U(1) << (s & _U(63)))
    return out.view(np.int64)


def set_id(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None


@dataclass(frozen=True)
class Plan:
    """Bands and blocks for links at num / den or more."""

    n: int
    num: int
    den: int

    @lru_cache  # noqa: B019
    def edges(self, upto: int) -> tuple[int, ...]:
        out = [1]
        while out[-1] <= upto:
            out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND_RATIO)))
        return tuple(out)

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(band, differences, blocks) of the bands in which a set of this size is joined: the band's number of blocks, and
        in how many shingles at most this set differs from one that it is linked with there."""
        edges = self.edges(1 << max(4, (2 * size * self.den // self.num).bit_length()))
        i = next(i for i in range(len(edges)) if edges[i + 1] > size)
        out = []
        while not out or size * self.den >= self.num * edges[i]:
            other = min(edges[i + 1] - 1, size * self.den // self.num)
            out.append((i, (self.den - self.num) * (size + other) // (self.den + self.num), self.blocks(edges[i], edges[i + 1] - 1)))
            i += 1
        return [x for x in out if x[1]]  # sets that may not differ at all are equal sets, which are one node

    @lru_cache  # noqa: B019
    def blocks(self, least: int, most: int) -> int:
        d = (self.den - self.num) * 2 * most // (self.den + self.num)
        spare = 0
        if d >= LEAST_ROOM:
            for _ in range(4):
                empty = (d + 1 + spare) * math.exp(-least * self.num / self.den / (d + 1 + spare))
                spare = min(d, math.ceil(empty + 2 * math.sqrt(empty)))
        return d + 1 + spare

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Join keys of a set; two sets of similarity num / den or more have one in common, if they aren't equal."""
        out = []
        for band, d, k in self.bands(len(s)):
            for seed in range(SEEDS):
                g = s if not seed else np.sort(mixed(s ^ _U((_STEP * (seed + 7)) % 2**64)))
                block = ((g >> _U(32)) * _U(k)) >> _U(32)
                start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                place = _U(((band << 4) | seed) << 40)
                if len(start) > d + 1:
                    g, start = g[: start[d + 1]], start[: d + 1]
                out.append(mixed(np.bitwise_xor.reduceat(g, start) ^ mixed(block[start] + place)))
                if len(start) > d:
                    break
                if seed == SEEDS - 1:
                    out.append(mixed(mixed(np.setdiff1d(np.arange(k, dtype=np.uint64), block[start]) + place)))
        return np.concatenate(out) >> _U(64 - KEY_BITS) if out else np.zeros(0, np.uint64)


def sized(df: DataFrame, plan: Plan, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_shingles, sid (the set's number, null for an empty set) and sketch; drops the text."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    kept = df.select(*keep)
    fields = list(to_arrow_schema(kept.schema))
    target = pa.schema([*fields, pa.field("n_shingles", pa.int64()), pa.field("sid", pa.int64()), pa.field("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, sketches = [], [], []
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(len(fields)).slice(at, 256).to_pylist():
                    s = shingle_set(t, plan.n)
                    n.append(len(s))
                    sid.append(set_id(s))
                    sketches.append(sketch(s))
            arrays = [batch.column(i).cast(f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], schema=target)

    schema = StructType(kept.schema.fields[:]).add("n_shingles", LongType()).add("sid", LongType()).add("sketch", ArrayType(LongType()))
    return arrow_map(df.select(*keep, F.col(text).cast("binary").alias("__text")), run, schema)


def _spot(text: str) -> F.Column:
    """A number by which a text is found again."""
    return F.xxhash64(F.col(text).cast("binary")).alias("spot")


def in_chunk(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
    """(first, place, key, sid) of the keys of a chunk: a key's first set once, and every further set with that first one.

    Rows of firsts meet by key (place is the key; key and sid are null). Further sets are dealt by key and chunk,
    so a key that very many sets hold has one row in a chunk that meets others, and its further rows are spread.
    """
    _, begin, kind = np.unique(keys, return_index=True, return_inverse=True)
    head = np.zeros(len(keys), bool)
    head[begin] = True
    n, key, sid = len(begin), keys[~head], sids[~head]
    spread = mixed(key ^ mixed(keys[:1] ^ sids[:1].view(_U)))
    gone = np.repeat([True, False], [n, len(key)])
    arrays = [
        pa.array(np.concatenate([sids[head], sids[begin][kind[~head]]])),
        pa.array(np.concatenate([keys[head], spread]).view(np.int64)),
        pa.array(np.concatenate([keys[head], key]).view(np.int64), mask=gone),
        pa.array(np.concatenate([sids[head], sid]), mask=gone),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["first", "place", "key", "sid"])


def join_keys(df: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """(first, place, key, sid) of all join keys, by chunks (see in_chunk); a task emits the keys of equal sets once.

    A shuffled row is mostly zeros after the place, whose upper bytes are zeros, too, so it compresses well in this order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, sids, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for t in batch.column(0).slice(at, 64).to_pylist():
                    s = shingle_set(t, plan.n)
                    sid = set_id(s)
                    if sid is None or sid in seen:
                        continue
                    seen.add(sid)
                    k = np.unique(plan.keys(s))
                    keys.append(k)
                    sids.append(np.full(len(k), sid, np.int64))
                    held += len(k)
                    if held >= CHUNK:
                        yield in_chunk(np.concatenate(keys), np.concatenate(sids))
                        keys, sids, held = [], [], 0
        if held:
            yield in_chunk(np.concatenate(keys), np.concatenate(sids))

    return arrow_map(df.select(F.col(text).cast("binary")), run, "first long, place long, key long, sid long")


def met_keys(df: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """(key, a, b): of every key that several sets hold its smallest first set a with each other first set b, and
    each first set with its chunk's further sets. The sets of a key are its a and b, and these pairs tie all of them."""
    d = join_keys(df, plan, text).withColumn("least", F.min("first").over(Window.partitionBy("place")))
    d = d.filter("sid IS NOT NULL OR first <> least")
    further = F.col("sid").isNotNull()
    d = d.select("place", F.coalesce("key", "place").alias("key"), F.when(further, F.col("first")).otherwise(F.col("least")).alias("a"), F.coalesce("sid", "first").alias("b"))
    return d.distinct().drop("place")  # rows of a place lie together already


def sets_of(df: DataFrame, rows: DataFrame, plan: Plan, wanted: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """(sid, hashes) of the wanted sets, from one text of each; rows are df's in the form of `sized`, with spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sets = [shingle_set(t, plan.n) for t in batch.column(0).slice(at, 64).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["sid", "hashes"])

    # a table of known size, so Spark itself decides whether it may be broadcast
    spots = scratch.stored(rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("spot").alias("spot")).select("spot"))
    texts = df.select(F.col(text).cast("binary").alias("text")).withColumn("spot", F.xxhash64("text")).join(spots, "spot", "left_semi")
    found = arrow_map(texts.select("text"), run, "sid long, hashes array<long>")
    return found.groupBy("sid").agg(F.first("hashes").alias("hashes"))


def _half(x: str, half: F.Column) -> F.Column:
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _folded(x: str, to: str) -> F.Column:
    """Sketch x at the size of sketch `to`, where that is half as large."""
    return F.when(F.size(x) > F.size(to), _half(x, F.size(to))).otherwise(F.col(x))


def halved(x: str) -> F.Column:
    """A sketch at half its size, if it has more than one word."""
    return F.when(F.size(x) > 1, _half(x, (F.size(x) / 2).cast("int"))).otherwise(F.col(x))


def close_pairs(pairs: DataFrame, marks: DataFrame, plan: Plan) -> DataFrame:
    """Of (a, b) the pairs that the whole sets' sketches don't rule out; marks are (sid, n_shingles, sketch)."""
    sketched = pairs
    for side in ("b", "a"):
        sketched = sketched.join(marks.select(F.col("sid").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    apart = F.aggregate(F.zip_with(_folded("sa", "sb"), _folded("sb", "sa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    return sketched.filter(apart * (plan.den + plan.num) <= (plan.den - plan.num) * (F.col("na") + F.col("nb"))).select("a", "b")


class Sets:
    """Exact sets of those that some pair asked for, each made and written once."""

    def __init__(self, df: DataFrame, rows: DataFrame, plan: Plan, scratch: Scratch, text: str):
        self.df, self.rows, self.plan, self.scratch, self.text, self.have = df, rows, plan, scratch, text, None

    def linked(self, near: DataFrame) -> DataFrame:
        """Of (a, b) the pairs whose exact similarity reaches the threshold; near is read twice."""
        wanted = self.scratch.stored(near.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
        lacking = wanted if self.have is None else self.scratch.stored(wanted.join(self.have.select("sid"), "sid", "left_anti"))
        new = self.scratch.stored(sets_of(self.df, self.rows, self.plan, lacking, self.scratch, self.text))
        # only the sets asked for now are moved to the pairs
        asked = new if self.have is None else self.have.unionByName(new).join(wanted, "sid", "left_semi")
        self.have = new if self.have is None else self.have.unionByName(new)
        both = near
        for side in ("b", "a"):
            both = both.join(asked.select(F.col("sid").alias(side), F.col("hashes").alias(f"h{side}")), side)
        shared = both.select("a", "b", (F.size("ha") + F.size("hb")).alias("sum"), F.size(F.array_intersect("ha", "hb")).alias("both"))
        return shared.filter(F.col("both") * self.plan.den >= self.plan.num * (F.col("sum") - F.col("both"))).select("a", "b")


def _at_size(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches folded to so many words, one to a row."""
    out = np.empty((len(sketches), words), np.uint64)
    for i, x in enumerate(sketches):
        out[i] = x if len(x) == words else np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)
    return out


def pivot_pairs(members: DataFrame, low: int, high: int, plan: Plan) -> DataFrame:
    """(a, b): members of places low + 1 to high against all later ones of their group, where roots differ and sketches are close.

    members are (key, place, size, sid, root, n_shingles, sketch). Pivots come in blocks of BLOCK, and a task has a
    block and a share of the later members: it stacks the block's sketches once and streams the members by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots, stacks = None, [], {}
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "block", "salt", "pivot", "place", "sid", "root", "n_shingles")), (np.asarray(v.values, np.int64).view(np.uint64) for v in batch.column("sketch")), strict=True)
            a, b, held = [], [], 0
            for key, block, salt, pivot, place, sid, root, n, sk in rows:
                if group != (key, block, salt):
                    group, pivots, stacks = (key, block, salt), [], {}
                if pivot:
                    pivots.append((place, sid, root, n, sk))
                    continue
                if not stacks:  # the block is full: pivots come before members
                    places, sids, roots, ns = (np.array([p[i] for p in pivots]) for i in range(4))
                    least = min(len(p[4]) for p in pivots)
                    stacks[least] = _at_size([p[4] for p in pivots], least)
                words = min(len(sk), least)
                if words not in stacks:
                    stacks[words] = np.bitwise_xor.reduce(stacks[least].reshape(len(pivots), -1, words), axis=1)
                apart = np.bitwise_count(stacks[words] ^ _at_size([sk], words)).sum(1, dtype=np.int64)
                near = sids[(places < place) & (roots != root) & (apart * (plan.den + plan.num) <= (plan.den - plan.num) * (ns + n))]
                if len(near):
                    a.append(np.minimum(near, sid))
                    b.append(np.maximum(near, sid))
                    held += len(near)
                if held >= EMIT:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                    a, b, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    salts = F.ceil(F.col("size") / SHARE).cast("int")
    columns = ("key", "place", "sid", "root", "n_shingles", "sketch")
    block_of = lambda place: F.floor((place - (low + 1)) / BLOCK).cast("int")
    pivots = members.filter(F.col("place").between(low + 1, high)).select(*columns, F.lit(True).alias("pivot"), block_of(F.col("place")).alias("block"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # a member meets the blocks that begin before it
    met = F.explode(F.sequence(F.lit(0), block_of(F.least(F.col("place") - 1, F.lit(high))))).alias("block")
    later = members.filter(F.col("place") > low + 1).select(*columns, F.lit(False).alias("pivot"), met, F.pmod(F.xxhash64("sid"), salts).cast("int").alias("salt"))
    ordered = pivots.unionByName(later).repartition("key", "block", "salt").sortWithinPartitions("key", "block", "salt", F.desc("pivot"))
    return arrow_map(ordered.select("key", "block", "salt", "pivot", "place", "sid", "root", "n_shingles", "sketch"), run, "a long, b long").distinct()


def placed(members: DataFrame, salts: int = 64) -> DataFrame:
    """(key, sid, place, size): members of each key numbered from 1, in parts, so a key's members needn't meet in one task."""
    part = members.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(salts)))
    counts = part.groupBy("key", "part").agg(F.count("*").alias("n"))
    upto, group = Window.partitionBy("key").orderBy("part"), Window.partitionBy("key")
    starts = counts.select("key", "part", (F.sum("n").over(upto) - F.col("n")).alias("start"), F.sum("n").over(group).alias("size")).filter("size > 2")
    own = part.withColumn("no", F.row_number().over(Window.partitionBy("key", "part").orderBy("sid")))
    return own.join(starts, ["key", "part"]).select("key", "sid", (F.col("start") + F.col("no")).alias("place"), "size")


def linked_sets(df: DataFrame, rows: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """(node, root) of all sets that are linked with another set; rows are df's in the form of `sized`, with spot."""
    with Scratch(df.sparkSession) as scratch:
        marks = scratch.stored(rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
        met = scratch.stored(met_keys(df, plan, text))
        pairs = scratch.stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        exact = Sets(df, rows, plan, scratch, text)
        near = scratch.stored(close_pairs(pairs, marks, plan))
        links = scratch.stored(exact.linked(near))
        roots = scratch.stored(components(links, scratch))
        # keys that hold a pair of different components, if they have members besides that pair
        apart = rooted(pairs.join(links, ["a", "b"], "left_anti"), roots).filter("root_a <> root_b").select("a", "b")
        odd = met.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).join(apart, ["a", "b"], "left_semi").select("key").distinct()
        ranks = scratch.stored(placed(met.join(odd, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("sid")).distinct()))
        for done in (met, pairs, near, links):
            dropped(done)
        most = ranks.agg(F.max("place")).first()[0] or 0
        low, high = 0, PIVOTS
        while low < most:
            held = labelled(ranks, roots)
            still = held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
            held = held.filter(F.col("size") > low + 1).join(still, "key", "left_semi").join(marks.withColumn("sketch", halved("sketch")), "sid")
            likely = scratch.stored(pivot_pairs(held, low, high, plan))
            near = scratch.stored(close_pairs(likely, marks, plan))
            dropped(likely)
            if near.head(1):
                new = scratch.stored(exact.linked(near))
                if new.head(1):
                    after = scratch.stored(merged_roots(roots, new, scratch))
                    dropped(roots)
                    roots = after
                dropped(new)
            dropped(near)
            low, high = high, high * 16
        return stored(roots)


def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): links join sets with den * intersection >= num * union."""
    plan = Plan(n, num, den)
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.stored(sized(df.select(key, text, _spot(text)), plan, text))
        sets = labelled(rows.drop("sketch", "spot"), linked_sets(df, rows, plan, text))
        least = sets.filter("root IS NOT NULL").groupBy("root").agg(F.min(key).alias("component_id"))
        out = sets.join(least, "root", "left")
        # a row without shingles is a class of its own
        return stored(out.select(key, "n_shingles", F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without those that are linked with a kept one: of each class the row of smallest key stays (null last).

    Among rows of one key a 128-bit hash of the row decides, and of fully equal rows one stays. Rows without words all stay.
    """
    taken = {c.lower() for c in df.columns}
    row = [c for c in (f"__row{i}" for i in range(len(taken) + 2)) if c not in taken][:2]  # names that the table doesn't have
    plan, marked = Plan(n, num, den), df.withColumns({row[0]: F.xxhash64(*df.columns), row[1]: F.xxhash64(F.lit(1), *df.columns)})
    with Scratch(df.sparkSession) as scratch:
        rows = scratch.stored(sized(marked.select(key, *row, text, _spot(text)), plan, text))
        sets = labelled(rows.filter("sid IS NOT NULL").drop("sketch", "spot"), linked_sets(df, rows, plan, text))
        ranked = sets.withColumn("rank", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), *row))
        judged = scratch.stored(ranked.join(ranked.groupBy("root").agg(F.min("rank").alias("best")), "root").select(*row, F.col("rank").eqNullSafe(F.col("best")).alias("best")))
        lost = stored(judged.filter("NOT best").select(*row).distinct())
        twice = stored(judged.filter("best").groupBy(*row).agg(F.count("*").alias("n")).filter("n > 1").select(*row))
    once = marked.join(lost, row, "left_anti").join(twice, row, "left_anti")
    again = marked.join(twice, row, "left_semi").dropDuplicates(row)
    return once.unionByName(again).select(*df.columns)
