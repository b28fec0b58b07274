"""The near-duplicate stage: SimHash by covering LSH, then an exact search for what it left apart.

Texts that are equal after lower-casing A-Z and joining words by one space are one
class. Two classes are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Groups are the connected components; the smallest doc_id stays.

First search: a class gets a 64-bit SimHash fingerprint over its words, weighted by
1 + log of their number; covering masks of radius 5 bring every pair within 5 bits
together. A bucket of up to ``ALL_PAIRS`` classes gives all its pairs within the
radius, a larger one each member's nearest, so rows stay in proportion to its size.
Candidates are compared exactly. This joins most near copies, but no radius is a guarantee
at similarity 0.8, and a member may be similar to others than its nearest.

Second search, exact, for pairs of classes in different components of the first: of two
similar sets, the parts with the smallest hashes must share shingles (prefix filter). A
class of n shingles gives its a + k smallest hashes, where a = n - ceil(0.8 n) may be
missing from a partner and k = ``DEPTH`` a + 1, at least, must be shared. Only hashes that two classes
hold go on; a class with fewer of these than its smallest partner asks for has no
partner. Of the others, the rarest go into buckets, as many as must hold a shared one.
A bucket of fewer than ``CROWD`` classes gives its pairs between different components whose
sizes allow the similarity. A larger one gives no pairs: its members go with their sets to
tiles, which compare them there, once for all the crowds that two classes are both in, and
give links that join components.

Candidates are compared in tiles: classes are dealt into blocks of bounded bytes, a tile
is a pair of blocks, and a set of shingles goes once to each tile that needs it. A tile
gives at most one link fewer than it has components.

Edge cases: null and empty texts are one class; texts of fewer than five words are
one shingle, so only equal ones group; rows with a null doc_id have no identity and
stay; rows that share a doc_id are one document and stay or go together, by its first text
in any group; very long texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pick
from .graph import components
from .simhash import HOT, masks, shingles

SHINGLE, SIMILARITY = 5, 0.8
SEED, RADIUS = 42, 5
ALL_PAIRS = 8
#: How many more shingles than the one that must be shared the exact search asks for, as a share of those that may be missing.
DEPTH = 0.25
#: Rows of one hash held before it counts as common; it is common for all its rows then.
COMMON = 1 << 20
#: Sets of one block; a task holds two blocks.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 8
PAIRS_AT_ONCE = 1 << 20
#: The classes of a hash that so many have are a crowd. A class tells in which crowds, the first ``BEFORE``, it was before.
CROWD, BEFORE = 64, 32
MASK = np.array(masks(RADIUS), dtype=np.int64).view(np.uint64)


def fingerprint(words: list[bytes]) -> int:
    count = Counter(words)
    if not count:
        return 0
    weight = np.fromiter((1 + log(n) for n in count.values()), dtype=np.float64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in count), dtype=np.uint64)
    ones = weight @ np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * ones > weight.sum()).tobytes(), "big", signed=True)


def digest(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.lower().split()
    return words, xxhash.xxh3_128_digest(b" ".join(words))


def short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x) for x in shingles(text, SHINGLE)), dtype=np.uint64))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary()))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, k, fp = [], [], []
        for text in _texts(b):
            words, own = digest(text)
            key.append(own)
            k.append(short(own))
            fp.append(fingerprint(words))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(key, pa.binary()), pa.array(k, pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "key", "k", "fp"])


def bucket(masked: np.ndarray, tables: np.ndarray) -> np.ndarray:
    k = (masked ^ (tables.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (k ^ (k >> np.uint64(31))).view(np.int64)


def first_here(x: np.ndarray, y: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether the first table in which x and y collide is the one of their bucket."""
    t = ((x ^ y)[:, None] & MASK[None, :] == 0).argmax(axis=1)
    return bucket(x & MASK[t], t) == here


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class in every table; the bucket is the hash of table and masked bits."""
    tables = np.arange(len(MASK))[None, :]
    for b in batches:
        fps, reps = b.column("fp").to_numpy(), b.column("rep").to_numpy()
        for lo in range(0, len(fps), 2000):
            fp, rep = fps[lo : lo + 2000], reps[lo : lo + 2000]
            k = bucket(fp.view(np.uint64)[:, None] & MASK[None, :], tables)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(fp, len(MASK))), pa.array(np.repeat(rep, len(MASK)))], ["bucket", "fp", "rep"])


def _near(here: int, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one bucket of the first search."""
    if len(fp) <= ALL_PAIRS:
        i, j = np.triu_indices(len(fp), 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
        i, j = i[near], j[near]
        near = first_here(fp[i], fp[j], here)
        return rep[i[near]], rep[j[near]]
    a, b = [], []
    for lo in range(0, len(fp), HOT):
        f, r = fp[lo : lo + HOT], rep[lo : lo + HOT]
        to = np.arange(len(f))
        for i in range(len(f)):
            far = np.bitwise_count(f ^ f[i])
            far[i] = 255
            j = int(far.argmin())  # of ties the first, so that many members choose the same
            to[i] = j if far[j] <= RADIUS else i
        near = np.flatnonzero(first_here(f, f[to], here))
        a.append(r[near])
        b.append(r[to[near]])
    return np.concatenate(a), np.concatenate(b)


def _pairs(a: list[np.ndarray], b: list[np.ndarray], *roots: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs, the smaller id first, with their components if they have any."""
    a, b, *roots = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, *roots))
    roots = roots or [a, b]
    flip = a > b
    rows = np.stack([np.where(flip, y, x) for x, y in ((a, b), (b, a), roots, roots[::-1])])
    rows = np.unique(rows[:, a != b], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["a", "b", "ra", "rb"])


PAIR = "a long, b long, ra long, rb long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs over rows sorted by bucket."""
    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(rest, ("bucket", "fp", "rep"), strict=True)]
        k = rows[0]
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        last = cuts[-1] if len(cuts) else 0  # the last bucket may go on in the next batch
        rest = [x[last:] for x in rows]
        fp, rep = rows[1].view(np.uint64), rows[2]
        starts = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
        size = cuts - starts
        two = starts[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        two = two[first_here(fp[two], fp[two + 1], k[two])]
        a, b = [rep[two]], [rep[two + 1]]
        for i in np.flatnonzero(size > 2):
            x, y = _near(k[starts[i]], fp[starts[i] : cuts[i]], rep[starts[i] : cuts[i]])
            a.append(x)
            b.append(y)
        yield _pairs(a, b)
    if len(rest[0]) > 1:
        x, y = _near(rest[0][0], rest[1].view(np.uint64), rest[2])
        yield _pairs([x], [y])


def may_miss(n):
    """How many of n shingles a similar set may lack."""
    return n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64)


def must_share(n):
    """How many of the smallest hashes the search asks a set of n to share."""
    return np.minimum(np.ceil(DEPTH * may_miss(n)).astype(np.int64) + 1, np.maximum(n - may_miss(n), 1))


def need(n):
    """How many of its smallest hashes any similar set must share with a set of n: the smallest partner has
    n - may_miss(n) shingles, and the fewer that either asks for count."""
    return np.minimum(must_share(n), must_share(n - may_miss(n)))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, k, n``: the smallest hashes of each text, the beginning of its class's key, and how many shingles it has."""
    for b in batches:
        h, k, n, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
        for text in _texts(b):
            own = short(digest(text)[1])
            if own in seen:
                continue
            seen.add(own)
            s = shingle_set(text)
            size = np.int64(len(s))
            s = s[: may_miss(size) + must_share(size)]
            h.append(s)
            k.append(np.full(len(s), own))
            n.append(np.full(len(s), size))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(k)), pa.array(np.concatenate(n))], ["h", "k", "n"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, k, n, need, df`` over rows sorted by h and k: those of hashes that two classes or more hold, with their number."""

    def out(rows: list[np.ndarray], df: np.ndarray) -> pa.RecordBatch:
        rows = [*rows, need(rows[2]), df]
        return pa.RecordBatch.from_arrays([pa.array(x[df > 1]) for x in rows], ["h", "k", "n", "need", "df"])

    def counted(rows: list[np.ndarray]) -> pa.RecordBatch:
        _, at, n = np.unique(rows[0], return_inverse=True, return_counts=True)
        return out(rows, n[at] if len(n) else np.zeros(0, np.int64))

    held, common = [np.zeros(0, np.int64)] * 3, None
    for batch in batches:
        rows = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("h", "k", "n"), strict=True)]
        if common is not None:
            own = rows[0] == common
            yield out([x[own] for x in rows], np.full(int(own.sum()), COMMON))
            rows = [x[~own] for x in rows]
            common = None if len(rows[0]) else common
        held = rows
        if not len(rows[0]):
            continue
        new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
        rows = [x[new] for x in rows]
        last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last hash may go on in the next batch
        yield counted([x[:last] for x in rows])
        held = [x[last:] for x in rows]
        if len(held[0]) > COMMON:
            common = held[0][0]
            yield out(held, np.full(len(held[0]), COMMON))
            held = [x[:0] for x in held]
    yield counted(held)


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs between different components whose sizes allow the similarity, over rows ``h, rep, root, n`` sorted by h."""

    def found(rep: np.ndarray, root: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for i in range(len(rep) - 1):
            j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & sizes_allow(n[i + 1 :], n[i]))
            yield np.full(len(j), rep[i]), rep[j], np.full(len(j), root[i]), root[j]

    parts, count = [[], [], [], []], 0
    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        rows = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("h", "rep", "root", "n"), strict=True)]
        cuts = np.concatenate([[0], np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for more in found(*(x[lo:hi] for x in rows[1:])):
                count += len(more[0])
                for p, m in zip(parts, more, strict=True):
                    p.append(m)
                if count > PAIRS_AT_ONCE:
                    yield _pairs(*parts)
                    parts, count = [[], [], [], []], 0
        held = [x[cuts[-1] :] for x in rows]
    for more in found(*held[1:]):
        for p, m in zip(parts, more, strict=True):
            p.append(m)
    yield _pairs(*parts)


def sizes_allow(n, m):
    return np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - 1e-9


def meet(rep: np.ndarray, root: np.ndarray, block: np.ndarray, before: list[list[int]], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that join the components of one tile of a crowd. Every pair between two components (between the two blocks, if there
    are two) is compared, but for pairs that met in an earlier crowd, one of ``before`` of both."""
    _, of, count = np.unique(root, return_inverse=True, return_counts=True)
    # The largest component comes last: its members need no look at each other.
    order = np.argsort(of == count.argmax(), kind="stable")
    rep, root, block, before, sets = rep[order], root[order], block[order], [before[i] for i in order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    _, terms = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    mark, two = np.zeros(terms.max() + 1, dtype=np.int32), block.min() != block.max()
    met: dict[int, list[int]] = {}
    for i, own in enumerate(before):
        for t in own:
            met.setdefault(t, []).append(i)
    at = {t: np.array(v) for t, v in met.items()}
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    a, b = [], []
    for i in range(len(rep) - int(count.max())):
        ok = (root != root[i]) & sizes_allow(n, n[i])
        ok[: i + 1] = False
        if two:
            ok &= block != block[i]
        for t in before[i]:
            ok[at[t]] = False
        if not ok.any():
            continue
        mine = terms[starts[i] : starts[i] + n[i]]
        mark[mine] = 1
        same = np.add.reduceat(mark[terms], starts)
        mark[mine] = 0
        for j in np.flatnonzero(ok & (same >= SIMILARITY * (n + n[i] - same) - 1e-9)):
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                a.append(int(rep[i]))
                b.append(int(rep[j]))
    return a, b


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of crowds over rows ``h, tile, block, rep, root, before, s`` sorted by h and tile."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        a, b = [], []
        if len({r[4] for r in rows}) > 1:
            block, rep, root = (np.array([r[i] for r in rows], dtype=np.int64) for i in (2, 3, 4))
            a, b = meet(rep, root, block, [r[5] for r in rows], [np.frombuffer(r[6], np.uint64) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "tile", "block", "rep", "root", "before", "s")), strict=True):
            if held and held[0][:2] != row[:2]:
                yield out(held)
                held = []
            held.append(row)
    yield out(held)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted, are similar."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or not sizes_allow(len(small), len(large)):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = int((large[at] == small).sum())
    return same >= SIMILARITY * (len(x) + len(y) - same) - 1e-9


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links over rows ``tile, a, b, root, s`` sorted by tile: first its sets (null b), then its pairs."""

    tile, sets, up, a, b = None, {}, {}, [], []

    def top(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tile", "a", "b", "root")]
        data = batch.column("s")
        for i, (t, x, y, root) in enumerate(zip(*columns, strict=True)):
            if tile != t:
                tile, sets, up = t, {}, {}
            if y is None:
                sets[x] = (root, np.frombuffer(data[i].as_py(), np.uint64))
                continue
            (rx, sx), (ry, sy) = sets[x], sets[y]
            rx, ry = top(rx), top(ry)
            if rx != ry and similar(sx, sy):
                up[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = [], []


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingle_set(t).tobytes() for t in _texts(b)], pa.binary())], ["id", "s"])


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, s`` of the documents ``doc_id`` of ``ids``."""
    return cut(docs.join(ids.distinct(), "doc_id", "left_semi").mapInArrow(_sets, "id long, s binary").dropDuplicates(["id"]))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the components of all similar pairs among ``a, b, ra, rb``."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sets.agg(F.sum(F.length("s"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    p = pairs.withColumn("tile", F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b")))
    members = p.select("tile", F.col("a").alias("id"), F.col("ra").alias("root")).union(p.select("tile", "b", "rb")).distinct().join(sets, "id")
    none = F.lit(None)
    rows = members.select("tile", F.col("id").alias("a"), none.cast("long").alias("b"), "root", "s").unionByName(p.select("tile", "a", "b", none.cast("long").alias("root"), none.cast("binary").alias("s")))
    return cut(rows.repartition(n, "tile").sortWithinPartitions("tile", F.asc_nulls_first("b")).mapInArrow(_tiles, "a long, b long"))


def crowd_links(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` among the members ``h, rep, root, n, before`` of crowds, dealt into blocks of bounded bytes."""
    n = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = crowd.groupBy("h").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    c = crowd.join(blocks, "h").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    c = c.withColumn("tile", F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other"))
    rows = c.select("h", "tile", "block", "rep", "root", "before").join(sets.withColumnRenamed("id", "rep"), "rep").select("h", "tile", "block", "rep", "root", "before", "s")
    return cut(rows.repartition(n, "h", "tile").sortWithinPartitions("h", "tile", "rep").mapInArrow(_crowds, "a long, b long"))


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, group_id`` for each document with an id: its group's smallest doc_id."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("doc_id"))
    c = cut(d.mapInArrow(_classes, "doc_id long, key binary, k long, fp long"))
    rep = cut(c.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("k").alias("k"), F.first("fp").alias("fp")))
    b = rep.select("rep", "fp").mapInArrow(_buckets, "bucket long, fp long, rep long")
    near = cut(b.repartition(n, "bucket").sortWithinPartitions("bucket", "rep").mapInArrow(_candidates, PAIR).distinct())
    roots = cut(components(confirmed(near, shingle_sets(d, ends(near)))))
    now = rep.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("k", "rep", F.coalesce("root", "rep").alias("root"))
    h = d.select("text").mapInArrow(_prefixes, "h long, k long, n long")
    h = h.repartition(n, "h").sortWithinPartitions("h", "k").mapInArrow(_shared, "h long, k long, n long, need long, df long")
    own = Window.partitionBy("rep")
    h = h.join(now, "k").withColumn("have", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("df", "h"))).where("place <= have - need + 1")
    h = h.withColumn("alone", F.count_if(F.col("df") < CROWD).over(own))
    earlier = F.when((F.col("place") > F.col("alone")) & (F.col("place") <= F.col("alone") + BEFORE), F.col("h"))
    h = h.withColumn("before", F.collect_list(earlier).over(own.orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)))
    h = cut(h.select("h", "df", "rep", "root", "n", "before"))
    crowd, few = h.where(F.col("df") >= CROWD), h.where(F.col("df") < CROWD)
    second = cut(few.select("h", "rep", "root", "n").repartition(n, "h").sortWithinPartitions("h").mapInArrow(_crossing, PAIR).distinct())
    sets = shingle_sets(d, ends(second).union(crowd.select("rep")))
    links = confirmed(second, sets).unionByName(crowd_links(crowd, sets))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    of = rep.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("group_id"))
    return c.select("doc_id", "key").join(of, "key").select("doc_id", "group_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group."""
    names = docs.columns
    d = pick(docs, *names)
    stay = groups(d).groupBy("doc_id").agg(F.min("group_id").alias("group_id")).where("doc_id = group_id").select(F.col("doc_id").alias("_stay"))
    return d.where("doc_id IS NULL").unionByName(d.join(stay, d["doc_id"] == stay["_stay"], "left_semi"))
