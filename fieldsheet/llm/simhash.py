"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, the bitwise majority of the XXH64 values (seed 42) of the
text's word shingles, repeats included.

Search: with radius r, bit i of the fingerprint gets a code m(i), a vector of
r + 1 bits; for every non-zero vector v, table v masks the fingerprint to the
bits with <m(i), v> odd. Two fingerprints that differ in r bits or fewer differ
in at most r codes, which leave some v orthogonal to them all, so they collide in
that table: the search misses no pair within the radius (2^(r+1) - 1 tables).

Equal fingerprints are merged before the search, so copies make no pairs. Each
bucket is searched in one sorted pass and gives a spanning forest of its links,
not pairs. A bucket of more than ``HOT`` fingerprints isn't held in one task:
its members meet, spread over the cluster, at the points they reach by flipping
one and two bits, which finds the same links.

Edge cases: a null text or one without words has fingerprint zero and links like
any other; texts of any length are hashed whole; repeated rows repeat; a null
doc_id is never a component id unless its group has no other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table
from .graph import components

SHINGLE, RADIUS, SEED = 3, 3, 42
HOT = 32_768


def shingles(text: bytes, size: int) -> list[bytes]:
    """Word shingles of a text; A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    whole = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return [whole[a:b] for a, b in zip([0, *ends], [e - 1 for e in ends[size - 1 :]], strict=False)]


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    h = xxhash.xxh64_intdigest
    v = np.fromiter((h(x, seed) for x in shingles(text, size)), dtype=np.uint64)
    if not len(v):
        return 0
    ones = np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(v)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [fingerprint(t.as_py() or b"", size, seed) for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.int64())], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks as signed 64-bit integers; codes are dealt in turn, so that every table
    keeps about half of the bits."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        m = sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def forest(bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within the radius, at most one fewer than fingerprints."""
    left, right, rest, front = [], [], bucket, []
    while len(rest) or front:
        if not front:
            front, rest = [rest[0]], rest[1:]
        x = front.pop()
        near = np.bitwise_count(rest ^ x) <= radius
        if near.any():
            new = rest[near]
            left.append(np.full(len(new), x, dtype=np.uint64))
            right.append(new)
            front += list(new)
            rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(radius: int):
    """Over rows sorted by table and key: links (a, b); (a, null) for each member of a hot bucket."""

    def out(a: list[np.ndarray], b: list[np.ndarray], hot: list[np.ndarray]) -> pa.RecordBatch:
        none = [np.zeros(0, np.uint64)]
        a, b, h = (np.concatenate(none + x).view(np.int64) for x in (a, b, hot))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, h])), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(h), pa.int64())])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, hot = None, [], 0, False  # the bucket that may go on in the next batch
        for batch in batches:
            t, k, f = (batch.column(c).to_numpy() for c in ("t", "k", "fp"))
            f = f.view(np.uint64)
            left, right, over = [], [], []
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
            two = np.flatnonzero(ends[1:-1] - starts[1:-1] == 2) + 1  # most that aren't alone, without a loop
            x, y = f[starts[two]], f[starts[two] + 1]
            near = np.bitwise_count(x ^ y) <= radius
            left.append(x[near])
            right.append(y[near])
            for i in [i for i in range(len(starts)) if i in (0, len(starts) - 1) or ends[i] - starts[i] > 2] if len(t) else []:
                s, e = starts[i], ends[i]
                if at != (t[s], k[s]):
                    if size > 1 and not hot:
                        for to, new in zip((left, right), forest(np.concatenate(held), radius), strict=True):
                            to.append(new)
                    at, held, size, hot = (t[s], k[s]), [], 0, False
                held.append(f[s:e])
                size += e - s
                if size > HOT or hot:
                    over += held
                    held, hot = [], True
            yield out(left, right, over)
        if size > 1 and not hot:
            a, b = forest(np.concatenate(held), radius)
            yield out([a], [b], [])

    return run


def _hot_links(hot: DataFrame) -> DataFrame:
    """Links within three bits between the members of hot buckets: x and y link if a point is one flip
    or none from x and two or fewer from y. A point has at most 65 and 2,081 such members."""
    one = [0] + [1 << i for i in range(64)]
    two = one + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = lambda v: [x - (1 << 64) if x >> 63 else x for x in v]
    flips = lambda v: F.explode(F.transform(F.array(*map(F.lit, signed(v))), lambda m: F.col("fp").bitwiseXOR(m)))
    near = hot.select(flips(one).alias("point"), "fp").groupBy("point").agg(F.min("fp").alias("a"))
    return hot.select(flips(two).alias("point"), F.col("fp").alias("b")).join(near, "point").where("a <> b").select("a", "b").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: enough links between the distinct fingerprints ``fp`` to connect what is within the radius."""
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius))]
    b = fps.select("fp", F.inline(F.array(*keys)).alias("t", "k"))
    n = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(b.repartition(n, "t", "k").sortWithinPartitions("t", "k").mapInArrow(_links(radius), "a long, b long"))
    pairs = found.where("b IS NOT NULL")
    hot = cut(found.where("b IS NULL").select(F.col("a").alias("fp")).distinct())
    if not hot.isEmpty():
        if radius != RADIUS:
            raise NotImplementedError("hot buckets are searched by flips of 1 + 2 bits, for radius 3")
        pairs = pairs.unionByName(_hot_links(hot))
    return pairs


def group(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row."""
    d = cut(fingerprints(docs, size))
    fps = d.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(fps, radius))
    of = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    of = cut(of)
    ids = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    return d.join(of.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
