"""Line deduplication: two Bloom filters find suspects, only suspects are shuffled.

Pass 1 gives every task a pair of Bloom filters over the keys of its documents:
bits seen once, and bits seen twice. Pairs are merged with
``once = a.once | b.once``, ``twice = a.twice | b.twice | (a.once & b.once)``,
which is associative and commutative and never misses a repeat. Pass 2 tests
every key against the merged "twice" filter; only suspects are shuffled, as
SHA-256 digests, for the exact confirmation and the choice of the smallest
doc_id. The filters have a fixed size (``BITS``), which bounds what is sent to
executors; with more lines than it holds well, more keys become suspects and the
result stays exact.

Edge cases: a null or empty text is one empty line; rows with one doc_id are one
document when documents are counted, and each keeps or loses its lines by that;
a null doc_id is a document larger than every other; an empty table gives no
rows; texts of any length are processed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table

SPACES = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Bits of each filter (8 MB), cut into segments that are merged by different tasks.
BITS, SEGMENTS, HASHES = 1 << 26, 16, 2
NO_ID = (1 << 63) - 1


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line; an empty one if it is too short to count."""
    out = []
    for x in text.lower().split(b"\n"):  # bytes.lower() changes A-Z only
        x = x.strip(SPACES)
        n = len(x)
        out.append(x if n >= 4 * MIN_CHARS or (n >= MIN_CHARS and len(x.decode("utf-8", "replace")) >= MIN_CHARS) else b"")
    return out


def places(hashes: np.ndarray) -> np.ndarray:
    """Filter positions of 64-bit hashes, a row each; the two halves are independent enough."""
    return np.stack([(hashes >> np.uint64(s)) & np.uint64(BITS - 1) for s in (0, 64 - 26)][:HASHES], axis=1).astype(np.int64)


def hashes_of(keys: Iterable[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(k) for k in keys), dtype=np.uint64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text").cast(pa.large_binary()):
        yield x.as_py() or b""


def _pack(once: np.ndarray, twice: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    for i, (a, b) in enumerate(zip(np.split(once, SEGMENTS), np.split(twice, SEGMENTS), strict=True)):
        if a.any():
            yield i, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))


def _get(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(BITS // 8, dtype=np.uint8), np.zeros(BITS // 8, dtype=np.uint8)
    for batch in batches:
        seen = [hashes_of({k for k in keys_of(t) if k}) for t in _texts(batch)]
        # Documents apart: a key repeated within one document isn't a repeat between documents.
        at = places(np.concatenate(seen)).ravel() if seen else np.zeros(0, np.int64)
        place, n = np.unique(at, return_counts=True)
        _set(twice, place[(n > 1) | _get(once, place)])
        _set(once, place)
    rows = list(_pack(once, twice))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whichever segments the task has, one at a time into one pair of arrays a segment."""
    have: dict[int, list[np.ndarray]] = {}
    bits = lambda x: np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
    for batch in batches:
        for s, a, b in zip(batch.column("segment").to_pylist(), batch.column("once"), batch.column("twice"), strict=True):
            a, b = bits(a), bits(b)
            if s in have:
                o, t = have[s]
                have[s] = [o | a, t | b | (o & a)]
            else:
                have[s] = [a, b]
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([zlib.compress(x[0].tobytes(), 1) for x in have.values()], pa.binary()), pa.array([zlib.compress(x[1].tobytes(), 1) for x in have.values()], pa.binary())], ["segment", "once", "twice"])


PAIR = "segment int, once binary, twice binary"


def repeat_filter(docs: DataFrame) -> np.ndarray:
    """The merged "twice" filter, BITS / 8 bytes whatever the input."""
    parts = pick(docs, "text").mapInArrow(_filters, PAIR)
    # Two levels: random groups first, so that no task folds what all the others have made.
    parts = parts.repartition(4 * SEGMENTS, "segment", (F.rand(7) * 16).cast("int")).mapInArrow(_merge, PAIR)
    merged = parts.repartition(SEGMENTS, "segment").mapInArrow(_merge, PAIR).select("segment", "twice").collect()
    out = np.zeros((SEGMENTS, BITS // SEGMENTS // 8), dtype=np.uint8)
    for r in merged:
        out[r.segment] |= np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return out.ravel()


def suspected(hashes: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return _get(twice, places(hashes)).all(axis=1)


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def dedup_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for each row, and its columns ``keep``; ``kept`` is the text
    that is left."""
    spark = docs.sparkSession
    whole = pick(docs, "doc_id", "text", *keep).withColumn("doc_id", F.col("doc_id").cast("long"))
    d = whole.select("doc_id", "text")
    twice = spark.sparkContext.broadcast(repeat_filter(d))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                own = [k for k in dict.fromkeys(keys_of(t)) if k]
                if own:
                    hit = np.flatnonzero(suspected(hashes_of(own), bits))
                    ids += [NO_ID if i is None else i] * len(hit)
                    keys += [digest(own[j]) for j in hit]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    s = cut(d.mapInArrow(suspects, "doc_id long, key binary"))
    # Kept apart from the join, which then has a shuffle on either side, so that Spark can split the
    # rows of a line that very many documents hold.
    first = cut(s.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first"))
    drops = s.join(first, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("drops"))
    drops = drops.withColumnRenamed("doc_id", "_id")
    joined = whole.join(drops, F.coalesce(whole["doc_id"], F.lit(NO_ID)) == drops["_id"], "left").select("doc_id", "text", "drops", *keep)
    schema = "doc_id long, n_lines long, n_dropped long, kept string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in whole.schema if f.name in keep)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for t, drop in zip(_texts(batch), batch.column("drops").to_pylist(), strict=True):
                lines = t.split(b"\n")
                left = lines
                if drop:
                    bad = set(drop)
                    left = [x for x, k in zip(lines, keys_of(t), strict=True) if not k or digest(k) not in bad]
                n.append(len(lines))
                gone.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *[batch.column(c) for c in keep]], ["doc_id", "n_lines", "n_dropped", "kept", *keep])

    return joined.mapInArrow(strip, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {"op5_line_dedup": r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""}
