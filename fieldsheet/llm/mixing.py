"""Mixing sources to target weights, with built-in functions only.

1. A document's size is its number of words; sources get targets by weight,
   limited to ``max_epochs`` times their size (water filling).
2. Every source is cut into blocks by a hash of doc_id; the blocks are permuted,
   and drawn (whole passes first, then permuted blocks up to the target; the one
   block at the edge is drawn document by document).
3. A multivariate-hypergeometric splitting tree deals each source's exact quota
   of drawn blocks to the output shards: every node splits its vector of quotas
   in two, so shards get disjoint blocks and random, exactly balanced shares.
4. Within a shard, documents are ordered by a hash (the local shuffle).

The driver holds one row a source, and quotas by source and shard: both have
bounds that don't follow the number of documents (``MAX_SHARDS``). Blocks are
at most ``MAX_BLOCKS`` a source, so no window sees a hot source's documents.

Edge cases: null texts and texts without words have size 0 and are drawn with
their block; a null source is a source, the last one; repeated rows are rows of
their own; null ids hash like any value; an empty table gives no rows; other
columns are ignored. The result depends on rows and seed only.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut, pick, table

WEIGHTS, SHARE, MAX_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2
MAX_BLOCKS, BLOCK_DOCS = 4096, 32
MAX_SHARDS, SHARD_WORDS = 1024, 50_000_000
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: list[float], weights: list[float], share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Share ``share`` of all sizes by weight; none above ``max_epochs`` times its size."""
    limit, out, free = [max_epochs * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = min(share, max_epochs) * sum(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > limit[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in sorted(over):
            out[i] = limit[i]
            left -= limit[i]
            free.discard(i)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quotas by shard and source: a binary tree over shards, a multivariate-hypergeometric draw a node."""
    rng, out = np.random.default_rng(seed), [[0] * len(quotas) for _ in range(shards)]
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1 or not len(have):
            out[lo] = have.tolist()
            continue
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if n else np.zeros_like(have)
        todo += [(mid, hi, have - left), (lo, mid, left)]
    return out


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as a literal of the plan."""
    text = F.lit(json.dumps(rows, ensure_ascii=False))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def allocate(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: ``doc_id, source, size, source_size, target, shards`` and its columns ``keep``;
    ``shards`` has one entry for each time the mix takes the document.

    Counts come from slim rows that are kept; with ``keep`` the documents are read again and meet
    their blocks' shards by broadcast, so texts aren't shuffled."""
    spark = docs.sparkSession
    own = ("doc_id", "text", "source")
    rows = pick(docs, *own, *[k for k in keep if k not in own]).withColumn("source", F.col("source").cast("string")).withColumn("size", words(F.col("text")))
    slim = cut(rows.select("doc_id", "source", "size"))
    d = slim
    total = sorted(d.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    t = targets([float(r.s) for r in total], [weights[i % len(weights)] for i in range(len(total))], share)
    per = [
        {"sid": i, "source": r.source, "source_size": r.s, "target": x, "blocks": max(1, min(MAX_BLOCKS, -(-r.n // BLOCK_DOCS))),
         "passes": min(int(x // r.s), MAX_EPOCHS) if r.s else 0}
        for i, (r, x) in enumerate(zip(total, t, strict=True))
    ]
    for p in per:
        p["rest"] = p["target"] - p["passes"] * p["source_size"]
    few = len(per) * MAX_BLOCKS <= BROADCAST_ROWS
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    src = _local(spark, per, "sid long, source string, source_size long, target double, blocks long, passes int, rest double")
    src = small(src.withColumnRenamed("source", "_s"))
    blocked = lambda x: x.join(src, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "blocks"))
    d = blocked(slim)

    # The permuted blocks of each source, and how far each lies within the last, partial pass.
    b = d.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), F.lit("draw"), "sid", "block"), "block")
    b = cut(b.withColumn("end", F.sum("words").over(order)).withColumn("start", F.col("end") - F.col("words")))
    drawn = b.select("sid", "block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("copy"), "passes", "rest", "start", "end").where("copy < passes OR start < rest")
    drawn = drawn.withColumn("edge", F.expr("copy = passes AND end > rest"))

    # Exact quotas in blocks, dealt to shards by the tree.
    got = {r.sid: r.n for r in drawn.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    quotas = [got.get(p["sid"], 0) for p in per]
    shards = int(max(1, min(MAX_SHARDS, sum(quotas) or 1, -(-sum(t) // SHARD_WORDS))))
    deal, at = [], [0] * len(per)
    for k, row in enumerate(split_quotas(quotas, shards, seed)):
        for s, n in enumerate(row):
            if n:
                deal.append({"sid": s, "shard": k, "lo": at[s], "hi": at[s] + n - 1})
                at[s] += n
    deal = _local(spark, deal, "sid long, shard int, lo long, hi long").select("sid", "shard", F.explode(F.sequence("lo", "hi")).alias("rank"))
    rank = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), F.lit("deal"), "sid", "copy", "block"), "copy", "block")
    placed = drawn.withColumn("rank", (F.row_number().over(rank) - 1).cast("long")).join(deal, ["sid", "rank"])
    placed = placed.groupBy("sid", "block").agg(
        F.sort_array(F.collect_list(F.when(~F.col("edge"), F.struct("copy", "shard")))).alias("whole"),
        F.max(F.when(F.col("edge"), F.col("shard"))).alias("edge_shard"), F.max(F.when(F.col("edge"), F.col("rest") - F.col("start"))).alias("edge_words"),
    )
    if keep:
        d = blocked(rows)
    d = d.join(small(placed), ["sid", "block"], "left")
    # Documents of a block at the edge, one block a source at most: as many as come nearest to the rest.
    by = Window.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("edge"), "doc_id"), "doc_id", "size")
    keep = ["doc_id", "source", "size", "source_size", "target", *[k for k in keep if k not in ("doc_id", "source")]]
    whole = F.transform(F.coalesce("whole", F.expr("array()")), lambda x: x["shard"])
    rest = d.where("edge_shard IS NULL").select(*keep, whole.alias("shards"))
    edge = d.where("edge_shard IS NOT NULL").withColumn("upto", F.sum("size").over(by))
    taken = F.col("upto") - F.col("size") / 2 <= F.col("edge_words")
    edge = edge.select(*keep, F.when(taken, F.concat(whole, F.array("edge_shard"))).otherwise(whole).alias("shards"))
    return rest.unionByName(edge)


def mixed(docs: DataFrame, seed: int = 42, keep: tuple[str, ...] = (), **more) -> DataFrame:
    """The mix itself: ``doc_id, mix_size, mix_copy, mix_shard, mix_order`` and the columns ``keep``; a document occurs
    once for each time it is taken, and ``mix_order`` its place in the shard after the local shuffle."""
    a = allocate(docs, seed=seed, keep=keep, **more).withColumnRenamed("size", "mix_size")
    a = a.select("doc_id", *[k for k in keep if k != "doc_id"], "mix_size", F.posexplode("shards").alias("mix_copy", "mix_shard"))
    return a.withColumn("mix_order", F.xxhash64(F.lit(seed), "mix_shard", "mix_copy", "doc_id"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = allocate(table(spark, sf_dir, "documents"))
    return a.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


SQL: dict[str, str] = {}
