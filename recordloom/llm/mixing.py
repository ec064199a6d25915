"""Mixing sources to target weights with a splitting tree of exact block quotas.

1. Targets: the sources, in code point order with null last, weigh 5, 2, 1 and again; they share
   the words of all. A target stops at `cap` times its source, the excess is shared again by
   weight until no source is above.
2. Blocks: a hash deals each source's documents to a fixed number of blocks, and another one
   permutes the blocks. A source gives whole epochs of its blocks, then blocks in permuted order
   up to its target; of the block at the end it gives documents, in hashed order, up to the target.
3. Shards: the root of the tree holds each source's quota of block draws. Each node deals its
   quotas to its two halves by a multivariate hypergeometric draw, so every shard gets its exact
   number of draws and the sums over shards are the quotas. Shards take disjoint runs of a
   second permutation of each source's draws.
4. Inside its shard a row carries a hashed sort key: shuffling is local.

What grows with the documents stays in narrow tables; only per-source and per-block totals, whose
number is (sources x blocks), reach the driver or a broadcast, and their number is checked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.llm.common import prepare, words
from recordloom.session import stored

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCKS = 1024
SHARDS = 16
MOST_SOURCES = 100_000
MOST_BROADCAST_ROWS = 250_000


def targets_of(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Share sum(sizes) by weight, none above cap x its size: sources that would be above are
    held at their cap and the rest is shared again."""
    total, held = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        free = [i for i, h in enumerate(held) if not h]
        left = total - sum(cap * sizes[i] for i, h in enumerate(held) if h)
        weight = sum(weights[i] for i in free)
        out = [cap * float(sizes[i]) if held[i] else left * weights[i] / weight for i in range(len(sizes))]
        over = [i for i in free if out[i] > cap * sizes[i]]
        if not over:
            return out
        for i in over:
            held[i] = True


def split_quotas(quotas: Sequence[int], shards: int, seed: str) -> np.ndarray:
    """(shards, sources): the tree. Each node halves its shards and draws the left half's share."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(held: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = held
            return
        middle = (first + last) // 2
        take = int(held.sum()) * (middle - first) // (last - first)
        digest = hashlib.sha256(f"{seed}:{first}:{last}".encode()).digest()
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "little")))
        left = rng.multivariate_hypergeometric(held, take, method="marginals") if held.sum() else held
        node(left, first, middle)
        node(held - left, middle, last)

    node(np.array(quotas, np.int64), 0, shards)
    return out


def _key(source: Column) -> Column:
    """A source as a text that orders like its code points, null last and apart from all texts."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _place(row: str, blocks: int, seed: str) -> list[Column]:
    """Source key, block and order inside the block of a row."""
    doc_id, source = F.col(f"{row}.doc_id").cast("long"), F.col(f"{row}.source").cast("string")
    return [_key(source).alias("_key"), F.pmod(F.xxhash64(doc_id, F.lit(f"{seed}/block")), F.lit(blocks)).cast("int").alias("_block"),
            F.xxhash64(doc_id, F.lit(f"{seed}/order")).alias("_order")]


def _deal(sized: DataFrame, weights: Sequence[float], cap: int, blocks: int, shards: int, seed: str) -> DataFrame:
    """One row per source and block: what the mix draws from it."""
    spark = sized.sparkSession
    totals = stored(sized.groupBy("_key", "_block").agg(F.sum("size").alias("words")))
    per_source = totals.groupBy("_key").agg(F.sum("words").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    per_source = sorted((r["_key"], int(r["size"])) for r in per_source)
    sizes = [n for _, n in per_source]
    goal = targets_of(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap) if sizes else []
    whole = [min(cap, int(math.floor(t / n + 1e-12))) if n else 0 for t, n in zip(goal, sizes)]
    rest = [max(0.0, t - e * n) if e < cap else 0.0 for t, n, e in zip(goal, sizes, whole)]
    facts = spark.createDataFrame([(k, n, t, e, r) for (k, n), t, e, r in zip(per_source, goal, whole, rest)],
                                  "_key string, source_size long, target double, epochs int, rest double")

    # blocks in permuted order: whole while they fit, then the one at the end
    permuted = W.partitionBy("_key").orderBy(F.xxhash64("_key", "_block", F.lit(f"{seed}/permute")), "_block")
    laid = (totals.join(F.broadcast(facts.hint("broadcast")), "_key")
            .withColumn("_past", F.sum("words").over(permuted))
            .withColumn("_fits", F.col("_past") <= F.col("rest"))
            .withColumn("_ends", ~F.col("_fits") & (F.col("_past") - F.col("words") < F.col("rest"))))
    # within the block at the end: the last document, in hashed order, whose middle is inside the target
    inside = W.partitionBy("_key", "_block").orderBy("_order").rangeBetween(W.unboundedPreceding, 0)
    cut = (sized.join(F.broadcast(laid.where("_ends").select("_key", "_block", (F.col("rest") - F.col("_past") + F.col("words")).alias("_room"))),
                      ["_key", "_block"])
           .withColumn("_upto", F.sum("size").over(inside))
           .where(F.col("_upto") - F.col("size") / 2 <= F.col("_room"))
           .groupBy("_key", "_block").agg(F.max("_order").alias("_last")))
    # draws of blocks: the copies of whole epochs, one more for blocks that fit or end
    draws = stored(laid.join(cut, ["_key", "_block"], "left")
                   .select("_key", "_block", "source_size", "target", "_last",
                           F.explode_outer(F.expr("case when epochs + int(_fits or _ends) > 0 then sequence(0, epochs + int(_fits or _ends) - 1) end")).alias("copy"),
                           (F.col("_ends")).alias("_ends"), "epochs"))
    counted = {r["_key"]: r["n"] for r in draws.where("copy is not null").groupBy("_key").agg(F.count("*").alias("n")).collect()}
    quotas = [counted.get(k, 0) for k, _ in per_source]
    bounds = np.cumsum(split_quotas(quotas, shards, seed), axis=0) if quotas else np.zeros((shards, 0), np.int64)
    ends = spark.createDataFrame([(k, [int(x) for x in bounds[:, i]]) for i, (k, _) in enumerate(per_source)],
                                 "_key string, _ends_at array<long>")
    second = W.partitionBy("_key").orderBy(F.col("copy").isNull(), F.xxhash64("_key", "_block", "copy", F.lit(f"{seed}/deal")), "_block", "copy")
    dealt = (draws.withColumn("_rank", F.row_number().over(second) - 1)
             .join(F.broadcast(ends), "_key")
             .withColumn("shard", F.expr("cast(size(filter(_ends_at, e -> e <= _rank)) as int)"))
             .groupBy("_key", "_block").agg(
                 F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_last").alias("_last"),
                 F.first("_ends").alias("_ends"), F.first("epochs").alias("epochs"),
                 F.array_sort(F.collect_list(F.when(F.col("copy").isNotNull(), F.struct("copy", "shard")))).alias("_all")))
    if len(per_source) * blocks <= MOST_BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    return dealt


def _draws() -> Column:
    """A row's own draws: in the block at a source's end only rows up to the last one get the extra copy."""
    return F.filter("_all", lambda d: ~F.col("_ends") | (d["copy"] < F.col("epochs"))
                    | F.coalesce(F.col("_order") <= F.col("_last"), F.lit(False)))


def _sized(docs: DataFrame, blocks: int, seed: str) -> DataFrame:
    size = F.size(words(F.col("row.text").cast("string"))).cast("long").alias("size")
    return docs.select(F.struct("doc_id", "source", "text").alias("row")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size, *_place("row", blocks, seed))


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, blocks: int = BLOCKS,
             shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, draws.

    `draws` lists the copies the mix takes, as structs of copy (from 0) and shard; it is empty for a
    document left out. Null text has size 0; a null source is a source of its own. Choices depend on
    doc_id alone, so reruns agree and repeated rows fare alike. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    sized = stored(_sized(docs, blocks, seed))
    return (sized.join(_deal(sized, weights, cap, blocks, shards, seed), ["_key", "_block"])
            .select("doc_id", "source", "size", "source_size", "target", _draws().alias("draws")))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, blocks: int = BLOCKS,
                  shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """The mix as documents: every row as often as it is drawn, with all its columns, dealt to the shards
    and shuffled inside each.

    A row finds its draws by its hash; then its copies go to their shards, a shard in sixteen parts so that
    none is gathered, and each part is sorted by a key of document and copy, which is its local shuffle. Null texts have
    size 0 and are drawn as the plan says, repeated rows fare alike, an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    dealt = _deal(stored(_sized(docs, blocks, seed)), weights, cap, blocks, shards, seed)
    placed = docs.select(F.struct(*docs.columns).alias("row")).select("row", *_place("row", blocks, seed))
    drawn = placed.join(dealt, ["_key", "_block"]).select("row", F.explode(_draws()).alias("_d"))
    return _shuffled(drawn.select("row", F.col("_d.shard").alias("shard"), sort_key("row.doc_id", "_d.copy", seed).alias("sort_key"))).select("row.*")


def sort_key(doc_id: str, copy: str, seed: str) -> Column:
    return F.xxhash64(doc_id, copy, F.lit(f"{seed}/local"))


def _shuffled(rows: DataFrame, parts: int = 16) -> DataFrame:
    return rows.repartition("shard", F.pmod("sort_key", F.lit(parts))).sortWithinPartitions("shard", "sort_key")


def mixed(plan: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: one row per copy taken, with its shard and its sort key inside the shard."""
    return (plan.select("doc_id", "source", "size", F.explode("draws").alias("_d"))
            .select("doc_id", "source", "size", F.col("_d.copy").alias("copy"), F.col("_d.shard").alias("shard"),
                    sort_key("doc_id", "_d.copy", seed).alias("sort_key")))


def write_mix(rows: DataFrame, path: str) -> None:
    """Files by shard, each shuffled inside by its sort key. Hot shards are not gathered: every
    task sorts and writes its own part of each shard."""
    _shuffled(rows).write.partitionBy("shard").parquet(path)
