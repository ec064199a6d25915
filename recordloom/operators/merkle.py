"""Merkle roots, batch sealing, inclusion proofs and their verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.fixed_values import MERKLE_BATCH

FAN = 1024
FAN_LEVELS = 10


def _digest(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(left, right), 256))


def _parents(layer: Column) -> Column:
    """Next layer up; an odd layer pairs its last node with itself."""
    return F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size(layer) - 1, 1)),
        lambda i: _digest(F.get(layer, i * 2), F.coalesce(F.get(layer, i * 2 + 1), F.get(layer, i * 2))))


def _climb(leaves: Column, levels: int, always: Column) -> Column:
    """Fold up `levels` layers; a lone node is lifted too where `always` holds."""
    return F.reduce(F.sequence(F.lit(1), F.lit(levels)), leaves,
                    lambda layer, _: F.when(always | (F.size(layer) > 1), _parents(layer)).otherwise(layer))


def _ordered(pos: str, node: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(node)))), lambda s: s[node])


def merkle_roots(df: DataFrame, keys: Sequence[str], pos: str, hash_hex: str, rounds: int = 4) -> DataFrame:
    """Root per key over any number of leaves at dense positions 0..n-1.

    Each round folds runs of 1,024 neighbours into one node, so a task only ever
    holds one run; four rounds cover 10^12 leaves of a single key. A short last
    run under a larger tree is lifted to full height, which repeats its last node
    exactly as pairing layer by layer would.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    nodes = df.join(sizes, list(keys)).select(
        *keys, F.col("_n").alias("leaves"), "_n", F.col(pos).alias("_p"), F.unhex(F.col(hash_hex)).alias("_h"))
    for _ in range(rounds):
        runs = (nodes.groupBy(*keys, "leaves", "_n", F.expr(f"_p div {FAN}").alias("_q"))
                .agg(_ordered("_p", "_h").alias("_layer")))
        # the node is made before _n is renewed: a new _n beside it would be read inside the fold
        nodes = runs.withColumn("_h", F.get(_climb(F.col("_layer"), FAN_LEVELS, F.col("_n") > FAN), F.lit(0))).select(
            *keys, "leaves", F.expr(f"(_n + {FAN - 1}) div {FAN}").alias("_n"), F.col("_q").alias("_p"), "_h")
    return nodes.select(*keys, "leaves", F.lower(F.hex("_h")).alias("root"))


def _runs(log: DataFrame, sealed: DataFrame | None, size: int) -> DataFrame:
    """Unsealed records tagged with their run; a run has at most `size` records."""
    if sealed is None:
        return log.withColumn("_base", F.lit(0)).withColumn("run", F.expr(f"idx div {size}"))
    done = sealed.groupBy("chain_id").agg((F.max("last_idx") + 1).alias("_base"))
    return (log.join(done, "chain_id", "left").withColumn("_base", F.coalesce("_base", F.lit(0)))
            .where("idx >= _base").withColumn("run", F.expr(f"(idx - _base) div {size}")))


def seal_batches(log: DataFrame, sealed: DataFrame | None = None, size: int = MERKLE_BATCH,
                 full_only: bool = False) -> DataFrame:
    """Seal every unsealed run of up to `size` records of every chain."""
    levels = max(1, (size - 1).bit_length())
    runs = (_runs(log.select("chain_id", "idx", "record_hash"), sealed, size)
            .withColumn("_h", F.unhex("record_hash"))
            .groupBy("chain_id", "run").agg(
                F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
                F.count("*").alias("leaves"), _ordered("idx", "_h").alias("_layer")))
    if full_only:
        runs = runs.where(F.col("leaves") == size)
    root = F.get(_climb(F.col("_layer"), levels, F.lit(False)), F.lit(0))
    return runs.select("chain_id", "first_idx", "last_idx", "leaves", F.lower(F.hex(root)).alias("root_hash"),
                       F.lit("pending").alias("anchor_status"))


def attach_anchors(batches: DataFrame, anchors: DataFrame) -> DataFrame:
    """Mark batches that have an external receipt (chain_id, first_idx, anchor_proof)."""
    return (batches.join(anchors, ["chain_id", "first_idx"], "left")
            .withColumn("anchor_status", F.when(F.col("anchor_proof").isNotNull(), "anchored")
                        .otherwise(F.col("anchor_status"))))


def batch_of(log: DataFrame, batches: DataFrame, size: int = MERKLE_BATCH) -> DataFrame:
    """The batch that contains each record.

    Interval containment as an equi-join: a batch spans at most two aligned buckets
    of `size`, so it is listed under both and the bounds are checked after.
    """
    spread = batches.withColumn("_bucket", F.explode(F.array_distinct(F.array(
        F.expr(f"first_idx div {size}"), F.expr(f"last_idx div {size}")))))
    return (log.withColumn("_bucket", F.expr(f"idx div {size}"))
            .join(spread, ["chain_id", "_bucket"])
            .where("idx between first_idx and last_idx").drop("_bucket"))


def inclusion_proofs(log: DataFrame, batches: DataFrame, targets: DataFrame | None = None,
                     size: int = MERKLE_BATCH) -> DataFrame:
    """Sibling path of each target record in its batch: array of (side, sibling hex)."""
    levels = max(1, (size - 1).bit_length())
    members = batch_of(log.select("chain_id", "idx", "record_hash"), batches, size)
    layers = (members.withColumn("_h", F.unhex("record_hash"))
              .groupBy("chain_id", "first_idx", "root_hash").agg(_ordered("idx", "_h").alias("_leaves"))
              .select("chain_id", "first_idx", "root_hash", F.reduce(
                  F.sequence(F.lit(1), F.lit(levels)), F.array("_leaves"),
                  lambda acc, _: F.when(
                      F.size(F.get(acc, F.size(acc) - 1)) > 1,
                      F.concat(acc, F.array(_parents(F.get(acc, F.size(acc) - 1))))).otherwise(acc)).alias("_layers")))
    wanted = members if targets is None else members.join(targets.select("chain_id", "idx"), ["chain_id", "idx"], "left_semi")

    def step(layer, level):
        at = F.floor((F.col("idx") - F.col("first_idx")) / F.pow(F.lit(2.0), level)).cast("int")
        odd = F.pmod(at, F.lit(2)) == 1
        sibling = F.when(odd, F.get(layer, at - 1)).otherwise(F.coalesce(F.get(layer, at + 1), F.get(layer, at)))
        return F.when(F.size(layer) > 1, F.struct(
            F.when(odd, "L").otherwise("R").alias("side"), F.lower(F.hex(sibling)).alias("sibling")))

    return (wanted.join(layers, ["chain_id", "first_idx", "root_hash"])
            .select("chain_id", "idx", "record_hash", "root_hash",
                    F.filter(F.transform("_layers", step), lambda s: s.isNotNull()).alias("proof")))


def proof_root(leaf_hex: Column, proof: Column) -> Column:
    """The root that a proof leads to, as hex."""
    return F.lower(F.hex(F.reduce(proof, F.unhex(leaf_hex), lambda h, s: F.when(
        s["side"] == "L", _digest(F.unhex(s["sibling"]), h)).otherwise(_digest(h, F.unhex(s["sibling"]))))))


def verify_proofs(proofs: DataFrame) -> DataFrame:
    return proofs.withColumn("ok", proof_root(F.col("record_hash"), F.col("proof")) == F.col("root_hash"))
