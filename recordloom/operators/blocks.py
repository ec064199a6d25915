"""Window work split into blocks, so that no task has to hold one whole hot key.

A chain, source or user may own a third of all rows. A plain window partitioned
by that key would send a third of the table to one task. The helpers here cut a
key into blocks of bounded span, work inside blocks, and carry the few values
that cross a block edge separately. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.session import cut_lineage

SPAN = 4096


def positions(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
              name: str = "idx") -> DataFrame:
    """Zero-based rank of each row within `keys`, ordered by (block, order).

    `block` must not decrease along the order (an hour of the timestamp, say).
    Only one row per (key, block) reaches the window over a whole key.
    """
    rows = df.withColumn("_block", block)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
               .select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    return (rows.join(offsets, [*keys, "_block"])
            .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
            .drop("_block", "_start"))


def running_sum(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
                values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums within `keys`, two-phase as in `positions`."""
    rows = df.withColumn("_block", block)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    starts = totals.select(*keys, "_block", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values])
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(starts, [*keys, "_block"])
    for n, v in values.items():
        out = out.withColumn(n, F.col(f"_s_{n}") + F.sum(v).over(inside))
    return out.drop("_block", *[f"_s_{n}" for n in values])


def with_preceding(df: DataFrame, keys: Sequence[str], idx: str, reach: int,
                   outputs: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Window expressions that look back at most `reach` rows along the index, which may have holes.

    `outputs` maps a new column to an expression without OVER (F.lag, collect_list
    and the like are given as callables of the window). The last rows of a block are copied,
    as silent carriers that are dropped afterwards, into every later block that has fewer than
    `reach` rows between: mostly the next one, and more of them where blocks are nearly empty.
    """
    if reach > span:
        raise ValueError("reach must not exceed the block span")
    rows = df.withColumn("_home", F.expr(f"`{idx}` div {span}"))
    along = W.partitionBy(*keys).orderBy("_home")  # one row per block
    blocks = (rows.groupBy(*keys, "_home").agg(F.count("*").alias("_n"))
              .withColumn("_upto", F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("_next", F.collect_list(F.struct("_home", (F.col("_upto") - F.col("_n")).alias("_before")))
                          .over(along.rowsBetween(1, max(1, reach))))
              .drop("_n"))
    placed = (rows.withColumn("_left", F.row_number().over(W.partitionBy(*keys, "_home").orderBy(F.desc(idx))))
              .join(blocks, [*keys, "_home"]))
    further = F.transform(F.filter("_next", lambda b: b["_before"] - F.col("_upto") + F.col("_left") <= reach), lambda b: b["_home"])
    spread = placed.select(*df.columns, "_home", F.explode(F.concat(F.array("_home"), further)).alias("_block"))
    window = W.partitionBy(*keys, "_block").orderBy(idx)
    for name, make in outputs.items():
        spread = spread.withColumn(name, make(window))
    return spread.where("_home = _block").drop("_home", "_block")


def global_positions(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rank from 1 over the whole frame. Rows are range-partitioned and ranked inside each part.

    The ranged rows are checkpointed first: part numbers must not change between the
    pass that counts parts and the pass that ranks rows, even if an executor is lost.
    """
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(
        "_part", F.spark_partition_id())
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part").orderBy(*order)
    return (parts.join(starts, "_part")
            .withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_part", "_start"))
