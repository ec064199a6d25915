"""Fitting ordered rows into a size budget."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.operators.blocks import SPAN, running_sum


def fit_prefix(df: DataFrame, group: Sequence[str], order: str, size: str, budget: int) -> DataFrame:
    """Longest prefix of each group within the budget; `order` is dense from 0.

    The first row always stays whole. The first later row that would overflow is cut
    to what is left (`room`), and nothing follows it. Adds kept, truncated and room.
    """
    run = running_sum(df, group, F.expr(f"`{order}` div {SPAN}"), [order], {"_sum": F.col(size)})
    before = F.col("_sum") - F.col(size)
    first = F.col(order) == 0
    fits = first | (F.col("_sum") <= budget)
    # sizes are positive, so the sums rise and only one row can start below the budget and end above it
    edge = ~fits & (before < budget)
    return run.where(fits | edge).select(
        *df.columns, fits.alias("kept"), edge.alias("truncated"),
        F.when(edge, F.lit(budget) - before).alias("room"))


def fit_greedy(df: DataFrame, group: Sequence[str], key: Sequence[str], order: Sequence[Column], size: str,
               budget: int, first_always: bool = True) -> DataFrame:
    """Walk each group in order, keep what still fits, skip what does not, go on. Adds `kept`.

    Of rows of one size s only the first budget // s can ever be kept, because a skipped
    size never fits again. Dropping the rest beforehand is exact and leaves the ordered
    walk about budget x ln(budget) rows however large a group is.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*group, *key, F.col(size).alias("_size"), *[o.alias(n) for o, n in zip(order, names)])
    by_size = F.row_number().over(W.partitionBy(*group, "_size").orderBy(*names))
    live = (rows.where(F.col("_size") <= budget).withColumn("_nth", by_size)
            .where((F.col("_nth") <= budget) & (F.col("_nth") * F.col("_size") <= budget)).drop("_nth"))
    top = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*group).orderBy(*names))).where("_nth = 1").drop("_nth")
    if first_always:
        live = live.unionByName(top).distinct()
    ids = [*group, *key]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ids)
    g = len(group)

    def walk(batches):
        now, used, fresh = None, 0, True
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(g)]
            sizes = b.column(b.schema.get_field_index("_size")).to_pylist()
            picked = []
            for i, who in enumerate(zip(*cols)):
                if who != now:
                    now, used, fresh = who, 0, True
                if used + sizes[i] <= budget or (fresh and first_always):
                    used += sizes[i]
                    picked.append(i)
                fresh = False
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(ids))], names=ids).take(pa.array(picked, pa.int32()))

    kept = (live.select(*ids, "_size", *names).repartition(*group).sortWithinPartitions(*group, *names)
            .mapInArrow(walk, schema).withColumn("kept", F.lit(True)))
    return df.join(kept, ids, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
