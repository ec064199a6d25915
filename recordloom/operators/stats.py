"""Counts and status of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EXPOSURE = "$._meta.exposure"


def log_stats(log: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    quarantined = F.coalesce(F.get_json_object("content_json", EXPOSURE) == "quarantine", F.lit(False))
    out = log.groupBy("chain_id").agg(
        F.count("*").alias("length"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
        F.count_if(quarantined).alias("quarantined"))
    if batches is None:
        return out.withColumn("sealed", F.lit(0).cast("long")).withColumn("anchored", F.lit(0).cast("long"))
    sealed = batches.groupBy("chain_id").agg(
        F.count("*").alias("sealed"), F.count_if(F.col("anchor_status") == "anchored").alias("anchored"))
    return out.join(sealed, "chain_id", "left").fillna(0, ["sealed", "anchored"])


def type_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("chain_id", "rec_type").agg(F.count("*").alias("n"))


def type_rollup(log: DataFrame) -> DataFrame:
    """Counts by (chain, type), by chain and in total, in one pass."""
    return log.rollup("chain_id", "rec_type").agg(F.count("*").alias("n"))


def count_since(log: DataFrame, marks: DataFrame, rec_type: str | None = None) -> DataFrame:
    """Records strictly after each chain's mark (chain_id, after_idx)."""
    hit = F.col("idx") > F.col("after_idx")
    if rec_type is not None:
        hit = hit & (F.col("rec_type") == rec_type)
    return (log.select("chain_id", "idx", "rec_type").join(marks.select("chain_id", "after_idx"), "chain_id")
            .groupBy("chain_id").agg(F.count_if(hit).alias("n")))


def turns_since_type(log: DataFrame, mark_type: str = "reflection", turn_type: str = "response") -> DataFrame:
    """Turns after the last `mark_type` record of each chain (all turns if there is none)."""
    marks = log.groupBy("chain_id").agg(
        F.coalesce(F.max(F.when(F.col("rec_type") == mark_type, F.col("idx"))), F.lit(-1)).alias("after_idx"))
    return count_since(log, marks, turn_type)


def turns_since_watermark(log: DataFrame, watermarks: DataFrame, turn_type: str = "response") -> DataFrame:
    """Turns at or after a stored length; one beyond the current length counts from the start."""
    marks = (log.groupBy("chain_id").agg(F.count("*").alias("_length")).join(watermarks, "chain_id", "left")
             .select("chain_id", F.when(F.coalesce("watermark", F.lit(0)) > F.col("_length"), F.lit(-1))
                     .otherwise(F.coalesce("watermark", F.lit(0)) - 1).alias("after_idx")))
    return count_since(log, marks, turn_type)
