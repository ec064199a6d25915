"""Witness attestations of chain heads and the quorum verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.functions.hashing import hmac_sha256, record_digest
from recordloom.sources.logs import heads

MAX_WITNESSES = 1000


def _witness_map(witnesses: list[tuple[str, str]]):
    if not 0 < len(witnesses) <= MAX_WITNESSES:
        raise ValueError("a quorum has between 1 and 1000 witnesses")
    return F.create_map(*[F.lit(x) for pair in witnesses for x in pair])


def attest_heads(log: DataFrame, witnesses: list[tuple[str, str]]) -> DataFrame:
    """Each witness (id, key hex) signs 'height:hash' of every chain's head."""
    signed = heads(log).select("chain_id", F.col("idx").alias("height"), "record_hash",
                               F.explode(_witness_map(witnesses)).alias("witness", "_key"))
    message = F.concat(F.col("height").cast("string"), F.lit(":"), F.col("record_hash"))
    return signed.select("chain_id", "height", "record_hash", "witness",
                         hmac_sha256(F.col("_key"), message).alias("mac"),
                         F.lit(0).cast("long").alias("seq"))


def quorum_report(log: DataFrame, attestations: DataFrame, witnesses: list[tuple[str, str]],
                  quorum: int = 2) -> DataFrame:
    """Valid and faulty attestations per attested height; only a witness's first one counts."""
    first = (attestations.groupBy("chain_id", "height", "witness")
             .agg(F.min_by(F.struct("record_hash", "mac"), "seq").alias("a"))
             .select("chain_id", "height", "witness", "a.*"))
    heights = first.select("chain_id", F.col("height").alias("idx")).distinct()
    actual = (log.join(heights, ["chain_id", "idx"], "left_semi")
              .select("chain_id", F.col("idx").alias("height"), record_digest().alias("actual")))
    message = F.concat(F.col("height").cast("string"), F.lit(":"), F.col("record_hash"))
    key = F.try_element_at(_witness_map(witnesses), F.col("witness"))
    signed = F.coalesce(hmac_sha256(key, message) == F.col("mac"), F.lit(False))
    agrees = F.coalesce(F.col("record_hash") == F.col("actual"), F.lit(False))
    fault = F.when(~signed, F.concat("witness", F.lit("(bad-sig)"))).when(~agrees, F.concat("witness", F.lit("(equivocates)")))
    return (first.join(actual, ["chain_id", "height"], "left").withColumn("_fault", fault)
            .groupBy("chain_id", "height").agg(
                F.count_if(F.col("_fault").isNull()).alias("valid"),
                F.array_join(F.sort_array(F.collect_list("_fault")), ", ").alias("faulty"))
            .withColumn("status", F.when(F.col("valid") >= quorum, "OK").otherwise("FAIL")))
