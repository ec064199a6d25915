"""Tamper evidence: link, gap and digest checks, and the first failure of each chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.fixed_values import GENESIS_PRIOR_HASH
from recordloom.functions.hashing import canonical_json, record_digest
from recordloom.operators.blocks import SPAN, with_preceding


def with_previous(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds prev_idx and prev_hash: the record before, if the one at idx - 1 or nearer exists."""
    return with_preceding(log, ["chain_id"], "idx", 1, {
        "prev_idx": lambda w: F.lag("idx").over(w),
        "prev_hash": lambda w: F.lag("record_hash").over(w)}, span)


def _gap() -> Column:
    return (F.col("idx") != F.coalesce(F.col("prev_idx") + 1, F.lit(0)))


def _broken_link() -> Column:
    return F.col("prior_hash") != F.coalesce(F.col("prev_hash"), F.lit(GENESIS_PRIOR_HASH))


def link_violations(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Records whose stored prior hash is not the hash of the record before."""
    return (with_previous(log, span).where(_broken_link())
            .select("chain_id", "idx", "prior_hash",
                    F.coalesce("prev_hash", F.lit(GENESIS_PRIOR_HASH)).alias("expected_hash")))


def gap_violations(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Records that do not directly follow an existing record (or open a chain at 0)."""
    return with_previous(log, span).where(_gap()).select("chain_id", "idx")


def digest_violations(log: DataFrame, writer: str | None = None) -> DataFrame:
    """Row-parallel recompute of content and record hashes, and the writer check."""
    return (log.select("chain_id", "idx",
                       _content_bad().alias("content_bad"), _record_bad().alias("record_bad"),
                       (F.lit(False) if writer is None else F.col("writer") != writer).alias("writer_bad"))
            .where("content_bad or record_bad or writer_bad"))


def _content_bad() -> Column:
    return F.sha2(canonical_json(F.col("content_json")), 256) != F.col("content_hash")


def _record_bad() -> Column:
    # a stored digest of changed content is caught by the content check before this one
    return record_digest() != F.col("record_hash")


def work_shortfall() -> Column:
    """True when a record that asked for d leading zeros lacks them."""
    wanted = F.get_json_object("content_json", "$._pow.difficulty").try_cast("int")
    return F.coalesce((wanted > 0) & (F.substring("record_hash", F.lit(1), wanted)
                                      != F.repeat(F.lit("0"), wanted)), F.lit(False))


def own_failure(writer: str | None = None) -> Column:
    """The first reason for which a record fails by itself, whatever stands before it; null if none."""
    foreign = F.lit(False) if writer is None else F.col("writer") != writer
    return (F.when(foreign, "unexpected pubkey").when(_content_bad(), "content_hash mismatch")
            .when(_record_bad(), "record_hash mismatch").when(work_shortfall(), "proof-of-work below target"))


def _judged(log: DataFrame, writer: str | None, span: int) -> DataFrame:
    """chain_id, idx, reason (null: none) of every record."""
    # digests are taken before the shuffle of the look-back, which then moves no content
    narrow = log.select("chain_id", "idx", "prior_hash", "record_hash", own_failure(writer).alias("_own"))
    reason = F.when(_gap(), "index gap").when(_broken_link(), "prior_hash mismatch").otherwise(F.col("_own"))
    return with_previous(narrow, span).select("chain_id", "idx", reason.alias("reason"))


def failures(log: DataFrame, writer: str | None = None, span: int = SPAN) -> DataFrame:
    """Every failing record with the first reason that applies to it."""
    return _judged(log, writer, span).where("reason is not null")


def verify_log(log: DataFrame, writer: str | None = None, span: int = SPAN) -> DataFrame:
    """One row per chain: record count, verdict, first bad index and its reason. One aggregate over the judged records."""
    bad = F.col("reason").isNotNull()
    per = _judged(log, writer, span).groupBy("chain_id").agg(
        F.count("*").alias("n"), F.min(F.when(bad, F.struct("idx", "reason"))).alias("f"))
    per = per.select("chain_id", "n", F.col("f.idx").alias("first_bad"), F.col("f.reason").alias("reason"))
    message = F.when(F.col("first_bad").isNull(), F.format_string("chain ok (%d records)", "n")).otherwise(
        F.concat("reason", F.lit(" at index "), F.col("first_bad").cast("string")))
    return per.select("chain_id", "n", F.col("first_bad").isNull().alias("ok"), "first_bad", "reason", message.alias("message"))
