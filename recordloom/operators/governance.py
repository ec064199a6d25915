"""Corrections, proposals, recurrences and statuses as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.functions.text import topic_signature
from recordloom.operators.semantic import supersedes

ESCALATE_AT = 3


def supersedes_links(log: DataFrame) -> DataFrame:
    """(chain_id, revision_idx, superseded_idx), the derived side table of revisions."""
    return (log.where("rec_type = 'revision'")
            .select("chain_id", F.col("idx").alias("revision_idx"), supersedes(F.col("content_json")).alias("superseded_idx"))
            .where("superseded_idx is not null"))


def revisions_of(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Revision records that replace any of the keyed records (chain_id, idx)."""
    wanted = keys.select("chain_id", F.col("idx").alias("superseded_idx")).distinct()
    hits = supersedes_links(log).join(wanted, ["chain_id", "superseded_idx"])
    return log.join(hits.withColumnRenamed("revision_idx", "idx"), ["chain_id", "idx"])


def with_superseded_flag(log: DataFrame) -> DataFrame:
    replaced = (supersedes_links(log).select("chain_id", F.col("superseded_idx").alias("idx")).distinct()
                .withColumn("superseded", F.lit(True)))
    return log.join(replaced, ["chain_id", "idx"], "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def corrections(log: DataFrame) -> DataFrame:
    """Superseded records with their newest correction."""
    newest = supersedes_links(log).groupBy("chain_id", F.col("superseded_idx").alias("idx")).agg(
        F.max("revision_idx").alias("correction_idx"))
    text = log.select("chain_id", F.col("idx").alias("correction_idx"), F.col("content_json").alias("correction"))
    return (log.select("chain_id", "idx", "rec_type", F.col("content_json").alias("original"))
            .join(newest, ["chain_id", "idx"]).join(text, ["chain_id", "correction_idx"]))


def _proposals(log: DataFrame) -> DataFrame:
    c = F.from_json("content_json", "status string, topic_signature string, title string, escalated boolean")
    return log.where("rec_type = 'proposal'").select(
        "chain_id", "idx", F.coalesce(c["status"], F.lit("open")).alias("stored"),
        c["topic_signature"].alias("signature"), c["title"].alias("title"),
        F.coalesce(c["escalated"], F.lit(False)).alias("flagged"))


def effective_status(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Newest status per proposal, or the stored one; `as_of` ignores later records."""
    seen = log if as_of is None else log.where(F.col("idx") <= as_of)
    c = F.from_json("content_json", "marks_proposal_index bigint, new_status string")
    latest = (seen.where("rec_type = 'proposal_status'")
              .select("chain_id", "idx", c["marks_proposal_index"].alias("target"), c["new_status"].alias("new_status"))
              .where("target is not null and new_status is not null")
              .groupBy("chain_id", F.col("target").alias("idx")).agg(F.max_by("new_status", "idx").alias("latest")))
    return (_proposals(seen).join(latest, ["chain_id", "idx"], "left")
            .select("chain_id", "idx", F.coalesce("latest", "stored").alias("status"), "signature", "title", "flagged"))


def recurrence_counts(log: DataFrame) -> DataFrame:
    """1 + number of recurrences for every proposal."""
    c = F.from_json("content_json", "recurs_proposal_index bigint")
    hits = (log.where("rec_type = 'proposal_recurrence'")
            .select("chain_id", c["recurs_proposal_index"].alias("idx"))
            .groupBy("chain_id", "idx").agg(F.count("*").alias("_n")))
    return (log.where("rec_type = 'proposal'").select("chain_id", "idx").join(hits, ["chain_id", "idx"], "left")
            .select("chain_id", "idx", (F.lit(1) + F.coalesce("_n", F.lit(0))).cast("long").alias("sightings")))


def escalated(log: DataFrame, threshold: int = ESCALATE_AT) -> DataFrame:
    return (recurrence_counts(log).join(_proposals(log).select("chain_id", "idx", "flagged"), ["chain_id", "idx"])
            .where((F.col("sightings") >= threshold) | F.col("flagged")).select("chain_id", "idx"))


def proposal_board(log: DataFrame, threshold: int = ESCALATE_AT) -> DataFrame:
    """Every proposal with its count, effective status and escalation; escalated first within a chain."""
    return (effective_status(log).join(recurrence_counts(log), ["chain_id", "idx"])
            .select("chain_id", "idx", "title", "status", "sightings",
                    ((F.col("sightings") >= threshold) | F.col("flagged")).alias("escalated")))


def open_topics(log: DataFrame) -> DataFrame:
    """First proposal that is not declined, per topic signature."""
    sig = F.coalesce(F.when(F.col("signature") != "", F.col("signature")), topic_signature(F.col("title")))
    return (effective_status(log).where("status <> 'declined'").withColumn("signature", sig)
            .where("signature <> ''").groupBy("chain_id", "signature").agg(F.min("idx").alias("idx")))
