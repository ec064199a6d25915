"""Checks on what records mean: pointers, ranges and evidence that must resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.session import stored

POINTERS = """_meta struct<supersedes: bigint>, revises_index bigint, recurs_proposal_index bigint,
 marks_proposal_index bigint, covers_indices array<bigint>, evidence array<string>,
 evidence_indices array<string>"""


def supersedes(content: Column) -> Column:
    """The record a revision replaces: _meta.supersedes, else revises_index; integers only."""
    c = F.from_json(content, "_meta struct<supersedes: bigint>, revises_index bigint")
    return F.coalesce(c["_meta"]["supersedes"], c["revises_index"])


def semantic_violations(log: DataFrame) -> DataFrame:
    """One row per broken pointer, range or evidence list.

    The log is read once, into a narrow table of what its records point at; a record's message then comes from one
    expression. Only pointers meet the types of their targets.
    """
    kinds = ["revision", "proposal_recurrence", "proposal_status", "reflection", "proposal"]
    parsed = log.select("chain_id", "idx", "rec_type", F.when(F.col("rec_type").isin(kinds), F.from_json("content_json", POINTERS)).alias("c"))
    kind, target, length = (F.col(c) for c in ("rec_type", "target", "length"))
    covers = F.col("c.covers_indices")
    evidence = F.concat(F.coalesce("c.evidence", F.array().cast("array<string>")), F.coalesce("c.evidence_indices", F.array().cast("array<string>")))
    facts = stored(parsed.select(
        "chain_id", "idx", "rec_type", F.when(kind == "proposal", evidence).alias("evidence"),
        F.when((kind == "reflection") & (F.size(covers) == 2), covers).alias("covers"),
        F.when(kind == "revision", F.coalesce("c._meta.supersedes", "c.revises_index")).when(kind == "proposal_recurrence", F.col("c.recurs_proposal_index"))
        .when(kind == "proposal_status", F.col("c.marks_proposal_index")).alias("target")))
    lengths = facts.groupBy("chain_id").agg(F.count("*").alias("length"))
    rows = facts.where(kind.isin(kinds)).join(lengths, "chain_id")
    missing = (target < 0) | (target >= length)
    pointer = kind.isin("proposal_recurrence", "proposal_status")

    types = facts.select("chain_id", F.col("idx").alias("target"), F.coalesce("rec_type", F.lit("missing")).alias("target_type"))
    pointed = rows.where(pointer).join(types, ["chain_id", "target"], "left").select(
        "chain_id", "idx", kind.alias("check"), "target",
        F.when(target.isNull(), "no integer target").when(missing, "target past the chain")
        .when(F.coalesce(F.col("target_type"), F.lit("missing")) != "proposal",
              F.concat(F.lit("target is "), F.coalesce(F.col("target_type"), F.lit("missing")), F.lit(" (expected 'proposal')"))).alias("message"))

    lo, hi = F.get("covers", F.lit(0)), F.get("covers", F.lit(1))
    bad = F.filter("evidence", lambda e: F.coalesce((e.try_cast("bigint") < 0) | (e.try_cast("bigint") >= length), F.lit(True)))
    message = (F.when(kind == "revision", F.when(target.isNull(), "no supersedes pointer").when(missing, "target past the chain"))
               .when(kind == "reflection", F.when((lo < 0) | (hi >= length) | (lo > hi), F.concat(
                   F.lit("range ["), lo.cast("string"), F.lit(", "), hi.cast("string"), F.lit("] is outside the chain"))))
               .when(F.size("_bad") > 0, F.concat(F.lit("evidence outside the chain: "), F.array_join(F.slice("_bad", 1, 10), ", "))))
    own = rows.where(~pointer).withColumn("_bad", bad).select(
        "chain_id", "idx", kind.alias("check"),
        F.when(kind == "revision", target).when(kind == "reflection", lo).otherwise(F.get("_bad", F.lit(0)).try_cast("bigint")).alias("target"), message.alias("message"))
    return pointed.unionByName(own).where("message is not null")
