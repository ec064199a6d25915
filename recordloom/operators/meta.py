"""Record metadata: resolution with defaults, building, and the predicates that rest on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom import fixed_values as fv

META_TYPE = """_meta struct<schema_version: int, source: string, salience: double, confidence: double,
 supersedes: bigint, epistemic_class: string, exposure: string,
 poq: struct<brightness: double, dimensions: map<string,double>>, truncated: boolean,
 tool_budget_exhausted: boolean, modalities_activated: array<string>, senses_activated: array<string>>,
 revises_index bigint"""


def defaults(df: DataFrame) -> DataFrame:
    """The fixed table of per-type defaults (one row per known type)."""
    return df.sparkSession.createDataFrame(
        fv.META_DEFAULTS, "rec_type string, d_source string, d_epistemic string, d_exposure string, "
                          "d_salience double, d_half_life double")


def resolve_meta(log: DataFrame) -> DataFrame:
    """Adds `meta`, with every missing field filled from the type's defaults; rows of all versions read alike."""
    src, epi, exp, sal, half = fv.FALLBACK_META
    none = F.array().cast("array<string>")
    m = F.col("_c._meta")
    sure = F.col("rec_type").isin(fv.FULL_CONFIDENCE_TYPES)
    legacy = F.when(F.col("rec_type") == "revision", F.col("_c.revises_index"))
    wide = (log.withColumn("_c", F.from_json("content_json", META_TYPE))
            .join(F.broadcast(defaults(log)), "rec_type", "left"))  # 23 fixed rows
    meta = F.struct(
        F.when(m.isNull(), 1).otherwise(F.coalesce(m["schema_version"], F.lit(3))).alias("schema_version"),
        F.coalesce(m["source"], "d_source", F.lit(src)).alias("source"),
        F.coalesce(m["salience"], "d_salience", F.lit(sal)).alias("salience"),
        F.coalesce(m["confidence"], F.when(m.isNotNull() | sure, 1.0).otherwise(0.8)).alias("confidence"),
        F.coalesce(m["supersedes"], legacy).alias("supersedes"),
        F.coalesce(m["epistemic_class"], "d_epistemic", F.lit(epi)).alias("epistemic_class"),
        F.coalesce(m["exposure"], "d_exposure", F.lit(exp)).alias("exposure"),
        m["poq"].alias("poq"),
        F.coalesce(m["truncated"], F.lit(False)).alias("truncated"),
        F.coalesce(m["tool_budget_exhausted"], F.lit(False)).alias("tool_budget_exhausted"),
        F.coalesce(m["modalities_activated"], none).alias("modalities_activated"),
        F.coalesce(m["senses_activated"], none).alias("senses_activated"),
        m.isNull().alias("is_default"),
        F.coalesce("d_half_life", F.lit(half)).alias("half_life_days"))
    return wide.select(*log.columns, meta.alias("meta"))


def clamp6(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)


def build_meta(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata JSON for new records: (accepted with meta_json, rejected with reason).

    Reads rec_type and optional source, salience, confidence, epistemic_class, exposure,
    supersedes, truncated, modalities_activated and senses_activated columns.
    """
    have = set(df.columns)
    get = lambda n, t: F.col(n).cast(t) if n in have else F.lit(None).cast(t)
    src, epi, exp, sal, _ = fv.FALLBACK_META
    wide = df.join(F.broadcast(defaults(df)), "rec_type", "left")
    source = F.coalesce(get("source", "string"), "d_source", F.lit(src))
    epistemic = F.coalesce(get("epistemic_class", "string"), "d_epistemic", F.lit(epi))
    exposure = F.coalesce(get("exposure", "string"), "d_exposure", F.lit(exp))
    reason = (F.when(~source.isin(fv.SOURCES), F.concat(F.lit("unknown source "), source))
              .when(~epistemic.isin(fv.EPISTEMIC_CLASSES), F.concat(F.lit("unknown epistemic_class "), epistemic))
              .when(~exposure.isin(fv.EXPOSURES), F.concat(F.lit("unknown exposure "), exposure)))
    names = lambda n: F.when(F.size(get(n, "array<string>")) > 0, F.sort_array(get(n, "array<string>")))
    meta = F.to_json(F.struct(
        clamp6(F.coalesce(get("confidence", "double"), F.lit(1.0))).alias("confidence"),
        epistemic.alias("epistemic_class"), exposure.alias("exposure"),
        names("modalities_activated").alias("modalities_activated"),
        clamp6(F.coalesce(get("salience", "double"), "d_salience", F.lit(sal))).alias("salience"),
        F.lit(3).alias("schema_version"), names("senses_activated").alias("senses_activated"),
        source.alias("source"), get("supersedes", "bigint").alias("supersedes"),
        F.when(get("truncated", "boolean"), True).alias("truncated")))
    out = wide.select(*df.columns, reason.alias("reject_reason"), meta.alias("meta_json"))
    return (out.where("reject_reason is null").drop("reject_reason"),
            out.where("reject_reason is not null").drop("meta_json"))


def split_quarantined(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be shown, ids of the rows that were dropped)."""
    hidden = F.col("meta.exposure") == "quarantine"
    return resolved.where(~hidden), resolved.where(hidden).select("chain_id", "idx")


def zone(resolved_type: Column, exposure: Column) -> Column:
    """Name of the protected zone a record lies in, or null."""
    return (F.when(resolved_type.isin(fv.PROTECTED_TYPES), resolved_type)
            .when(exposure == "summary", "summary-exposure record"))


def revision_verdicts(resolved: DataFrame) -> DataFrame:
    """Whether an ordinary revision may target each record, and why not."""
    z = zone(F.col("rec_type"), F.col("meta.exposure"))
    return resolved.select("chain_id", "idx", z.isNull().alias("allowed"), z.alias("zone"), F.when(
        z.isNull(), "ordinary record").otherwise(F.concat(F.lit("protected zone: "), z)).alias("reason"))


def exposure_for_commit(action: Column) -> Column:
    return F.when(action == "quarantine", "quarantine")


def salience_for_commit(action: Column, default: Column) -> Column:
    return F.when(action == "light_log", default * 0.5)
