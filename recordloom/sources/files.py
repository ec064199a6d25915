"""File trees, text extraction, blob folders and JSON documents."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.operators.blocks import global_positions
from recordloom.operators.log import blob_index


def _tree(spark: SparkSession, root: str, exts: Sequence[str] | None, skip: Sequence[str], columns) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(*columns)
             .withColumn("relative_path", F.regexp_replace("path", "^.*?" + _quote(root.rstrip("/")) + "/", "")))
    kept = files.where(~F.arrays_overlap(F.split("relative_path", "/"), tx.literal_array(list(skip))))
    return kept if exts is None else kept.where(tx.extension(F.col("relative_path")).isin(list(exts)))


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def scan_files(spark: SparkSession, root: str, exts: Sequence[str] | None = None,
               skip: Sequence[str] = fv.SKIP_DIRS) -> DataFrame:
    """Files under a folder with their path, size and bytes; folders named in `skip` are left out anywhere."""
    return _tree(spark, root, exts, skip, ["path", "length", "modificationTime", "content"])


def numbered_files(spark: SparkSession, root: str, exts: Sequence[str] | None = None,
                   skip: Sequence[str] = fv.SKIP_DIRS) -> DataFrame:
    """Paths in order with a file_index from 1; contents are not read."""
    listing = _tree(spark, root, exts, skip, ["path", "length"]).withColumn("_parts", F.split("relative_path", "/"))
    return global_positions(listing, ["_parts"], "file_index").drop("_parts")


def volume_survey(spark: SparkSession, root: str, exts: Sequence[str] | None = None,
                  skip: Sequence[str] = fv.SKIP_DIRS) -> DataFrame:
    """Files and bytes a walk would read, and whether that calls for a confirmation. Contents are not read."""
    return (_tree(spark, root, exts, skip, ["path", "length"])
            .agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
            .withColumn("over_threshold", (F.col("files") > fv.SURVEY_FILES) | (F.col("bytes") > fv.SURVEY_BYTES)))


@F.pandas_udf(T.StringType())
def _table_text(texts: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(" | ".join(row) for row in csv.reader(io.StringIO(t), delimiter=m))
                      for t, m in zip(texts, marks)])


def extract_text(files: DataFrame, char_cap: int | None = None) -> DataFrame:
    """Text of plain, CSV and TSV files: UTF-8, else Latin-1; table rows are joined by ' | '.

    Whole texts by default; with `char_cap` longer ones are cut and flagged.
    """
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    plain = F.when(valid, raw).otherwise(F.decode("content", "ISO-8859-1"))
    ext = tx.extension(F.col("relative_path"))
    known = files.drop("content").columns
    rows = files.select(*known, plain.alias("_plain"), F.when(ext == ".csv", ",").when(ext == ".tsv", "\t").alias("_mark"),
                        F.when(valid, "utf8").otherwise("latin1-fallback").alias("_how"))
    text = F.when(F.col("_mark").isNull(), F.col("_plain")).otherwise(
        _table_text(F.when(F.col("_mark").isNull(), "").otherwise(F.col("_plain")), F.coalesce("_mark", F.lit(","))))
    long = F.lit(False) if char_cap is None else F.length("text") > char_cap
    out = rows.select(*known, text.alias("text"), F.when(F.col("_mark").isNull(), F.col("_how")).otherwise("csv").alias("method"))
    cut = F.col("text") if char_cap is None else F.when(long, F.concat(
        F.substring("text", 1, char_cap), F.lit("\n\n[... truncated ...]"))).otherwise(F.col("text"))
    return out.withColumn("truncated", long).withColumn("text", cut)


def blob_inventory(spark: SparkSession, folder: str, log: DataFrame) -> DataFrame:
    """Files named by their digest, with the newest known file name."""
    names = blob_index(log).groupBy("sha").agg(F.max_by("filename", F.struct("idx", "chain_id")).alias("filename"))
    found = _tree(spark, folder, None, [], ["path", "length"]).select(
        F.element_at(F.split("path", "/"), -1).alias("sha"), F.col("length").alias("size"))
    return found.join(names, "sha", "left").select(
        "sha", "size", F.coalesce("filename", F.concat(F.substring("sha", 1, 16), F.lit("…"))).alias("name"))


def read_registry(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Rows of a registry document {key: [{id, name, function, category}]}."""
    doc = spark.read.json(path, multiLine=True, schema=(
        f"{key} array<struct<id: bigint, name: string, function: string, category: string>>"))
    return doc.select(F.explode(key).alias("r")).select(
        F.lit(kind).alias("kind"), F.concat(F.lit("data:"), F.col("r.id").cast("string")).alias("id"), "r.name",
        "r.function", F.coalesce("r.category", F.lit("general")).alias("category"))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a detector registry document {modalities: [{name, patterns, ...}]}."""
    doc = spark.read.json(path, multiLine=True, schema=(
        "modalities array<struct<name: string, patterns: array<string>, threshold: double, match_mode: string, "
        "domain: boolean, status: string, weight_factor: double>>"))
    return doc.select(F.inline("modalities"))


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line; attestations and audit tables are kept this way."""
    df.write.mode(mode).json(path)


def read_attestations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="chain_id long, height long, record_hash string, witness string, mac string, seq long")
