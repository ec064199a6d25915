"""Recall of source blocks by question and path, each with the state of its file now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from recordloom import fixed_values as fv
from recordloom.operators import ingest, retrieval


def recall_paths(blocks: DataFrame, queries: DataFrame, live: DataFrame, semantic: DataFrame | None = None, k: int = 8,
                 neighbours: int = 1, stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """query_id, chain_id, idx, score, neighbour_of, relative_path, verdict, stale: the ranked blocks with their neighbours, judged.

    `blocks` are those of `path_aware` with file_content_hash and, where known, source_commit; `live` is a manifest of
    source_path, live_hash, live_commit, live_dirty. Only the few ranked blocks meet the manifest.
    """
    hits = retrieval.path_aware(blocks, queries, semantic, k, neighbours, stop)
    commit = F.col("source_commit") if "source_commit" in blocks.columns else F.lit(None).cast("string")
    wanted = hits.select("chain_id", "idx").distinct()
    coordinates = wanted.join(blocks.select("chain_id", "idx", "relative_path", "file_content_hash", commit.alias("source_commit")), ["chain_id", "idx"])
    judged = ingest.source_verdicts(coordinates.select(
        "chain_id", "idx", F.lit(True).alias("found"), F.lit("file").alias("rec_type"), F.col("relative_path").alias("source_path"),
        F.col("file_content_hash").alias("stored_hash"), F.col("source_commit").alias("stored_commit")), live)
    return hits.join(judged, ["chain_id", "idx"]).select(
        "query_id", "chain_id", "idx", "score", "neighbour_of", F.col("source_path").alias("relative_path"), "verdict", (F.col("verdict") != "verified").alias("stale"))
