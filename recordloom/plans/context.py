"""What a reader should see for a query: one lazy plan from similarity to the budgeted record list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.functions import text as tx
from recordloom.operators.budget import fit_greedy
from recordloom.operators.governance import supersedes_links
from recordloom.operators.knn import knn_scoped
from recordloom.operators.meta import resolve_meta
from recordloom.operators.retrieval import hybrid, stitch_pairs

WHY = ["semantic", "recent", "explicit", "revision", "partner"]


def build_context(log: DataFrame, chunks: DataFrame, queries: DataFrame, as_of_ms: int, k: int = 5,
                  n_recent: int = 15, modes: str | None = None, epistemic: bool = True,
                  weight_factors: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries: query_id, chain_id, text, vector [, modes]. Chunks: chain_id, idx, vector.

    Gives (query_id, chain_id, idx, pinned, why) and the same for records that were hidden.
    """
    ids = ["query_id", "chain_id", "idx"]
    found = knn_scoped(chunks, queries, max(4 * k, 20))
    if modes:
        found = found.join(queries.select("query_id", modes), "query_id")
    semantic = hybrid(found, log, as_of_ms, k, modes, weight_factors, epistemic).select(*ids, F.lit(0).alias("src"))

    lengths = log.groupBy("chain_id").agg((F.max("idx") + 1).alias("_length"))
    ends = queries.select("query_id", "chain_id").join(lengths, "chain_id")
    newest = (log.select("chain_id", "idx").join(ends, "chain_id")
              .where(F.col("idx") >= F.col("_length") - n_recent).select(*ids, F.lit(1).alias("src")))
    named = (queries.select("query_id", "chain_id", F.explode(tx.explicit_indices(F.col("text"))).alias("idx"))
             .join(log.select("chain_id", "idx"), ["chain_id", "idx"]).select(*ids, F.lit(2).alias("src")))
    direct = semantic.unionByName(newest).unionByName(named).groupBy(*ids).agg(
        F.min("src").alias("src"), F.max(F.col("src") == 2).alias("pinned"))

    links = supersedes_links(log)
    newer = (direct.select("query_id", "chain_id", F.col("idx").alias("superseded_idx"))
             .join(links, ["chain_id", "superseded_idx"])
             .select("query_id", "chain_id", F.col("revision_idx").alias("idx")).distinct()
             .join(direct.select(*ids), ids, "left_anti"))
    merged = direct.unionByName(newer.withColumns({"src": F.lit(3), "pinned": F.lit(False)}))

    exposure = resolve_meta(log.select("chain_id", "idx", "rec_type", "content_json")).select(
        "chain_id", "idx", (F.col("meta.exposure") == "quarantine").alias("_hidden"))
    partners = stitch_pairs(log, merged, exposure.where("_hidden").select("chain_id", "idx"))
    pins = (partners.select("query_id", "chain_id", F.col("partner_of").alias("idx")).distinct().withColumn("_pin", F.lit(True)))
    joined = (merged.join(pins, ids, "left").withColumn("pinned", F.col("pinned") | F.coalesce("_pin", F.lit(False))).drop("_pin")
              .unionByName(partners.select(*ids).distinct().withColumns({"src": F.lit(4), "pinned": F.lit(True)})))
    told = (joined.join(exposure, ["chain_id", "idx"])
            .withColumn("why", F.element_at(F.array(*[F.lit(w) for w in WHY]), F.col("src") + 1)))
    out = ["query_id", "chain_id", "idx", "pinned", "why"]
    return told.where("not _hidden").select(*out), told.where("_hidden").select(*out)


def fit_context(context: DataFrame, log: DataFrame, char_budget: int) -> DataFrame:
    """Drop the least salient records until each query's context fits; pinned ones first, newer first on ties."""
    facts = resolve_meta(log.select("chain_id", "idx", "rec_type", "content_json")).select(
        "chain_id", "idx", F.col("meta.salience").alias("_sal"), (F.length("content_json") + 80).cast("long").alias("size"))
    rows = context.join(facts, ["chain_id", "idx"])
    order = [-F.col("pinned").cast("int"), -F.col("_sal"), -F.col("idx")]
    return fit_greedy(rows, ["query_id"], ["chain_id", "idx"], order, "size", char_budget).drop("_sal")
