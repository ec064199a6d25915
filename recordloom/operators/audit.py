"""Audit rollups over the text of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.operators.integrity import verify_log


MAX_WORDS = 10_000  # a larger word table joins without a hint


def body_text(content: Column) -> Column:
    return F.coalesce(F.get_json_object(content, "$.data.content"), F.get_json_object(content, "$.text"),
                      tx.handle(content), F.lit(""))


def audit_tokens(text: Column, stop: Sequence[str] = fv.STOPWORDS) -> Column:
    return F.filter(tx.content_words(tx.tokenize(text), stop), lambda w: F.length(w) > 1)


def domain_rollup(log: DataFrame, domains: dict[str, Sequence[str]] = fv.DOMAINS, top: int = 8,
                  stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """Per subject domain: records that touch it, their estimated tokens, a bar, and its top words.

    `domains` is a small fixed table of words. Words are counted per record before
    anything is shuffled, so a common word costs one row per record at most.
    """
    pairs = [(d, w) for d, ws in domains.items() for w in ws]
    words = log.sparkSession.createDataFrame(pairs, "domain string, word string")
    if len(pairs) <= MAX_WORDS:
        words = F.broadcast(words)
    text = body_text(F.col("content_json"))
    rows = log.select("chain_id", "idx", text.alias("_t")).select(
        "chain_id", "idx", tx.approx_tokens(F.col("_t")).alias("_tok"),
        F.explode(tx.bag(audit_tokens(F.col("_t"), stop))).alias("b"))
    hits = rows.select("chain_id", "idx", "_tok", F.col("b.w").alias("word"), F.col("b.n").cast("long").alias("n")).join(words, "word")
    per = (hits.groupBy("domain", "chain_id", "idx").agg(F.max("_tok").alias("_tok"))
           .groupBy("domain").agg(F.count("*").alias("rings"), F.sum("_tok").alias("est_tokens")))
    counts = hits.groupBy("domain", "word").agg(F.sum("n").alias("n"), F.min(F.struct("chain_id", "idx")).alias("_first"))
    place = F.row_number().over(W.partitionBy("domain").orderBy(F.desc("n"), "word"))
    names = (counts.withColumn("_p", place).where(F.col("_p") <= top).groupBy("domain").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_p", "word", "n"))), lambda s: s.dropFields("_p")).alias("keywords")))
    most = F.max("rings").over(W.partitionBy())  # one row per domain
    return per.withColumn("bar", F.round(F.col("rings") / most, 3)).join(names, "domain")


def category_counts(registry: DataFrame) -> DataFrame:
    """Entries per category with the total (a registry is a small table)."""
    counts = registry.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(W.partitionBy()))


def audit_metrics(log: DataFrame, modalities: DataFrame, senses: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """One row: records, estimated tokens, registry and blob sizes, integrity."""
    out = log.agg(F.count("*").alias("rings"), F.sum(tx.approx_tokens(body_text(F.col("content_json")))).alias("context_tokens"))
    parts = [modalities.agg(F.count("*").alias("modalities")), senses.agg(F.count("*").alias("senses")),
             verify_log(log).agg(F.when(F.min(F.col("ok").cast("int")) == 1, "PASS").otherwise("FAIL").alias("integrity"))]
    if blobs is not None:
        parts.append(blobs.agg(F.count("*").alias("blobs")))
    for p in parts:  # one-row frames meet on a constant
        out = out.withColumn("_one", F.lit(1)).join(p.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out


def ring_list(log: DataFrame, n: int = 250, top: int = 8, stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """Newest n records of each chain with brightness, a 260-character summary and top words."""
    from recordloom.operators.retrieval import recent
    rows = recent(log, n).withColumn("_t", body_text(F.col("content_json")))
    return rows.select(
        "chain_id", "idx", "rec_type", F.get_json_object("content_json", "$._meta.poq.brightness").try_cast("double").alias("brightness"),
        F.substring(F.translate(tx.strip(F.col("_t")), "\n", " "), 1, 260).alias("summary"),
        tx.words_of(tx.top_words(audit_tokens(F.col("_t"), stop), top)).alias("keywords"))
