"""Record logs: schema, bulk append, scans, and adapters that derive logs from tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recordloom.fixed_values import GENESIS_PRIOR_HASH
from recordloom.functions.hashing import canonical_json, record_message_parts
from recordloom.operators.blocks import positions

LOG_SCHEMA = T.StructType([
    T.StructField("chain_id", T.LongType()), T.StructField("idx", T.LongType()),
    T.StructField("prior_hash", T.StringType()), T.StructField("ts_ms", T.LongType()),
    T.StructField("rec_type", T.StringType()), T.StructField("content_json", T.StringType()),
    T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("writer", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("record_hash", T.StringType()),
])
# Chain ids of users leave room between them.
CHAIN_STRIDE = 1 << 20


def _link(batches):
    chain = prior = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in
                ("chain_id", "_head", "_middle", "_tail", "cites_prior", "_seed")}
        priors, hashes = [], []
        for cid, head, mid, tail, cites, seed in zip(*cols.values()):
            if cid != chain:
                chain, prior = cid, seed
            text = head + prior + mid + (prior if cites else "") + tail
            priors.append(prior)
            prior = hashlib.sha256(text.encode("utf-8")).hexdigest()
            hashes.append(prior)
        kept = [n for n in batch.schema.names if not n.startswith("_")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in kept] + [pa.array(priors, pa.string()), pa.array(hashes, pa.string())],
            names=kept + ["prior_hash", "record_hash"])


def append(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Link a batch of new records onto many chains at once.

    `rows` has chain_id, seq (order within the batch, dense from 0), ts_ms, rec_type,
    content_json, refs, writer and cites_prior (also cite the record before). `heads`
    gives (chain_id, idx, record_hash) of the chains so far. Each partition is a
    sorted stream with one carried hash, so memory stays flat for any chain length.
    """
    if heads is None:
        seeded = rows.withColumn("_seed", F.lit(GENESIS_PRIOR_HASH)).withColumn("idx", F.col("seq"))
    else:
        known = heads.select("chain_id", F.col("idx").alias("_last"), F.col("record_hash").alias("_hash"))
        seeded = (rows.join(known, "chain_id", "left")
                  .withColumn("_seed", F.coalesce("_hash", F.lit(GENESIS_PRIOR_HASH)))
                  .withColumn("idx", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("seq"))
                  .drop("_hash", "_last"))
    head, middle, tail = record_message_parts()
    ready = seeded.select(
        "chain_id", F.col("idx").cast("long").alias("idx"), "ts_ms", "rec_type",
        canonical_json(F.col("content_json")).alias("content_json"), "refs", "writer", "cites_prior",
        F.sha2(canonical_json(F.col("content_json")), 256).alias("content_hash"),
        head.alias("_head"), middle.alias("_middle"), tail.alias("_tail"), "_seed")
    kept = T.StructType([f for f in ready.schema.fields if not f.name.startswith("_")])
    kept = kept.add("prior_hash", "string").add("record_hash", "string")
    linked = (ready.repartition("chain_id").sortWithinPartitions("chain_id", "idx")
              .mapInArrow(_link, kept))
    refs = F.when(F.col("cites_prior"), F.concat("refs", F.array("prior_hash"))).otherwise(F.col("refs"))
    return linked.withColumn("refs", refs).select(*LOG_SCHEMA.names)


def heads(log: DataFrame) -> DataFrame:
    """Newest record and length of each chain."""
    top = F.max_by(F.struct("idx", "record_hash", "ts_ms", "rec_type"), "idx")
    return (log.groupBy("chain_id").agg(F.count("*").alias("length"), top.alias("h"))
            .select("chain_id", "length", F.col("h.idx").alias("idx"), F.col("h.record_hash").alias("record_hash"),
                    F.col("h.ts_ms").alias("ts_ms"), F.col("h.rec_type").alias("rec_type")))


def scan(log: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows with start <= idx < end; a plain range filter that reaches the file scan."""
    kept = log.where(F.col("idx") >= start)
    return kept if end is None else kept.where(F.col("idx") < end)


# --- adapters ----------------------------------------------------------------

EVENT_TYPES = {"click": "observation", "view": "response", "purchase": "reflection",
               "error": "revision", "signup": "principle"}


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlinked records, one chain per user whatever their number."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))
    placed = positions(ev, ["user_id"], F.date_trunc("hour", F.col("ts")), ["ts", "event_id"], "seq")
    seq = F.col("seq")
    rec_type = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in EVENT_TYPES.items()
                            if e != "signup"],
                          F.when(F.col("seq") == 0, "genesis").otherwise("principle"))
    exposure = (F.when(F.col("k") >= 90, "quarantine").when(F.col("k") >= 80, "shared")
                .when(F.col("k") >= 70, "public"))
    flag = F.when(exposure.isNotNull(), F.concat(F.lit('"exposure":"'), exposure, F.lit('"')))
    target = F.when(F.col("event_type") == "error",
                    F.concat(F.lit('"supersedes":'), (F.col("seq") - 1).cast("string")))
    meta = F.when(flag.isNotNull() | target.isNotNull(),
                  F.concat(F.lit('"_meta":{'), F.concat_ws(",", flag, target), F.lit("},")))
    content = F.concat(F.lit("{"), F.coalesce(meta, F.lit("")), F.lit('"cents":'), F.col("cents").cast("string"),
                       F.lit(',"event_id":'), F.col("event_id").cast("string"),
                       F.lit(',"k":'), F.col("k").cast("string"), F.lit("}"))
    return placed.select(
        (F.col("user_id") * CHAIN_STRIDE).alias("chain_id"),
        F.col("seq").cast("long").alias("seq"), F.unix_millis("ts").alias("ts_ms"), rec_type.alias("rec_type"),
        content.alias("content_json"), F.array().cast("array<string>").alias("refs"),
        F.concat(F.lit("w"), F.pmod(F.col("user_id"), F.lit(7)).cast("string")).alias("writer"),
        ((F.col("event_type") == "view") & (F.col("seq") > 0)).alias("cites_prior"))


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlinked records of dialogues; a response cites the turn before it. Some turns carry metadata."""
    role, size = F.col("role"), F.length("text")
    meta = F.when(F.pmod(size, F.lit(5)) == 0, F.concat(
        F.lit('"_meta":{"exposure":"'), F.when(F.pmod(size, F.lit(15)) == 0, "quarantine").otherwise("private"), F.lit('",'),
        F.when(F.pmod(size, F.lit(10)) == 0, '"modalities_activated":["artifact_content"],').otherwise(""),
        F.lit('"salience":0.'), (F.pmod(size, F.lit(9)) + 1).cast("string"), F.lit("},")))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("chain_id"), F.col("turn").alias("seq"),
        (F.lit(1_700_000_000_000) + F.col("conv_id") * 86_400_000 + F.col("turn") * 60_000).alias("ts_ms"),
        F.when(role == "user", "observation").when(role == "assistant", "response")
        .otherwise("system_prompt").alias("rec_type"),
        F.concat(F.lit("{"), F.coalesce(meta, F.lit("")), F.substr(F.to_json(F.struct("text")), F.lit(2))).alias("content_json"),
        F.array().cast("array<string>").alias("refs"), F.lit("w0").alias("writer"),
        ((role == "assistant") & (F.col("turn") > 0)).alias("cites_prior"))


def unlinked(rows: DataFrame) -> DataFrame:
    """The record columns of a batch for work that needs no hashes."""
    return rows.select("chain_id", F.col("seq").alias("idx"), "ts_ms", "rec_type", "content_json", "writer")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append(events_rows(spark, sf_dir))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append(conversation_rows(spark, sf_dir))


def governance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events read as proposals, recurrences, statuses, reflections and revisions."""
    base = events_rows(spark, sf_dir)
    k = F.get_json_object("content_json", "$.k").cast("long")
    seq, text = F.col("seq"), (lambda c: c.cast("string"))
    kind = (F.when(F.col("rec_type").isin("genesis", "principle"), "proposal")
            .when(F.col("rec_type") == "observation", "proposal_recurrence")
            .when(F.col("rec_type") == "response", "proposal_status")
            .otherwise(F.col("rec_type")))
    back = seq - 1 - F.pmod(k, F.lit(8))
    content = (
        F.when(kind == "proposal", F.concat(
            F.lit('{"escalated":'), F.when(k >= 95, "true").otherwise("false"),
            F.lit(',"evidence":['), text(seq - 1), F.lit(","), text(seq + F.pmod(k, F.lit(5))),
            F.lit('],"status":"'), F.when(k < 4, "declined").otherwise("open"),
            F.lit('","title":"topic '), text(F.pmod(k, F.lit(6))),
            F.lit('","topic_signature":"topic'), text(F.pmod(k, F.lit(6))), F.lit('"}')))
        .when(kind == "proposal_recurrence", F.concat(F.lit('{"recurs_proposal_index":'), text(back), F.lit("}")))
        .when(kind == "proposal_status", F.concat(
            F.lit('{"marks_proposal_index":'), text(back), F.lit(',"new_status":"'),
            F.element_at(F.array(*[F.lit(s) for s in ("accepted", "declined", "done")]),
                         (F.pmod(k, F.lit(3)) + 1).cast("int")), F.lit('"}')))
        .when(kind == "reflection", F.concat(
            F.lit('{"covers_indices":['), text(seq - F.pmod(k, F.lit(20))), F.lit(","), text(seq - 1), F.lit("]}")))
        .otherwise(F.when(F.pmod(k, F.lit(9)) == 0, F.lit('{"note":"none"}')).otherwise(
            F.concat(F.lit('{"revises_index":'), text(seq - 1 - F.pmod(k, F.lit(5))), F.lit("}")))))
    return base.withColumn("content_json", content).withColumn("rec_type", kind)


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file records, one chain per source; every seventh comes as a response's attachment."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", F.sha2("text", 256).alias("sha"), "n_chars")
    placed = positions(docs, ["source"], F.expr("doc_id div 65536"), ["doc_id"], "seq")
    entry = F.struct(F.col("sha").alias("blob_sha256"), F.concat(
        F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("n_chars").alias("size_bytes"))
    attached = F.pmod("doc_id", F.lit(7)) == 0
    return placed.select(
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("chain_id"), F.col("seq").cast("long").alias("seq"),
        (F.lit(1_700_000_000_000) + F.col("doc_id") * 1000).alias("ts_ms"),
        F.when(attached, "response").otherwise("file").alias("rec_type"),
        F.when(attached, F.to_json(F.struct(F.array(entry).alias("attachments")))).otherwise(F.to_json(entry)).alias("content_json"),
        F.array().cast("array<string>").alias("refs"), F.lit("w0").alias("writer"), F.lit(False).alias("cites_prior"))
