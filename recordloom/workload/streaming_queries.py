"""Incremental jobs run over derived logs that arrive in three parts."""

import uuid

from pyspark.sql import functions as F

from recordloom.functions import vectors
from recordloom.functions.chunking import chunk_table_function
from recordloom.operators import audit, bundle, mining, quorum
from recordloom.session import shared_dir, stored
from recordloom.sources import files as fs, logs
from recordloom.streaming import batches, keyed, stateful
from recordloom.workload.integrity_queries import HEADS, RUNS, TAMPERED, WITNESSES, tampered
from recordloom.workload.logs_sql import CONV, EVENTS, FILES, GOV, merkle_levels
from recordloom.workload.corpus_queries import _BN, _MN, _OM, CONFUSE_WORDS, DATA_DOMAINS, FAIL_WORDS, KEY, doc_log, exported, faculty_rows, mined
from recordloom.workload.registry import query
from recordloom.workload.signals_queries import TOK


def scratch(spark):
    return f"{shared_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"


def arriving(spark, log, cuts=(20, 40)):
    """A log as a stream: records below the first cut, then up to the second, then the rest.
    All records of a chain in one part lie in one file, and a part has a file for each core, read as one batch."""
    at, cores = scratch(spark), max(2, spark.sparkContext.defaultParallelism)
    kept = stored(log)
    edges = [(-1, cuts[0]), (cuts[0], cuts[1]), (cuts[1], 1 << 60)]
    files = 0
    for low, high in edges:
        part = kept.where((F.col("idx") >= max(low, 0)) & (F.col("idx") < high))
        part.repartition(cores, "chain_id").write.mode("append").parquet(at)
        # few chains fill fewer files
        files = files or len(spark.read.schema(kept.schema).parquet(at).inputFiles())
    return spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", files).parquet(at)


def drained(spark, stream):
    at = scratch(spark)
    (stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def job(spark, start):
    at = scratch(spark)
    start(f"{at}/out", f"{at}/state", f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/out/v=*")


@query("r02_verify_stream", TAMPERED + """
select chain_id, idx, case when idx<>coalesce(prev_idx+1,0) then 'index gap' when prior_hash<>coalesce(prev_hash,repeat('0',64)) then 'prior_hash mismatch'
   when forged then 'content_hash mismatch' end as reason from pv
where idx<>coalesce(prev_idx+1,0) or prior_hash<>coalesce(prev_hash,repeat('0',64)) or forged""")
def _(spark, sf):
    stream = arriving(spark, tampered(spark, sf))
    return drained(spark, keyed.verify_stream(stream))


@query("r03_seal_stream", RUNS + ",\n" + merkle_levels("lv", "rk", 6) + """
select chain_id, first_idx, last_idx, t6.h as root_hash from bt join t6 using (rk) where leaves=64""")
def _(spark, sf):
    stream = arriving(spark, logs.events_log(spark, sf).select("chain_id", "idx", "record_hash", "ts_ms"))
    return drained(spark, keyed.seal_stream(stream)).select("chain_id", "first_idx", "last_idx", "root_hash")


@query("r04_index_stream", CONV + " select chain_id, idx, 64 as dim from lg")
def _(spark, sf):
    stream = arriving(spark, logs.unlinked(logs.conversation_rows(spark, sf)), (2, 4))
    return job(spark, lambda o, s, c: batches.index_stream(stream, lambda t: vectors.hash_embed(t, 64), o, s, c)).select(
        "chain_id", "idx", F.size("vector").alias("dim"))


@query("r05_cadence_stream", EVENTS + """,
t as (select chain_id, idx, rec_type, sum(case when rec_type='reflection' then 1 else 0 end) over (partition by chain_id order by idx) as seg from lg),
n as (select chain_id, idx, row_number() over (partition by chain_id, seg order by idx) as i from t where rec_type='response')
select chain_id, idx, 3::bigint as turns from n where i%3=0""")
def _(spark, sf):
    stream = arriving(spark, logs.unlinked(logs.events_rows(spark, sf)).select("chain_id", "idx", "rec_type"))
    return drained(spark, stateful.cadence_stream(stream, 3))


@query("r06_side_index_stream", EVENTS + " select chain_id, idx as revision_idx, supersedes as superseded_idx from lg where rec_type='revision'")
def _(spark, sf):
    stream = arriving(spark, logs.unlinked(logs.events_rows(spark, sf)))
    at = scratch(spark)
    batches.side_index_stream(stream, f"{at}/out", f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/out/supersedes/v=*").select("chain_id", "revision_idx", "superseded_idx")


@query("r01_mine_stream", _MN + """,
al as (select trigger, chain_id, signature, idx from ev union all select 'contradiction', chain_id, 'contradiction-handling', idx from mn where disputed),
bt as (select *, case when idx<40 then 0 when idx<80 then 1 else 2 end as b, row_number() over (partition by trigger, chain_id, signature order by idx) as i from al),
lb as (select chain_id, max(case when idx<40 then 0 when idx<80 then 1 else 2 end) as last from mn group by 1),
tp as (select trigger, chain_id, signature, count(*) as hits, max(b) filter (i=3) as since from bt group by all having count(*)>=3)
select trigger, chain_id, signature, hits, case when since=last then 'proposal' else 'recurrence' end as decision from tp join lb using (chain_id)""")
def _(spark, sf):
    """A log that arrives in three parts, each a micro-batch: in the end every topic has the hits of mining the whole log at once."""
    log, at = stored(mined(spark, sf)), scratch(spark)
    for low, high in ((0, 40), (40, 80), (80, 1 << 60)):
        log.where((F.col("idx") >= low) & (F.col("idx") < high)).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{at}/in")
        batches.mine_stream(stream, f"{at}/out", f"{at}/state", f"{at}/cp", lookback=1 << 40, known=["elle", "aux"],
                            failure_markers=FAIL_WORDS, confusion_markers=CONFUSE_WORDS).awaitTermination()
    found = spark.read.parquet(f"{at}/out/v=*").where("trigger <> 'output_mode'")
    return found.groupBy("trigger", "chain_id", "signature").agg(F.max_by(F.struct("hits", "decision"), "batch").alias("r")).select("trigger", "chain_id", "signature", "r.*")


@query("r06_recurrence_index", GOV + " select chain_id, idx, sightings from rc")
def _(spark, sf):
    """Counts kept on append: the log's beginning is backfilled, then the whole log arrives, its beginning again."""
    log = logs.unlinked(logs.governance_rows(spark, sf))
    at = scratch(spark)
    batches.backfill_indexes(log.where("idx < 10"), f"{at}/out")
    batches.side_index_stream(arriving(spark, log), f"{at}/out", f"{at}/cp").awaitTermination()
    return batches.recurrence_index(spark, f"{at}/out")


@query("r06_blob_index", FILES + " select chain_id, sha, max(idx) as idx, arg_max(filename, idx) as filename from lg group by 1,2")
def _(spark, sf):
    at = scratch(spark)
    batches.side_index_stream(arriving(spark, logs.unlinked(logs.file_rows(spark, sf))), f"{at}/out", f"{at}/cp").awaitTermination()
    kept = spark.read.parquet(f"{at}/out/blobs/v=*")
    return kept.groupBy("chain_id", "sha").agg(F.max("idx").alias("idx"), F.max_by("filename", "idx").alias("filename"))


@query("r07_deduplicated_stream", "select distinct user_id%50 as op, event_type from events")
def _(spark, sf):
    at = scratch(spark)
    spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.pmod("user_id", F.lit(50)).alias("op"), "event_type",
        F.concat(F.pmod("user_id", F.lit(50)).cast("string"), F.lit("/"), "event_type").alias("op_id")).write.parquet(at)
    schema = spark.read.parquet(at).schema
    stream = spark.readStream.schema(schema).parquet(at)
    return drained(spark, stateful.dedup_stream(stream, "op_id", "ts", "60 days")).select("op", "event_type")


@query("r09_escalation_stream", GOV + " select chain_id, idx from rc where sightings>=3")
def _(spark, sf):
    stream = arriving(spark, logs.unlinked(logs.governance_rows(spark, sf)))
    return drained(spark, stateful.escalation_stream(stream)).select("chain_id", "idx")


@query("r11_frame_stream", """
select c.conv_id as chain_id, c.turn as idx, count(p.turn) as n, md5(coalesce(string_agg(p.text, '|' order by p.turn),'')) as digest
from conversations c left join conversations p on p.conv_id=c.conv_id and p.turn between c.turn-3 and c.turn-1 group by 1,2""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("idx"), "text")
    out = drained(spark, stateful.frame_stream(arriving(spark, rows, (2, 4)), "chain_id", "idx", "text", 3))
    return out.select("chain_id", "idx", F.size("prior").cast("long").alias("n"), F.md5(F.array_join("prior", "|")).alias("digest"))


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


@query("r12_tumbling_windows", "select epoch_us(time_bucket(interval 1 hour, ts))//1000000 as start_s, event_type, count(*) as n from events group by 1,2")
def _(spark, sf):
    return stateful.windowed_counts(events(spark, sf), "ts", "event_type").select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query("r12_sliding_windows", """
select epoch_us(time_bucket(interval 30 minutes, ts))//1000000 - o*1800 as start_s, event_type, count(*) as n from events, (values (0),(1)) t(o) group by 1,2""")
def _(spark, sf):
    return stateful.windowed_counts(events(spark, sf), "ts", "event_type", "sliding", "1 hour", "30 minutes").select(
        F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query("r12_session_windows", """
with g as (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sn from g)
select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, sn""")
def _(spark, sf):
    return stateful.windowed_counts(events(spark, sf), "ts", "user_id", "session", "6 hours").select(
        "user_id", F.unix_micros("start").alias("start_us"), "n")


# --- sinks, unions and table functions over the same data ------------------------------------
@query("s08_bundle_round_trip", _BN + " select distinct bundle_key, true as ok from bx")
def _(spark, sf):
    at = scratch(spark)
    bundle.write_bundle(*exported(spark, sf), at)
    headers, records = bundle.read_bundle(spark, at)
    return bundle.verify_bundle(headers, records, KEY).select("bundle_key", "ok")


@query("s11_attestation_sink", HEADS + " select chain_id, height, record_hash, witness, mac from att")
def _(spark, sf):
    at = scratch(spark)
    fs.write_json(quorum.attest_heads(logs.events_log(spark, sf), WITNESSES), at)
    return fs.read_attestations(spark, at).drop("seq")


@query("s12_audit_snapshot", f"""with dm(domain, word) as (values {', '.join(f"('{d}','{w}')" for d, ws in DATA_DOMAINS.items() for w in ws)}),
tk as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as word from documents)
select domain, count(distinct doc_id) as rings from tk join dm using (word) group by 1""")
def _(spark, sf):
    at = scratch(spark)
    fs.write_json(audit.domain_rollup(doc_log(spark, sf), DATA_DOMAINS, stop=["zu"]), at)
    return spark.read.json(at).select("domain", "rings")


@query("u04_new_words", f"""
with t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{TOK}')) as w from conversations)
select a.conv_id, a.turn, len(list_filter(a.w, lambda x: not list_contains(b.w, x)))::int as fresh from t a join t b on b.conv_id=a.conv_id and b.turn=a.turn-1""")
def _(spark, sf):
    from recordloom.functions import text as tx
    t = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.array_distinct(tx.tokenize(F.col("text"))).alias("w"))
    p = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("p"))
    return t.join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_except("w", "p")).alias("fresh"))


@query("u05_quarantine_union", EVENTS + " select chain_id, idx from lg where exposure='quarantine' or rec_type='revision'")
def _(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf))
    flagged = log.where(F.get_json_object("content_json", "$._meta.exposure") == "quarantine").select("chain_id", "idx")
    return flagged.union(log.where("rec_type = 'revision'").select("chain_id", "idx")).distinct()


@query("u06_registry_union", "select case when item_id%2=0 then 'sense' else 'modality' end as kind, count(*) + case when item_id%2=0 then 17 else 13 end as n from benchmark group by item_id%2")
def _(spark, sf):
    from recordloom.operators import growth
    both = faculty_rows(spark, sf).unionByName(growth.detector_registry(spark))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("u07_known_vocabulary", _OM + " select distinct w as word from v4 join gt using (chain_id) join nm using (chain_id) where responses>=5 and hits>=5 and spread_ms>=7200000 and interleaved and n>=2")
def _(spark, sf):
    return mining.known_vocabulary(mining.sprout_specs(mining.output_modes(mined(spark, sf), ["elle", "aux"])[0]))


@query("x06_chunk_table_function")
def _(spark, sf):
    spark.udtf.register("chunks_of", chunk_table_function())
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("rl_documents")
    return spark.sql("select d.doc_id, c.chunk_index, length(c.chunk) as chars from rl_documents d, lateral chunks_of(d.text) c")
