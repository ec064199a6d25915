"""Composed plans, caller-supplied parts, and small operators by themselves."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from recordloom.functions import quality, signals as sg, text as tx, vectors
from recordloom.operators import bundle, ingest, knn, retrieval
from recordloom.plans.recall import recall_paths
from recordloom.session import shared_dir
from recordloom.sources import files as fs, logs
from recordloom.sources.vector_store import IdentityMismatch, VectorStore
from recordloom.workload.corpus_queries import _BN, _PATH, KEY, asks, doc_blocks, exported, file_rows
from recordloom.workload.registry import query
from recordloom.workload.signals_queries import LEX, PB, PFROM, REL, pairs, r6


@query("c08_path_recall", _PATH + """,
nb as (select h.query_id, h.chain_id, h.idx+o as idx, h.score-0.001 as score, h.idx as of from hit h join bl b on b.chain_id=h.chain_id and b.idx=h.idx, (values (-1),(1)) t(o)),
nx as (select query_id, chain_id, idx, max(score) as score, arg_min(of, (-score, of)) as neighbour_of from nb where exists (select 1 from bl where bl.chain_id=nb.chain_id and bl.idx=nb.idx
   and bl.relative_path=(select relative_path from bl x where x.chain_id=nb.chain_id and x.idx=nb.of))
  and not exists (select 1 from hit h where h.query_id=nb.query_id and h.idx=nb.idx) group by all),
al as (select query_id, chain_id, idx, round(score,4)::double as score, null::bigint as neighbour_of from hit union all select query_id, chain_id, idx, round(score,4)::double, neighbour_of from nx)
select query_id, al.chain_id, idx, score, neighbour_of, relative_path, case doc_id%4 when 1 then 'source-mismatch' when 2 then 'missing-source-file' else 'verified' end as verdict, doc_id%4 in (1,2) as stale
from al join fr on fr.chain_id=al.chain_id and fr.file_index=al.idx""")
def _(spark, sf):
    """Ranked blocks against files of which some have changed and some are gone."""
    blocks = doc_blocks(spark, sf)
    rest = F.pmod("doc_id", F.lit(4))
    live = blocks.where(rest != 2).select(
        F.col("relative_path").alias("source_path"), F.when(rest == 1, F.sha2("relative_path", 256)).otherwise(F.col("file_content_hash")).alias("live_hash"),
        F.lit(None).cast("string").alias("live_commit"), F.lit(None).cast("boolean").alias("live_dirty"))
    return recall_paths(blocks, asks(spark, sf), live, k=8, neighbours=1, stop=LEX.stop).withColumn("score", F.round("score", 4))


@query("x04_custom_labels", """select doc_id, length(text)-length(replace(text,chr(10),''))+1 as lines from documents""")
def _(spark, sf):
    """Blocks sealed with a caller's own labels."""
    files = file_rows(spark, sf)
    whole = 1 << 28
    lines = lambda content: F.struct((tx.occurrences(content, "\n") + 1).cast("long").alias("lines"))
    made = ingest.blocks(files.drop("doc_id"), 0, whole, 0, whole, labeller=lines)
    return made.join(files.select("chain_id", "file_index", "doc_id"), ["chain_id", "file_index"]).select("doc_id", "labels.lines")


@query("x01_custom_embedder", """select conv_id, turn, length(text)::double as a, (length(text)-length(replace(text,'e','')))::double as b from conversations""")
def _(spark, sf):
    embed = vectors.embed_udf(lambda t: np.array([len(t), t.count("e")], np.float32), 2)
    t = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", embed(F.col("text")).alias("v"))
    return t.select("conv_id", "turn", F.col("v")[0].cast("double").alias("a"), F.col("v")[1].cast("double").alias("b"))


@query("x02_extra_detector", """select conv_id, turn, least(1.0, (length(text)-length(replace(text,'?','')))/2.0)::double as activation, (length(text)-length(replace(text,'?','')))/2.0 > 0.1 as active from conversations""")
def _(spark, sf):
    """A caller's detector beside the built-in ones."""
    marks = lambda p: sg._hit(F.least(F.lit(1.0), tx.occurrences(p.text, "?") / 2.0))
    t = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    wide = sg.analyze(t, "text", extra={"asking": marks}, lex=LEX, floor=0.1)
    return wide.select("conv_id", "turn", F.col("asking.activation").alias("activation"), F.array_contains("modalities_activated", "asking").alias("active"))


@query("q10_x05_external_scores", f"{PB} select pr.conv_id, pr.turn, case when pr.turn%3=0 then 0.125 else round(cast({REL} as double),6) end as relevance, case when pr.turn%2=0 then 'reject' end as given {PFROM}")
def _(spark, sf):
    """Scores and verdicts of a caller win where they are given."""
    turn = F.col("turn")
    rows = pairs(spark, sf).withColumns({
        "ext": F.when(turn % 3 == 0, F.create_map(F.lit("relevance"), F.lit(0.125))), "ruled": F.when(turn % 2 == 0, "reject").otherwise("nonsense")})
    scored = quality.evaluate(rows, "question", "candidate", retrieved="retrieved", epistemic="epistemic", external="ext", external_verdict="ruled", lex=LEX)
    return scored.select("conv_id", "turn", r6(F.col("relevance")).alias("relevance"), F.when(turn % 2 == 0, F.col("verdict")).alias("given"))


@query("q12_commit_meta", """select doc_id, case when doc_id%10>=6 then 'speculative' else 'inferred' end as commit_epistemic, case when toxic=1 then 'quarantine' else 'private' end as commit_exposure,
 case when toxic=0 and quality=0 then 0.2 else 0.4 end::double as commit_salience from labels""")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/labels.parquet")
    act = F.when(F.col("toxic") == 1, "quarantine").when(F.col("quality") == 0, "light_log").otherwise("commit")
    rows = t.select("doc_id", act.alias("action"), (F.pmod("doc_id", F.lit(10)) / 10).alias("uncertainty"))
    return quality.commit_meta(rows).drop("action", "uncertainty")


def _hmac_sql(message: str) -> str:
    key = bytes.fromhex(KEY).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


_MESSAGE = """'{"kind":"summary-commitment","origin_record_hash":"' || record_hash || '","summary":{"summary":"(summary withheld)"}}'"""


@query("f26_summary_commitments", _BN + f" select bundle_key, idx, case when ex='summary' then {_hmac_sql(_MESSAGE)} else '' end as summary_commitment from bx")
def _(spark, sf):
    return exported(spark, sf)[1].select("bundle_key", "idx", "summary_commitment")


@query("f27_demotion", """select doc_id, case when doc_id%5 in (3,4) then ['known','user_context','inferred','speculative','disputed'][(doc_id%5+1)::int] else 'inferred' end as demoted from documents""")
def _(spark, sf):
    said = F.element_at(tx.literal_array(bundle.STRENGTH), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", bundle.demote(said).alias("demoted"))


@query("f20_store_identity", """
with s as (select 'first' as stage, 32 as dim, conv_id, turn from conversations where turn<3 union all select 'extended', 32, conv_id, turn from conversations
 union all select 'rebuilt', 16, conv_id, turn from conversations union all select 'old reader', 32, conv_id, turn from conversations)
select stage, dim, conv_id as chain_id, count(*) as records, false as refused from s group by all union all select 'other space', 16, null, 0, true""")
def _(spark, sf):
    """A store is filled, extended, refuses another vector space, is rebuilt for it, and is still read as it was."""
    log = logs.unlinked(logs.conversation_rows(spark, sf))
    store = VectorStore(spark, f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}")
    space = {dim: vectors.embedder_id("hash", dim) for dim in (32, 16)}
    fill = lambda rows, dim, **kw: store.index(rows, F.col("content_json"), lambda t: vectors.hash_embed(t, dim), space[dim], **kw)
    first, whole = fill(log.where("idx < 3"), 32), fill(log, 32)
    refused = False
    try:
        fill(log, 16)
    except IdentityMismatch:
        refused = True
    fill(log, 16, rebuild=True)

    def seen(stage, dim, version=None):
        return (store.open(space[dim], version).groupBy("chain_id", F.size("vector").alias("dim")).agg(F.count("*").alias("records"))
                .select(F.lit(stage).alias("stage"), "dim", "chain_id", "records", F.lit(False).alias("refused")))
    out = seen("first", 32, first).unionByName(seen("extended", 32, whole)).unionByName(seen("rebuilt", 16)).unionByName(seen("old reader", 32, whole))
    told = spark.createDataFrame([("other space", 16, None, 0, refused)], "stage string, dim int, chain_id long, records long, refused boolean")
    return out.unionByName(told)


@query("s09_registry_documents", """select case when item_id%2=0 then 'sense' else 'modality' end as kind, 'data:' || item_id as id, 'Faculty ' || item_id as name, text as function,
 case when item_id%3=0 then 'general' else 'c' || (item_id%4) end as category from benchmark""")
def _(spark, sf):
    """Registries written as JSON documents of at most 64 entries and read back; an entry without a category is a general one."""
    at = f"{shared_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    n = F.col("item_id")
    entry = F.struct(n.alias("id"), F.concat(F.lit("Faculty "), n.cast("string")).alias("name"), F.col("text").alias("function"),
                     F.when(n % 3 != 0, F.concat(F.lit("c"), F.pmod(n, F.lit(4)).cast("string"))).alias("category"))
    docs = (spark.read.parquet(f"{sf}/benchmark.parquet").groupBy(F.when(n % 2 == 0, "sense").otherwise("modality").alias("kind"), F.expr("item_id div 64").alias("part"))
            .agg(F.collect_list(entry).alias("faculties")))
    docs.select("kind", "part", F.to_json(F.struct("faculties")).alias("value")).repartition("kind", "part").write.partitionBy("kind", "part").text(at)
    both = [fs.read_registry(spark, f"{at}/kind={kind}", "faculties", kind) for kind in ("modality", "sense")]
    return both[0].unionByName(both[1])


@query("j16_excerpts", """
with m as (select conv_id, turn, (length(text)%10)/10.0 as sim from conversations where length(text)%3=0 qualify row_number() over (partition by conv_id order by sim desc, turn)<=3),
nb as (select distinct m.conv_id, c.turn from m join conversations c on c.conv_id=m.conv_id and abs(c.turn-m.turn)=1)
select conv_id as chain_id, turn as chunk_index, 'matched' as tag from m union all
select conv_id, turn, 'context' from nb where not exists (select 1 from m where m.conv_id=nb.conv_id and m.turn=nb.turn)""")
def _(spark, sf):
    """The three best chunks of each record with a neighbour on each side."""
    t = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.col("conv_id").alias("chain_id"), F.lit(0).cast("long").alias("idx"), F.col("turn").alias("chunk_index"), F.length("text").alias("n"))
    pairs_ = t.where(F.col("n") % 3 == 0).select(F.lit("q").alias("query_id"), "chain_id", "idx", "chunk_index", (F.pmod("n", F.lit(10)) / 10).alias("sim"))
    near = retrieval.excerpt_chunks(t.drop("n"), knn.top_chunks(pairs_, 3).drop("place"))
    return near.select("chain_id", "chunk_index", "tag")
