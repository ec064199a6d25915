"""Ingest, mining, defence, growth, bundles, audit and file sources."""

import uuid

from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.operators import audit, budget, bundle, defence, growth, ingest, merkle, mining, quorum, retrieval
from recordloom.operators.blocks import positions
from recordloom.session import shared_dir, spread, stored
from recordloom.sources import files as fs, logs, ranges
from recordloom.sources.resume import TaskIngest
from recordloom.workload.integrity_queries import WITNESSES
from recordloom.workload.logs_sql import CONV, EVENTS, EVENTS_LINKED, FILES, GOV, LINK, CR, defaults_values, merkle_levels
from recordloom.workload.registry import query
from recordloom.workload.signals_queries import LEX, TOK, r6, words

# --- documents as files of one task per source ------------------------------------------
FOLDERS = ["src", "test", "docs", "build", "vendor", "lib"]
SUFFIXES = [".py", ".md", ".json", ".go", ".bin", ".txt", ".js"]


def file_rows(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    placed = positions(d, ["source"], F.expr("doc_id div 65536"), ["doc_id"], "file_index")
    pick = lambda xs: F.element_at(tx.literal_array(xs), (F.pmod("doc_id", F.lit(len(xs))) + 1).cast("int"))
    return placed.select(
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("chain_id"), "file_index",
        F.concat("source", F.lit("/"), pick(FOLDERS), F.lit("/doc_"), F.col("doc_id").cast("string"), pick(SUFFIXES)).alias("relative_path"),
        "text", "doc_id")


def _case(xs):
    return f"(case doc_id%{len(xs)} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(xs)) + " end)"


FR = f"""fr as (select cast(regexp_extract(source,'(\\d+)',1) as bigint) as chain_id, doc_id, text, source,
 row_number() over (partition by source order by doc_id)-1 as file_index,
 source || '/' || {_case(FOLDERS)} || '/doc_' || doc_id || {_case(SUFFIXES)} as relative_path, {_case(SUFFIXES)} as ext, {_case(FOLDERS)} as folder from documents)"""


@query("p25_path_roles", f"""with {FR}
select doc_id, source as top_dir, ext as extension, case ext when '.py' then 'python' when '.md' then 'markdown' when '.json' then 'json' when '.go' then 'go' when '.js' then 'javascript' end as language,
 case folder when 'build' then 'generated' when 'vendor' then 'vendor' when 'test' then 'test' when 'docs' then 'docs' else
  case when ext in ('.md','.txt') then 'docs' when ext='.json' then 'config' when ext in ('.py','.go','.js') then 'source' else 'other' end end as path_role,
 sha256(text) as file_content_hash from fr""")
def _(spark, sf):
    rows = file_rows(spark, sf)
    facts = ingest.file_facts(rows).select("chain_id", "file_index", "top_dir", "extension", "language", "path_role", "file_content_hash")
    return facts.join(rows.select("chain_id", "file_index", "doc_id"), ["chain_id", "file_index"]).drop("chain_id", "file_index")


@query("p24_by_path", f"""with {FR}
select chain_id, file_index as idx, relative_path, doc_id from fr where doc_id in (select doc_id from labels where toxic=1)""")
def _(spark, sf):
    blocks = doc_blocks(spark, sf)
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id")
    asked = file_rows(spark, sf).join(toxic, "doc_id", "left_semi").select("chain_id", "relative_path")
    return ingest.find_by_path(blocks, asked).select("chain_id", "idx", "relative_path", "doc_id")


def task_blocks(spark, sf):
    return ingest.blocks(file_rows(spark, sf))


@query("c07_corpus_blocks")
def _(spark, sf):
    return task_blocks(spark, sf).drop("content")


@query("f16_line_chunks_cover_text", f"""with {FR}
select chain_id, file_index, md5(text) as digest from fr where doc_id not in (select doc_id from documents where regexp_matches(text,'(?i)(api|access|secret|private|auth|bearer|token|password|passwd|pwd)[A-Za-z0-9_.-]*\\s*[:=]') or text like '%PRIVATE KEY%')""")
def _(spark, sf):
    """Chunks of a file, put back together, are the file: checked on every text without secrets."""
    b = task_blocks(spark, sf).where(~F.col("redacted"))
    whole = b.groupBy("chain_id", "file_index").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("_c"))
    plain = file_rows(spark, sf).where(~(F.col("text").rlike(
        r"(?i)(api|access|secret|private|auth|bearer|token|password|passwd|pwd)[A-Za-z0-9_.-]*\s*[:=]")
        | F.contains("text", F.lit("PRIVATE KEY")))).select("chain_id", "file_index")
    return whole.join(plain, ["chain_id", "file_index"], "left_semi").select(
        "chain_id", "file_index", F.md5(F.array_join(F.transform("_c", lambda c: c["content"]), "")).alias("digest"))


@query("f15_paragraph_chunks")
def _(spark, sf):
    from recordloom.functions.chunking import chunk_text
    d = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return chunk_text(d, "text").select("doc_id", "chunk_index", "chunk_count", F.length("chunk").alias("chars"))


@query("w05_task_violations")
def _(spark, sf):
    rows = task_blocks(spark, sf).select("chain_id", "idx", "approx_tokens", "items_done", "chunks_sealed", "approx_tokens_ingested")
    harmed = rows.withColumn("items_done", F.when(F.pmod("idx", F.lit(17)) == 5, 0).otherwise(F.col("items_done")))
    return ingest.task_violations(harmed)


# events carry a running state whose every 13th row is wrong: the SQL-checkable form of the same operator
_STATE = EVENTS + """,
s0 as (select chain_id, idx, 1+k*20 as approx_tokens, idx+1 as chunks_sealed, sum(case when k%3=0 then 1 else 0 end) over w as items_done, sum(1+k*20) over w as approx_tokens_ingested
  from lg window w as (partition by chain_id order by idx)),
st as (select chain_id, idx, approx_tokens, case when idx%13=7 then chunks_sealed+1 else chunks_sealed end as chunks_sealed,
  case when idx%13=9 then 0 else items_done end as items_done, case when idx%13=11 then 1 else approx_tokens_ingested end as approx_tokens_ingested from s0)"""


def harmed_state(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf)).withColumn("k", F.get_json_object("content_json", "$.k").cast("long"))
    run = budget.running_sum(log, ["chain_id"], F.expr("idx div 16"), ["idx"], {
        "items_done": F.when(F.pmod("k", F.lit(3)) == 0, 1).otherwise(0), "approx_tokens_ingested": 1 + F.col("k") * 20})
    at = lambda r: F.pmod("idx", F.lit(13)) == r
    return run.select("chain_id", "idx", (1 + F.col("k") * 20).alias("approx_tokens"),
                      F.when(at(7), F.col("idx") + 2).otherwise(F.col("idx") + 1).alias("chunks_sealed"),
                      F.when(at(9), 0).otherwise(F.col("items_done")).alias("items_done"),
                      F.when(at(11), 1).otherwise(F.col("approx_tokens_ingested")).alias("approx_tokens_ingested"))


@query("w05_state_violations", _STATE + """,
p as (select *, lag(items_done) over w as pi, lag(chunks_sealed) over w as pc, lag(approx_tokens_ingested) over w as pt from st window w as (partition by chain_id order by idx))
select chain_id, idx, 'data-height over max' as issue from p where approx_tokens>1536 union all
select chain_id, idx, 'items_done regressed' from p where chunks_sealed<>1 and items_done<pi union all
select chain_id, idx, 'chunks_sealed not monotonic +1' from p where chunks_sealed<>1 and chunks_sealed<>pc+1 union all
select chain_id, idx, 'tokens ingested regressed' from p where chunks_sealed<>1 and approx_tokens_ingested<pt""")
def _(spark, sf):
    return ingest.task_violations(harmed_state(spark, sf))


@query("w06_running_state", _STATE + " select chain_id, idx, items_done::bigint as items_done, approx_tokens_ingested::bigint as approx_tokens_ingested from s0")
def _(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf)).withColumn("k", F.get_json_object("content_json", "$.k").cast("long"))
    return budget.running_sum(log, ["chain_id"], F.expr("idx div 16"), ["idx"], {
        "items_done": F.when(F.pmod("k", F.lit(3)) == 0, 1).otherwise(0), "approx_tokens_ingested": 1 + F.col("k") * 20}).select(
        "chain_id", "idx", F.col("items_done").cast("long"), "approx_tokens_ingested")


@query("w06_findings", f"""with {FR},
f as (select chain_id, file_index, relative_path || ': ' || (length(text)-length(replace(text,chr(10),''))+1) || ' lines, ' || ((length(text)-length(replace(text,'def ','')))//4) || ' defs, '
  || ((length(text)-length(replace(text,'class ','')))//6) || ' classes' as f, doc_id from fr)
select chain_id, file_index, md5(string_agg(f,'|') over (partition by chain_id order by file_index rows between 5 preceding and current row)) as digest from f""")
def _(spark, sf):
    rows = file_rows(spark, sf)
    t = F.col("text")
    finding = F.concat((tx.occurrences(t, "\n") + 1).cast("string"), F.lit(" lines, "), tx.occurrences(t, "def ").cast("string"),
                       F.lit(" defs, "), tx.occurrences(t, "class ").cast("string"), F.lit(" classes"))
    found = ingest.task_findings(rows.select("chain_id", "file_index", "relative_path", finding.alias("finding")))
    return found.select("chain_id", "file_index", F.md5(F.array_join("findings", "|")).alias("digest"))


def doc_blocks(spark, sf):
    """Whole documents as single blocks, for the operators that only need stored coordinates."""
    r = file_rows(spark, sf)
    ext = tx.extension(F.col("relative_path"))
    return r.select("chain_id", F.col("file_index").alias("idx"), "relative_path", tx.path_role(F.col("relative_path"), ext).alias("path_role"),
                    tx.language(ext).alias("language"), ext.alias("extension"), F.substring_index("relative_path", "/", 1).alias("top_dir"),
                    F.col("text").alias("content"), tx.approx_tokens(F.col("text")).alias("approx_tokens"), "doc_id",
                    F.sha2("text", 256).alias("file_content_hash"))


@query("a13_height_stats", f"""with {FR}, b as (select chain_id, greatest(1,length(text)//4) as t, strlen(text) as s from fr)
select chain_id, count(*) as blocks, min(t) as min_tokens, sum(t)::bigint//count(*) as avg_tokens, max(t) as max_tokens, min(s) as min_bytes, sum(s)::bigint//count(*) as avg_bytes, max(s) as max_bytes from b group by 1""")
def _(spark, sf):
    return ingest.height_stats(doc_blocks(spark, sf))


def renamed(spark, sf):
    """Stored blocks of three walks over fewer paths, so that a path has several digests."""
    return doc_blocks(spark, sf).withColumn("relative_path", F.concat(F.lit("p"), F.pmod("doc_id", F.lit(9)).cast("string")))


_RN = f"""with {FR}, rn as (select chain_id, file_index as idx, 'p' || (doc_id%9) as relative_path, sha256(text) as h, doc_id from fr)"""


@query("a08_latest_hashes", _RN + " select chain_id, relative_path, arg_max(h, idx) as file_content_hash from rn group by 1,2")
def _(spark, sf):
    return ingest.latest_hashes(renamed(spark, sf))


@query("j10_changed_files", _RN + """, l as (select chain_id, relative_path, arg_max(h, idx) as old from rn where doc_id%4<>1 group by 1,2)
select rn.doc_id, rn.relative_path from rn left join l using (chain_id, relative_path) where old is null or old<>h""")
def _(spark, sf):
    live = renamed(spark, sf).withColumnRenamed("content", "text").select("chain_id", "relative_path", "text", "doc_id")
    return ingest.changed_files(live, renamed(spark, sf).where("doc_id % 4 <> 1")).select("doc_id", "relative_path")


@query("j09_source_verdicts", """
select doc_id as idx, case when doc_id%11=0 then 'missing-ring' when doc_id%11=1 then 'not-a-file-record' when doc_id%11=2 then 'no-source-path' when doc_id%11=3 then 'missing-source-file'
 when doc_id%11=4 then 'source-mismatch' when doc_id%11=5 then 'dirty-worktree' when doc_id%11=6 then 'revision-drift' when doc_id%11=7 then 'git-unverifiable' else 'verified' end as verdict from documents""")
def _(spark, sf):
    m = F.pmod("doc_id", F.lit(11))
    path = F.concat(F.lit("f/"), F.col("doc_id").cast("string"))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("h"))
    stored_ = d.select(
        F.lit(0).cast("long").alias("chain_id"), F.col("doc_id").alias("idx"), (m != 0).alias("found"), F.when(m == 1, "response").otherwise("file").alias("rec_type"),
        F.when(m != 2, path).alias("source_path"), F.when(m == 4, F.sha2("h", 256)).otherwise(F.col("h")).alias("stored_hash"),
        F.when(m.isin(5, 6, 7, 8), "c1").alias("stored_commit"))
    live = d.where(m != 3).select(path.alias("source_path"), F.col("h").alias("live_hash"), F.when(m == 6, "c2").when(m != 7, "c1").alias("live_commit"),
                                  F.when(m != 7, m == 5).alias("live_dirty"))
    return ingest.source_verdicts(stored_, live).select("idx", "verdict")


@query("j12_missing_chunks", EVENTS + " select chain_id, idx from lg where k%4=0")
def _(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf))
    have = log.where(F.get_json_object("content_json", "$.k").cast("long") % 4 != 0)
    return ingest.missing_chunks(log, have).select("chain_id", "idx")


@query("s10_replaced_chunks", "select doc_id//2 as idx, doc_id, case when (doc_id//2)%3=0 then 'new' else 'old' end as version from documents")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit(0).alias("chain_id"), F.expr("doc_id div 2").alias("idx"), "doc_id")
    fresh = d.where("idx % 3 = 0").withColumn("version", F.lit("new"))
    return ingest.replace_chunks(d.withColumn("version", F.lit("old")), fresh).select("idx", "doc_id", "version")


@query("j17_reconcile", """
select coalesce(m.name, l.name) as name, case when m.name is null then 'active' when l.name is null and m.status<>'missing' then 'missing' else m.status end as status,
 case when m.name is null then 'orphan_recovered' when l.name is null and m.status<>'missing' then 'stale_marked' else 'kept' end as action
from (select 'd' || doc_id as name, case when doc_id%7=0 then 'missing' else 'active' end as status from documents where doc_id%5<>0) m
full join (select 'd' || doc_id as name from documents where doc_id%3<>0) l on m.name=l.name""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    m = d.where("doc_id % 5 <> 0").select("name", F.when(F.col("doc_id") % 7 == 0, "missing").otherwise("active").alias("status"))
    return ingest.reconcile(m, d.where("doc_id % 3 <> 0").select("name"))


@query("j18_resolve_names", """
with r as (select p_partkey, lower(p_name) as n, lower(p_brand || ' ' || p_type) as o from part),
h as (select distinct c_mktsegment as hint from customer union select distinct r_name from region union select distinct s from (select unnest(string_split(p_type,' ')) as s from part) union select 'Brand#1' union select p_name from part where p_partkey=7),
e as (select hint, min(p_name) as exact_name from h join part on lower(p_name)=lower(hint) group by 1),
f as (select hint, count(*) as candidates from h join r on contains(n, lower(hint)) or contains(o, lower(hint)) group by 1)
select h.hint, case when exact_name is not null then 'exact' when candidates>0 then 'ambiguous' else 'not_found' end as status, exact_name,
 case when exact_name is null then coalesce(candidates,0) else 1 end as candidates from h left join e using (hint) left join f using (hint)""")
def _(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    part = t("part")
    hints = (t("customer").select(F.col("c_mktsegment").alias("hint")).union(t("region").select("r_name"))
             .union(part.select(F.explode(F.split("p_type", " ")))).union(part.select(F.lit("Brand#1")).limit(1))
             .union(part.where("p_partkey = 7").select("p_name"))).distinct()
    return ingest.resolve_names(hints, part.select(F.col("p_name").alias("name"), F.concat("p_brand", F.lit(" "), "p_type").alias("objective")))


@query("j20_genesis_drift", EVENTS + """
select chain_id, case when rec_type<>'genesis' then 'unexpected' else 'drift' end as status from lg where idx=0""")
def _(spark, sf):
    return ingest.genesis_drift(logs.unlinked(logs.events_rows(spark, sf)), ["be honest"])


# --- path-aware ranking -----------------------------------------------------------------
def asks(spark, sf):
    """One question per source: the benchmark item of that number, with path hints."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text"))
    n = F.pmod("item_id", F.lit(20))
    return b.select(F.col("item_id").alias("query_id"), n.alias("chain_id"), "text",
                    F.when(F.pmod("item_id", F.lit(2)) == 0, F.concat(F.lit("src"), n.cast("string"), F.lit("/lib"))).alias("dir"),
                    F.when(F.pmod("item_id", F.lit(3)) == 0, "docs").alias("role"), F.when(F.pmod("item_id", F.lit(5)) == 0, "vendor").alias("exclude_dir"))


_PATH = f"""with {FR},
bl as (select chain_id, file_index as idx, relative_path, folder, ext, text, case folder when 'build' then 'generated' when 'vendor' then 'vendor' when 'test' then 'test' when 'docs' then 'docs' else
  case when ext in ('.md','.txt') then 'docs' when ext='.json' then 'config' when ext in ('.py','.go','.js') then 'source' else 'other' end end as path_role, source from fr),
q as (select item_id as query_id, item_id%20 as chain_id, text, item_id%2=0 as hinted, item_id%3=0 as docs_only, item_id%5=0 as no_vendor from benchmark),
qw as (select distinct query_id, chain_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as w from q), qn as (select *, count(*) over (partition by query_id) as n from qw where w not in {words(LEX.stop)}),
bw as (select distinct chain_id, idx, unnest(regexp_extract_all(lower(text), '{TOK}')) as w from bl),
sm as (select query_id, chain_id, idx, count(*)/any_value(n) as sim from qn join bw using (chain_id, w) group by query_id, chain_id, idx),
mx as (select chain_id, max(idx) as m from bl group by 1),
sc as (select sm.query_id, sm.chain_id, sm.idx, relative_path, round(0.7*sim + 0.2*case when not hinted then 0 when folder='lib' then 0.8 else 0.6*1/2 end + 0.1*sm.idx/greatest(m,1)
   - case when not docs_only and path_role in ('test','docs','generated','vendor') then 0.15 else 0 end, 4) as score
  from sm join bl using (chain_id, idx) join q using (query_id, chain_id) join mx using (chain_id) where (not docs_only or path_role='docs') and (not no_vendor or folder<>'vendor')),
hit as (select * from sc qualify row_number() over (partition by query_id order by score desc, idx)<=8)"""


@query("t07_path_aware", _PATH + " select query_id, chain_id, idx, round(score,4)::double as score from hit")
def _(spark, sf):
    found = retrieval.path_aware(doc_blocks(spark, sf), asks(spark, sf), k=8, neighbours=0, stop=LEX.stop)
    return found.select("query_id", "chain_id", "idx", F.round("score", 4).alias("score"))


@query("j05_neighbours", _PATH + """,
nb as (select h.query_id, h.chain_id, h.idx+o as idx, h.score-0.001 as score, h.idx as of from hit h, (values (-1),(1)) t(o)),
nx as (select query_id, chain_id, idx, max(score) as score, arg_min(of, (-score, of)) as neighbour_of from nb where exists (select 1 from bl where bl.chain_id=nb.chain_id and bl.idx=nb.idx)
  and not exists (select 1 from hit h where h.query_id=nb.query_id and h.idx=nb.idx) group by all)
select query_id, chain_id, idx, round(score,4)::double as score, null::bigint as neighbour_of from hit union all select query_id, chain_id, idx, round(score,4)::double, neighbour_of from nx""")
def _(spark, sf):
    b = doc_blocks(spark, sf)
    hits = retrieval.path_aware(b, asks(spark, sf), k=8, neighbours=0, stop=LEX.stop)
    return retrieval.with_neighbours(b, hits, 1, ["chain_id"], "idx").select(
        "query_id", "chain_id", "idx", F.round("score", 4).alias("score"), "neighbour_of")


# --- mining -----------------------------------------------------------------------------
def mined(spark, sf):
    """Dialogues of one language region as one long chain: turns of twenty conversations in a row."""
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    placed = positions(t.withColumn("chain_id", F.expr("conv_id div 20")), ["chain_id"], F.expr("conv_id"), ["turn"], "idx")
    kind = F.when(F.pmod(F.length("text"), F.lit(7)) == 0, "revision").when(F.col("role") == "user", "observation").when(
        F.col("role") == "assistant", "response").otherwise("system_prompt")
    disputed = F.when(F.pmod(F.length("text"), F.lit(11)) == 0, F.lit('{"_meta":{"epistemic_class":"disputed"},')).otherwise(F.lit("{"))
    return placed.select("chain_id", F.col("idx").cast("long").alias("idx"), (F.lit(1_700_000_000_000) + F.col("conv_id") * 86_400_000 + F.col("turn") * 60_000).alias("ts_ms"),
                         kind.alias("rec_type"), F.concat(disputed, F.substr(F.to_json(F.struct("text")), F.lit(2))).alias("content_json"), F.lit("w0").alias("writer"))


_MN = f"""with mn as (select conv_id//20 as chain_id, row_number() over (partition by conv_id//20 order by conv_id, turn)-1 as idx, 1700000000000+conv_id*86400000+turn*60000 as ts_ms, text,
  case when length(text)%7=0 then 'revision' when role='user' then 'observation' when role='assistant' then 'response' else 'system_prompt' end as rec_type, length(text)%11=0 as disputed from conversations),
tk as (select chain_id, idx, unnest(regexp_extract_all(lower(text), '{TOK}')) as w, generate_subscripts(regexp_extract_all(lower(text), '{TOK}'),1) as pos from mn),
k as (select chain_id, idx, w, row_number() over (partition by chain_id, idx order by count(*) desc, min(pos)) as p from tk where not contains(w,'''') and not contains(w,'-') and length(w)>2 and w not in {words(fv.STOPWORDS)} group by chain_id, idx, w),
sg as (select chain_id, idx, string_agg(w,'+' order by w) as signature from k where p<=3 group by all),
ev as (select 'corrections' as trigger, chain_id, signature, idx from sg join mn using (chain_id, idx) where rec_type='revision'
 union all select 'failures', chain_id, signature, idx from sg join mn using (chain_id, idx) where rec_type in ('observation','response') and (contains(lower(text),'thth') or contains(lower(text),'ouou'))
 union all select 'confusion', chain_id, 'confusion:' || coalesce(signature,'general'), idx from mn left join sg using (chain_id, idx) where rec_type='observation' and contains(lower(text),'reti'))"""
FAIL_WORDS, CONFUSE_WORDS = ["thth", "ouou"], ["reti"]


def _evidence(spark, sf):
    rows = mining.with_text(mined(spark, sf))
    parts = [mining.topic_rows(rows, k, markers=m).withColumn("trigger", F.lit(k)) for k, m in (
        ("corrections", None), ("failures", FAIL_WORDS), ("confusion", CONFUSE_WORDS))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a15_topic_evidence", _MN + " select trigger, chain_id, signature, idx from ev")
def _(spark, sf):
    return _evidence(spark, sf)


@query("a15_topic_clusters", f"""with c as (select doc_id, lang, source from documents),
tk as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as w, generate_subscripts(regexp_extract_all(lower(text), '{TOK}'),1) as pos from documents),
k as (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, min(pos)) as p from tk where not contains(w,'''') and not contains(w,'-') and length(w)>2 and w not in {words(LEX.stop)} group by doc_id, w),
sg as (select doc_id, string_agg(w,'+' order by w) as signature from k where p<=3 group by 1)
select 0::bigint as chain_id, signature, count(*) as hits, min(doc_id) as first_idx, max(doc_id) as last_idx from sg group by 2 having count(*)>=3""")
def _(spark, sf):
    rows = spread(spark.read.parquet(f"{sf}/documents.parquet").select(
        F.lit(0).cast("long").alias("chain_id"), F.col("doc_id").alias("idx"), F.lit("revision").alias("rec_type"), "text"))
    return mining.topic_clusters(mining.topic_rows(rows, "corrections", LEX.stop))


@query("a22_contradictions", _MN + " select chain_id, idx from mn where disputed")
def _(spark, sf):
    return mining.contradiction_rows(mined(spark, sf)).select("chain_id", "idx")


_OM = _MN + """,
rs as (select chain_id, idx, ts_ms from mn where rec_type='response' and regexp_replace(text,'\\s','','g')<>''),
rw as (select k.chain_id, k.idx, p, w, ts_ms from k join rs using (chain_id, idx) where p<=12),
fq as (select chain_id, w, count(*) as tf, min(idx*100+p) as f from rw group by all), dc as (select chain_id, count(distinct idx) as d from rw group by 1),
sl as (select *, row_number() over (partition by chain_id order by tf desc, f) as r from fq),
vc as (select chain_id, w, tf, row_number() over (partition by chain_id order by r) as place from sl join dc using (chain_id) where r<=16 and tf<=0.6*d and w not in ('elle','aux')),
v4 as (select * from vc where place<=4),
ht as (select chain_id, idx, ts_ms from rw join v4 using (chain_id, w) group by all having count(*)>=2),
bd as (select chain_id, count(*) as hits, max(ts_ms)-min(ts_ms) as spread_ms, min(idx) as first_idx, max(idx) as last_idx from ht group by 1),
gt as (select bd.*, count(rs.idx) as responses, count(*) filter (rs.idx between first_idx and last_idx) > hits as interleaved from bd join rs using (chain_id) group by bd.chain_id, hits, spread_ms, first_idx, last_idx),
nm as (select chain_id, string_agg(w,'+' order by w) as ws, count(*) as n from v4 group by 1)"""


@query("a23_vocabulary", _OM + " select chain_id, w as word, tf, tf as df, place from v4")
def _(spark, sf):
    replies = mining.with_text(mined(spark, sf).where("rec_type = 'response'"))
    top = tx.top_words(tx.keyword_tokens(tx.tokenize(F.col("text"))), 12)
    found = replies.select("chain_id", "idx", F.posexplode(tx.words_of(top)).alias("place", "word"))
    return mining.vocabulary(found, ["elle", "aux"]).withColumn("place", F.col("place").cast("long"))


@query("a24_w08_output_modes", _OM + """ select chain_id, 'outputmode:' || ws as signature, hits, responses, spread_ms, interleaved, first_idx, last_idx,
 responses>=5 and hits>=5 and spread_ms>=7200000 and interleaved and n>=2 as passes from gt join nm using (chain_id)""")
def _(spark, sf):
    return mining.output_modes(mined(spark, sf), ["elle", "aux"])[0].drop("words")


@query("c06_mined_patterns", _OM + """,
cl as (select trigger, case trigger when 'corrections' then 'principle' when 'failures' then 'skill' else 'modality' end as kind, chain_id, signature, count(*) as hits from ev group by all having count(*)>=3
 union all select 'contradiction', 'sense', chain_id, 'contradiction-handling', count(*) from mn where disputed group by chain_id having count(*)>=3
 union all select 'output_mode', 'modality', chain_id, 'outputmode:' || ws, hits from gt join nm using (chain_id) where responses>=5 and hits>=5 and spread_ms>=7200000 and interleaved and n>=2)
select trigger, kind, chain_id, signature, hits, 'proposal' as decision from cl""")
def _(spark, sf):
    found = mining.mine(stored(mined(spark, sf)), known=["elle", "aux"], failure_markers=FAIL_WORDS, confusion_markers=CONFUSE_WORDS)
    return found.select("trigger", "kind", "chain_id", "signature", "hits", "decision")


@query("r01_scan_window", EVENTS + """, e as (select chain_id, max(idx)+1 as n, max(user_id)%90 as m from lg group by 1)
select chain_id, idx from lg join e using (chain_id) where idx>=greatest(case when m>n then 0 else m end - 10, 0)""")
def _(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf))
    marks = log.select("chain_id").distinct().withColumn("watermark", F.pmod(F.expr("chain_id div 1048576"), F.lit(90)))
    return mining.scan_window(log, marks, 10).select("chain_id", "idx")


@query("r09_newly_escalated", GOV + " select chain_id, idx, sightings from rc where sightings>=3 and not exists (select 1 from gv s where s.chain_id=rc.chain_id and s.rec_type='proposal_status' and s.back=rc.idx and s.new_status='declined')")
def _(spark, sf):
    log = logs.unlinked(logs.governance_rows(spark, sf)).withColumn("content_json", F.replace("content_json", F.lit("declined"), F.lit("escalated")))
    return mining.newly_escalated(log)


@query("r10_graduations", GOV + " select 'm' || idx as name, chain_id, idx as proposal_idx, sightings, 'active' as new_status from rc where idx%2=0 and sightings>=3")
def _(spark, sf):
    log = logs.unlinked(logs.governance_rows(spark, sf))
    sprouts = log.where("rec_type = 'proposal'").select(F.concat(F.lit("m"), F.col("idx").cast("string")).alias("name"), "chain_id",
                                                        F.col("idx").alias("proposal_idx"), F.when(F.col("idx") % 2 == 0, "tentative").otherwise("active").alias("status"))
    return mining.graduations(log, sprouts)


# --- defence ------------------------------------------------------------------------------
def scars_of(spark, sf):
    """Learned scars: the ten longest words of every benchmark item."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    by_len = F.transform(F.sort_array(F.transform(F.array_distinct(tx.tokenize(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda s: s["w"])
    return b.select(F.concat(F.lit("scar"), F.col("item_id").cast("string")).alias("scar_id"), F.col("item_id").alias("ordinal"), F.slice(by_len, 1, 10).alias("vector"))


_SC = f"""with vw as (select item_id, w from (select distinct item_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as w from benchmark) qualify row_number() over (partition by item_id order by length(w) desc, encode(w))<=10),
vn as (select item_id, count(*) as n from vw group by 1),
dw as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as w from documents),
mt as (select doc_id, item_id, count(*) as shared from dw join vw using (w) group by all),
ok as (select * from mt join vn using (item_id) where shared>=greatest(2, n//2)),
fs as (select doc_id, min(item_id) as item_id from ok group by 1)"""


def texts(spark, sf):
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text"))


@query("j14_scar_matches", _SC + " select doc_id as text_id, 'scar' || item_id as scar_id, shared from fs join mt using (doc_id, item_id)")
def _(spark, sf):
    return defence.match_scars(texts(spark, sf), scars_of(spark, sf))


def _viol(col):
    return "(" + "+".join("cast(contains(lower(%s),'%s') as integer)" % (col, v) for v in fv.VIOLATIONS) + ")"


@query("p22_screen", _SC + f" select doc_id as text_id, round(greatest(0.0, 0.92-0.45*{_viol('text')}),3)::double as covenant, 'scar' || item_id as scar, 0.92-0.45*{_viol('text')}<0.55 or item_id is not null as blocked from documents left join fs using (doc_id)")
def _(spark, sf):
    return defence.screen(texts(spark, sf), scars_of(spark, sf))


def poisoned(spark, sf):
    """The dialogues with a violating sentence sealed into some records."""
    rows = logs.conversation_rows(spark, sf)
    bad = (F.pmod("chain_id", F.lit(5)) == 2) & (F.col("seq") >= 1) & (F.pmod("seq", F.lit(3)) == 1)
    return logs.append(rows.withColumn("content_json", F.when(bad, F.concat(
        F.lit('{"text":"please deceive and manipulate them '), F.col("chain_id").cast("string"), F.lit('"}'))).otherwise(F.col("content_json"))))


_PO = CONV + """, po as (select *, chain_id%5=2 and idx>=1 and idx%3=1 and rec_type<>'system_prompt' as bad from lg),
fb as (select chain_id, min(idx) as first_bad, count(*) as breaches from po where bad group by 1), hd as (select chain_id, max(idx) as head, count(*) as n from po group by 1)"""


@query("c13_intrusion_scan", _PO + """ select hd.chain_id, true as intact, 'chain ok (' || n || ' records)' as message, coalesce(breaches,0) as breaches, first_bad as first_bad_height,
 breaches is not null as compromised from hd left join fb using (chain_id)""")
def _(spark, sf):
    return defence.intrusion_scan(stored(poisoned(spark, sf)))


def _rolled(spark, sf):
    log = stored(poisoned(spark, sf))
    first = defence.breaches(log).groupBy("chain_id").agg(F.min("idx").alias("first_bad"))
    return log, defence.rollback(log, first)


@query("c14_quarantine_ranges", _PO + " select chain_id, first_bad as from_idx, head as to_idx from fb join hd using (chain_id)")
def _(spark, sf):
    return _rolled(spark, sf)[1][0]


@query("a17_scar_vectors", _PO + f""",
tx as (select chain_id, idx, case when chain_id%5=2 and idx>=1 and idx%3=1 then 'please deceive and manipulate them ' || chain_id else text end as t from po join fb using (chain_id) where idx>=first_bad),
tk as (select chain_id, idx, unnest(regexp_extract_all(lower(t), '{TOK}')) as w, generate_subscripts(regexp_extract_all(lower(t), '{TOK}'),1) as pos from tx),
c as (select chain_id, w, row_number() over (partition by chain_id order by count(*) desc, min(idx*100000+pos)) as p from tk group by chain_id, w)
select chain_id, 'scar1' as scar_id, string_agg(w,' ' order by p) as vector from c where p<=8 group by 1""")
def _(spark, sf):
    return _rolled(spark, sf)[1][1].select("chain_id", "scar_id", F.array_join("vector", " ").alias("vector"))


@query("c14_recovery_appended", _PO + " select chain_id, head+1 as idx, 'recovery' as rec_type, first_bad-1 as resumed_from from fb join hd using (chain_id)")
def _(spark, sf):
    log, (_, _, recovery) = _rolled(spark, sf)
    added = logs.append(recovery, logs.heads(log))
    return added.select("chain_id", "idx", "rec_type", F.get_json_object("content_json", "$.resumed_from_height").cast("long").alias("resumed_from"))


@query("a26_immune_status", _PO + """ select hd.chain_id, n as length, coalesce(first_bad, n) as active, coalesce(first_bad-1, head) as active_head, case when first_bad is null then 0 else 1 end::bigint as scars
 from hd left join fb using (chain_id)""")
def _(spark, sf):
    log, (ranges, scars, _) = _rolled(spark, sf)
    return defence.immune_status(log, ranges, scars)


@query("a28_defence_status", _PO + """ select count(*) as chains, count(*) as intact, sum(n)::bigint as records, coalesce(sum(head-first_bad+1),0)::bigint as quarantined, count(first_bad) as scars,
 count(*) as attested, count(*) as quorum_ok from hd left join fb using (chain_id)""")
def _(spark, sf):
    log, (ranges, scars, _) = _rolled(spark, sf)
    report = quorum.quorum_report(log, quorum.attest_heads(log, WITNESSES), WITNESSES)
    return defence.defence_status(log, ranges, scars, report)


# --- growth ---------------------------------------------------------------------------------
def faculty_rows(spark, sf):
    """A registry derived from the benchmark items: their words are what each entry covers."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    return growth.with_tokens(b.select(
        F.when(F.pmod("item_id", F.lit(2)) == 0, "sense").otherwise("modality").alias("kind"), F.concat(F.lit("data:"), F.col("item_id").cast("string")).alias("id"),
        F.concat(F.lit("Faculty "), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("function"),
        F.concat(F.lit("c"), F.pmod("item_id", F.lit(4)).cast("string")).alias("category")))


_FT = f"list_distinct(list_filter(regexp_extract_all(lower(TT), '{TOK}'), lambda w: length(w)>1 and w not in {words(fv.STOPWORDS)}))"
_GP = f"""with fk as (select item_id, 'data:' || item_id as id, case when item_id%2=0 then 'sense' else 'modality' end as kind, {_FT.replace('TT', "'Faculty ' || item_id || ' ' || text")} as ts from benchmark),
fw as (select id, kind, unnest(ts) as w from fk), iw0 as (select doc_id, {_FT.replace('TT', 'text')} as ws from documents), iw as (select doc_id, unnest(ws) as w from iw0),
cv as (select doc_id, count(distinct w) as c from iw join fw using (w) group by 1),
ac as (select doc_id, id, kind, count(*) as m, row_number() over (partition by doc_id order by count(*) desc, kind, id) as p from iw join fw using (w) group by doc_id, id, kind),
un as (select doc_id, w, row_number() over (partition by doc_id order by length(w) desc, encode(w)) as p from iw where w not in (select w from fw)),
gp as (select doc_id, len(ws) as n, case when len(ws)=0 then 1.0 else coalesce(c,0)/len(ws) end as ratio from iw0 left join cv using (doc_id))"""


def inputs(spark, sf):
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("input_id"), "text"))


@query("j13_t11_faculty_gap", _GP + """ select doc_id as input_id, n::int as n_words, round(ratio,3)::double as coverage_ratio, round_even((1-ratio)*255,0)::int as dissonance,
 coalesce((select string_agg(w,' ' order by p) from un where un.doc_id=gp.doc_id and p<=5),'') as uncovered, coalesce((select string_agg(id || ':' || m,' ' order by p) from ac where ac.doc_id=gp.doc_id and p<=5),'') as top from gp""")
def _(spark, sf):
    g = growth.faculty_gap(inputs(spark, sf), faculty_rows(spark, sf))
    return g.select("input_id", "n_words", "coverage_ratio", "dissonance", F.array_join(F.slice("uncovered", 1, 5), " ").alias("uncovered"),
                    F.coalesce(F.array_join(F.transform("top_activated", lambda t: F.concat(t["id"], F.lit(":"), t["matched"].cast("string"))), " "), F.lit("")).alias("top"))


@query("c15_proposed_faculties", _GP + """,
pr as (select gp.*, round_even((1-ratio)*255,0) as ds, a.id as ia, b.id as ib, coalesce(a.m>=2 and b.m>=2,false) and round_even((1-ratio)*255,0)<210 as fuse from gp left join ac a on a.doc_id=gp.doc_id and a.p=1 left join ac b on b.doc_id=gp.doc_id and b.p=2)
select doc_id as input_id, case when fuse then 'fusion(' || ia || '+' || ib || ')' else 'sprout' end as origin, ds::int as dissonance from pr where ds>150""")
def _(spark, sf):
    reg = faculty_rows(spark, sf)
    i = inputs(spark, sf)
    return growth.propose_faculties(growth.faculty_gap(i, reg), i, reg).select("input_id", "origin", "dissonance")


@query("c15_faculty_growth", _GP + f""",
us as (select doc_id, list(w order by p) as u from un group by 1),
p0 as (select gp.doc_id, round_even((1-ratio)*255,0)::int as ds, a.id as ia, b.id as ib, a.kind as ka, b.kind as kb, coalesce(a.m>=2 and b.m>=2,false) and round_even((1-ratio)*255,0)<{fv.SPROUT_AT} as fuse,
 list_has_any(ws, {list(fv.REASON_VERBS)}) as reasons, coalesce(u, []) as u, list_filter(coalesce(u, []), lambda w: length(w)>=4) as lu
 from gp join iw0 using (doc_id) left join us using (doc_id) left join ac a on a.doc_id=gp.doc_id and a.p=1 left join ac b on b.doc_id=gp.doc_id and b.p=2),
p1 as (select *, case when len(lu)>0 then lu[1:6] else u[1:6] end as sd, case when fuse then case when ka='sense' and kb='sense' then 'sense' else 'modality' end when reasons then 'modality' else 'sense' end as kind from p0 where ds>{fv.DISSONANCE_FLOOR}),
pp as (select doc_id, kind, case when fuse then 'Faculty ' || substr(ia,6) || ' × Faculty ' || substr(ib,6) || ' Fusion' else case when len(sd)>0 then array_to_string(list_transform(sd[1:2], lambda w: upper(w[1]) || w[2:]),'-') else 'Novel' end
  || case when kind='sense' then ' Sensing' else ' Reasoning' end end as name, case when fuse then [ia, ib] else [] end as parents, case when fuse then [] else sd end as seeds from p1),
em as (select name, arg_min(kind, doc_id) as kind, arg_min(parents, doc_id) as parents, arg_min(seeds, doc_id) as seeds, min(doc_id) as o from pp where doc_id%5=0 group by 1),
hit as (select pp.doc_id, arg_min('E' || o, o) as eid from pp join em on pp.name=em.name or (len(pp.parents)>0 and pp.parents=em.parents) or (len(list_intersect(pp.seeds, em.seeds))>0
  and 2*len(list_intersect(pp.seeds, em.seeds)) >= len(pp.seeds)+len(em.seeds)-len(list_intersect(pp.seeds, em.seeds))) group by 1),
sn as (select eid, count(*) as more from hit group by 1),
gr as (select 'E' || o as eid, name, kind, 1+coalesce(more,0) as recurrence, more is not null as touched, 'emergent' as status from em left join sn on sn.eid='E' || o
 union all select null, name, arg_min(kind, doc_id), count(*), true, 'new' from pp where doc_id not in (select doc_id from hit) group by name)
select eid, name, kind, recurrence, case when not touched then 'kept' when recurrence>={fv.PROMOTE_AT} then 'promoted' when status='new' then 'born' else 'recurrence' end as action,
 case when touched and recurrence>={fv.PROMOTE_AT} then 'promoted' else 'emergent' end as status from gr""")
def _(spark, sf):
    reg, i = stored(faculty_rows(spark, sf)), stored(inputs(spark, sf))
    prop = stored(growth.propose_faculties(growth.faculty_gap(i, reg), i, reg))
    old = prop.where("input_id % 5 = 0").groupBy("name").agg(
        F.min_by("kind", "input_id").alias("kind"), F.min_by("parents", "input_id").alias("parents"), F.min_by("seed_terms", "input_id").alias("seed_terms"),
        F.min("input_id").alias("ordinal")).withColumns({"recurrence": F.lit(1).cast("long"), "status": F.lit("emergent"), "eid": F.concat(F.lit("E"), F.col("ordinal").cast("string"))})
    return growth.grow(prop, old).drop("parents", "seed_terms")


@query("t09_lens_ranking", _GP + f""",
qw as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as w from documents), qn as (select doc_id, count(*) as nq from qw group by 1),
pr as (select doc_id, fw.id, fw.kind, count(*) as i, any_value(nq) as nq, any_value(len(ts)) as nt from qw join fw using (w) join qn using (doc_id) join fk on fk.id=fw.id group by doc_id, fw.id, fw.kind),
sc as (select doc_id, kind, id, i + i/(nq+nt-i) as score from pr)
select doc_id as query_id, kind, id, round(score,6) as score, row_number() over (partition by doc_id order by score desc, kind, id) as rank from sc qualify rank<=3""")
def _(spark, sf):
    q = inputs(spark, sf).withColumnRenamed("input_id", "query_id")
    return growth.lens_ranking(q, faculty_rows(spark, sf), 3).select("query_id", "kind", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def spec_rows(spark, sf):
    """Detector specs from the event types and the sources, some of them unfit."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().withColumn("n", F.regexp_extract("source", r"(\d+)", 1).cast("int"))
    pats = F.array(F.concat(F.lit("\\bth"), F.char(F.lit(97) + F.col("n"))), F.when(F.col("n") % 3 == 0, "(a+)+").otherwise("ou"), F.lit("nd\\b"))
    return d.select(F.when(F.col("n") % 6 == 5, F.concat(F.lit("Bad "), "source")).otherwise(F.concat(F.lit("mode_"), "source")).alias("name"),
                    F.when(F.col("n") % 6 == 4, F.array().cast("array<string>")).otherwise(pats).alias("patterns"), (F.col("n") / 4).cast("double").alias("threshold"),
                    F.element_at(tx.literal_array(["any", "count", "fraction_lines", "odd"]), (F.col("n") % 4 + 1)).alias("match_mode"), F.lit(True).alias("domain"),
                    F.when(F.col("n") % 2 == 0, "tentative").otherwise("active").alias("status"), F.lit(0.8).alias("weight_factor"))


_SP = """with s as (select distinct source, cast(regexp_extract(source,'(\\d+)',1) as int) as n from documents)"""


@query("d34_d35_valid_specs", _SP + """ select 'mode_' || source as name, case when n%3=0 then 1 else 0 end::int as skipped, least(1.0, n/4)::double as threshold,
 case n%4 when 0 then 'any' when 1 then 'count' else 'fraction_lines' end as match_mode, case when n%2=0 then 'tentative' else 'active' end as status, case when n%2=0 then 0.5 else 0.8 end::double as weight_factor from s where n%6 not in (4,5)""")
def _(spark, sf):
    return growth.validate_specs(spec_rows(spark, sf))[0].drop("patterns", "domain")


@query("d34_rejected_specs", _SP + " select case when n%6=5 then 'Bad ' || source else 'mode_' || source end as name, case when n%6=5 then 'bad name' else 'no patterns' end as reason from s where n%6 in (4,5)")
def _(spark, sf):
    return growth.validate_specs(spec_rows(spark, sf))[1]


def _pattern_sql():
    """One SELECT per source number with its patterns as constants."""
    parts = []
    for n in range(26):
        if n % 6 in (4, 5) or n % 4 == 1:
            continue
        p = "(?i)(?:^|[^\\pL\\pN_])th" + chr(97 + n) + ("" if n % 3 == 0 else "|ou") + "|nd(?:$|[^\\pL\\pN_])"
        if n % 4 == 0:
            parts.append(f"select doc_id, {n} as n, regexp_matches(text, '{p}')::int::double as a from documents")
        else:
            parts.append(f"select doc_id, {n} as n, avg(regexp_matches(l, '{p}')::int) as a from ln group by doc_id")
    return " union all ".join(parts)


@query("d33_pattern_detectors", _SP + """,
l0 as (select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) as l from documents),
ln as (select * from l0 where regexp_replace(l,'\\s','','g')<>''),
h as (""" + _pattern_sql() + """)
select doc_id, 'mode_' || source as spec, round(a,6)::double as activation from h join s using (n) where a>0""")
def _(spark, sf):
    good = growth.spec_list(growth.validate_specs(spec_rows(spark, sf))[0].where("match_mode <> 'count'"))
    d = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    wide = growth.apply_registry(d, good)
    long = wide.select("doc_id", F.explode(F.create_map(*[x for s in good for x in (F.lit(s["name"]), F.col(s["name"]))])).alias("spec", "activation"))
    return long.where("activation > 0").select("doc_id", "spec", r6(F.col("activation")).alias("activation"))


@query("a27_collapsed_perspectives", """
with n as (select l_orderkey as query_id, l_linenumber as i, any_value(l_partkey) as p, l_shipdate, (l_quantity + l_discount*100 + l_tax*100)/3 as v, l_quantity>49 as hint from lineitem group by all),
m as (select query_id, l_linenumber, 1 from (select l_orderkey as query_id, l_linenumber from lineitem)),
x as (select l_orderkey as query_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as idx, round_even((l_quantity + round(l_discount*100) + round(l_tax*100))/3,3) as value, l_quantity>=49 as hint from lineitem),
h as (select query_id, count(*) filter (hint) as nh, arg_max(idx, (hint, value, -idx)) as best from x group by 1)
select query_id, idx as "index", value::double as value, case when nh>1 then 'error' when idx=best then 'sealed' else 'rejected' end as decision from x join h using (query_id)""")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    placed = positions(li, ["l_orderkey"], F.lit(0), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "index")
    notes = placed.select(F.col("l_orderkey").alias("query_id"), (F.col("index") + 1).alias("index"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("name"),
                          F.create_map(F.lit("a"), F.col("l_quantity"), F.lit("b"), F.round(F.col("l_discount") * 100), F.lit("c"), F.round(F.col("l_tax") * 100)).alias("scores"),
                          (F.col("l_quantity") >= 49).alias("chosen_hint"))
    return growth.collapse_perspectives(notes).select("query_id", "index", "value", "decision")


# --- bundles ----------------------------------------------------------------------------------
KEY = "5e1f00aa5e1f00aa5e1f00aa5e1f00aa"


def exported(spark, sf):
    return bundle.export_bundle(logs.events_log(spark, sf), KEY, 1_700_000_000_000, title="t", note="n")


_BN = EVENTS_LINKED + """,
sel as (select ll.*, coalesce(exposure, case when rec_type='genesis' then 'summary' else 'private' end) as ex, ll.chain_id || ':' || writer as bundle_key from ll),
bx as (select *, row_number() over (partition by bundle_key order by idx)-1 as pos, case rec_type when 'genesis' then 'known' when 'observation' then 'user_context' else 'inferred' end as epi from sel where ex in ('summary','shared','public'))"""


@query("p19_p20_exported_records", _BN + """ select bundle_key, idx, pos, ex as exposure, epi as epistemic_class, ex='summary' as redacted,
 case when ex='summary' then '{' || case when supersedes is not null then '' else '' end || '"summary":"(summary withheld)"}' else content_json end as body from bx""")
def _(spark, sf):
    return exported(spark, sf)[1].select("bundle_key", "idx", "pos", "exposure", "epistemic_class", "redacted", "body")


@query("a29_c09_bundle_headers", _BN + ",\nlv as (select bundle_key, pos, record_hash as h from bx),\n" + merkle_levels("lv", "bundle_key", 8) + """,
c as (select bundle_key, count(*) as record_count from bx group by 1),
hh as (select bundle_key, record_count, h as merkle_root, split_part(bundle_key,':',2) as origin from c join t8 using (bundle_key))
select *, sha256('{"created_at":1700000000000,"format_version":2,"merkle_root":"' || merkle_root || '","note":"n","origin":"' || origin || '","record_count":' || record_count || ',"title":"t"}') as bundle_id from hh""")
def _(spark, sf):
    return exported(spark, sf)[0].select("bundle_key", "record_count", "merkle_root", "origin", "bundle_id")


def damaged(spark, sf):
    """Exported bundles of which some were changed on the way."""
    headers, records = exported(spark, sf)
    headers, records = stored(headers), stored(records)
    n = F.pmod(F.expr("cast(substring_index(bundle_key, ':', 1) as bigint) div 1048576"), F.lit(6))
    records = records.withColumn("body", F.when((n == 1) & (F.col("pos") == 1) & ~F.col("redacted"), '{"x":1}').otherwise(F.col("body"))).where(~((n == 2) & (F.col("pos") == 0)))
    return headers.withColumn("title", F.when(n == 3, "changed").otherwise(F.col("title"))), records


@query("c10_bundle_verdicts", _BN + """,
c as (select bundle_key, count(*) as n, max(case when pos=1 and ex<>'summary' then idx end) as second, any_value((chain_id//1048576)%6) as m from bx group by 1)
select bundle_key, not ((m=1 and second is not null) or m=2 or m=3) as ok,
 case when m=1 and second is not null then 'content_hash mismatch at index ' || second when m=2 then case when n=1 then 'no records' else 'record set altered' end when m=3 then 'bundle_id mismatch' else 'bundle ok' end as message from c""")
def _(spark, sf):
    return bundle.verify_bundle(*damaged(spark, sf), KEY).select("bundle_key", "ok", "message")


@query("c11_j11_imported_bundles", _BN + ",\nlv as (select bundle_key, pos, record_hash as h from bx),\n" + merkle_levels("lv", "bundle_key", 8) + f""",
c as (select bundle_key, count(*) as n, max(case when pos=1 and ex<>'summary' then idx end) as second, any_value((chain_id//1048576)%6) as m from bx group by 1),
ok as (select bundle_key, c.n, sha256('{{"created_at":1700000000000,"format_version":2,"merkle_root":"' || h || '","note":"n","origin":"' || split_part(bundle_key,':',2) || '","record_count":' || c.n || ',"title":"t"}}') as bundle_id
  from c join t8 using (bundle_key) where not ((m=1 and second is not null) or m=2 or m=3)),
pl as (select *, {bundle.IMPORT_BASE} + cast('0x' || substr(bundle_id,1,15) as bigint) % {bundle.IMPORT_CHAINS} as chain from ok),
st as (select *, coalesce(sum(n) over (partition by chain order by bundle_key not like '%:w1', bundle_id rows between unbounded preceding and 1 preceding),0)::bigint as start from pl)
select chain as chain_id, start+pos as idx, 'imported_capsule' as rec_type, record_hash as origin_record_hash, 'inferred' as epistemic_class from bx join st using (bundle_key)""")
def _(spark, sf):
    """Some bundles first, then all of them: what the ledger knows is not imported again."""
    headers, records = damaged(spark, sf)
    ledger = f"{shared_dir(spark).rstrip('/')}/imports-{uuid.uuid4().hex}"
    target = None
    for n, some in enumerate((headers.where("bundle_key like '%:w1'"), headers), 1):
        rows, ids = bundle.import_bundle(some, records, KEY, bundle.known_imports(spark, ledger), 1_700_000_000_000 + n)
        linked = stored(logs.append(rows, None if target is None else logs.heads(target)))
        bundle.record_imports(ids, ledger)
        target = linked if target is None else target.unionByName(linked)
    return target.select("chain_id", "idx", "rec_type", F.get_json_object("content_json", "$.origin_record_hash").alias("origin_record_hash"),
                         F.get_json_object("content_json", "$._meta.epistemic_class").alias("epistemic_class"))


@query("c17_resume_reports", f"""with {FR},
m as (select * from (values ('broken', 32, -1), ('resumed', 1000000000, -1), ('changed', 1000000000, 7)) t(moment, upto, harm)),
x as (select moment, chain_id, file_index, file_index < upto as sealed, coalesce(file_index%10=harm, false) and file_index<upto as changed from fr, m)
select moment, chain_id, count(*) as files, count(*) filter (sealed) as sealed, count(*) filter (changed) as changed, min(file_index) filter (not sealed) as next_file, 0::bigint as incoherent,
 case when count(*) filter (changed)>0 then 'changed' when count(*) filter (not sealed)=0 then 'complete' else 'resumable' end as status from x group by moment, chain_id""")
def _(spark, sf):
    """An ingest that breaks off in its third wave, and what is left after it was resumed."""
    files = stored(file_rows(spark, sf).drop("doc_id"))
    job = TaskIngest(spark, f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}", wave=16)
    job.run(files, waves=2)
    job.prepare(files)  # written, never published
    out = stored(job.report(files).withColumn("moment", F.lit("broken")))
    job.wave = 65536
    job.run(files)
    edited = files.withColumn("text", F.when(F.pmod("file_index", F.lit(10)) == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return out.unionByName(job.report(files).withColumn("moment", F.lit("resumed"))).unionByName(job.report(edited).withColumn("moment", F.lit("changed")))


# --- audit ----------------------------------------------------------------------------------------
DATA_DOMAINS = {"Articles": ["the", "der", "die", "la", "le"], "Links": ["and", "und", "et", "of", "de"], "Rare": ["thth", "thon", "rewh"]}


def doc_log(spark, sf):
    d = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"))
    return d.select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("chain_id"), F.col("doc_id").alias("idx"), F.lit("file").alias("rec_type"), F.to_json(F.struct("text")).alias("content_json"))


@query("a09_domain_rollup", f"""with dm(domain, word) as (values {', '.join(f"('{d}','{w}')" for d, ws in DATA_DOMAINS.items() for w in ws)}),
tk as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as word from documents),
h as (select domain, doc_id, word, count(*) as n from tk join dm using (word) group by all),
r as (select domain, count(*) as rings, sum(t)::bigint as est_tokens from (select distinct domain, doc_id, greatest(1,length(text)//4) as t from h join documents using (doc_id)) group by 1),
k as (select domain, string_agg(word || ':' || n, ' ' order by n desc, word) as keywords from (select domain, word, sum(n)::bigint as n from h group by all) group by 1)
select domain, rings, est_tokens, round(rings/max(rings) over (),3)::double as bar, keywords from r join k using (domain)""")
def _(spark, sf):
    out = audit.domain_rollup(doc_log(spark, sf), DATA_DOMAINS, stop=["zu"])
    return out.select("domain", "rings", "est_tokens", "bar", F.array_join(F.transform(
        "keywords", lambda k: F.concat(k["word"], F.lit(":"), k["n"].cast("string"))), " ").alias("keywords"))


@query("a10_category_counts", "select 'c' || (item_id%4) as category, count(*) as n, (select count(*) from benchmark) as total from benchmark group by 1")
def _(spark, sf):
    return audit.category_counts(faculty_rows(spark, sf))


@query("a11_c12_audit_metrics", CONV + """ select count(*) as rings, sum(greatest(1,length(text)//4))::bigint as context_tokens, (select count(*) from benchmark where item_id%2=1) as modalities,
 (select count(*) from benchmark where item_id%2=0) as senses, 'PASS' as integrity from lg""")
def _(spark, sf):
    reg = faculty_rows(spark, sf)
    return audit.audit_metrics(stored(logs.conversation_log(spark, sf)), reg.where("kind = 'modality'"), reg.where("kind = 'sense'"))


@query("a12_ring_list", f"""with tk as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as w, generate_subscripts(regexp_extract_all(lower(text), '{TOK}'),1) as pos from documents),
k as (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, min(pos)) as p from tk where length(w)>1 and w not in {words(LEX.stop)} group by doc_id, w)
select cast(regexp_extract(source,'(\\d+)',1) as bigint) as chain_id, doc_id as idx, replace(regexp_replace(text,'^\\s+|\\s+$','','g'),chr(10),' ')[1:260] as summary,
 coalesce((select string_agg(w,' ' order by p) from k where k.doc_id=documents.doc_id and p<=8),'') as keywords from documents qualify row_number() over (partition by source order by doc_id desc)<=25""")
def _(spark, sf):
    return audit.ring_list(doc_log(spark, sf), 25, stop=LEX.stop).select("chain_id", "idx", "summary", F.array_join("keywords", " ").alias("keywords"))


# --- files --------------------------------------------------------------------------------------
#: Documents of neighbouring ids that share a file.
FILE_DOCS = 4096
PART = f"doc_id div {FILE_DOCS}"


def file_tree(spark, sf, *folders):
    """Documents written as text files of a bounded number of them, by folder and in order of their id."""
    root = f"{shared_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    d = spark.read.parquet(f"{sf}/documents.parquet").select(*folders, F.expr(PART).alias("part"), "doc_id", "text")
    keys = [*folders, "part"]
    d.repartition(*keys).sortWithinPartitions(*keys, "doc_id").drop("doc_id").write.partitionBy(*keys).text(root)
    return root


def _folder(path):
    return F.regexp_replace(path, "/[^/]+$", "").alias("folder")


_IN = f"'source=' || source || '/lang=' || lang || '/part=' || (doc_id // {FILE_DOCS})"


@query("s05_volume_survey", f"""select count(distinct {_IN}) as files, sum(strlen(text)+1)::bigint as bytes, false as over_threshold from documents where source<>'src3'""")
def _(spark, sf):
    return fs.volume_survey(spark, file_tree(spark, sf, "source", "lang"), [".txt"], ["source=src3"])


@query("s04_numbered_files", f"""select folder, row_number() over (order by encode(split_part(folder,'/',1)), encode(split_part(folder,'/',2)), encode(split_part(folder,'/',3))) as file_index from (select distinct {_IN} as folder from documents)""")
def _(spark, sf):
    found = fs.numbered_files(spark, file_tree(spark, sf, "source", "lang"), [".txt"])
    return found.select(_folder("relative_path"), "file_index")


@query("s06_extracted_text", f"""select {_IN} as folder, sum(length(text)+1)::int as chars, 'utf8' as method, false as truncated from documents group by 1""")
def _(spark, sf):
    out = fs.extract_text(fs.scan_files(spark, file_tree(spark, sf, "source", "lang"), [".txt"]))
    return out.select(_folder("relative_path"), F.length("text").alias("chars"), "method", "truncated")


_T = fv.CHUNK_TOKENS
_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"


@query("r08_ranged_chunks", f"""with recursive f as (select 'source=' || source || '/part=' || (doc_id // {FILE_DOCS}) as folder, string_agg(text || chr(10), '' order by doc_id) as body from documents group by 1),
x as (select folder, regexp_extract_all(body, '[^{_ENDS}]*(?:\r\n|[{_ENDS}])') as parts from f),
l as (select folder, unnest(parts) as line, generate_subscripts(parts, 1) as n from x),
ln as (select folder, n, length(line)::bigint as len, length(line)//4 > {_T["max"]} as wide, (sum(length(line)) over (partition by folder order by n))::bigint as upto from l),
r as (select folder, n, case when wide then (len+{4 * _T["max"] - 1})//{4 * _T["max"]} else 1 end as k, case when wide then 0 else len end as open from ln where n=1
 union all select ln.folder, ln.n, r.k + case when wide then (len+{4 * _T["max"] - 1})//{4 * _T["max"]} when r.open>0 and r.open+len < {4 * (_T["target"] + 1)} then 0 else 1 end,
  case when wide then 0 when r.open>0 and r.open+len < {4 * (_T["target"] + 1)} then r.open+len else len end from r join ln on ln.folder=r.folder and ln.n=r.n+1),
p as (select folder, r.k as c, upto-len as a, upto as z, n from r join ln using (folder, n) where not wide
 union all select folder, c, a, least(a+{4 * _T["max"]}, upto), n from (select folder, n, upto, r.k-((len+{4 * _T["max"] - 1})//{4 * _T["max"]})+1+i as c, upto-len+i*{4 * _T["max"]} as a
  from r join ln using (folder, n), unnest(range((len+{4 * _T["max"] - 1})//{4 * _T["max"]})) t(i) where wide)),
c as (select folder, c, min(a) as a, max(z) as z, min(n) as n1, max(n) as n2, max(c) over (partition by folder) as last from p group by folder, c),
t as (select folder, max(last) as last, bool_and(case when c=last then greatest(1,(z-a)//4) < {_T["min"]} else true end) and max(last)>1 and (max(z)-min(case when c>=last-1 then a end))//4 <= {_T["max"]} as joins from c group by folder),
m as (select folder, case when joins and c.c=c.last then c.c-1 else c.c end as chunk_index, t.last - (case when joins then 1 else 0 end) as chunk_of, a, z, n1, n2 from c join t using (folder)),
g as (select folder, chunk_index, chunk_of, min(a) as a, max(z) as z, min(n1) as line_start, max(n2) as line_end from m group by all)
select folder, chunk_index, chunk_of, line_start, line_end, md5(substring(body, (a+1)::bigint, (z-a)::bigint)) as digest from g join f using (folder)""")
def _(spark, sf):
    """Files of thousands of documents, cut by tasks that each read 64 KB of them."""
    out = ranges.chunk_files(spark, file_tree(spark, sf, "source"), [".txt"], range_bytes=1 << 16)
    return out.select(_folder("file"), "chunk_index", "chunk_of", "line_start", "line_end", F.md5("content").alias("digest"))
