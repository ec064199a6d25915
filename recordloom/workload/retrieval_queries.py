"""Vectors, ranking, context, neighbours and ancestry."""

from pyspark.sql import functions as F

from recordloom.functions import text as tx, vectors
from recordloom.operators import knn as nn, meta, retrieval
from recordloom.operators.blocks import positions
from recordloom.operators.knn import knn, knn_scoped, scoped_similarity, top_chunks
from recordloom.plans.context import build_context, fit_context
from recordloom.session import spread, stored
from recordloom.sources import logs
from recordloom.workload.logs_sql import CONV, CR, EVENTS_LINKED, LINK, defaults_values
from recordloom.workload.registry import query
from recordloom.workload.signals_queries import LEX, TOK, r6, words

DIM = 64
AS_OF = 1_720_000_000_000


def store(spark, sf):
    """The given vectors as chunks: five neighbours in id form one record."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.expr("vec_id div 5").alias("rec"), F.pmod("vec_id", F.lit(5)).cast("int").alias("chunk_index"),
        F.col("embedding").alias("vector"), "label", "vec_id")


def centroids(spark, sf):
    """Mean vector of each label: a query set as small as the number of labels."""
    e = store(spark, sf).select("label", F.posexplode("vector").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return mean.groupBy("label").agg(vec.alias("vector")).withColumnRenamed("label", "query_id")


_CENT = """with e as (select vec_id, vec_id//5 as rec, vec_id%5 as chunk_index, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
ex as (select label, unnest(v) as x, generate_subscripts(v,1) as i from e),
ce as (select label, list(m order by i) as q from (select label, i, avg(x) as m from ex group by 1,2) group by 1),
sm as (select ce.label as query_id, rec, chunk_index, list_cosine_similarity(e.v, ce.q) as sim from e cross join ce),
rk as (select query_id, rec, max(sim) as sim, row_number() over (partition by query_id order by max(sim) desc, rec) as rank from sm group by 1,2)"""


@query("t01_exact_knn", _CENT + " select query_id, rec, round(sim,6) as sim, rank from rk where rank<=10")
def _(spark, sf):
    return knn(store(spark, sf), centroids(spark, sf), 10, ["rec"]).select("query_id", "rec", r6(F.col("sim")).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("t01_exact_knn_tiled", _CENT + " select query_id, rec, round(sim,6) as sim, rank from rk where rank<=10")
def _(spark, sf):
    found = knn(store(spark, sf), centroids(spark, sf), 10, ["rec"], max_queries=1)
    return found.select("query_id", "rec", r6(F.col("sim")).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("a21_matched_chunks", _CENT + """,
h as (select query_id, rec from rk where rank<=10)
select query_id, rec, chunk_index::int as chunk_index, round(sim,6) as sim, row_number() over (partition by query_id, rec order by sim desc, chunk_index) as place
from sm semi join h using (query_id, rec) qualify place<=3""")
def _(spark, sf):
    chunks, cents = store(spark, sf), centroids(spark, sf)
    hits = knn(chunks, cents, 10, ["rec"]).select("query_id", "rec")
    pairs = (chunks.join(hits, "rec").join(cents.withColumnRenamed("vector", "_q"), "query_id")
             .withColumn("sim", vectors.cosine(F.col("vector"), F.col("_q"))))
    return top_chunks(pairs, 3, ["rec"]).select("query_id", "rec", "chunk_index", r6(F.col("sim")).alias("sim"), F.col("place").cast("long").alias("place"))


@query("a14_drift", _CENT + """,
mn as (select query_id, avg(sim) as m from rk where rank<=5 group by 1)
select a.query_id as pair_id, round(a.m,6) as anchor_mean, round(b.m,6) as recent_mean, round(a.m-b.m,6) as gap,
 case when a.m-b.m>0.02 then 'drift' else 'ok' end as status
from mn a join mn b on b.query_id=(a.query_id+1)%(select count(*) from mn)""")
def _(spark, sf):
    c = centroids(spark, sf)
    n = c.agg(F.count("*").alias("_n"))
    nxt = c.select(F.col("query_id").alias("_b"), F.col("vector").alias("recent"))
    pairs = (c.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one")
             .withColumn("_b", F.pmod(F.col("query_id") + 1, F.col("_n"))).join(nxt, "_b")
             .select(F.col("query_id").alias("pair_id"), F.col("vector").alias("anchor"), "recent"))
    out = nn.drift(store(spark, sf), pairs, 5, 0.02, ["rec"])
    return out.select("pair_id", *[r6(F.col(x)).alias(x) for x in ("anchor_mean", "recent_mean", "gap")], "status")


# --- hashing embeddings of dialogue turns ---------------------------------------------
def embed_sql(source, key, text, name="em", dim=DIM):
    """Sparse unit vectors (key, slot, x) of `source`."""
    return f"""{name}0 as (select {key}, cast('0x' || md5(substring(t, i::int, 3))[1:8] as bigint)%{dim} as slot from
  (select {key}, t, unnest(range(1, greatest(length(t)-1, 2))) as i from (select {key}, case when length({text})<3 then lower({text}) || '   ' else lower({text}) end as t from {source}))),
{name}1 as (select {key}, slot, count(*) as c from {name}0 group by all),
{name} as (select {key}, slot, cast(cast(c/sqrt(sum(c*c) over (partition by {key})) as float) as double) as x from {name}1)"""


@query("f19_hash_embedding", f"""with s as (select conv_id, turn, text from conversations),
{embed_sql('s', 'conv_id, turn', 'text')} select conv_id, turn, slot::int as slot, round(x,6) as x from em""")
def _(spark, sf):
    t = spread(spark.read.parquet(f"{sf}/conversations.parquet"))
    v = t.select("conv_id", "turn", F.posexplode(vectors.hash_embed(F.col("text"), DIM, "md5")).alias("slot", "x"))
    return v.where("x <> 0").select("conv_id", "turn", "slot", r6(F.col("x").cast("double")).alias("x"))


def conv_log(spark, sf):
    return logs.conversation_log(spark, sf)


def embedded(rows):
    """Records of any log as single chunks with their vectors."""
    return rows.select("chain_id", "idx", vectors.hash_embed(tx.embed_text(F.col("rec_type"), F.col("content_json")), DIM, "md5").alias("vector"))


def last_asks(spark, sf, note=""):
    """The last user turn of each dialogue as a query on that dialogue."""
    t = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    last = t.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    q = last.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("chain_id"), F.concat("text", F.lit(note)).alias("text"))
    return q.withColumn("vector", vectors.hash_embed(F.col("text"), DIM, "md5"))


def _scoped(note=""):
    return CR + f""",
rt as (select chain_id, idx, '[' || rec_type || '] ' || content_json as t from lg),
{embed_sql('rt', 'chain_id, idx', 't', 'em')},
qs as (select chain_id as query_id, arg_max(text, idx) || '{note}' as text from lg where role='user' group by 1),
{embed_sql('qs', 'query_id', 'text', 'qe')},
nq as (select query_id, sqrt(sum(x*x)) as n from qe group by 1), nr as (select chain_id, idx, sqrt(sum(x*x)) as n from em group by 1,2),
dp as (select query_id, chain_id, idx, sum(em.x*qe.x) as d from em join qe on qe.query_id=em.chain_id and qe.slot=em.slot group by all),
sm as (select nq.query_id, nr.chain_id, nr.idx, coalesce(d,0)/(nq.n*nr.n) as sim from nr join nq on nq.query_id=nr.chain_id left join dp on dp.query_id=nq.query_id and dp.chain_id=nr.chain_id and dp.idx=nr.idx),
{defaults_values()},
mt as (select lg.chain_id, lg.idx, lg.rec_type, lg.ts_ms, coalesce(own_salience, d_salience) as salience, d_half, hidden, moded,
  case d_epistemic when 'known' then 1.0 when 'user_context' then 1.0 when 'inferred' then 0.97 else 0.97 end as epi from lg join df using (rec_type)),
bs as (select sm.*, mt.salience, pow(0.5, greatest({AS_OF}-ts_ms,0)/1000.0/(d_half*86400.0)) as rec, epi, hidden, moded, rec_type from sm join mt using (chain_id, idx))"""


@query("t02_hybrid", "with " + _scoped() + """,
sc as (select query_id, chain_id, idx, (0.55*sim+0.25*salience+0.2*rec)*epi as score from bs),
rk as (select *, row_number() over (partition by query_id order by score desc, chain_id, idx) as rank from sc)
select query_id, chain_id, idx, round(score,6) as score, rank from rk where rank<=4""")
def _(spark, sf):
    log = logs.unlinked(logs.conversation_rows(spark, sf))
    found = knn_scoped(embedded(log), last_asks(spark, sf), 20)
    return retrieval.hybrid(found, log, AS_OF, 4, epistemic=True).select(
        "query_id", "chain_id", "idx", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("t02_w12_hybrid_with_modes", "with " + _scoped() + """,
b0 as (select *, 0.45*sim+0.25*salience+0.15*rec as base from bs),
b1 as (select *, row_number() over (partition by query_id order by base desc, chain_id, idx) as p from b0),
b2 as (select *, avg(case when p<=10 then moded::int end) over (partition by query_id) as sat from b1),
sc as (select *, base+0.15*case when moded then 1.0 else 0.5 end*case when moded then 0.5 else 1.0 end*greatest(0.0,1-greatest(0.0,sat-0.6)) as score from b2),
rk as (select *, row_number() over (partition by query_id order by score desc, chain_id, idx) as rank from sc)
select query_id, chain_id, idx, round(score,6) as score, round(sat,6) as saturation, rank from rk where rank<=4""")
def _(spark, sf):
    log = logs.unlinked(logs.conversation_rows(spark, sf))
    found = knn_scoped(embedded(log), last_asks(spark, sf), 20).withColumn("modes", F.array(F.lit("artifact_content")))
    out = retrieval.hybrid(found, log, AS_OF, 4, modes="modes", weight_factors={"artifact_content": 0.5})
    return out.select("query_id", "chain_id", "idx", r6(F.col("score")).alias("score"), r6(F.col("saturation")).alias("saturation"), F.col("rank").cast("long").alias("rank"))


_CTX = "with recursive " + _scoped(" see record 0") + ",\n" + LINK + """,
sc as (select query_id, chain_id, idx, (0.55*sim+0.25*salience+0.2*rec)*epi as score from bs),
rk as (select *, row_number() over (partition by query_id order by score desc, chain_id, idx) as rank from sc),
ln as (select chain_id, max(idx)+1 as n from lg group by 1),
src as (select query_id, chain_id, idx, 0 as s from rk where rank<=2 union all
 select query_id, qs.query_id, lg.idx, 1 from qs join lg on lg.chain_id=qs.query_id join ln using (chain_id) where lg.idx>=n-1 union all
 select query_id, query_id, 0, 2 from qs),
dr as (select query_id, chain_id, idx, min(s) as s, bool_or(s=2) as pinned from src group by all),
pt as (select d.query_id, d.chain_id, d.idx as partner_of, case when m.rec_type='observation' then d.idx+1 else d.idx-1 end as idx, m.rec_type as t
  from dr d join mt m using (chain_id, idx) where m.rec_type in ('observation','response')),
st as (select p.* from pt p join mt o on o.chain_id=p.chain_id and o.idx=p.idx and not o.hidden
  and o.rec_type=case when t='observation' then 'response' else 'observation' end
  where not exists (select 1 from dr where dr.query_id=p.query_id and dr.idx=p.idx)),
al as (select d.query_id, d.chain_id, d.idx, d.pinned or exists (select 1 from st where st.query_id=d.query_id and st.partner_of=d.idx) as pinned, d.s from dr d
  union all select distinct query_id, chain_id, idx, true, 4 from st),
ct as (select al.query_id, al.chain_id, al.idx, al.pinned, case s when 0 then 'semantic' when 1 then 'recent' when 2 then 'explicit' else 'partner' end as why, hidden
  from al join mt using (chain_id, idx))"""


def _context(spark, sf):
    log = stored(conv_log(spark, sf))  # many branches read it, as they would read a log table
    return log, build_context(log, stored(embedded(log)), stored(last_asks(spark, sf, " see record 0")), AS_OF, k=2, n_recent=1)


@query("c03_build_context", _CTX + " select query_id, chain_id, idx, pinned, why from ct where not hidden")
def _(spark, sf):
    return _context(spark, sf)[1][0]


@query("c03_hidden_from_context", _CTX + " select query_id, chain_id, idx, why from ct where hidden")
def _(spark, sf):
    return _context(spark, sf)[1][1].drop("pinned")


@query("c03_fitted_context", _CTX + """,
z as (select ct.query_id, ct.chain_id, ct.idx, length(content_json)+80 as size, row_number() over (partition by query_id order by pinned desc, salience desc, ct.idx desc)-1 as place
  from ct join mt using (chain_id, idx) join lg using (chain_id, idx) where not ct.hidden),
w as (select *, true as kept, size as used from z where place=0 union all
  select z.*, w.used+z.size<=1500, case when w.used+z.size<=1500 then w.used+z.size else w.used end from w join z on z.query_id=w.query_id and z.place=w.place+1)
select query_id, chain_id, idx, size, kept from w""")
def _(spark, sf):
    log, (context, _hidden) = _context(spark, sf)
    return fit_context(stored(context), log, 1500).select("query_id", "chain_id", "idx", "size", "kept")


@query("j04_stitched_pairs", CONV + """,
h as (select chain_id, idx, rec_type from lg where idx%3=0),
p as (select chain_id, idx as partner_of, case when rec_type='observation' then idx+1 else idx-1 end as idx, rec_type as t from h where rec_type in ('observation','response'))
select p.chain_id as query_id, p.chain_id, p.idx, partner_of from p join lg o on o.chain_id=p.chain_id and o.idx=p.idx
 and o.rec_type=case when t='observation' then 'response' else 'observation' end where p.idx%3<>0""")
def _(spark, sf):
    log = conv_log(spark, sf)
    hits = log.where("idx % 3 = 0").select(F.col("chain_id").alias("query_id"), "chain_id", "idx")
    return retrieval.stitch_pairs(log, hits)


@query("j03_ancestry", EVENTS_LINKED + """,
hd as (select chain_id, max(idx) as h from ll group by 1),
an as (select l.chain_id, l.record_hash as seed, l.idx, l.cites_prior, 1 as level from ll l join hd on hd.chain_id=l.chain_id and hd.h=l.idx
 union all select a.chain_id, a.seed, l.idx, l.cites_prior, a.level+1 from an a join ll l on l.chain_id=a.chain_id and l.idx=a.idx-1 where a.cites_prior and a.level<4)
select chain_id, seed, idx, level from an""")
def _(spark, sf):
    log = logs.events_log(spark, sf)
    return retrieval.ancestry(log, logs.heads(log), 4).select("chain_id", "seed", "idx", F.col("level"))


@query("t06_query_modes", """select item_id, case when length(text)%3=0 then 'c,a,b' when length(text)%3=1 then 'b,c' else 'c' end as modes from benchmark""")
def _(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.pmod(F.length("text"), F.lit(3)).alias("m"))
    act = lambda x: F.struct(x.cast("double").alias("activation"))
    wide = b.select("item_id", act(F.when(F.col("m") == 0, 0.5).otherwise(0.1)).alias("a"),
                    act(F.when(F.col("m") < 2, F.when(F.col("m") == 0, 0.5).otherwise(0.9)).otherwise(0.2)).alias("b"),
                    act(F.when(F.col("m") == 0, 0.8).otherwise(0.3)).alias("c"))
    return retrieval.query_modes(wide, ["a", "b", "c"]).select("item_id", F.array_join("modes", ",").alias("modes"))


@query("t08_memory_map", CONV + ",\n" + defaults_values() + f""",
r as (select lg.*, coalesce(own_salience, d_salience)::double as salience, row_number() over (partition by chain_id order by idx desc) as p from lg join df using (rec_type))
select chain_id as query_id, chain_id, idx, p as place, rec_type, false as superseded, ((({AS_OF}-ts_ms)//1000)//604800) || 'w' as age, salience,
 (case when rec_type='response' then 'agent: ' || t[1:90] else t[1:120] end)[1:220] as line
from (select *, array_to_string(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>''),' ') as t from r) where p<=4 and not hidden""")
def _(spark, sf):
    log = logs.unlinked(logs.conversation_rows(spark, sf))
    q = log.select(F.col("chain_id").alias("query_id"), "chain_id").distinct()
    return retrieval.memory_map(log, q, None, AS_OF, limit=10, newest=4).withColumn("place", F.col("place").cast("long"))


@query("t10_record_index", CONV + f""",
tk as (select chain_id, idx, unnest(regexp_extract_all(lower(text), '{TOK}')) as w, generate_subscripts(regexp_extract_all(lower(text), '{TOK}'),1) as pos from lg),
k as (select chain_id, idx, w, row_number() over (partition by chain_id, idx order by count(*) desc, min(pos)) as p from tk where w not in {words(LEX.stop)} group by chain_id, idx, w),
j as (select chain_id, idx, string_agg(w,' ' order by p) as kws from k where p<=6 group by all)
select chain_id, idx, rec_type, array_to_string(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')[1:24],' ')[1:240] as summary, coalesce(kws,'') as keywords
from lg left join j using (chain_id, idx)""")
def _(spark, sf):
    log = logs.unlinked(logs.conversation_rows(spark, sf))
    return retrieval.record_index(log, LEX.stop).select("chain_id", "idx", "rec_type", "summary", F.array_join("keywords", " ").alias("keywords"))
