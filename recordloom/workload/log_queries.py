"""Lookups, metadata, text functions and simple windows."""

from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators import log as lg, meta, retrieval
from recordloom.operators.blocks import positions
from recordloom.operators.budget import fit_greedy, fit_prefix
from recordloom.session import spread
from recordloom.sources import logs
from recordloom.workload.logs_sql import CONV, EVENTS, EVENTS_LINKED, FILES, defaults_values
from recordloom.workload.registry import query
from recordloom.workload.signals_queries import LEX, TOK, docs, occ, r6, words


def ev(spark, sf):
    return logs.unlinked(logs.events_rows(spark, sf))


@query("s01_range_scan", EVENTS + " select chain_id, idx, rec_type, ts_ms from lg where idx>=10 and idx<40")
def _(spark, sf):
    return logs.scan(ev(spark, sf), 10, 40).select("chain_id", "idx", "rec_type", "ts_ms")


@query("p01_newest_of_type", EVENTS + """
select chain_id, idx, content_json from lg where rec_type='observation' qualify row_number() over (partition by chain_id order by idx desc)<=5""")
def _(spark, sf):
    return retrieval.recent(ev(spark, sf), 5, "observation").select("chain_id", "idx", "content_json")


@query("t05_most_recent", EVENTS + """
select chain_id, idx, rec_type from lg qualify row_number() over (partition by chain_id order by idx desc)<=10""")
def _(spark, sf):
    return retrieval.recent(ev(spark, sf), 10).select("chain_id", "idx", "rec_type")


@query("p02_lookup_by_hash", EVENTS_LINKED + """
select l.chain_id, l.idx, l.record_hash, l.rec_type from ll l where record_hash in (select prior_hash from ll where cites_prior)""")
def _(spark, sf):
    log = logs.events_log(spark, sf)
    cited = log.select(F.explode("refs").alias("record_hash"))
    return lg.lookup(log, cited, "record_hash").select("chain_id", "idx", "record_hash", "rec_type")


@query("p03_blob_index", FILES + """
select chain_id, sha, max(idx) as idx, arg_max(filename, idx) as filename from lg group by 1,2""")
def _(spark, sf):
    return lg.blob_index(logs.unlinked(logs.file_rows(spark, sf)))


@query("p04_blob_by_prefix", FILES + """,
pf as (select distinct case when doc_id%3=0 then sha[1:6] when doc_id%3=1 then sha[1:12] || '…' else sha[1:8] || '..' end as prefix from lg),
cl as (select prefix, rtrim(prefix, '.…') as p from pf)
select prefix, case when count(distinct sha)=1 then min(sha) end as sha from cl left join (select distinct sha from lg) s
 on length(p)>=8 and starts_with(s.sha, p) group by prefix""")
def _(spark, sf):
    index = lg.blob_index(logs.unlinked(logs.file_rows(spark, sf)))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha"))
    third = F.pmod("doc_id", F.lit(3))
    prefix = (F.when(third == 0, F.substring("sha", 1, 6)).when(third == 1, F.concat(F.substring("sha", 1, 12), F.lit("…")))
              .otherwise(F.concat(F.substring("sha", 1, 8), F.lit(".."))))
    return lg.blobs_by_prefix(index, d.select(prefix.alias("prefix")).distinct())


@query("p05_match_content", EVENTS + " select chain_id, idx, content_json from lg where k=42")
def _(spark, sf):
    return lg.where_content(ev(spark, sf), "$.k", 42).select("chain_id", "idx", "content_json")


_META = EVENTS + ",\n" + defaults_values() + """,
m as (select lg.chain_id, lg.idx, lg.rec_type, coalesce(d_source,'assistant') as source, coalesce(d_salience,0.4)::double as salience,
  coalesce(d_half,30)::double as half_life_days, coalesce(d_epistemic,'inferred') as epistemic_class, coalesce(lg.exposure, d_exposure, 'private') as exposure,
  supersedes, case when lg.exposure is null and supersedes is null then 1 else 3 end as schema_version,
  case when lg.exposure is not null or supersedes is not null then 1.0 when lg.rec_type in ('observation','system_prompt','genesis','file') then 1.0 else 0.8 end::double as confidence
  from lg left join df using (rec_type))"""


def resolved(spark, sf):
    return meta.resolve_meta(ev(spark, sf))


@query("p07_resolved_meta", _META + """ select chain_id, idx, source, salience, half_life_days, epistemic_class, exposure, supersedes,
 schema_version::int as schema_version, confidence from m""")
def _(spark, sf):
    return resolved(spark, sf).select("chain_id", "idx", *[f"meta.{c}" for c in (
        "source", "salience", "half_life_days", "epistemic_class", "exposure", "supersedes", "schema_version", "confidence")])


@query("p08_build_meta", _META + """ select chain_id, idx, '{"confidence":1.0,"epistemic_class":"' || epistemic_class || '","exposure":"' || exposure
 || '","salience":' || salience || ',"schema_version":3,"source":"' || source || '"}' as meta_json from m where exposure<>'quarantine'""")
def _(spark, sf):
    rows = resolved(spark, sf).select("chain_id", "idx", "rec_type", F.when(
        F.col("meta.exposure") == "quarantine", "secret").otherwise(F.col("meta.exposure")).alias("exposure"))
    return meta.build_meta(rows)[0].select("chain_id", "idx", "meta_json")


@query("p08_rejected_meta", _META + " select chain_id, idx, 'unknown exposure secret' as reject_reason from m where exposure='quarantine'")
def _(spark, sf):
    rows = resolved(spark, sf).select("chain_id", "idx", "rec_type", F.when(
        F.col("meta.exposure") == "quarantine", "secret").otherwise(F.col("meta.exposure")).alias("exposure"))
    return meta.build_meta(rows)[1].select("chain_id", "idx", "reject_reason")


@query("p06_p09_quarantined", _META + " select chain_id, idx from m where exposure='quarantine'")
def _(spark, sf):
    return meta.split_quarantined(resolved(spark, sf))[1]


@query("p09_visible", _META + " select chain_id, idx, exposure from m where exposure<>'quarantine'")
def _(spark, sf):
    return meta.split_quarantined(resolved(spark, sf))[0].select("chain_id", "idx", "meta.exposure")


@query("p10_revision_verdicts", _META + """,
z as (select *, case when rec_type in ('genesis','system_prompt','principle') then rec_type when exposure='summary' then 'summary-exposure record' end as zone from m)
select chain_id, idx, zone is null as allowed, zone, case when zone is null then 'ordinary record' else 'protected zone: ' || zone end as reason from z""")
def _(spark, sf):
    return meta.revision_verdicts(resolved(spark, sf))


@query("p11_commit_exposure", """
select doc_id, case when toxic=1 then 'quarantine' end as exposure, case when toxic=0 and quality=0 then 0.2 end::double as salience from labels""")
def _(spark, sf):
    act = F.when(F.col("toxic") == 1, "quarantine").when(F.col("quality") == 0, "light_log").otherwise("commit")
    return spark.read.parquet(f"{sf}/labels.parquet").select(
        "doc_id", meta.exposure_for_commit(act).alias("exposure"), meta.salience_for_commit(act, F.lit(0.4)).alias("salience"))


@query("p12_page", EVENTS + """,
e as (select chain_id, least(max(idx)+1, 30 + chain_id//1048576%20) as hi from lg group by 1)
select chain_id, idx, rec_type, greatest(hi-25,0)>0 as has_more from lg join e using (chain_id) where idx<hi and idx>=greatest(hi-25,0)""")
def _(spark, sf):
    log = ev(spark, sf)
    before = log.select("chain_id").distinct().withColumn("before", 30 + F.pmod(F.expr("chain_id div 1048576"), F.lit(20)))
    return retrieval.page(log, before, 25).select("chain_id", "idx", "rec_type", "has_more")


@query("p14_ring_view", EVENTS_LINKED + """
select chain_id, idx as "index", rec_type as ring_type, ts_ms as "timestamp", record_hash as ring_hash, prior_hash as prev_hash,
 content_json as payload, cast(null as varchar) as poq from ll""")
def _(spark, sf):
    return lg.ring_view(logs.events_log(spark, sf))


@query("p15_payload_text", CONV + " select chain_id, idx, text from lg")
def _(spark, sf):
    return logs.unlinked(logs.conversation_rows(spark, sf)).select("chain_id", "idx", lg.payload_text("content_json").alias("text"))


@query("p16_embed_text", CONV + " select chain_id, idx, '[' || rec_type || '] ' || content_json as text from lg")
def _(spark, sf):
    return logs.unlinked(logs.conversation_rows(spark, sf)).select(
        "chain_id", "idx", tx.embed_text(F.col("rec_type"), F.col("content_json")).alias("text"))


@query("p17_explicit_indices", r"""
with q as (select doc_id, 'see record ' || doc_id || ', and #' || (n_chars%90) || ' or indices 3 and ' || (doc_id%11) || ', not ' || n_chars || '; ' || text as t from documents),
a as (select doc_id, list_transform(regexp_extract_all(t, '(?i)(?:record|index|indices|records|idx)\s*#?\s*(\d+(?:\s*(?:,\s*and|,|and)\s*#?\d+)*)', 1), lambda s: regexp_extract_all(s,'\d+')) as named,
  regexp_extract_all(t, '(?:^|[^\w#])#(\d+)\b', 1) as hashed from q),
u as (select doc_id, flatten(named) || hashed as xs from a),
p as (select doc_id, unnest(xs) as x, generate_subscripts(xs,1) as i from u),
f as (select doc_id, x, min(i) as i from p group by all)
select doc_id, string_agg(x, ',' order by i) as refs from f group by 1""")
def _(spark, sf):
    q = docs(spark, sf, "text", "n_chars").withColumn("t", F.concat(
        F.lit("see record "), F.col("doc_id").cast("string"), F.lit(", and #"), F.pmod("n_chars", F.lit(90)).cast("string"),
        F.lit(" or indices 3 and "), F.pmod("doc_id", F.lit(11)).cast("string"), F.lit(", not "), F.col("n_chars").cast("string"),
        F.lit("; "), F.col("text")))
    return q.select("doc_id", F.array_join(F.transform(tx.explicit_indices(F.col("t")), lambda n: n.cast("string")), ",").alias("refs"))


@query("p23_holistic", r"""
select doc_id, regexp_matches(lower(text), '(?:^|[^\pL\pN_])(?:(?:ver|ther|thre|the)(?:s|d|ed)?|(?:ver|ther|thr|th)ing)(?:$|[^\pL\pN_])') as holistic from documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.is_holistic(F.col("text"), ["ver", "ther", "thre", "the"]).alias("holistic"))


# --- text functions ------------------------------------------------------------------
_FT = f"regexp_extract_all(lower(text), '{TOK}')"
_SENTS = r"list_filter(list_transform(regexp_split_to_array(text,'[.!?]+'), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'')"


@query("f01_f05_f10_text_measures", f"""
with t as (select doc_id, text, {_FT} as w from documents)
select doc_id, len(w)::int as word_count, round(coalesce(list_avg(list_transform(list_filter(w, lambda x: not contains(x,'''') and not contains(x,'-')), lambda x: length(x))),0),6) as avg_word_length,
 greatest(1, length(text)//4) as approx_tokens, md5(array_to_string(w,' ')) as tokens_digest from t""")
def _(spark, sf):
    return docs(spark, sf).withColumn("w", tx.tokenize(F.col("text"))).select(
        "doc_id", F.size("w").alias("word_count"), r6(tx.avg_word_length(F.col("w"))).alias("avg_word_length"),
        tx.approx_tokens(F.col("text")).alias("approx_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_digest"))


@query("f02_f06_sentences", f"""
with t as (select doc_id, {_SENTS} as s from documents),
l as (select doc_id, s, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x,'\\s+'), lambda y: y<>''))) as n from t)
select doc_id, len(s)::int as sentences, case when len(s)<2 then 0.0 else round(list_stddev_pop(n),6) end as spread, md5(array_to_string(s,'|')) as digest from l""")
def _(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.size(tx.sentences(F.col("text"))).alias("sentences"),
        r6(tx.sentence_length_variance(F.col("text"))).alias("spread"),
        F.md5(F.array_join(tx.sentences(F.col("text")), "|")).alias("digest"))


@query("f04_f07_f08_lexicons", f"""
with t as (select doc_id, text, {_FT} as w from documents),
c as (select doc_id, text, len(w) as n, len(list_filter(w, lambda x: x in {words(LEX.positive)})) as p, len(list_filter(w, lambda x: x in {words(LEX.negative)})) as g,
  len(list_filter(w, lambda x: x in {words(LEX.question)})) as q, len(list_filter(w, lambda x: x in {words(LEX.tech)})) as x from t)
select doc_id, case when n=0 then 0.0 else round(least(1.0, x/n*5),6) end as score, x::int as hits,
  case when n=0 then 0.0 else round(least(1.0, ({occ('text', '?')}*2+q)/n*3),6) end as questions, case when p+g=0 then 0.0 else round((p-g)/(p+g),6) end as valence from c""")
def _(spark, sf):
    w = F.col("w")
    return docs(spark, sf).withColumn("w", tx.tokenize(F.col("text"))).select(
        "doc_id", r6(tx.lexicon_score(w, LEX.tech)).alias("score"), tx.lexicon_count(w, LEX.tech).alias("hits"),
        r6(tx.question_density(F.col("text"), w, LEX.question)).alias("questions"),
        r6(tx.emotional_valence(w, LEX.positive, LEX.negative)).alias("valence"))


@query("t03_top_keywords", f"""
with tk as (select doc_id, unnest({_FT}) as w, generate_subscripts({_FT},1) as pos from documents),
k as (select doc_id, w, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, min(pos)) as place from tk
  where not contains(w,'''') and not contains(w,'-') and length(w)>2 and w not in {words(LEX.stop)} group by doc_id, w)
select doc_id, place, w as word, n from k where place<=10""")
def _(spark, sf):
    return lg.keyword_rows(docs(spark, sf), "doc_id", "text", 10, stop=LEX.stop)


@query("f11_entities", r"""
with e as (select page_id, unnest(regexp_extract_all(html,'[A-Za-z_][A-Za-z0-9_.]*')) as raw from pages),
c as (select distinct page_id, regexp_replace(raw,'^\.+|\.+$','','g') as w from e),
k as (select page_id, w, row_number() over (partition by page_id order by encode(w)) as i from c where length(w)>2 and regexp_matches(w,'_|^.+[A-Z]|\.|[0-9]'))
select p.page_id, coalesce(string_agg(w, ' ' order by i) filter (i<=12),'') as entities from pages p left join k using (page_id) group by 1""")
def _(spark, sf):
    return spread(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")).select(
        "page_id", F.array_join(tx.entities(F.col("html")), " ").alias("entities"))


@query("f12_f13_f14_labels", f"""
with tk as (select doc_id, unnest({_FT}) as w, generate_subscripts({_FT},1) as pos from documents),
k as (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, min(pos)) as place from tk where w not in {words(LEX.stop)} group by doc_id, w),
j as (select doc_id, string_agg(w, ' ' order by place) as kws from k where place<=6 group by 1),
v as (select doc_id, count(distinct w)/count(*) as variety from tk group by 1),
e0 as (select doc_id, unnest(regexp_extract_all(text,'[A-Za-z_][A-Za-z0-9_.]*')) as raw from documents),
e as (select doc_id, least(12, count(distinct regexp_replace(raw,'^\\.+|\\.+$','','g')) filter (length(regexp_replace(raw,'^\\.+|\\.+$','','g'))>2 and regexp_matches(regexp_replace(raw,'^\\.+|\\.+$','','g'),'_|^.+[A-Z]|\\.|[0-9]'))) as n from e0 group by 1)
select d.doc_id, coalesce(kws,'') as keywords, array_to_string(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')[1:24],' ') as excerpt,
  round(least(1.0, 0.2+0.04*coalesce(e.n,0)+0.4*coalesce(variety,0)),3)::double as salience
from documents d left join j using (doc_id) left join v using (doc_id) left join e using (doc_id)""")
def _(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", F.array_join(tx.keywords(t, 6, LEX.stop), " ").alias("keywords"),
                                  tx.excerpt(t, 24).alias("excerpt"), tx.salience(t).alias("salience"))


@query("f17_redact_secrets", r"""
with a as (select doc_id, text as t0, regexp_replace(text,'(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----','[REDACTED_PRIVATE_KEY]','g') as t1 from documents),
b as (select *, regexp_replace(t1,'\bgh[pousr]_[A-Za-z0-9_]{20,}\b','[REDACTED_GITHUB_TOKEN]','g') as t2 from a),
c as (select *, regexp_replace(t2,'\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b','[REDACTED_OPENAI_KEY]','g') as t3 from b),
d as (select *, '(?i)\b((?:api|access|secret|private|auth|bearer|token|password|passwd|pwd)[A-Za-z0-9_.-]*\s*[:=]\s*)([''"]?)[^''"\s]{8,}([''"]?)' as p4 from c)
select doc_id, md5(regexp_replace(t3, p4, '\1\2[REDACTED_SECRET]\3','g')) as digest,
 (len(regexp_extract_all(t0,'(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----'))+len(regexp_extract_all(t1,'\bgh[pousr]_[A-Za-z0-9_]{20,}\b'))
  +len(regexp_extract_all(t2,'\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b'))+len(regexp_extract_all(t3,p4)))::int as n from d""")
def _(spark, sf):
    masked, n = tx.redact_secrets(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(masked).alias("digest"), n.alias("n"))


@query("f09_bag_cosine", f"""
with t as (select doc_id, unnest({_FT}) as w from documents), b as (select doc_id, w, count(*) as c from t group by all),
n as (select doc_id, sqrt(sum(c*c)) as norm from b group by 1),
d as (select x.doc_id, sum(x.c*y.c) as dot from b x join b y on y.doc_id=x.doc_id-1 and y.w=x.w group by 1)
select a.doc_id, round(coalesce(dot/(m.norm*o.norm),0),6) as cosine from documents a join documents p on p.doc_id=a.doc_id-1
left join d on d.doc_id=a.doc_id left join n m on m.doc_id=a.doc_id left join n o on o.doc_id=a.doc_id-1""")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", tx.bag(tx.tokenize(F.col("text"))).alias("b"))
    p = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("b").alias("p"))
    return d.join(p, "doc_id").select("doc_id", r6(tx.cosine_bags(F.col("b"), F.col("p"))).alias("cosine"))


@query("f18_path_proximity", """
with r as (select page_id, regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') as rel from pages),
h as (select page_id, rel, case when page_id%3=0 then regexp_extract(rel,'[^/]+$') end as ph, case when page_id%3=1 then regexp_extract(rel,'^[^/]+') when page_id%3=2 then regexp_extract(rel,'^[^/]+') || '/zz/yy' end as dh from r)
select page_id, round(cast(case when ph<>'' then 1.0 when ph='' then 0.0 when page_id%3=1 then case when contains(rel,'/') then 0.8 else 0.6 end else 0.6*1/3 end as double),6) as proximity from h""")
def _(spark, sf):
    rel = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    host, third = F.regexp_extract("rel", "^[^/]+", 0), F.pmod("page_id", F.lit(3))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", rel.alias("rel")).select("page_id", r6(tx.path_proximity(
        F.col("rel"), F.when(third == 0, F.regexp_extract("rel", "[^/]+$", 0)),
        F.when(third == 1, host).when(third == 2, F.concat(host, F.lit("/zz/yy"))))).alias("proximity"))


@query("f21_f22_age", EVENTS + ",\n" + defaults_values() + """,
a as (select chain_id, idx, ts_ms, 1706700000000-ts_ms as age, d_half from lg join df using (rec_type))
select chain_id, idx, round(pow(0.5, age/1000.0/(d_half*86400.0)),6) as recency,
 case when age<3600000 then (age//60000)||'m' when age<86400000 then (age//3600000)||'h' when age<1209600000 then (age//86400000)||'d' else (age//604800000)||'w' end as compact,
 strftime(make_timestamp(ts_ms*1000), '%Y-%m-%d %H:%M UTC') as at,
 case when age//86400000<1 then (age//3600000)||' hour'||case when age//3600000<>1 then 's' else '' end||' ago'
  when age//86400000<7 then (age//86400000)||' day'||case when age//86400000<>1 then 's' else '' end||' ago'
  when age//86400000<30 then (age//604800000)||' week'||case when age//604800000<>1 then 's' else '' end||' ago'
  else (age//2592000000)||' month'||case when age//2592000000<>1 then 's' else '' end||' ago' end as human from a""")
def _(spark, sf):
    age = F.lit(1_706_700_000_000) - F.col("ts_ms")
    return resolved(spark, sf).select(
        "chain_id", "idx", r6(tx.recency(age, F.col("meta.half_life_days"))).alias("recency"), tx.compact_age(age).alias("compact"),
        tx.absolute_time(F.col("ts_ms")).alias("at"), tx.humanize_delta(age / 1000).alias("human"))


@query("f30_snippets", CONV + """
select chain_id, idx, (case when rec_type='response' then 'agent: ' || t[1:90] else t[1:120] end)[1:220] as line, text as handle
from (select *, array_to_string(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>''),' ') as t from lg)""")
def _(spark, sf):
    return logs.unlinked(logs.conversation_rows(spark, sf)).select(
        "chain_id", "idx", tx.snippet(F.col("rec_type"), F.col("content_json")).alias("line"), tx.handle(F.col("content_json")).alias("handle"))


@query("u02_u03_set_overlap", f"""
with t as (select conv_id, turn, list_distinct({_FT}) as w from conversations),
p as (select a.conv_id, a.turn, a.w as x, b.w as y from t a join t b on b.conv_id=a.conv_id and b.turn=a.turn-1),
s as (select *, len(list_intersect(x,y)) as i, len(x) as nx, len(y) as ny from p)
select conv_id, turn, round(i/(nx+ny-i),6) as jaccard, round(i/nx,6) as coverage, round(i/nx,6) as overlap from s""")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.array_distinct(tx.tokenize(F.col("text"))).alias("x"))
    p = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return t.join(p, ["conv_id", "turn"]).select("conv_id", "turn", r6(tx.jaccard(x, y)).alias("jaccard"),
                                                 r6(tx.coverage(x, y)).alias("coverage"), r6(tx.overlap_or_neutral(x, y)).alias("overlap"))


# --- copies, first occurrences, budgets, windows ------------------------------------------
@query("j22_exact_copies", """
with s as (select doc_id, sha256(text) as sha from documents)
select sha, doc_id, copies, first from s join (select sha, count(*) as copies, min(doc_id) as first from s group by 1 having count(*)>1) using (sha)""")
def _(spark, sf):
    return lg.exact_copies(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")


@query("w13_first_occurrence", "select doc_id, source from documents qualify row_number() over (partition by md5(text) order by doc_id)=1")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.md5("text").alias("h"))
    return retrieval.first_of(d, ["h"], F.col("doc_id")).select("doc_id", "source")


def sized(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.expr("greatest(1L, n_chars div 4)").alias("size"))
    return positions(d, ["source"], F.expr("doc_id div 65536"), ["doc_id"], "place")


_SZ = "z as (select doc_id, source, greatest(1, n_chars//4) as size, row_number() over (partition by source order by doc_id)-1 as place from documents)"


@query("w09_prefix_budget", f"""with {_SZ}, r as (select *, sum(size) over (partition by source order by place) as s from z)
select doc_id, source, place=0 or s<=9000 as kept, not (place=0 or s<=9000) as truncated, case when not (place=0 or s<=9000) then 9000-(s-size) end::bigint as room
from r where place=0 or s<=9000 or s-size<9000""")
def _(spark, sf):
    return fit_prefix(sized(spark, sf), ["source"], "place", "size", 9000).select("doc_id", "source", "kept", "truncated", "room")


def _greedy(first):
    rule = "used+size<=6000" + (" or place=0" if first else "")
    start = "true" if first else "size<=6000"
    return f"""with recursive {_SZ},
w as (select source, place, doc_id, {start} as kept, case when {start} then size else 0 end as used from z where place=0
 union all select z.source, z.place, z.doc_id, {rule.replace('place=0', 'false')}, case when {rule.replace('place=0', 'false')} then used+size else used end
 from w join z on z.source=w.source and z.place=w.place+1)
select doc_id, source, kept from w"""


@query("w10_greedy_budget", _greedy(True))
def _(spark, sf):
    return fit_greedy(sized(spark, sf), ["source"], ["doc_id"], [F.col("place")], "size", 6000).select("doc_id", "source", "kept")


@query("w11_fetch_budget", _greedy(False))
def _(spark, sf):
    return fit_greedy(sized(spark, sf), ["source"], ["doc_id"], [F.col("place")], "size", 6000, first_always=False).select("doc_id", "source", "kept")


@query("w14_reflection_window", EVENTS + """,
e as (select chain_id, coalesce(max(idx) filter (rec_type='reflection'),-1)+1 as s, max(idx) as h from lg group by 1),
i as (select lg.chain_id, lg.idx, lg.rec_type, greatest(s, h-5+1) as window_start, greatest(s, h-5+1)>s as capped from lg join e using (chain_id) where idx>=greatest(s, h-5+1))
select * from i where chain_id in (select chain_id from i where rec_type in ('observation','response','reflection','revision') group by 1 having count(*)>=4)""")
def _(spark, sf):
    return retrieval.reflection_window(ev(spark, sf), 5).select("chain_id", "idx", "rec_type", "window_start", "capped")
