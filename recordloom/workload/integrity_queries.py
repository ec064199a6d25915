import uuid

from pyspark.sql import functions as F

from recordloom.functions.hashing import hmac_sha256
from recordloom.operators import governance, integrity, merkle, quorum, semantic, stats
from recordloom.operators.blocks import positions
from recordloom.session import shared_dir, stored
from recordloom.sources import logs
from recordloom.sources.guarded import GuardedLog
from recordloom.workload.logs_sql import CONV_LINKED, EVENTS, EVENTS_LINKED, GOV, defaults_values, merkle_levels
from recordloom.workload.registry import query


def tampered(spark, sf):
    """The events log with record 5 of every tenth user's chain changed after the fact."""
    log = logs.events_log(spark, sf)
    hit = (F.col("idx") == 5) & (F.pmod(F.floor(F.col("chain_id") / 1048576), F.lit(10)) == 3)
    return (log.withColumn("content_json", F.when(hit, F.lit('{"forged":1}')).otherwise(F.col("content_json")))
            .withColumn("prior_hash", F.when((F.col("idx") == 9) & (F.pmod(F.floor(F.col("chain_id") / 1048576), F.lit(10)) == 4),
                                             F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("prior_hash")))
            .where(~((F.col("idx") == 7) & (F.pmod(F.floor(F.col("chain_id") / 1048576), F.lit(10)) == 6))))


@query("s02_bulk_append", EVENTS_LINKED + """
select chain_id, idx, prior_hash, record_hash, content_hash from ll""")
def _(spark, sf):
    return logs.events_log(spark, sf).select("chain_id", "idx", "prior_hash", "record_hash", "content_hash")


@query("s03_heads", EVENTS_LINKED + """
select chain_id, count(*) as length, max(idx) as idx, arg_max(record_hash, idx) as record_hash,
       arg_max(ts_ms, idx) as ts_ms, arg_max(rec_type, idx) as rec_type from ll group by chain_id""")
def _(spark, sf):
    return logs.heads(logs.events_log(spark, sf))


@query("s13_log_from_events", EVENTS + """
select chain_id, idx, ts_ms, rec_type, content_json, writer from lg""")
def _(spark, sf):
    return logs.unlinked(logs.events_rows(spark, sf))


@query("s13_log_from_conversations", CONV_LINKED + """
select chain_id, idx, rec_type, content_json, prior_hash, record_hash from ll""")
def _(spark, sf):
    return logs.conversation_log(spark, sf).select("chain_id", "idx", "rec_type", "content_json", "prior_hash", "record_hash")


@query("c01_verify_log", EVENTS_LINKED + """
select chain_id, count(*) as n, true as ok, cast(null as bigint) as first_bad, cast(null as varchar) as reason,
       'chain ok (' || count(*) || ' records)' as message from ll group by chain_id""")
def _(spark, sf):
    return integrity.verify_log(logs.events_log(spark, sf))


# --- the same log after tampering ----------------------------------------------
TAMPERED = EVENTS_LINKED + """,
tp as (select chain_id, idx, record_hash,
   case when idx=9 and user_id%10=4 then repeat('f',64) else prior_hash end as prior_hash,
   idx=5 and user_id%10=3 as forged, idx=9 and user_id%10=4 as cut, writer
   from ll where not (idx=7 and user_id%10=6)),
pv as (select *, lag(idx) over w as prev_idx, lag(record_hash) over w as prev_hash
   from tp window w as (partition by chain_id order by idx))"""
SPAN = 16  # small blocks, so that block edges are met at this size


@query("c01_verify_tampered_log", TAMPERED + """,
bad as (select chain_id, idx, case when idx<>coalesce(prev_idx+1,0) then 'index gap'
   when prior_hash<>coalesce(prev_hash,repeat('0',64)) then 'prior_hash mismatch'
   when forged then 'content_hash mismatch' end as reason from pv),
fb as (select chain_id, min(idx) as first_bad, arg_min(reason, idx) as reason from bad where reason is not null group by 1)
select c.chain_id, c.n, f.first_bad is null as ok, f.first_bad, f.reason,
   case when f.first_bad is null then 'chain ok (' || c.n || ' records)' else reason || ' at index ' || f.first_bad end as message
from (select chain_id, count(*) as n from tp group by 1) c left join fb f using (chain_id)""")
def _(spark, sf):
    return integrity.verify_log(tampered(spark, sf), span=SPAN)


@query("w01_link_check", TAMPERED + """
select chain_id, idx, prior_hash, coalesce(prev_hash, repeat('0',64)) as expected_hash from pv
where prior_hash <> coalesce(prev_hash, repeat('0',64))""")
def _(spark, sf):
    return integrity.link_violations(tampered(spark, sf), SPAN)


@query("w02_contiguity", TAMPERED + """
select chain_id, idx from pv where idx <> coalesce(prev_idx+1, 0)""")
def _(spark, sf):
    return integrity.gap_violations(tampered(spark, sf), SPAN)


@query("w03_digest_check", TAMPERED + """
select chain_id, idx, forged as content_bad, forged or cut as record_bad, writer<>'w3' as writer_bad
from pv where forged or cut or writer<>'w3'""")
def _(spark, sf):
    return integrity.digest_violations(tampered(spark, sf), writer="w3")


@query("w04_first_failure", TAMPERED + """
select chain_id, idx, case when idx<>coalesce(prev_idx+1,0) then 'index gap'
   when prior_hash<>coalesce(prev_hash,repeat('0',64)) then 'prior_hash mismatch'
   when forged then 'content_hash mismatch' end as reason from pv
where idx<>coalesce(prev_idx+1,0) or prior_hash<>coalesce(prev_hash,repeat('0',64)) or forged""")
def _(spark, sf):
    return integrity.failures(tampered(spark, sf), span=SPAN)


@query("p21_proof_of_work", EVENTS_LINKED + """
select chain_id, idx, k%3 as difficulty, not starts_with(record_hash, repeat('0', cast(k%3 as integer))) as short
from ll where k%3>0""")
def _(spark, sf):
    want = F.pmod(F.get_json_object("content_json", "$.k").cast("long"), F.lit(3))
    marked = logs.events_log(spark, sf).withColumn("difficulty", want).where("difficulty > 0").withColumn(
        "content_json", F.concat(F.lit('{"_pow":{"difficulty":'), F.col("difficulty").cast("string"), F.lit("}}")))
    return marked.select("chain_id", "idx", "difficulty", integrity.work_shortfall().alias("short"))


@query("c02_semantic_violations", GOV + """,
pt as (select g.*, t.rec_type as target_type from gv g left join gv t on t.chain_id=g.chain_id and t.idx=g.back
       where g.rec_type in ('proposal_recurrence','proposal_status')),
v as (
 select chain_id, idx, 'revision' as "check", revises as target,
   case when revises is null then 'no supersedes pointer' when revises<0 or revises>=length then 'target past the chain' end as message
 from gv join ln using (chain_id) where rec_type='revision'
 union all
 select chain_id, idx, rec_type, back, case when back<0 or back>=length then 'target past the chain'
   when target_type<>'proposal' then 'target is ' || target_type || ' (expected ''proposal'')' end
 from pt join ln using (chain_id)
 union all
 select chain_id, idx, 'reflection', lo, case when lo<0 or hi>=length or lo>hi then
   'range [' || lo || ', ' || hi || '] is outside the chain' end from gv join ln using (chain_id) where rec_type='reflection'
 union all
 select chain_id, idx, 'proposal', list_filter(evidence, lambda e: e<0 or e>=length)[1],
   case when len(list_filter(evidence, lambda e: e<0 or e>=length))>0 then
   'evidence outside the chain: ' || array_to_string(list_filter(evidence, lambda e: e<0 or e>=length), ', ') end
 from gv join ln using (chain_id) where rec_type='proposal')
select * from v where message is not null""")
def _(spark, sf):
    return semantic.semantic_violations(logs.unlinked(logs.governance_rows(spark, sf)))


# --- Merkle -----------------------------------------------------------------------
LEAVES = EVENTS_LINKED + """,
lv as (select chain_id, idx as pos, record_hash as h from ll)"""


@query("a18_merkle_root", LEAVES + ",\n" + merkle_levels("lv", "chain_id", 12) + """
select chain_id, (select count(*) from lv where lv.chain_id=t12.chain_id) as leaves, h as root from t12""")
def _(spark, sf):
    return merkle.merkle_roots(logs.events_log(spark, sf), ["chain_id"], "idx", "record_hash")


@query("a18_merkle_root_one_chain", EVENTS + """,
lv as (select 0::bigint as one, row_number() over (order by ts_ms, chain_id, idx)-1 as pos, sha256(content_json) as h from lg),
""" + merkle_levels("lv", "one", 24) + """
select one as chain_id, (select count(*) from lv) as leaves, h as root from t24""")
def _(spark, sf):
    """All events as the leaves of one chain: a hot key and several rounds of folding."""
    rows = logs.unlinked(logs.events_rows(spark, sf)).withColumn("one", F.lit(0).cast("long"))
    placed = positions(rows, ["one"], F.expr("ts_ms div 60000"), ["ts_ms", "chain_id", "idx"], "pos")
    leaves = placed.select(F.col("one").alias("chain_id"), F.col("pos").cast("long").alias("pos"), F.sha2("content_json", 256).alias("leaf"))
    return merkle.merkle_roots(leaves, ["chain_id"], "pos", "leaf")


RUNS = EVENTS_LINKED + """,
lv as (select chain_id, idx//64 as run, chain_id*1000000 + idx//64 as rk, idx, idx%64 as pos, record_hash as h from ll),
bt as (select rk, min(chain_id) as chain_id, min(idx) as first_idx, max(idx) as last_idx, count(*) as leaves from lv group by rk)"""


@query("a19_seal_batches", RUNS + ",\n" + merkle_levels("lv", "rk", 6) + """
select chain_id, first_idx, last_idx, leaves, t6.h as root_hash, 'pending' as anchor_status from bt join t6 using (rk)""")
def _(spark, sf):
    return merkle.seal_batches(logs.events_log(spark, sf))


@query("j06_batch_of_record", RUNS + """
select lv.chain_id, lv.idx, first_idx, last_idx from lv join bt using (rk)""")
def _(spark, sf):
    log = logs.events_log(spark, sf)
    return (merkle.batch_of(log.select("chain_id", "idx"), merkle.seal_batches(log).select("chain_id", "first_idx", "last_idx"))
            .select("chain_id", "idx", "first_idx", "last_idx"))


_STEPS = " || ".join(
    f"""case when s{i}.n>1 then (case when (lv.pos>>{i})%2=1 then 'L' else 'R' end) || coalesce(b{i}.h, s{i}.h) || ' ' else '' end"""
    for i in range(6))
_JOINS = "\n".join(
    f"""join t{i} s{i} on s{i}.rk=lv.rk and s{i}.pos=lv.pos>>{i}
left join t{i} b{i} on b{i}.rk=lv.rk and b{i}.pos=(case when (lv.pos>>{i})%2=1 then (lv.pos>>{i})-1 else (lv.pos>>{i})+1 end)"""
    for i in range(6))


@query("a20_inclusion_proofs", RUNS + ",\n" + merkle_levels("lv", "rk", 6) + f"""
select lv.chain_id, lv.idx, t6.h as root_hash, trim({_STEPS}) as path, true as ok
from lv join t6 using (rk) {_JOINS}""")
def _(spark, sf):
    log = logs.events_log(spark, sf)
    path = F.array_join(F.transform("proof", lambda s: F.concat(s["side"], s["sibling"])), " ")
    return (merkle.verify_proofs(merkle.inclusion_proofs(log, merkle.seal_batches(log)))
            .select("chain_id", "idx", "root_hash", path.alias("path"), "ok"))


# --- quorum ------------------------------------------------------------------------
WITNESSES = [("w0", "00112233445566778899aabbccddeeff"), ("w1", "a1b2c3d4e5f60718293a4b5c6d7e8f90"),
             ("w2", "0f1e2d3c4b5a69788796a5b4c3d2e1f0")]


def _pads(key):
    raw = bytes.fromhex(key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


_WIT = "wt(witness, ip, op) as (values " + ", ".join(
    "('%s','%s','%s')" % (w, *_pads(k)) for w, k in WITNESSES) + ")"
_MAC = "sha256(unhex(op) || unhex(sha256(unhex(ip) || encode(height || ':' || record_hash))))"
HEADS = EVENTS_LINKED + f""",
{_WIT},
hd as (select chain_id, max(idx) as height, arg_max(record_hash, idx) as record_hash from ll group by 1),
att as (select chain_id, height, record_hash, witness, {_MAC} as mac from hd, wt)"""


def attested(spark, sf):
    """Attestations of all heads; witness w1 garbles some, w2 signs another hash for some."""
    log = logs.events_log(spark, sf)
    good = quorum.attest_heads(log, WITNESSES)
    user = F.expr("chain_id div 1048576")
    forked = F.sha2(F.col("record_hash"), 256)
    swap = (F.col("witness") == "w2") & (F.pmod(user, F.lit(5)).isin(2, 3))
    key = F.lit(dict(WITNESSES)["w2"])
    bad = good.withColumn("record_hash", F.when(swap, forked).otherwise(F.col("record_hash")))
    remade = hmac_sha256(key, F.concat(F.col("height").cast("string"), F.lit(":"), F.col("record_hash")))
    return log, bad.withColumn("mac", F.when(swap, remade).when(
        (F.col("witness") == "w1") & F.pmod(user, F.lit(5)).isin(1, 3), F.reverse("mac")).otherwise(F.col("mac")))


@query("s11_attestations", HEADS + """
select chain_id, height, record_hash, witness, mac from att""")
def _(spark, sf):
    return quorum.attest_heads(logs.events_log(spark, sf), WITNESSES).drop("seq")


_VOTES = HEADS + """,
vt as (select chain_id, height, witness,
  case when witness='w1' and (chain_id//1048576)%5 in (1,3) then 'w1(bad-sig)'
       when witness='w2' and (chain_id//1048576)%5 in (2,3) then 'w2(equivocates)' end as fault from att)"""


@query("a16_quorum", _VOTES + """
select chain_id, height, count(*)-count(fault) as valid, coalesce(string_agg(fault, ', ' order by fault),'') as faulty,
  case when count(*)-count(fault)>=2 then 'OK' else 'FAIL' end as status from vt group by 1,2""")
def _(spark, sf):
    log, votes = attested(spark, sf)
    return quorum.quorum_report(log, votes, WITNESSES, 2)


# --- counts, statuses, corrections ----------------------------------------------------
@query("a01_log_stats", RUNS + """,
q as (select chain_id, count(*) as length, min(ts_ms) as first_ts, max(ts_ms) as last_ts,
  count(*) filter (exposure='quarantine') as quarantined from ll group by 1),
b as (select chain_id, count(*) as sealed, count(*) filter (first_idx=0) as anchored from bt group by 1)
select q.*, sealed, anchored from q join b using (chain_id)""")
def _(spark, sf):
    log = logs.events_log(spark, sf)
    batches = merkle.seal_batches(log)
    receipts = batches.where("first_idx = 0").select("chain_id", "first_idx", F.lit("r").alias("anchor_proof"))
    return stats.log_stats(log, merkle.attach_anchors(batches, receipts))


@query("a02_type_counts", EVENTS + """
select chain_id, rec_type, count(*) as n from lg group by 1,2""")
def _(spark, sf):
    return stats.type_counts(logs.unlinked(logs.events_rows(spark, sf)))


@query("a02_type_rollup", EVENTS + """
select chain_id, rec_type, count(*) as n from lg group by rollup(chain_id, rec_type)""")
def _(spark, sf):
    return stats.type_rollup(logs.unlinked(logs.events_rows(spark, sf)))


@query("a03_count_since", EVENTS + """
select chain_id, count(*) filter (idx>user_id%20 and rec_type='observation') as n from lg group by 1""")
def _(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf))
    marks = log.select("chain_id").distinct().withColumn("after_idx", F.pmod(F.expr("chain_id div 1048576"), F.lit(20)))
    return stats.count_since(log, marks, "observation")


@query("a04_turns_since_reflection", EVENTS + """,
m as (select chain_id, coalesce(max(idx) filter (rec_type='reflection'),-1) as a from lg group by 1)
select chain_id, count(*) filter (idx>a and rec_type='response') as n from lg join m using (chain_id) group by 1""")
def _(spark, sf):
    return stats.turns_since_type(logs.unlinked(logs.events_rows(spark, sf)))


@query("a04_turns_since_watermark", EVENTS + """,
m as (select chain_id, case when max(user_id)%90 > count(*) then 0 else max(user_id)%90 end as w from lg group by 1)
select chain_id, count(*) filter (idx>=w and rec_type='response') as n from lg join m using (chain_id) group by 1""")
def _(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf))
    marks = log.select("chain_id").distinct().withColumn("watermark", F.pmod(F.expr("chain_id div 1048576"), F.lit(90)))
    return stats.turns_since_watermark(log, marks)


def _gov(spark, sf):
    return logs.unlinked(logs.governance_rows(spark, sf))


@query("a05_recurrence_counts", GOV + " select chain_id, idx, sightings from rc")
def _(spark, sf):
    return governance.recurrence_counts(_gov(spark, sf))


@query("a06_escalated", GOV + " select chain_id, idx from rc join es using (chain_id, idx) where sightings>=3 or flagged")
def _(spark, sf):
    return governance.escalated(_gov(spark, sf))


@query("a07_proposal_board", GOV + """ select chain_id, idx, 'topic ' || topic as title, status, sightings,
  sightings>=3 or flagged as escalated from rc join es using (chain_id, idx)""")
def _(spark, sf):
    return governance.proposal_board(_gov(spark, sf))


@query("j08_effective_status", GOV + " select chain_id, idx, status, 'topic' || topic as signature from es")
def _(spark, sf):
    return governance.effective_status(_gov(spark, sf)).select("chain_id", "idx", "status", "signature")


@query("j08_status_as_of", GOV + """
select p.chain_id, p.idx, coalesce(arg_max(s.new_status, s.idx), p.stored) as status
from gv p left join gv s on s.chain_id=p.chain_id and s.rec_type='proposal_status' and s.back=p.idx and s.idx<=30
where p.rec_type='proposal' and p.idx<=30 group by p.chain_id, p.idx, p.stored""")
def _(spark, sf):
    return governance.effective_status(_gov(spark, sf), as_of=30).select("chain_id", "idx", "status")


@query("a25_open_topics", GOV + """
select chain_id, 'topic' || topic as signature, min(idx) as idx from es where status<>'declined' group by 1,2""")
def _(spark, sf):
    return governance.open_topics(_gov(spark, sf))


_SUP = EVENTS + """,
sp as (select chain_id, idx as revision_idx, supersedes as superseded_idx from lg where rec_type='revision')"""


@query("p13_supersedes_pointer", _SUP + " select * from sp")
def _(spark, sf):
    return governance.supersedes_links(logs.unlinked(logs.events_rows(spark, sf)))


@query("j01_revisions_of", _SUP + """
select lg.chain_id, lg.idx, superseded_idx from lg join sp on sp.chain_id=lg.chain_id and sp.revision_idx=lg.idx
join lg o on o.chain_id=sp.chain_id and o.idx=superseded_idx where o.rec_type='observation'""")
def _(spark, sf):
    log = logs.unlinked(logs.events_rows(spark, sf))
    return governance.revisions_of(log, log.where("rec_type = 'observation'")).select("chain_id", "idx", "superseded_idx")


@query("j02_superseded_flag", _SUP + """
select lg.chain_id, lg.idx, lg.rec_type, s.superseded_idx is not null as superseded from lg left join
(select distinct chain_id, superseded_idx from sp) s on s.chain_id=lg.chain_id and s.superseded_idx=lg.idx""")
def _(spark, sf):
    return governance.with_superseded_flag(logs.unlinked(logs.events_rows(spark, sf))).select("chain_id", "idx", "rec_type", "superseded")


@query("j19_corrections", _SUP + """,
nw as (select chain_id, superseded_idx as idx, max(revision_idx) as correction_idx from sp group by 1,2)
select o.chain_id, o.idx, o.rec_type, o.content_json as original, correction_idx, c.content_json as correction
from nw join lg o using (chain_id, idx) join lg c on c.chain_id=nw.chain_id and c.idx=correction_idx""")
def _(spark, sf):
    return governance.corrections(logs.unlinked(logs.events_rows(spark, sf)))


# --- guarded appends --------------------------------------------------------------------------
def _guarded_sql() -> str:
    def judged(name, parity, log, count):
        return f"""
{name}j as (select r.*, case when r.rec_type='revision' and b.event_id is null then 'no such record' when r.rec_type='revision' and z.zone is not null then 'protected zone: ' || z.zone end as reason
  from r left join {log} b on b.chain_id=r.chain_id and b.idx=r.target left join z on z.event_id=b.event_id where o>=10 and k%2={parity}),
{name}a as (select chain_id, event_id, n + row_number() over (partition by chain_id order by o)-1 as idx from {name}j join {count} using (chain_id) where reason is null)"""
    return EVENTS + ",\n" + defaults_values() + """,
z as (select event_id, case when rec_type in ('genesis','system_prompt','principle') then rec_type when coalesce(lg.exposure, d_exposure, 'private')='summary' then 'summary-exposure record' end as zone from lg left join df using (rec_type)),
r as (select chain_id, event_id, idx as o, k, rec_type, case when rec_type='revision' then idx-1-k%8 end as target from lg),
l0 as (select chain_id, event_id, o as idx from r where o<10),
n0 as (select chain_id, count(*) as n from l0 group by 1),""" + judged("a", 0, "l0", "n0") + """,
l1 as (select * from l0 union all select * from aa),
n1 as (select chain_id, count(*) as n from l1 group by 1),""" + judged("b", 1, "l1", "n1") + """
select chain_id, event_id, idx, cast(null as varchar) as reason from l1 union all select chain_id, event_id, idx, null from ba
union all select chain_id, event_id, null, reason from aj where reason is not null union all select chain_id, event_id, null, reason from bj where reason is not null"""


@query("c16_guarded_append", _guarded_sql())
def _(spark, sf):
    """Two writers prepare on the same version; the second loses, and is judged and linked on the first one's heads."""
    rows = stored(logs.events_rows(spark, sf).withColumn("k", F.get_json_object("content_json", "$.k").cast("long")).withColumn(
        "target", F.when(F.col("rec_type") == "revision", F.col("seq") - 1 - F.pmod("k", F.lit(8)))))
    table = GuardedLog(spark, f"{shared_dir(spark).rstrip('/')}/guarded-{uuid.uuid4().hex}")
    table.append(rows.where("seq < 10").withColumn("target", F.lit(None).cast("long")))
    first, second = rows.where("seq >= 10 and k % 2 = 0"), rows.where("seq >= 10 and k % 2 = 1")
    early, late = table.prepare(first), table.prepare(second)
    if not table.publish(early) or table.publish(late):
        raise RuntimeError("one of two writers on one version must win")
    table.drop(late)
    table.append(second)
    event = F.get_json_object("content_json", "$.event_id").cast("long").alias("event_id")
    taken = table.read().select("chain_id", event, "idx", F.lit(None).cast("string").alias("reason"))
    return taken.unionByName(table.rejects().select("chain_id", event, F.lit(None).cast("long").alias("idx"), "reason"))
