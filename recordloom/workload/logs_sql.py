"""SQL twins of the log adapters, as common table expressions."""

ER = """er as (
  select event_id, user_id, epoch_us(ts)//1000 as ts_ms, event_type,
         cast(regexp_extract(props,'(\\d+)',1) as bigint) as k,
         cast(round(value*100) as bigint) as cents,
         row_number() over (partition by user_id order by ts,event_id)-1 as pos
  from events),
er2 as (select *, user_id*1048576 as chain_id, pos as idx,
         case when k>=90 then 'quarantine' when k>=80 then 'shared' when k>=70 then 'public' end as exposure
         from er),
lg as (select chain_id, idx, ts_ms, k, cents, event_id, exposure, user_id,
         case event_type when 'click' then 'observation' when 'view' then 'response'
              when 'purchase' then 'reflection' when 'error' then 'revision'
              else case when idx=0 then 'genesis' else 'principle' end end as rec_type,
         case when event_type='error' then idx-1 end as supersedes,
         event_type='view' and idx>0 as cites_prior,
         'w' || (user_id%7) as writer,
         '{' || case when exposure is not null or event_type='error' then
             '"_meta":{' || concat_ws(',', case when exposure is not null then '"exposure":"'||exposure||'"' end,
                                       case when event_type='error' then '"supersedes":'||(idx-1) end) || '},'
             else '' end
         || '"cents":' || cents || ',"event_id":' || event_id || ',"k":' || k || '}' as content_json
       from er2)"""

CR = """lg as (
  select conv_id as chain_id, turn as idx, 1700000000000 + conv_id*86400000 + turn*60000 as ts_ms,
         case role when 'user' then 'observation' when 'assistant' then 'response' else 'system_prompt' end as rec_type,
         '{' || case when length(text)%5=0 then '"_meta":{"exposure":"' || case when length(text)%15=0 then 'quarantine' else 'private' end || '",'
            || case when length(text)%10=0 then '"modalities_activated":["artifact_content"],' else '' end
            || '"salience":0.' || (length(text)%9+1) || '},' else '' end || '"text":' || to_json(text) || '}' as content_json, text, role,
         length(text)%15=0 as hidden, case when length(text)%5=0 then (length(text)%9+1)/10.0 end as own_salience,
         length(text)%10=0 as moded,
         role='assistant' and turn>0 as cites_prior, 'w0' as writer
  from conversations)"""

LINK = """pr as (select *, sha256(content_json) as content_hash,
         '{"content":' || content_json || ',"content_hash":"' || sha256(content_json) || '","index":' || idx
           || ',"prior_hash":"' as head,
         '","pubkey":"' || writer || '","refs":[' || case when cites_prior then '"' else '' end as middle,
         case when cites_prior then '"' else '' end || '],"timestamp":' || ts_ms || ',"type":"' || rec_type || '"}' as tail
       from lg),
hc as (select chain_id, idx, repeat('0',64) as prior_hash, sha256(head || repeat('0',64) || middle || tail) as record_hash
       from pr where idx=0
       union all
       select p.chain_id, p.idx, h.record_hash,
              sha256(p.head || h.record_hash || p.middle || case when p.cites_prior then h.record_hash else '' end || p.tail)
       from hc h join pr p on p.chain_id=h.chain_id and p.idx=h.idx+1),
ll as (select pr.*, hc.prior_hash, hc.record_hash from pr join hc using (chain_id, idx))"""

EVENTS = f"with {ER}"
EVENTS_LINKED = f"with recursive {ER},\n{LINK}"
CONV = f"with {CR}"
CONV_LINKED = f"with recursive {CR},\n{LINK}"

_GV = """gv as (select chain_id, idx, k, ts_ms,
   case when rec_type in ('genesis','principle') then 'proposal' when rec_type='observation' then 'proposal_recurrence'
        when rec_type='response' then 'proposal_status' else rec_type end as rec_type,
   idx-1-k%8 as back, k%6 as topic, k>=95 as flagged, case when k<4 then 'declined' else 'open' end as stored,
   case k%3 when 0 then 'accepted' when 1 then 'declined' else 'done' end as new_status,
   idx - k%20 as lo, idx-1 as hi, case when k%9=0 then null else idx-1-k%5 end as revises,
   [idx-1, idx+k%5] as evidence from lg),
ln as (select chain_id, count(*) as length from gv group by chain_id),
rc as (select p.chain_id, p.idx, 1+count(r.idx) as sightings from gv p left join gv r
       on r.chain_id=p.chain_id and r.rec_type='proposal_recurrence' and r.back=p.idx
       where p.rec_type='proposal' group by 1,2),
es as (select p.chain_id, p.idx, p.topic, p.flagged, coalesce(arg_max(s.new_status, s.idx), p.stored) as status
       from gv p left join gv s on s.chain_id=p.chain_id and s.rec_type='proposal_status' and s.back=p.idx
       where p.rec_type='proposal' group by p.chain_id, p.idx, p.topic, p.flagged, p.stored)"""
GOV = f"with {ER},\n{_GV}"


def merkle_levels(source: str, key: str, levels: int, prefix: str = "t") -> str:
    """CTEs t0..tN of a Merkle tree over `source`(key, pos, h)."""
    out = [f"{prefix}0 as (select {key}, pos, h, count(*) over (partition by {key}) as n from {source})"]
    for i in range(levels):
        left, right = "max(case when pos%2=0 then h end)", "max(case when pos%2=1 then h end)"
        out.append(f"{prefix}{i+1} as (select {key}, pos//2 as pos, case when n=1 then {left} else "
                   f"sha256(unhex({left}) || unhex(coalesce({right}, {left}))) end as h, (n+1)//2 as n "
                   f"from {prefix}{i} group by {key}, pos//2, n)")
    return ",\n".join(out)

FILES = """with lg as (select cast(regexp_extract(source,'(\\d+)',1) as bigint) as chain_id,
   row_number() over (partition by source order by doc_id)-1 as idx, doc_id, sha256(text) as sha,
   'doc_' || doc_id || '.txt' as filename, n_chars, case when doc_id%7=0 then 'response' else 'file' end as rec_type
   from documents)"""


def defaults_values() -> str:
    from recordloom.fixed_values import META_DEFAULTS
    rows = ", ".join(f"('{t}','{s}','{e}','{x}',{a},{h})" for t, s, e, x, a, h in META_DEFAULTS)
    return f"df(rec_type, d_source, d_epistemic, d_exposure, d_salience, d_half) as (values {rows})"
