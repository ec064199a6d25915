"""The queries of this subpackage, one per operator, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm import (blob_ledger, bloom_lm, divergence, hard_negatives, language_id, license_rules, mixing, near_dedup, ordinal,
                            periodic_runs, sharding, telephony, trie_bpe)
from recordloom.llm.common import documents, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def _ids_text(ids):
    return F.array_join(ids.cast("array<string>"), ",")


@query("op6_trie_bpe")
def op6(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = trie_bpe.decode(trie_bpe.encode(documents(spark, sf_dir), path), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(_ids_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_mixing")
def op7(spark, sf_dir):
    plan = mixing.plan_mix(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws")


@query("op9_telephony")
def op9(spark, sf_dir):
    return telephony.round_trip(documents(spark, sf_dir))


def _sharding_sql() -> str:
    names = ", ".join(f"'{n}'" for n in sharding.lookup_table())
    return f"""
with hashed as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as key_hash from documents)
select doc_id, key_hash, key_hash % {sharding.SIZE} as slot, ([{names}])[(key_hash % {sharding.SIZE} + 1)::int] as shard from hashed"""


@query("op10_sharding", _sharding_sql())
def op10(spark, sf_dir):
    return sharding.place(documents(spark, sf_dir), "doc_id")


@query("op1_divergence")
def op1(spark, sf_dir):
    return divergence.judge(documents(spark, sf_dir))


@query("op3_blob_ledger")
def op3(spark, sf_dir):
    found = blob_ledger.scan_documents(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("found", lambda f: f["kind"].isin(*[r.kind for r in blob_ledger.BASE]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(blob_ledger.span_text(base), 256).alias("base_sha256"),
                        blob_ledger.span_text(F.col("found")).alias("spans"), "blob")


@query("op5_license_rules")
def op5(spark, sf_dir):
    return license_rules.licenses(documents(spark, sf_dir))


@query("op2_ordinal")
def op2(spark, sf_dir):
    return ordinal.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op4_near_dedup")
def op4(spark, sf_dir):
    return near_dedup.link(documents(spark, sf_dir))


@query("op8_bloom_lm")
def op8(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return bloom_lm.score(documents(spark, sf_dir), held_out)


@query("op11_language_id")
def op11(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return language_id.identify(documents(spark, sf_dir), held_out)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    return periodic_runs.digest(documents(spark, sf_dir))


_HARD_NEGATIVES_SQL = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x, row_number() over (order by vec_id) as row
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pairs as (
    select a.row as anchor, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
        cast(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) as bigint) as score, b.row as other
    from rows a join rows b on a.vec_id % 50 = 0 and a.row <> b.row),
positives as (
    select *, row_number() over (partition by anchor order by score desc, other_id) as place from pairs where same
    qualify place <= 5)
select p.anchor_id, p.other_id as positive_id,
    cast(row_number() over (partition by p.anchor, p.place order by n.score desc, n.other_id) as int) as rank,
    n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on n.anchor = p.anchor and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3"""


@query("op13_hard_negatives", _HARD_NEGATIVES_SQL)
def op13(spark, sf_dir):
    vectors = hard_negatives.whole_numbers(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
