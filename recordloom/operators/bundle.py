"""Governed export, verification and import of record bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.functions.hashing import canonical_json, hmac_sha256, record_message_parts
from recordloom.operators.merkle import merkle_roots
from recordloom.operators.blocks import SPAN, positions
from recordloom.operators.meta import resolve_meta
from recordloom.session import stored

VERSION = 2
STRENGTH = ["known", "user_context", "inferred", "speculative", "disputed"]
BUNDLE_RECORD = """struct<idx: bigint, prior_hash: string, ts_ms: bigint, rec_type: string, body: string,
 refs: array<string>, writer: string, content_hash: string, record_hash: string, exposure: string,
 epistemic_class: string, redacted: boolean, summary_commitment: string, pos: bigint>"""


def summary_body(content: Column) -> Column:
    """What may leave of a summary-only record: its title and summary, and the metadata."""
    c = F.from_json(content, "_meta string, summary string, title string")
    withheld = F.when(c["title"].isNull() & c["summary"].isNull(), "(summary withheld)").otherwise(c["summary"])
    meta = F.get_json_object(content, "$._meta")
    rest = F.to_json(F.struct(withheld.alias("summary"), c["title"].alias("title")))
    return canonical_json(F.when(meta.isNotNull(), F.concat(
        F.lit('{"_meta":'), meta, F.lit(","), F.substr(rest, F.lit(2)))).otherwise(rest))


def commitment(record_hash: Column, body: Column, key_hex: Column) -> Column:
    """Keyed digest that ties a summary to one origin record."""
    message = F.concat(F.lit('{"kind":"summary-commitment","origin_record_hash":"'), record_hash,
                       F.lit('","summary":'), body, F.lit("}"))
    return hmac_sha256(key_hex, message)


def select_records(log: DataFrame, keys: DataFrame | None = None, rec_type: str | None = None, min_salience: float = 0.0,
                   after_ms: int | None = None, before_ms: int | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """Records that may leave and match the filters; private and quarantined ones never do."""
    rows = resolve_meta(log).where(F.col("meta.exposure").isin("summary", "shared", "public"))
    if keys is not None:
        rows = rows.join(keys.select("chain_id", "idx").distinct(), ["chain_id", "idx"], "left_semi")
    if rec_type is not None:
        rows = rows.where(F.col("rec_type") == rec_type)
    rows = rows.where(F.col("meta.salience") >= min_salience)
    if after_ms is not None:
        rows = rows.where(F.col("ts_ms") >= after_ms)
    if before_ms is not None:
        rows = rows.where(F.col("ts_ms") < before_ms)
    if tags is not None:
        have = F.from_json("content_json", "tags array<string>")["tags"]
        rows = rows.where(F.coalesce(F.arrays_overlap(have, F.array(*[F.lit(t) for t in tags])), F.lit(False)))
    return rows


def _header_json() -> Column:
    return F.to_json(F.struct("created_at", F.lit(VERSION).alias("format_version"), "merkle_root", "note",
                              "origin", "record_count", "title"))


def _sealed(records: DataFrame) -> DataFrame:
    roots = merkle_roots(records, ["bundle_key"], "pos", "record_hash")
    return roots.select("bundle_key", F.col("leaves").alias("record_count"), F.col("root").alias("merkle_root"))


def export_bundle(log: DataFrame, key_hex: str, created_at: int, title: str = "", note: str = "",
                  **filters) -> tuple[DataFrame, DataFrame]:
    """(headers, records): one bundle per chain and writer. The id is the digest of the header,
    which binds the records through their Merkle root and count."""
    rows = select_records(log, **filters)
    redacted = F.col("meta.exposure") == "summary"
    body = F.when(redacted, summary_body(F.col("content_json"))).otherwise(F.col("content_json"))
    keyed = rows.withColumn("bundle_key", F.concat(F.col("chain_id").cast("string"), F.lit(":"), "writer"))
    placed = positions(keyed, ["bundle_key"], F.expr(f"idx div {SPAN}"), ["idx"], "pos")
    out = placed.select(
        "bundle_key", "idx", "prior_hash", "ts_ms", "rec_type", body.alias("body"), "refs", "writer", "content_hash",
        "record_hash", F.col("meta.exposure").alias("exposure"), F.col("meta.epistemic_class").alias("epistemic_class"),
        redacted.alias("redacted"), "pos")
    out = out.withColumn("summary_commitment", F.when(
        F.col("redacted"), commitment(F.col("record_hash"), F.col("body"), F.lit(key_hex))).otherwise(""))
    headers = (_sealed(out).withColumns({
        "origin": F.substring_index("bundle_key", ":", -1), "created_at": F.lit(created_at).cast("long"),
        "title": F.lit(title), "note": F.lit(note), "format_version": F.lit(VERSION)})
        .withColumn("bundle_id", F.sha2(_header_json(), 256)))
    return headers, out


def verify_bundle(headers: DataFrame, records: DataFrame, key_hex: str) -> DataFrame:
    """One verdict per bundle; the first failing check names it and the whole bundle is refused."""
    origin = headers.select("bundle_key", "origin")
    head, middle, tail = record_message_parts({"content_json": F.col("body"), "cites_prior": F.lit(False)})
    digest = F.sha2(F.concat(head, F.col("prior_hash"), middle, tail), 256)
    plain = ~F.col("redacted")
    check = F.struct
    problem = (F.when(F.col("writer") != F.col("origin"), "writer does not match the origin")
               .when(plain & (F.sha2(canonical_json(F.col("body")), 256) != F.col("content_hash")), "content_hash mismatch")
               .when(plain & (digest != F.col("record_hash")), "record_hash mismatch")
               .when(~plain & (F.col("summary_commitment") == ""), "missing summary commitment")
               .when(~plain & (commitment(F.col("record_hash"), F.col("body"), F.lit(key_hex)) != F.col("summary_commitment")),
                     "bad summary commitment")
               .when(plain & (F.col("summary_commitment") != ""), "unexpected summary commitment"))
    bad = (records.join(origin, "bundle_key").withColumn("_bad", problem).where("_bad is not null")
           .groupBy("bundle_key").agg(F.min_by(check("_bad", "idx"), "pos").alias("p")))
    facts = _sealed(records).withColumnsRenamed({"record_count": "_count", "merkle_root": "_root"})
    rows = headers.join(facts, "bundle_key", "left").join(bad, "bundle_key", "left")
    problem = (F.when(F.col("format_version") != VERSION, "unsupported format version")
               .when(F.coalesce("origin", F.lit("")) == "", "missing origin")
               .when(F.col("_count").isNull(), "no records")
               .when(F.col("p").isNotNull(), F.concat(F.col("p._bad"), F.lit(" at index "), F.col("p.idx").cast("string")))
               .when((F.col("_root") != F.col("merkle_root")) | (F.col("_count") != F.col("record_count")), "record set altered")
               .when(F.sha2(_header_json(), 256) != F.col("bundle_id"), "bundle_id mismatch"))
    return rows.select("bundle_key", "bundle_id", problem.isNull().alias("ok"), F.coalesce(problem, F.lit("bundle ok")).alias("message"))


def demote(epistemic: Column) -> Column:
    """An imported claim is never stronger than inferred."""
    return F.when(epistemic.isin("speculative", "disputed"), epistemic).otherwise("inferred")


#: Imported records go to so many chains, numbered from here on.
IMPORT_CHAINS, IMPORT_BASE = 4096, 1 << 40


def imported_ids(log: DataFrame) -> DataFrame:
    """Bundle ids that a log holds, for a ledger that was lost."""
    return (log.where("rec_type = 'imported_capsule'")
            .select(F.get_json_object("content_json", "$.bundle_id").alias("bundle_id")).distinct())


def record_imports(ids: DataFrame, path: str) -> None:
    """Add bundle ids to the ledger of imports, in folders by their first byte."""
    ids.select("bundle_id", F.substring("bundle_id", 1, 2).alias("part")).write.mode("append").partitionBy("part").parquet(path)


def known_imports(spark, path: str) -> DataFrame:
    """The ledger; a join on `part` and `bundle_id` reads only the folders of the asked ids."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    schema = "bundle_id string, part string"
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def import_chain(bundle_id: Column, chains: int = IMPORT_CHAINS, base: int = IMPORT_BASE) -> Column:
    """The chain of a bundle: by its id, so that the bundles of one origin spread and a bundle stays together."""
    return F.lit(base) + F.pmod(F.conv(F.substring(bundle_id, 1, 15), 16, 10).cast("long"), F.lit(chains))


def import_bundle(headers: DataFrame, records: DataFrame, key_hex: str, known: DataFrame, ts_ms: int,
                  chains: int = IMPORT_CHAINS, base: int = IMPORT_BASE) -> tuple[DataFrame, DataFrame]:
    """(rows to append, ids for the ledger) of all bundles that verify and are not in the ledger `known`.

    Each bundle goes to one of `chains` chains, those of a chain in order of their ids. The places of its records
    follow from the counts of the bundles before, so only headers are ranked and no record meets
    another; linking then runs chain by chain in as many tasks.
    """
    good = verify_bundle(headers, records, key_hex).where("ok").select("bundle_key")
    part = F.substring("bundle_id", 1, 2).alias("part")
    fresh = (headers.join(good, "bundle_key", "left_semi").dropDuplicates(["bundle_id"]).select("bundle_key", "bundle_id", part, "origin", "record_count")
             .join(known.select("part", "bundle_id"), ["part", "bundle_id"], "left_anti"))
    before = W.partitionBy("chain_id").orderBy("bundle_id").rowsBetween(W.unboundedPreceding, -1)  # one row per bundle
    placed = stored(fresh.withColumn("chain_id", import_chain(F.col("bundle_id"), chains, base))
                    .withColumn("_start", F.coalesce(F.sum("record_count").over(before), F.lit(0))))
    rows = records.join(placed.select("bundle_key", "bundle_id", "origin", "chain_id", "_start"), "bundle_key")
    meta = F.concat(F.lit('{"confidence":0.6,"epistemic_class":"'), demote(F.col("epistemic_class")),
                    F.lit('","exposure":"private","salience":0.35,"schema_version":3,"source":"peer_agent"}'))
    content = F.concat(
        F.lit('{"_meta":'), meta, F.lit(',"bundle_id":"'), F.col("bundle_id"), F.lit('","imported_body":'), F.col("body"),
        F.lit(',"origin":"'), F.col("origin"), F.lit('","origin_index":'), F.col("idx").cast("string"),
        F.lit(',"origin_record_hash":"'), F.col("record_hash"), F.lit('","origin_redacted":'), F.col("redacted").cast("string"),
        F.lit(',"origin_type":"'), F.col("rec_type"), F.lit('"}'))
    out = rows.select(
        "chain_id", (F.col("_start") + F.col("pos")).cast("long").alias("seq"), F.lit(ts_ms).cast("long").alias("ts_ms"),
        F.lit("imported_capsule").alias("rec_type"), content.alias("content_json"),
        F.array().cast("array<string>").alias("refs"), F.lit("w0").alias("writer"), F.lit(False).alias("cites_prior"))
    return out, placed.select("bundle_id")


def write_bundle(headers: DataFrame, records: DataFrame, path: str) -> None:
    """Header lines and record lines side by side; any size, no document built in one task."""
    headers.write.mode("overwrite").json(f"{path}/headers")
    records.write.mode("overwrite").json(f"{path}/records")


def read_bundle(spark, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.json(f"{path}/headers", schema=(
        "bundle_key string, record_count long, merkle_root string, origin string, created_at long, title string, "
        "note string, format_version int, bundle_id string"))
    records = spark.read.json(f"{path}/records", schema=f"bundle_key string, {BUNDLE_RECORD[7:-1].replace(': ', ' ')}")
    return headers, records
