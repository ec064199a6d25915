"""Lookups and projections over the record log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions import text as tx

SKIPPED_KEYS = ("labels", "state", "_meta", "poq_verdict")


def lookup(log: DataFrame, keys: DataFrame, by: str = "idx") -> DataFrame:
    """Records whose (chain_id, idx), or record_hash, is listed in `keys`."""
    on = ["record_hash"] if by == "record_hash" else ["chain_id", "idx"]
    return log.join(keys.select(*on).distinct(), on, "left_semi")


def where_content(log: DataFrame, path: str, value) -> DataFrame:
    """Records whose JSON payload holds `value` at `path`."""
    return log.where(F.get_json_object("content_json", path) == F.lit(value).cast("string"))


def blob_entries(log: DataFrame) -> DataFrame:
    """(chain_id, idx, sha, filename) of file and attachment records and of files attached to responses."""
    one = "blob_sha256 string, filename string"
    c = F.from_json("content_json", f"{one}, attachments array<struct<blob_sha256: string, filename: string>>")
    rows = log.where(F.col("rec_type").isin("file", "attachment", "response")).select(
        "chain_id", "idx", F.when(F.col("rec_type") == "response", c["attachments"]).otherwise(
            F.array(F.struct(c["blob_sha256"].alias("blob_sha256"), c["filename"].alias("filename")))).alias("_e"))
    return (rows.select("chain_id", "idx", F.explode("_e").alias("e"))
            .select("chain_id", "idx", F.col("e.blob_sha256").alias("sha"), F.col("e.filename").alias("filename"))
            .where("coalesce(sha, '') <> ''"))


def blob_index(log: DataFrame) -> DataFrame:
    """Newest record and file name per content digest and chain."""
    return blob_entries(log).groupBy("chain_id", "sha").agg(
        F.max("idx").alias("idx"), F.max_by("filename", "idx").alias("filename"))


def blobs_by_prefix(index: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Resolve digest prefixes of eight or more characters; null unless exactly one digest matches."""
    p = prefixes.select("prefix", F.regexp_replace("prefix", "[.…]+$", "").alias("_p")).withColumn(
        "_head", F.when(F.length("_p") >= 8, F.substring("_p", 1, 8)))
    hits = (p.join(index.select("sha", F.substring("sha", 1, 8).alias("_head")).distinct(), "_head")
            .where(F.startswith("sha", "_p")).groupBy("prefix").agg(F.count("*").alias("_n"), F.min("sha").alias("_sha")))
    return p.select("prefix").distinct().join(hits, "prefix", "left").select(
        "prefix", F.when(F.col("_n") == 1, F.col("_sha")).alias("sha"))


def exact_copies(df: DataFrame, key: str, content: str) -> DataFrame:
    """Members of groups with byte-identical content: (sha, key, copies, first)."""
    rows = df.select(key, F.sha2(content, 256).alias("sha"))
    groups = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")
    return rows.join(groups, "sha")


def ring_view(log: DataFrame) -> DataFrame:
    """Log rows under their other names; payloads that are no objects are wrapped, the quality block is lifted."""
    body = F.col("content_json")
    return log.select("chain_id", F.col("idx").alias("index"), F.col("rec_type").alias("ring_type"),
                      F.col("ts_ms").alias("timestamp"), F.col("record_hash").alias("ring_hash"),
                      F.col("prior_hash").alias("prev_hash"),
                      F.when(F.startswith(F.ltrim(body), F.lit("{")), body).otherwise(
                          F.concat(F.lit('{"value":'), body, F.lit("}"))).alias("payload"),
                      F.get_json_object(body, "$._meta.poq").alias("poq"))


def payload_text(content: Column | str, skipped: tuple[str, ...] = SKIPPED_KEYS) -> Column:
    """All strings of a JSON payload joined by blanks; a block's own content stands alone.

    Nested values are replaced in place by what they hold, level by level, until only scalars are
    left: there are at most as many levels as opening brackets. Objects give their values in the
    order of their keys, as canonical JSON has them. Null, empty and malformed payloads give an
    empty text; a content that is no string gives its JSON.
    """
    raw = F.col(content) if isinstance(content, str) else content
    body = F.try_parse_json(raw)

    def held(value: Column) -> Column:
        fields = F.filter(F.map_entries(value.try_cast("map<string,variant>")), lambda e: ~e["key"].isin(*skipped))
        return F.coalesce(F.transform(fields, lambda e: e["value"]), value.try_cast("array<variant>"), F.array(value))

    def level(values: Column) -> Column:
        return F.flatten(F.transform(values, held))

    def nested(values: Column) -> Column:
        return F.exists(values, lambda v: v.try_cast("map<string,variant>").isNotNull() | v.try_cast("array<variant>").isNotNull())

    start = F.struct(F.array(body).alias("values"), nested(F.array(body)).alias("open"))
    levels = F.sequence(F.lit(0), F.length(F.regexp_replace(raw, r"[^\[{]", "")))

    def deeper(state: Column, _: Column) -> Column:
        inner = level(state["values"])
        return F.when(state["open"], F.struct(inner.alias("values"), nested(inner).alias("open"))).otherwise(state)

    leaves = F.aggregate(levels, start, deeper)["values"]
    strings = F.filter(leaves, lambda v: F.schema_of_variant(v) == "STRING")
    joined = F.array_join(F.transform(strings, lambda v: v.cast("string")), " ")
    own = F.try_variant_get(body, "$.data.content", "variant")
    return F.when(own.isNotNull(), F.coalesce(own.cast("string"), F.lit(""))).otherwise(F.coalesce(joined, F.lit("")))


def keyword_rows(df: DataFrame, key: str, text: str, n: int, **kw) -> DataFrame:
    """Top n keywords of each row, one row per word with its count and place."""
    return df.select(key, F.posexplode(tx.top_keywords(F.col(text), n, **kw)).alias("place", "k")).select(
        key, (F.col("place") + 1).cast("long").alias("place"), F.col("k.w").alias("word"), F.col("k.n").alias("n"))
