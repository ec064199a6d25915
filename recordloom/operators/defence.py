"""Intake screening, learned scars, intrusion scan and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.operators.integrity import verify_log


def covenant_score(text: Column) -> Column:
    hits = tx.contains_count(F.lower(text), fv.VIOLATIONS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.92 - 0.45 * hits))


def match_scars(texts: DataFrame, scars: DataFrame, key: str = "text_id") -> DataFrame:
    """First scar (scar_id, ordinal, vector) whose words a text (key, text) shares enough of.

    An equi-join on words: only pairs with a common word arise, and the count decides.
    """
    words = texts.select(key, F.explode(F.array_distinct(tx.tokenize(F.col("text")))).alias("_w"))
    vectors = scars.select("scar_id", "ordinal", F.array_distinct("vector").alias("_v")).select(
        "scar_id", "ordinal", F.greatest(F.lit(2), F.floor(F.size("_v") / 2)).alias("_need"), F.explode("_v").alias("_w"))
    shared = (words.join(vectors, "_w").groupBy(key, "scar_id", "ordinal").agg(
        F.count("*").alias("shared"), F.max("_need").alias("_need")).where(F.col("shared") >= F.col("_need")))
    return shared.groupBy(key).agg(F.min_by(F.struct("scar_id", "shared"), "ordinal").alias("m")).select(key, "m.*")


def screen(texts: DataFrame, scars: DataFrame, key: str = "text_id", floor: float = fv.COVENANT_FLOOR) -> DataFrame:
    """Which inputs to refuse: a covenant score below the floor or a known scar."""
    scored = texts.select(key, F.round(covenant_score(F.col("text")), 3).alias("covenant"))
    return (scored.join(match_scars(texts, scars, key).select(key, F.col("scar_id").alias("scar")), key, "left")
            .withColumn("blocked", (F.col("covenant") < floor) | F.col("scar").isNotNull()))


def summary_text(content: Column) -> Column:
    """Short handle of a record for scanning."""
    return F.coalesce(tx.handle(content), F.get_json_object(content, "$.note"), F.lit(""))


def active_rows(log: DataFrame, quarantine: DataFrame | None) -> DataFrame:
    """Rows outside all quarantined ranges (chain_id, from_idx, to_idx)."""
    if quarantine is None:
        return log
    q = quarantine.select(F.col("chain_id").alias("_c"), "from_idx", "to_idx")
    return log.join(q, (log["chain_id"] == q["_c"]) & (log["idx"] >= q["from_idx"]) & (log["idx"] <= q["to_idx"]), "left_anti")


def breaches(log: DataFrame, quarantine: DataFrame | None = None, floor: float = fv.COVENANT_FLOOR) -> DataFrame:
    """Sealed records that read as covenant violations."""
    rows = active_rows(log, quarantine).where((F.col("idx") != 0) & ~F.col("rec_type").isin(fv.SCAN_SKIPS))
    return rows.where(covenant_score(summary_text(F.col("content_json"))) < floor).select("chain_id", "idx")


def intrusion_scan(log: DataFrame, quarantine: DataFrame | None = None, floor: float = fv.COVENANT_FLOOR) -> DataFrame:
    """Per chain: integrity verdict, number of breaches and the first bad height."""
    bad = breaches(log, quarantine, floor).groupBy("chain_id").agg(
        F.count("*").alias("breaches"), F.min("idx").alias("first_bad_height"))
    return (verify_log(log).select("chain_id", F.col("ok").alias("intact"), "message")
            .join(bad, "chain_id", "left").fillna(0, ["breaches"])
            .withColumn("compromised", ~F.col("intact") | (F.col("breaches") > 0)))


def scar_vectors(log: DataFrame, ranges: DataFrame, size: int = 8) -> DataFrame:
    """The most common words of each quarantined range (chain_id, from_idx, to_idx), earlier seen first on ties."""
    rows = log.join(ranges, "chain_id").where("idx between from_idx and to_idx")
    words = rows.select("chain_id", "from_idx", "idx", F.posexplode(tx.tokenize(summary_text(F.col("content_json")))).alias("pos", "word"))
    counts = words.groupBy("chain_id", "from_idx", "word").agg(F.count("*").alias("n"), F.min(F.struct("idx", "pos")).alias("_first"))
    place = F.row_number().over(W.partitionBy("chain_id", "from_idx").orderBy(F.desc("n"), "_first"))
    return (counts.withColumn("place", place).where(F.col("place") <= size)
            .groupBy("chain_id", "from_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))),
                                                             lambda s: s["word"]).alias("vector")))


def rollback(log: DataFrame, first_bad: DataFrame, lesson: str = "prompt-injection / jailbreak",
             known_scars: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quarantine everything from each chain's first bad height (chain_id, first_bad) to its head.

    Gives (quarantine ranges, scars, recovery records ready for an append).
    """
    heads = log.groupBy("chain_id").agg(F.max("idx").alias("_head"), F.max("ts_ms").alias("_ts"))
    ranges = (first_bad.select("chain_id", "first_bad").join(heads, "chain_id")
              .where("first_bad >= 1 and first_bad <= _head")
              .select("chain_id", F.col("first_bad").alias("from_idx"), F.col("_head").alias("to_idx"), "_ts"))
    before = F.lit(0) if known_scars is None else F.coalesce("_known", F.lit(0))
    numbered = ranges if known_scars is None else ranges.join(
        known_scars.groupBy("chain_id").agg(F.count("*").alias("_known")), "chain_id", "left")
    ordinal = before + 1
    scars = (numbered.join(scar_vectors(log, ranges.select("chain_id", "from_idx", "to_idx")), ["chain_id", "from_idx"], "left")
             .select("chain_id", F.concat(F.lit("scar"), ordinal.cast("string")).alias("scar_id"), ordinal.cast("long").alias("ordinal"),
                     F.coalesce("vector", F.array().cast("array<string>")).alias("vector"), "from_idx", "to_idx", "_ts", F.lit(lesson).alias("lesson")))
    safe = log.select("chain_id", (F.col("idx") + 1).alias("from_idx"), F.col("record_hash").alias("_safe_hash"))
    content = F.to_json(F.struct(
        F.lit("recovery").alias("event"), F.lit(lesson).alias("lesson"),
        F.struct("from_idx", "to_idx").alias("quarantined"), F.col("_safe_hash").alias("resumed_from_hash"),
        (F.col("from_idx") - 1).alias("resumed_from_height"), F.struct("scar_id", "vector").alias("scar")))
    recovery = scars.join(safe, ["chain_id", "from_idx"]).select(
        "chain_id", F.lit(0).cast("long").alias("seq"), F.col("_ts").alias("ts_ms"), F.lit("recovery").alias("rec_type"),
        content.alias("content_json"), F.array().cast("array<string>").alias("refs"), F.lit("w0").alias("writer"),
        F.lit(False).alias("cites_prior"))
    return ranges.drop("_ts"), scars.drop("_ts"), recovery


def immune_status(log: DataFrame, quarantine: DataFrame, scars: DataFrame) -> DataFrame:
    """Active rows, active head and number of scars per chain."""
    active = active_rows(log, quarantine).groupBy("chain_id").agg(F.count("*").alias("active"), F.max("idx").alias("active_head"))
    n = scars.groupBy("chain_id").agg(F.count("*").alias("scars"))
    return (log.groupBy("chain_id").agg(F.count("*").alias("length")).join(active, "chain_id", "left")
            .join(n, "chain_id", "left").fillna(0, ["active", "scars"]))


def defence_status(log: DataFrame, quarantine: DataFrame, scars: DataFrame, quorum: DataFrame | None = None,
                   antibodies: DataFrame | None = None) -> DataFrame:
    """One row on the whole posture: integrity, quarantine, scars, quorum and antibodies."""
    out = verify_log(log).agg(F.count("*").alias("chains"), F.count_if("ok").alias("intact"), F.sum("n").alias("records"))
    parts = [quarantine.agg(F.coalesce(F.sum(F.col("to_idx") - F.col("from_idx") + 1), F.lit(0)).alias("quarantined")),
             scars.agg(F.count("*").alias("scars"))]
    if quorum is not None:
        parts.append(quorum.agg(F.count("*").alias("attested"), F.count_if(F.col("status") == "OK").alias("quorum_ok")))
    if antibodies is not None:
        parts.append(antibodies.agg(F.count("*").alias("antibodies")))
    for p in parts:  # one-row frames meet on a constant
        out = out.withColumn("_one", F.lit(1)).join(p.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out
