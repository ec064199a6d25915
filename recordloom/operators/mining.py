"""Recurring topics, contradictions and output modes in the history, and what to propose about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.operators.governance import ESCALATE_AT, open_topics, recurrence_counts
from recordloom.operators.meta import resolve_meta

THRESHOLD = 3


def with_text(log: DataFrame) -> DataFrame:
    return log.withColumn("text", F.coalesce(F.get_json_object("content_json", "$.text"), F.lit("")))


def scan_window(log: DataFrame, marks: DataFrame | None = None, lookback: int = 500) -> DataFrame:
    """Rows to examine: the newest `lookback`, or from a watermark (chain_id, watermark) minus `lookback`."""
    lengths = log.groupBy("chain_id").agg((F.max("idx") + 1).alias("_length"))
    if marks is None:
        start = lengths.select("chain_id", F.greatest(F.col("_length") - lookback, F.lit(0)).alias("_start"))
    else:
        start = lengths.join(marks, "chain_id", "left").select("chain_id", F.greatest(F.when(
            F.coalesce("watermark", F.lit(0)) > F.col("_length"), 0).otherwise(F.coalesce("watermark", F.lit(0))) - lookback,
            F.lit(0)).alias("_start"))
    return log.join(start, "chain_id").where(F.col("idx") >= F.col("_start")).drop("_start")


def topic_rows(rows: DataFrame, kind: str, stop: Sequence[str] = fv.STOPWORDS,
               markers: Sequence[str] | None = None) -> DataFrame:
    """Evidence rows (chain_id, signature, idx) of one trigger; rows carry rec_type and text."""
    low = F.lower("text")
    if kind == "corrections":
        hit = F.col("rec_type") == "revision"
    elif kind == "failures":
        hit = F.col("rec_type").isin("observation", "response") & tx.contains_any(low, markers or fv.FAILURE_MARKERS)
    elif kind == "confusion":
        hit = (F.col("rec_type") == "observation") & tx.contains_any(low, markers or fv.CONFUSION_MARKERS)
    else:
        raise ValueError("kind is corrections, failures or confusion")
    top = tx.top_words(tx.keyword_tokens(tx.tokenize(F.col("text")), stop), 3)
    sig = F.array_join(F.sort_array(tx.words_of(top)), "+")
    if kind == "confusion":
        sig = F.concat(F.lit("confusion:"), F.when(sig == "", "general").otherwise(sig))
    # one evaluation of the signature: a filter after it would be pushed down and compute it again
    return rows.where(hit).select("chain_id", F.explode(F.filter(F.array(sig), lambda s: s != "")).alias("signature"), "idx")


def topic_clusters(evidence: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Topics seen often enough: count, first and last record. The evidence stays a long table, never one list."""
    return (evidence.groupBy("chain_id", "signature").agg(
        F.count("*").alias("hits"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
        .where(F.col("hits") >= threshold))


def contradiction_rows(log: DataFrame) -> DataFrame:
    """Records marked disputed or with a stored contradiction of 0.5 or more."""
    strong = F.coalesce(F.try_element_at("meta.poq.dimensions", F.lit("contradiction")), F.lit(0.0)) >= 0.5
    return (resolve_meta(log).where(strong | (F.col("meta.epistemic_class") == "disputed"))
            .select("chain_id", F.lit("contradiction-handling").alias("signature"), "idx"))


def vocabulary(words: DataFrame, known: Sequence[str] = (), ceiling: float = fv.OUTPUT_MODE["df_ceiling"],
               size: int = fv.OUTPUT_MODE["vocab"]) -> DataFrame:
    """The mode vocabulary of each chain from its responses' keywords (chain_id, idx, place, word).

    The 4 x size most frequent words are looked at (earlier seen first on ties); known
    words and words in too many responses are passed over.
    """
    docs = words.select("chain_id", "idx").distinct().groupBy("chain_id").agg(F.count("*").alias("_docs"))
    freq = words.groupBy("chain_id", "word").agg(
        F.count("*").alias("tf"), F.count_distinct("idx").alias("df"), F.min(F.struct("idx", "place")).alias("_first"))
    top = F.row_number().over(W.partitionBy("chain_id").orderBy(F.desc("tf"), "_first"))
    shortlist = freq.withColumn("_r", top).where(F.col("_r") <= 4 * size).join(docs, "chain_id")
    kept = shortlist.where((F.col("df") <= ceiling * F.col("_docs")) & ~tx.among(F.col("word"), list(known)))
    place = F.row_number().over(W.partitionBy("chain_id").orderBy("_r"))
    return kept.withColumn("place", place).where(F.col("place") <= size).select("chain_id", "word", "tf", "df", "place")


def output_modes(log: DataFrame, known: Sequence[str] = (), stop: Sequence[str] = fv.STOPWORDS,
                 rules: dict = fv.OUTPUT_MODE) -> tuple[DataFrame, DataFrame]:
    """Kinds of output that recur: (one row per chain with the gate's figures, matching responses).

    A mode passes when enough responses share its words, spread over enough time and
    interleaved with others. All figures are aggregates; no chain is walked in one task.
    """
    replies = with_text(log.where("rec_type = 'response'")).where(tx.strip(F.col("text")) != "")
    top = tx.top_words(tx.keyword_tokens(tx.tokenize(F.col("text")), stop), 12)
    words = replies.select("chain_id", "idx", "ts_ms", F.posexplode(tx.words_of(top)).alias("place", "word"))
    vocab = vocabulary(words, known, rules["df_ceiling"], rules["vocab"])
    hits = (words.join(vocab.select("chain_id", "word"), ["chain_id", "word"])
            .groupBy("chain_id", "idx", "ts_ms").agg(F.count("*").alias("_n")).where(F.col("_n") >= rules["overlap"]))
    bounds = hits.groupBy("chain_id").agg(
        F.count("*").alias("hits"), (F.max("ts_ms") - F.min("ts_ms")).alias("spread_ms"),
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    between = (replies.select("chain_id", "idx").join(bounds, "chain_id").groupBy("chain_id").agg(
        F.count("*").alias("responses"),
        F.count_if((F.col("idx") >= F.col("first_idx")) & (F.col("idx") <= F.col("last_idx"))).alias("_inside")))
    names = vocab.groupBy("chain_id").agg(F.sort_array(F.collect_list("word")).alias("words"))  # at most four words
    gate = bounds.join(between, "chain_id").join(names, "chain_id").select(
        "chain_id", F.concat(F.lit("outputmode:"), F.array_join("words", "+")).alias("signature"), "hits", "responses",
        "spread_ms", (F.col("_inside") > F.col("hits")).alias("interleaved"), "first_idx", "last_idx", "words")
    passes = ((F.col("responses") >= rules["min_hits"]) & (F.col("hits") >= rules["min_hits"])
              & (F.col("spread_ms") >= rules["spread_ms"]) & F.col("interleaved") & (F.size("words") >= rules["overlap"]))
    return gate.withColumn("passes", passes), hits.select("chain_id", "idx")


def sprout_specs(modes: DataFrame) -> DataFrame:
    """Detector specs of the modes that pass, staged as tentative."""
    name = F.substring(F.regexp_replace(F.concat(F.lit("mode_"), F.array_join(F.slice("words", 1, 2), "_")), "[^a-z0-9_]", ""), 1, 40)
    return modes.where("passes").select(
        "chain_id", "signature", name.alias("name"), F.transform("words", lambda w: F.concat(F.lit("\\b"), w, F.lit("\\b"))).alias("patterns"),
        F.lit(0.2).alias("threshold"), F.lit("fraction_lines").alias("match_mode"), F.lit(True).alias("domain"),
        F.lit("tentative").alias("status"), F.lit(1.0).alias("weight_factor"))


def known_vocabulary(specs: DataFrame) -> DataFrame:
    """Words behind the plain word patterns of existing specs."""
    return specs.select(F.explode("patterns").alias("p")).select(
        F.lower(F.regexp_extract("p", r"^\\b(\w+)\\b$", 1)).alias("word")).where("word <> ''").distinct()


def mine(log: DataFrame, threshold: int = THRESHOLD, known: Sequence[str] = (), stop: Sequence[str] = fv.STOPWORDS,
         failure_markers: Sequence[str] | None = None, confusion_markers: Sequence[str] | None = None) -> DataFrame:
    """All five triggers and the decision on each: a new proposal, or a recurrence of an open one."""
    rows = with_text(log)
    kinds = {"corrections": "principle", "failures": "skill", "confusion": "modality"}
    marks = {"failures": failure_markers, "confusion": confusion_markers}
    found = [topic_clusters(topic_rows(rows, k, stop, marks.get(k)), threshold).withColumn("trigger", F.lit(k))
             .withColumn("kind", F.lit(kind)) for k, kind in kinds.items()]
    found.append(topic_clusters(contradiction_rows(log), threshold).withColumn("trigger", F.lit("contradiction"))
                 .withColumn("kind", F.lit("sense")))
    gate, _ = output_modes(log, known, stop)
    found.append(gate.where("passes").select("chain_id", "signature", "hits", "first_idx", "last_idx",
                                             F.lit("output_mode").alias("trigger"), F.lit("modality").alias("kind")))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    existing = open_topics(log).withColumnRenamed("idx", "proposal_idx")
    return all_.join(existing, ["chain_id", "signature"], "left").withColumn(
        "decision", F.when(F.col("proposal_idx").isNull(), "proposal").otherwise("recurrence"))


def newly_escalated(log: DataFrame, threshold: int = ESCALATE_AT) -> DataFrame:
    """Proposals over the threshold that no status record has escalated yet."""
    c = F.from_json("content_json", "marks_proposal_index bigint, new_status string")
    done = (log.where("rec_type = 'proposal_status'").select("chain_id", c["marks_proposal_index"].alias("idx"), c["new_status"].alias("s"))
            .where("s = 'escalated'").select("chain_id", "idx").distinct())
    return recurrence_counts(log).where(F.col("sightings") >= threshold).join(done, ["chain_id", "idx"], "left_anti")


def graduations(log: DataFrame, sprouts: DataFrame, confirmations: int = fv.OUTPUT_MODE["graduate"]) -> DataFrame:
    """Tentative sprouts (name, chain_id, proposal_idx, status) that have been confirmed often enough."""
    counts = recurrence_counts(log).withColumnRenamed("idx", "proposal_idx")
    return (sprouts.where("status = 'tentative'").join(counts, ["chain_id", "proposal_idx"])
            .where(F.col("sightings") >= confirmations)
            .select("name", "chain_id", "proposal_idx", "sightings", F.lit("active").alias("new_status")))
