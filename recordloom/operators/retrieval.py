"""Ranking of records and blocks, neighbours, ancestry and pair completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.operators.governance import with_superseded_flag
from recordloom.operators.meta import resolve_meta


def recent(log: DataFrame, n: int, rec_type: str | None = None) -> DataFrame:
    """Newest n records of each chain, optionally of one type."""
    rows = log if rec_type is None else log.where(F.col("rec_type") == rec_type)
    place = F.row_number().over(W.partitionBy("chain_id").orderBy(F.desc("idx")))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def page(log: DataFrame, before: DataFrame | None, limit: int) -> DataFrame:
    """One page per chain, newest first: rows in [before - limit, before), limit clamped to 1..200.

    Without `before` (chain_id, before) the page ends at the head. Adds has_more.
    """
    limit = max(1, min(200, limit))
    heads = log.groupBy("chain_id").agg((F.max("idx") + 1).alias("_length"))
    ends = heads if before is None else heads.join(before, "chain_id", "left").withColumn(
        "_length", F.least(F.coalesce("before", "_length"), "_length")).drop("before")
    low = F.greatest(F.col("_length") - limit, F.lit(0))
    return (log.join(ends, "chain_id").where((F.col("idx") < F.col("_length")) & (F.col("idx") >= low))
            .withColumn("has_more", low > 0).drop("_length"))


def hybrid(candidates: DataFrame, log: DataFrame, as_of_ms: int, k: int = 10, modes: str | None = None,
           weight_factors: dict[str, float] | None = None, epistemic: bool = False,
           rec_type: str | None = None, recency_weight: float | None = None) -> DataFrame:
    """Blend of similarity, salience and age over candidates (query_id, chain_id, idx, sim).

    `modes` names an array column of the candidates with the query's mode names. The
    mode term weakens where the ten best candidates mostly share the mode already.
    """
    base = fv.WEIGHTS if modes is None else fv.WEIGHTS_WITH_MODES
    w_recent = base["recency"] if recency_weight is None else recency_weight
    facts = with_superseded_flag(resolve_meta(log.select("chain_id", "idx", "ts_ms", "rec_type", "content_json")))
    rows = candidates.join(facts, ["chain_id", "idx"])
    if rec_type is not None:
        rows = rows.where(F.col("rec_type") == rec_type)
    epi = F.lit(1.0)
    if epistemic:
        epi = F.lit(fv.EPISTEMIC_FACTOR_OTHER)
        for name, factor in fv.EPISTEMIC_FACTORS.items():
            epi = F.when(F.col("meta.epistemic_class") == name, factor).otherwise(epi)
    risk = F.coalesce(F.try_element_at("meta.poq.dimensions", F.lit("risk")), F.lit(0.0))
    rows = rows.withColumns({
        "recency": tx.recency(F.lit(as_of_ms) - F.col("ts_ms"), F.col("meta.half_life_days")),
        "epistemic_factor": epi})
    rows = rows.withColumn("base", (
        base["semantic"] * F.col("sim") + base["salience"] * F.col("meta.salience") + w_recent * F.col("recency"))
        * F.col("epistemic_factor") - F.when(F.col("superseded"), fv.SUPERSEDED_PENALTY).otherwise(0.0)
        - F.when(risk >= fv.RISK_AT, fv.RISK_PENALTY).otherwise(0.0))
    if modes is None:
        rows = rows.withColumn("score", F.col("base"))
    else:
        wanted = F.coalesce(F.col(modes), F.array().cast("array<string>"))
        shared = F.array_intersect("meta.modalities_activated", wanted)
        factors = F.expr("map(" + ",".join(f"'{n}',{float(x)}d" for n, x in (weight_factors or {"": 1.0}).items()) + ")")
        weight = F.coalesce(F.array_min(F.transform(shared, lambda m: F.coalesce(F.try_element_at(factors, m), F.lit(1.0)))), F.lit(1.0))
        # a record without any of the query's modes tells nothing: neutral
        rows = rows.withColumns({"mode_overlap": tx.overlap_or_neutral(wanted, shared), "mode_weight": weight})
        by_base = W.partitionBy("query_id").orderBy(F.desc("base"), "chain_id", "idx")
        rows = rows.withColumn("_place", F.row_number().over(by_base))
        share = F.avg(F.when(F.col("_place") <= fv.SATURATION_TOP, (F.col("mode_overlap") > fv.NEUTRAL_OVERLAP).cast("int"))).over(
            W.partitionBy("query_id"))
        rows = rows.withColumn("saturation", share).withColumn("score", F.when(F.size(wanted) == 0, F.col("base")).otherwise(
            F.col("base") + base["mode"] * F.col("mode_overlap") * F.col("mode_weight")
            * F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.col("saturation") - fv.SATURATION_AT))))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chain_id", "idx"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).drop("_place")


def query_modes(df: DataFrame, domains: Sequence[str], cap: int = fv.MODE_CAP,
                floor: float = fv.ACTIVATION_FLOOR) -> DataFrame:
    """Adds `modes`: the strongest domain detectors of a query, from its detector columns."""
    live = F.array_compact(F.array(*[F.when(F.col(d)["activation"] > floor, F.struct(
        (-F.col(d)["activation"]).alias("neg"), F.lit(i).alias("i"), F.lit(d).alias("name"))) for i, d in enumerate(domains)]))
    return df.withColumn("modes", F.transform(F.slice(F.sort_array(live), 1, cap), lambda s: s["name"]))


def ancestry(log: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Records reachable over refs from each seed (chain_id, record_hash); the seed is level 1."""
    edges = log.select("chain_id", F.col("record_hash").alias("_from"), F.explode("refs").alias("_to"))
    level = seeds.select("chain_id", F.col("record_hash").alias("seed"), F.col("record_hash").alias("node"), F.lit(1).alias("level"))
    found = level
    for d in range(2, depth + 1):
        level = (level.join(edges, (edges["chain_id"] == level["chain_id"]) & (edges["_from"] == level["node"]))
                 .select(level["chain_id"], "seed", F.col("_to").alias("node"), F.lit(d).alias("level")).distinct())
        found = found.unionByName(level)
    first = found.groupBy("chain_id", "seed", "node").agg(F.min("level").alias("level"))
    return first.join(log.select("chain_id", F.col("record_hash").alias("node"), "idx", "rec_type"), ["chain_id", "node"])


def stitch_pairs(log: DataFrame, hits: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Missing halves of question/answer pairs among hits (query_id, chain_id, idx).

    A response at N + 1 must cite the observation at N. `hidden` lists (chain_id, idx)
    that may not be pulled in. Gives (query_id, chain_id, idx, partner_of).
    """
    facts = log.select("chain_id", "idx", "rec_type", "refs", "record_hash",
                       F.get_json_object("content_json", "$.context").isNotNull().alias("_whole"))
    have = hits.select("query_id", "chain_id", "idx").distinct()
    known = have.join(facts, ["chain_id", "idx"]).where(
        (F.col("rec_type") == "observation") | ((F.col("rec_type") == "response") & ~F.col("_whole")))
    step = F.when(F.col("rec_type") == "observation", 1).otherwise(-1)
    wanted = known.select("query_id", "chain_id", F.col("idx").alias("partner_of"), (F.col("idx") + step).alias("idx"),
                          F.col("rec_type").alias("_type"), F.col("refs").alias("_refs"), F.col("record_hash").alias("_hash"))
    missing = wanted.join(have, ["query_id", "chain_id", "idx"], "left_anti")
    other = facts.drop("_whole")
    if hidden is not None:
        other = other.join(hidden.select("chain_id", "idx"), ["chain_id", "idx"], "left_anti")
    pair = missing.join(other, ["chain_id", "idx"])
    answers = (F.col("_type") == "observation") & (F.col("rec_type") == "response") & F.array_contains(F.col("refs"), F.col("_hash"))
    asks = (F.col("_type") == "response") & (F.col("rec_type") == "observation") & F.array_contains(F.col("_refs"), F.col("record_hash"))
    return pair.where(answers | asks).select("query_id", "chain_id", "idx", "partner_of")


def with_neighbours(blocks: DataFrame, hits: DataFrame, n: int, group: Sequence[str], pos: str,
                    same: str | None = None, score: str = "score") -> DataFrame:
    """Hits plus rows up to n positions away in the same group (and the same `same` value).

    The band condition becomes an equi-join: each hit names its 2n + 1 positions.
    A row near several hits goes with the first of the best score. Adds neighbour_of.
    """
    ids = ["query_id", *group, pos]
    spread = hits.select("query_id", *group, F.col(pos).alias("_at"), F.col(score).alias("_score"),
                         *([F.col(same).alias("_same")] if same else []),
                         F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("_off"))
    near = spread.where("_off <> 0").withColumn(pos, F.col("_at") + F.col("_off"))
    joined = near.join(blocks.select(*group, pos, *([same] if same else [])).distinct(), [*group, pos])
    if same:
        joined = joined.where(F.col("_same") == F.col(same))
    extra = (joined.join(hits.select(*ids), ids, "left_anti")
             .groupBy(*ids).agg(F.max(F.struct(F.col("_score").alias("s"), (-F.col("_at")).alias("a"))).alias("_b"))
             .select(*ids, (F.col("_b.s") - 0.001).alias(score), (-F.col("_b.a")).alias("neighbour_of")))
    mine = hits.select(*ids, score, F.lit(None).cast("long").alias("neighbour_of"))
    return mine.unionByName(extra)


def path_aware(blocks: DataFrame, queries: DataFrame, semantic: DataFrame | None = None, k: int = 8,
               neighbours: int = 1, stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """Ranks source blocks for queries of the same chain by meaning, path and order.

    Blocks: chain_id, idx, relative_path, path_role, language, extension, top_dir, content.
    Queries: query_id, chain_id, text and any of path, dir, role, language, ext, top_dir,
    exclude_dir. `semantic` (query_id, chain_id, idx, sim) replaces word overlap.
    """
    have = set(queries.columns)
    q = queries.select("query_id", "chain_id", "text", *[
        (F.col(c) if c in have else F.lit(None)).cast("string").alias(f"q_{c}")
        for c in ("path", "dir", "role", "language", "ext", "top_dir", "exclude_dir")])
    last = blocks.groupBy("chain_id").agg(F.max("idx").alias("_last"))
    b = blocks.where("coalesce(relative_path, '') <> ''").join(last, "chain_id")
    unset = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    under = F.concat(F.rtrim("q_top_dir", F.lit("/")), F.lit("/"))
    passes = ((unset("q_role") | (F.col("path_role") == F.col("q_role")))
              & (unset("q_language") | (F.col("language") == F.col("q_language")))
              & (unset("q_ext") | (F.col("extension") == F.col("q_ext")))
              & (unset("q_top_dir") | (F.col("relative_path") == F.col("q_top_dir"))
                 | F.startswith("relative_path", under) | (F.col("top_dir") == F.col("q_top_dir")))
              & (unset("q_exclude_dir") | ~F.array_contains(
                  F.split("relative_path", "/"), F.trim("q_exclude_dir", F.lit("/")))))
    if semantic is None:
        # words of a query meet words of the blocks of its chain: an equi-join, no pairs without a shared word
        qw = q.select("query_id", "chain_id", F.array_distinct(tx.content_words(tx.tokenize(F.col("text")), stop)).alias("_w"))
        qw = qw.select("query_id", "chain_id", F.size("_w").alias("_n"), F.explode("_w").alias("_word"))
        bw = b.select("chain_id", "idx", F.explode(F.array_distinct(
            tx.content_words(tx.tokenize(F.col("content")), stop))).alias("_word"))
        semantic = (qw.join(bw, ["chain_id", "_word"]).groupBy("query_id", "chain_id", "idx")
                    .agg((F.count("*") / F.max("_n")).alias("sim")))
    proximity = tx.path_proximity(F.col("relative_path"), F.col("q_path"), F.col("q_dir"))
    noise = F.when(unset("q_role") & F.col("path_role").isin(fv.NOISY_ROLES), fv.NOISE_PENALTY).otherwise(0.0)
    w = fv.PATH_WEIGHTS
    score = (w["semantic"] * F.col("sim") + w["path"] * proximity + w["order"] * F.col("idx") / F.greatest("_last", F.lit(1)) - noise)
    scored = (semantic.join(b, ["chain_id", "idx"]).join(q, ["query_id", "chain_id"]).where(passes)
              .withColumn("score", F.round(score, 4)))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "idx"))
    hits = scored.withColumn("_place", place).where(F.col("_place") <= k)
    if neighbours <= 0:
        return hits.select("query_id", "chain_id", "idx", "score", F.lit(None).cast("long").alias("neighbour_of"))
    return with_neighbours(blocks, hits, neighbours, ["chain_id"], "idx", "relative_path")


def excerpt_chunks(chunks: DataFrame, matched: DataFrame, group: Sequence[str] = ("chain_id", "idx")) -> DataFrame:
    """Matched chunks (at most three per record) with one neighbour on each side, tagged and in order."""
    near = with_neighbours(chunks, matched.withColumn("score", F.col("sim")), 1, list(group), "chunk_index")
    return near.select("query_id", *group, "chunk_index", F.when(
        F.col("neighbour_of").isNull(), "matched").otherwise("context").alias("tag"))


def record_index(log: DataFrame, stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """Compact handles of every record: summary, keywords, entities, salience."""
    body = F.coalesce(F.get_json_object("content_json", "$.data.content"), F.get_json_object("content_json", "$.text"),
                      tx.handle(F.col("content_json")), F.lit(""))
    rows = log.withColumn("_text", body)
    return rows.select(
        "chain_id", "idx", "rec_type", F.substring(tx.excerpt(F.col("_text"), 24), 1, 240).alias("summary"),
        F.slice(tx.keywords(F.col("_text"), 6, stop), 1, 6).alias("keywords"),
        tx.entities(F.col("_text"), 6).alias("entities"), tx.salience(F.col("_text")).alias("salience"))


def memory_map(log: DataFrame, queries: DataFrame, shortlist: DataFrame | None, as_of_ms: int,
               limit: int = 50, newest: int = 25) -> DataFrame:
    """Lines of a memory map per query (query_id, chain_id): shortlisted records first, then the newest."""
    fresh = (queries.select("query_id", "chain_id").join(recent(log, newest).select("chain_id", "idx"), "chain_id")
             .withColumn("_src", F.lit(1)).withColumn("_ord", -F.col("idx").cast("double")))
    rows = fresh
    if shortlist is not None:
        rows = fresh.unionByName(shortlist.select("query_id", "chain_id", "idx", F.lit(0).alias("_src"), F.col("rank").cast("double").alias("_ord")))
    first = rows.groupBy("query_id", "chain_id", "idx").agg(F.min(F.struct("_src", "_ord")).alias("_p"))
    place = F.row_number().over(W.partitionBy("query_id", "chain_id").orderBy("_p._src", "_p._ord"))
    picked = first.withColumn("place", place).where(F.col("place") <= limit)
    facts = with_superseded_flag(resolve_meta(log))
    return (picked.join(facts, ["chain_id", "idx"]).where("meta.exposure <> 'quarantine'").select(
        "query_id", "chain_id", "idx", "place", "rec_type", "superseded",
        tx.compact_age(F.lit(as_of_ms) - F.col("ts_ms")).alias("age"), F.col("meta.salience").alias("salience"),
        tx.snippet(F.col("rec_type"), F.col("content_json")).alias("line")))


def reflection_window(log: DataFrame, cap: int = 300) -> DataFrame:
    """Records after each chain's last reflection, at most the newest `cap`; chains with little to say are left out."""
    kinds = ["observation", "response", "reflection", "revision"]
    ends = log.groupBy("chain_id").agg(
        (F.coalesce(F.max(F.when(F.col("rec_type") == "reflection", F.col("idx"))), F.lit(-1)) + 1).alias("_start"),
        F.max("idx").alias("_head"))
    inside = (log.join(ends.withColumn("_from", F.greatest(F.col("_start"), F.col("_head") - cap + 1)), "chain_id")
              .where(F.col("idx") >= F.col("_from")))
    rich = inside.groupBy("chain_id").agg(F.count_if(F.col("rec_type").isin(kinds)).alias("_n")).where("_n >= 4").select("chain_id")
    return (inside.join(rich, "chain_id", "left_semi")
            .select(*log.columns, F.col("_from").alias("window_start"), (F.col("_from") > F.col("_start")).alias("capped")))


def first_of(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keep the first row per key by an order expression."""
    return (df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
            .where("_place = 1").drop("_place"))
