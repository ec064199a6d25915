"""Registries of faculties and pattern detectors: gaps, growth, validation, application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import signals as sg, text as tx
from recordloom.operators.setjoin import by_overlap, match_registry, similar_sets


def name_tokens(text: Column, stop: Sequence[str] = fv.STOPWORDS) -> Column:
    return F.array_distinct(F.filter(tx.content_words(tx.tokenize(text), stop), lambda w: F.length(w) > 1))


def detector_registry(spark) -> DataFrame:
    """The built-in detectors as registry rows (30 fixed rows); trigger words describe them."""
    rows = []
    for kind, names, triggers in (("modality", fv.MODALITIES, fv.MODALITY_TRIGGERS), ("sense", fv.SENSES, fv.SENSE_TRIGGERS)):
        rows += [(kind, f"sig:{n}", n, " ".join(triggers.get(n, [])) or n, "signal",
                  sorted({*n.split("_"), *triggers.get(n, [])})) for n in names]
    return spark.createDataFrame(rows, "kind string, id string, name string, function string, category string, tokens array<string>")


def with_tokens(registry: DataFrame, stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    return registry.withColumn("tokens", name_tokens(F.concat_ws(" ", "name", "function"), stop))


def faculty_gap(inputs: DataFrame, registry: DataFrame, key: str = "input_id", stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """How far a registry (with tokens) covers each input (key, text): coverage, dissonance 0..255,
    uncovered words and the five faculties that share most words."""
    met = match_registry(inputs.select(key, name_tokens(F.col("text"), stop).alias("words")), key, registry, 5)
    n, covered = F.size("words"), F.size("covered")
    ratio = F.when(n == 0, 1.0).otherwise(covered / n)
    rest = F.array_except("words", "covered")
    by_length = F.transform(F.sort_array(F.transform(rest, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda s: s["w"])
    top = F.transform("hits", lambda h: F.struct(h["id"].alias("id"), h["name"].alias("name"), h["kind"].alias("kind"), h["matched"].alias("matched")))
    return met.select(
        key, n.alias("n_words"), F.round(ratio, 3).alias("coverage_ratio"),
        F.greatest(F.lit(0), F.least(F.lit(255), F.bround((1 - ratio) * 255))).cast("int").alias("dissonance"),
        by_length.alias("uncovered"), F.when(F.size("hits") > 0, top).alias("top_activated"))


def propose_faculties(gaps: DataFrame, inputs: DataFrame, registry: DataFrame, key: str = "input_id",
                      stop: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """A new faculty for every input the registry does not cover: a fusion of the two best, or a sprout."""
    a, b = F.get("top_activated", F.lit(0)), F.get("top_activated", F.lit(1))
    fuse = F.coalesce((a["matched"] >= 2) & (b["matched"] >= 2), F.lit(False)) & (F.col("dissonance") < fv.SPROUT_AT)
    long = F.slice(F.filter("uncovered", lambda w: F.length(w) >= 4), 1, 6)
    seed = F.when(F.size(long) > 0, long).otherwise(F.slice("uncovered", 1, 6))
    reasons = F.arrays_overlap(name_tokens(F.col("text"), stop), tx.literal_array(fv.REASON_VERBS))
    facts = registry.select("id", "function", "category")
    fa = facts.select(F.col("id").alias("_ia"), F.col("function").alias("_fa"), F.col("category").alias("_ca"))
    fb = facts.select(F.col("id").alias("_ib"), F.col("function").alias("_fb"))
    rows = (gaps.where(F.col("dissonance") > fv.DISSONANCE_FLOOR).join(inputs.select(key, "text"), key)
            .withColumns({"_fuse": fuse, "_seed": seed, "_a": a, "_b": b})
            .join(fa, F.col("_a.id") == F.col("_ia"), "left").join(fb, F.col("_b.id") == F.col("_ib"), "left"))
    kind = F.when(F.col("_fuse"), F.when((F.col("_a.kind") == "sense") & (F.col("_b.kind") == "sense"), "sense").otherwise("modality")
                  ).otherwise(F.when(reasons, "modality").otherwise("sense"))
    short = lambda c: F.when(F.length(c) <= 40, c).otherwise(F.concat(F.substring(c, 1, 39), F.lit("…")))
    label = F.when(F.size("_seed") > 0, F.array_join(F.transform(F.slice("_seed", 1, 2), F.initcap), "-")).otherwise("Novel")
    terms = F.array_join("_seed", ", ")
    name = F.when(F.col("_fuse"), F.concat(F.col("_a.name"), F.lit(" × "), F.col("_b.name"), F.lit(" Fusion"))).otherwise(
        F.concat(label, F.when(kind == "sense", " Sensing").otherwise(" Reasoning")))
    function = F.when(F.col("_fuse"), F.concat(
        F.lit("Joint use of "), F.col("_a.name"), F.lit(" ("), short(F.col("_fa")), F.lit(") and "), F.col("_b.name"),
        F.lit(" ("), short(F.col("_fb")), F.lit(")"))).otherwise(F.concat(
            F.when(kind == "sense", "Perceive ").otherwise("Reason about "), terms))
    none = F.array().cast("array<string>")
    return rows.select(
        key, kind.alias("kind"), name.alias("name"), function.alias("function"),
        F.when(F.col("_fuse"), F.col("_ca")).when(kind == "sense", "structural").otherwise("knowledge").alias("category"),
        F.when(F.col("_fuse"), F.concat(F.lit("fusion("), F.col("_ia"), F.lit("+"), F.col("_ib"), F.lit(")"))).otherwise("sprout").alias("origin"),
        F.when(F.col("_fuse"), F.array("_ia", "_ib")).otherwise(none).alias("parents"),
        F.when(F.col("_fuse"), none).otherwise(F.col("_seed")).alias("seed_terms"), "dissonance")


def match_emergent(proposals: DataFrame, emergent: DataFrame, key: str = "input_id") -> DataFrame:
    """The earliest emergent faculty (eid, ordinal, name, parents, seed_terms) each proposal repeats, if any:
    same name, same parents, or seed terms that overlap by half or more."""
    e = emergent.select("eid", "ordinal", F.col("name").alias("_n"), F.col("parents").alias("_p"), F.col("seed_terms").alias("_s"))
    p = proposals.select(key, "name", "parents", "seed_terms")
    by_name = p.join(e, F.col("name") == F.col("_n")).select(key, "eid", "ordinal")
    by_parents = p.where(F.size("parents") > 0).join(e, F.col("parents") == F.col("_p")).select(key, "eid", "ordinal")
    alike = similar_sets(p.select(F.col(key).alias("l"), F.col("seed_terms").alias("words")), e.select(F.col("eid").alias("r"), F.col("_s").alias("words")))
    by_terms = alike.join(e.select("eid", "ordinal"), F.col("r") == F.col("eid")).select(F.col("l").alias(key), "eid", "ordinal")
    return (by_name.unionByName(by_parents).unionByName(by_terms).groupBy(key)
            .agg(F.min_by("eid", "ordinal").alias("eid")))


def grow(proposals: DataFrame, emergent: DataFrame, key: str = "input_id") -> DataFrame:
    """Emergent faculties after one batch: births, recurrences, promotions at three sightings.

    Proposals of the batch that share a name count as one faculty.
    """
    hits = match_emergent(proposals, emergent, key)
    seen = hits.groupBy("eid").agg(F.count("*").alias("_more"))
    old = emergent.join(seen, "eid", "left").withColumn("recurrence", F.col("recurrence") + F.coalesce("_more", F.lit(0)))
    fresh = proposals.join(hits.select(key), key, "left_anti")
    first = lambda c: F.min_by(c, key).alias(c)
    born = fresh.groupBy("name").agg(F.count("*").alias("recurrence"), first("kind"), first("parents"), first("seed_terms"))
    cols = ["name", "kind", "parents", "seed_terms", "recurrence"]
    both = old.select("eid", *cols, "status", (F.col("_more").isNotNull()).alias("touched")).unionByName(
        born.select(F.lit(None).cast("string").alias("eid"), *cols, F.lit("new").alias("status"), F.lit(True).alias("touched")))
    promoted = F.col("touched") & (F.col("recurrence") >= fv.PROMOTE_AT) & (F.col("status") != "promoted")
    action = (F.when(~F.col("touched"), "kept").when(promoted, "promoted").when(F.col("status") == "new", "born").otherwise("recurrence"))
    return both.select("eid", *cols, action.alias("action"),
                       F.when(promoted, "promoted").when(F.col("status") == "new", "emergent").otherwise(F.col("status")).alias("status"))


def lens_ranking(queries: DataFrame, registry: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Faculties by shared words plus overlap ratio; only those that share a word are ranked."""
    q = queries.select(key, F.array_distinct(tx.tokenize(F.col("text"))).alias("words"))
    ranked = match_registry(q, key, registry, k, by_overlap).select(key, F.posexplode("hits").alias("_p", "h"))
    return ranked.select(key, "h.kind", "h.id", "h.score", (F.col("_p") + 1).alias("rank"))


# --- pattern detectors -----------------------------------------------------------------

def validate_specs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable specs with screened patterns, rejects with reason). Ranges are clamped, odd modes reset."""
    lim = fv.SPEC_LIMITS
    patterns = F.coalesce("patterns", F.array().cast("array<string>"))
    head = F.slice(patterns, 1, lim["patterns"])
    ok = lambda p: p.isNotNull() & (p != "") & (F.length(p) <= lim["pattern_chars"]) & ~p.rlike(fv.NESTED_QUANTIFIER)
    reason = (F.when(F.col("name").isNull() | ~F.col("name").rlike(fv.SPEC_NAME), "bad name")
              .when(F.size(patterns) == 0, "no patterns"))
    clamp = lambda c, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(d))))
    weight = clamp("weight_factor", 1.0)
    status = F.when(F.col("status") == "tentative", "tentative").otherwise("active")
    rows = specs.withColumn("_reason", reason)
    good = rows.where("_reason is null").select(
        "name", F.filter(head, ok).alias("patterns"), (F.size(patterns) - F.size(F.filter(head, ok))).alias("skipped"),
        clamp("threshold", 0.2).alias("threshold"),
        F.when(F.col("match_mode").isin("any", "count"), F.col("match_mode")).otherwise("fraction_lines").alias("match_mode"),
        F.coalesce("domain", F.lit(True)).alias("domain"), status.alias("status"),
        F.when(status == "tentative", F.least(weight, F.lit(0.5))).otherwise(weight).alias("weight_factor"))
    return good, rows.where("_reason is not null").select("name", F.col("_reason").alias("reason"))


def spec_list(good: DataFrame) -> list:
    """At most 64 checked specs, small by rule, ready to be built into expressions."""
    rows = good.limit(fv.SPEC_LIMITS["specs"] + 1).collect()
    if len(rows) > fv.SPEC_LIMITS["specs"]:
        raise ValueError("a detector registry holds at most 64 specs")
    return rows


def spec_activation(text: Column, patterns: Sequence[str], match_mode: str) -> Column:
    """One detector over whole texts."""
    if not patterns:
        return F.lit(0.0)
    either = "(?iU)" + "|".join(f"(?:{p})" for p in patterns)
    if match_mode == "any":
        return text.rlike(either).cast("double")
    if match_mode == "count":
        hits = sum((F.regexp_count(text, F.lit(f"(?iU){p}")) for p in patterns), F.lit(0))
        return F.least(F.lit(1.0), hits / 5.0)
    return tx.let(F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda ln: tx.strip(ln) != ""), lambda lines: F.when(
        F.size(lines) == 0, 0.0).otherwise(F.size(F.filter(lines, lambda ln: ln.rlike(either))) / F.size(lines)))


def apply_registry(docs: DataFrame, specs: list, text: str = "text") -> DataFrame:
    """One column per spec with its activation."""
    return docs.select("*", *[spec_activation(F.col(text), s["patterns"], s["match_mode"]).alias(s["name"]) for s in specs])


def spec_detectors(specs: list) -> dict:
    """The specs as further detectors for `signals.analyze(extra=...)`."""
    return {s["name"]: (lambda p, s=s: sg._hit(spec_activation(p.text, s["patterns"], s["match_mode"]))) for s in specs}


def collapse_perspectives(notes: DataFrame, winners: DataFrame | None = None) -> DataFrame:
    """Notes (query_id, index, name, summary, scores map, chosen_hint) with their value and the decision.

    The winner is the named one (query_id, winner: number or name), else the hinted one,
    else the highest value, lower index first. A name that fits none or several is an error row.
    """
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, v: a + v)
    n = notes.withColumn("value", F.bround(total / F.size("scores"), 3))
    if winners is not None:
        n = n.join(winners, "query_id", "left")
        w = F.trim("winner")
        numeric = w.rlike("^[0-9]+$") & (w.try_cast("bigint") == F.col("index"))
        named = F.coalesce(numeric | (F.lower(w) == F.lower("name")), F.lit(False))
    else:
        named, w = F.lit(False), F.lit(None).cast("string")
    hinted = F.coalesce("chosen_hint", F.lit(False))
    n = n.withColumns({"_named": named, "_hint": hinted, "_asked": F.coalesce(w != "", F.lit(False))})
    per = n.groupBy("query_id").agg(
        F.count_if("_named").alias("_nn"), F.count_if("_hint").alias("_nh"), F.max("_asked").alias("_asked_any"),
        F.max(F.struct("_named", "_hint", "value", (-F.col("index")).alias("i"))).alias("_best"))
    error = (F.when(F.col("_asked_any") & (F.col("_nn") != 1), "winner did not match exactly one perspective")
             .when(~F.col("_asked_any") & (F.col("_nh") > 1), "several perspectives marked chosen"))
    out = n.join(per.withColumn("error", error), "query_id")
    return out.select("query_id", "index", "name", "value", F.when(F.col("error").isNotNull(), "error").when(
        F.col("index") == -F.col("_best.i"), "sealed").otherwise("rejected").alias("decision"), "error")
