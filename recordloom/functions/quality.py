"""Answer quality: six dimensions, risk, brightness, action and verdict as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import signals as sg, text as tx


def _clamp(x: Column, low: float, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def relevance(question: Column, candidate: Column, stop=fv.STOPWORDS) -> Column:
    """0.4 cosine of content bags + 0.6 coverage of the question's eight top words, times 1.4."""
    qt, ct = tx.tokenize(question), tx.tokenize(candidate)
    sim = tx.cosine_tokens(tx.content_words(qt, stop), tx.content_words(ct, stop))
    keys = tx.words_of(tx.top_words(tx.keyword_tokens(qt, stop), 8))
    covered = tx.let(F.struct(sim.alias("s"), keys.alias("k")), lambda v: 0.4 * v["s"] + 0.6 * F.when(
        F.size(v["k"]) == 0, v["s"]).otherwise(F.size(F.array_intersect(v["k"], ct)) / F.size(v["k"])))
    return _clamp(covered * 1.4, 0.25)


def continuity(candidate: Column, retrieved: Column | None, stop=fv.STOPWORDS) -> Column:
    if retrieved is None:
        return F.lit(0.6)
    own = tx.content_words(tx.tokenize(candidate), stop)
    best = tx.let(own, lambda c: tx.let(tx.sum_squares(c), lambda c2: F.when(F.size(c) == 0, None).otherwise(F.array_max(
        F.transform(retrieved, lambda t: tx.cosine_tokens(c, tx.content_words(tx.tokenize(t), stop), a2=c2))))))
    return F.coalesce(_clamp(0.5 + best, 0.4), F.lit(0.6))


def usefulness(candidate: Column) -> Column:
    tokens = tx.tokenize(candidate)
    start = F.lower(tx.strip(candidate))
    filler = F.exists(tx.literal_array(fv.FILLER_STARTS), lambda w: F.startswith(start, w))
    return tx.let(tokens, lambda t: F.when(F.size(t) == 0, 0.0).when((F.size(t) < 8) & filler, 0.15).otherwise(
        _clamp(0.55 * F.least(F.lit(1.0), F.size(t) / 60) + 0.45 * F.size(F.array_distinct(t)) / F.size(t), 0.2)))


def source_trust(source: Column, table=None) -> Column:
    table = table or fv.SOURCE_TRUST
    out = F.lit(0.5)
    for name, value in table.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def covenant_alignment(candidate: Column, covenant: Column | None) -> Column:
    judged = F.when(tx.contains_any(F.lower(candidate), fv.COVENANT_RED_FLAGS), 0.2).otherwise(0.85)
    if covenant is None:
        return F.lit(0.8)
    return F.when(F.coalesce(F.size(covenant), F.lit(0)) < 1, 0.8).otherwise(judged)


def authority(epistemic: Column) -> Column:
    out = F.lit(0.5)
    for name, value in fv.EPISTEMIC_AUTHORITY.items():
        out = F.when(epistemic == name, value).otherwise(out)
    return out


def contradiction_risk(activation: Column, candidate: Column, retrieved: Column | None, epistemic: Column,
                       stop=fv.STOPWORDS) -> Column:
    """Largest contradiction x topical overlap x authority over the retrieved records, capped.

    Without texts it falls back to the strongest authority alone.
    """
    if retrieved is None:
        raw = activation * F.array_max(F.transform(epistemic, authority))
    else:
        own = tx.content_words(tx.tokenize(candidate), stop)
        n = F.least(F.size(retrieved), F.size(epistemic))
        raw = tx.let(own, lambda c: F.array_max(F.zip_with(
            F.slice(retrieved, F.lit(1), n), F.slice(epistemic, F.lit(1), n),
            lambda t, e: tx.let(tx.cosine_tokens(c, tx.content_words(tx.tokenize(t), stop)), lambda o: F.when(
                o >= fv.CONTRADICTION_TOPIC_FLOOR, activation * o * authority(e)).otherwise(0.0)))))
    live = (activation > 0) & (F.coalesce(F.size(epistemic), F.lit(0)) > 0)
    return F.when(live, F.least(F.lit(fv.CONTRADICTION_RISK_CAP), F.coalesce(raw, F.lit(0.0)))).otherwise(0.0)


def grounding(candidate: Column, support: Column | None, stop=fv.STOPWORDS) -> Column:
    """Share of the candidate's content words found in the support; 0.5 when either is empty."""
    own = F.array_distinct(tx.content_words(tx.tokenize(candidate), stop))
    if support is None:
        return F.lit(0.5)
    base = F.array_distinct(F.flatten(F.transform(support, lambda t: tx.content_words(tx.tokenize(t), stop))))
    return tx.let(F.struct(own.alias("o"), F.coalesce(base, F.array().cast("array<string>")).alias("b")), lambda v: F.when(
        (F.size(v["o"]) == 0) | (F.size(v["b"]) == 0), 0.5).otherwise(
        F.size(F.array_intersect(v["o"], v["b"])) / F.size(v["o"])))


def assertiveness(candidate: Column) -> Column:
    low = F.lower(candidate)
    counts = F.struct(tx.occurrences_of(low, fv.HEDGE_PHRASES).alias("hedge"),
                      (tx.occurrences_of(low, fv.ASSERTION_PHRASES) + F.size(tx.sentences(candidate))).alias("firm"))
    return tx.let(counts, lambda c: c["firm"] / (c["firm"] + c["hedge"] + 1))


def brightness(d: dict[str, Column], risk: Column) -> Column:
    blend = sum((w * d[k] for k, w in fv.QUALITY_WEIGHTS.items()), F.lit(0.0))
    return _clamp(blend - fv.RISK_SCALE * risk, 0.0)


def action(bright: Column, alert: Column) -> Column:
    return (F.when(alert & (bright < fv.COMMIT_AT), "quarantine")
            .when(bright >= fv.COMMIT_AT, "commit").otherwise("light_log"))


def verdict(bright: Column, covenant: Column, consistency: Column, grounded: Column, assertive: Column,
            given: Column | None = None) -> Column:
    t = fv.VERDICT_FLOORS
    ladder = (F.when((covenant < t["covenant"]) | (consistency < t["consistency"]), "reject")
              .when((grounded < t["grounding"]) & (assertive > t["assertive"]), "force_uncertainty")
              .when(bright < t["brightness"], "revise").otherwise("seal"))
    if given is None:
        return ladder
    return F.when(given.isin("seal", "revise", "force_uncertainty", "reject"), given).otherwise(ladder)


def evaluate(df: DataFrame, question: str, candidate: str, retrieved: str | None = None,
             epistemic: str | None = None, source: str | None = None, covenant: str | None = None,
             prior: str | None = None, external: str | None = None, external_verdict: str | None = None,
             lex: sg.Lexicons | None = None) -> DataFrame:
    """Scores every (question, candidate) row. `external` is a map of caller scores that win per name."""
    kept = df.columns
    lex = lex or sg.Lexicons()
    cand, pc = sg.prepare(df, candidate, prior, retrieved, lex, "_c_")
    both, pq = sg.prepare(cand, question, prior, retrieved, lex, "_q_")
    col = lambda name: None if name is None else F.col(name)

    def judged(name, value):
        return value if external is None else F.coalesce(F.try_element_at(F.col(external), F.lit(name)), value)

    mods = {f"_m_{n}": sg.DETECTORS[n](pc) for n in fv.MODALITIES}
    senses = {f"_s_{n}": sg.DETECTORS[n](pc) for n in fv.SENSES}
    wide = both.withColumns({**mods, **senses, "_qi": sg.integrity_field(pq), "_qs": sg.injection_scan(pq)})
    c, q, r = F.col(candidate), F.col(question), col(retrieved)
    dims = {
        "relevance": judged("relevance", relevance(q, c, lex.stop)),
        "coherence": judged("coherence", F.col("_m_coherence.coherence")),
        "continuity": judged("continuity_consistency", continuity(c, r, lex.stop)),
        "usefulness": judged("usefulness", usefulness(c)),
        "source_trust": judged("source_trust", source_trust(F.lit("user") if source is None else F.col(source))),
        "covenant": judged("covenant_alignment", covenant_alignment(c, col(covenant)))}
    epi = F.lit(0.0) if epistemic is None else contradiction_risk(
        F.col("_s_contradiction.activation"), c, r, F.col(epistemic), lex.stop)
    wide = wide.withColumns({
        **dims, "epistemic_risk": epi, "grounding": judged("grounding", grounding(c, r, lex.stop)),
        "assertiveness": judged("assertiveness", assertiveness(c)),
        "has_alert": F.col("_m_integrity_field.alert") | F.col("_s_injection_scan.alert")
        | F.col("_qi.alert") | F.col("_qs.alert")})
    wide = wide.withColumn("risk", F.greatest("_m_integrity_field.tension", "_qi.tension", "epistemic_risk"))
    wide = wide.withColumn("brightness", brightness({k: F.col(k) for k in dims}, F.col("risk")))
    names = lambda pre, ns: sg._names([(n, F.col(f"{pre}{n}")["activation"] > fv.ACTIVATION_FLOOR) for n in ns])
    return wide.select(
        *kept, *dims, "risk", "epistemic_risk", "brightness", "grounding", "assertiveness", "has_alert",
        action(F.col("brightness"), F.col("has_alert")).alias("action"),
        verdict(F.col("brightness"), F.col("covenant"), F.col("continuity"), F.col("grounding"),
                F.col("assertiveness"), col(external_verdict)).alias("verdict"),
        F.col("_s_uncertainty.activation").alias("uncertainty"),
        F.col("_m_artifact_content.activation").alias("artifact_score"),
        names("_m_", fv.MODALITIES).alias("modalities_activated"),
        names("_s_", [s for s in fv.SENSES if s not in fv.SECURITY_SENSES]).alias("senses_activated"))


def commit_meta(df: DataFrame, default_salience: float = 0.4) -> DataFrame:
    """What a scored candidate is stored with: epistemic class, exposure and salience."""
    return df.withColumns({
        "commit_epistemic": F.when(F.col("uncertainty") >= 0.6, "speculative").otherwise("inferred"),
        "commit_exposure": F.when(F.col("action") == "quarantine", "quarantine").otherwise("private"),
        "commit_salience": F.when(F.col("action") == "light_log", default_salience * 0.5).otherwise(default_salience)})
