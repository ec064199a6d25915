"""License scans by ordered signature rules.

A text becomes its words (ASCII letters in lower case) with one blank between them. Hundreds of
regexes, written for that form, each have a priority and a keyword that any of their matches holds.
Texts without a keyword are left after one look; in the others only rules whose keyword occurs are
matched. Overlaps are resolved by interval containment: a detection that lies inside another one
falls if the other ranks higher, or as high and is longer or, at equal span, earlier in the list.

Only DataFrame functions are used. Texts are read once, into a narrow table of counts and of the
detections' lengths in words; running sums and maxima over a text's detections do the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.llm.common import bind, prepare
from recordloom.session import stored


@dataclass(frozen=True)
class Signature:
    """`priority`: 1 ranks highest; 0 marks base phrases, which take no part in suppression.

    Any match holds the keyword and, if there are any, one of the `names` as whole words.
    """
    label: str
    pattern: str
    keyword: str
    priority: int
    score: float
    names: tuple[str, ...] = ()


#: Base phrases and their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Families: label, names as they are written (one pattern of words), short identifiers.
FAMILIES = (
    ("mit", "mit|expat", "mit"), ("apache-2.0", "apache", "apache 2 0"), ("apache-1.1", "apache software", "apache 1 1"),
    ("gpl-2.0", "(?:gnu )?(?:general public|gpl) (?:license )?(?:version |v )?2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "(?:gnu )?(?:general public|gpl) (?:license )?(?:version |v )?3", "gpl 3 0(?: only| or later)?"),
    ("gpl", "gnu general public|gnu gpl", "gpl"), ("lgpl-2.1", "(?:gnu )?(?:lesser general public|lgpl) (?:license )?(?:version |v )?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "(?:gnu )?lgpl (?:version |v )?3", "lgpl 3 0(?: only| or later)?"), ("lgpl", "(?:gnu )?(?:lgpl|lesser general public|library general public)", "lgpl"),
    ("agpl-3.0", "(?:gnu )?(?:affero general public|agpl)", "agpl 3 0(?: only| or later)?"), ("gfdl", "(?:gnu )?free documentation", "gfdl 1 [123]"),
    ("bsd-2-clause", "(?:simplified|2 clause|two clause|freebsd) bsd|bsd (?:2|two) clause", "bsd 2 clause"),
    ("bsd-3-clause", "(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd 4 clause"), ("bsd", "bsd|berkeley software distribution", "bsd"),
    ("0bsd", "(?:zero clause|free public) bsd|bsd zero clause", "0bsd"), ("isc", "isc|internet systems consortium", "isc"),
    ("mpl-2.0", "mozilla public license (?:version |v )?2 0|mpl (?:version |v )?2 0", "mpl 2 0"), ("mpl-1.1", "mozilla public license (?:version |v )?1 1|mpl (?:version |v )?1 1", "mpl 1 1"),
    ("mpl", "mozilla public", "mpl"), ("epl-2.0", "eclipse public license (?:version |v )?2 0|epl (?:version |v )?2 0", "epl 2 0"),
    ("epl-1.0", "eclipse public license (?:version |v )?1 0|epl (?:version |v )?1 0", "epl 1 0"), ("epl", "eclipse public", "epl"),
    ("cddl-1.0", "common development and distribution", "cddl 1 [01]"), ("cpl-1.0", "common public", "cpl 1 0"),
    ("artistic-2.0", "artistic license (?:version |v )?2 0|artistic 2 0", "artistic 2 0"), ("artistic", "(?:perl )?artistic", "artistic 1 0"),
    ("zlib", "zlib(?: libpng)?", "zlib"), ("libpng", "libpng|png reference library", "libpng 2 0"), ("bsl-1.0", "boost software|boost", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "do what the f\\S* you want to public|wtfpl", "wtfpl"), ("cc0-1.0", "cc0(?: 1 0)?|creative commons zero", "cc0 1 0"),
    ("cc-by-4.0", "(?:creative commons )?attribution 4 0(?: international)?|cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "(?:creative commons )?attribution 3 0(?: unported)?|cc by 3 0", "cc by 3 0"),
    ("cc-by-sa-4.0", "(?:creative commons )?attribution share ?alike 4 0(?: international)?|cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "(?:creative commons )?attribution share ?alike 3 0(?: unported)?|cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-nc-4.0", "(?:creative commons )?attribution non ?commercial 4 0(?: international)?|cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "(?:creative commons )?attribution non ?commercial share ?alike 4 0|cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "(?:creative commons )?attribution no ?deriv(?:ative)?s 4 0|cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-nd-4.0", "(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s 4 0|cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc", "creative commons", "cc by"), ("eupl-1.2", "european union public|eupl", "eupl 1 2"), ("osl-3.0", "open software", "osl 3 0"),
    ("afl-3.0", "academic free", "afl 3 0"), ("ms-pl", "microsoft public", "ms pl"), ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("ncsa", "university of illinois ncsa open source|ncsa", "ncsa"), ("postgresql", "postgresql", "postgresql"), ("python-2.0", "python software foundation|psf", "psf 2 0"),
    ("php-3.01", "php", "php 3 01"), ("ruby", "ruby", "ruby"), ("vim", "vim", "vim"), ("openssl", "openssl", "openssl"), ("odbl-1.0", "open database|odbl", "odbl 1 0"),
    ("ofl-1.1", "sil open font|open font", "ofl 1 1"), ("w3c", "w3c(?: software notice and)?", "w3c"), ("x11", "x11", "x11"), ("curl", "curl", "curl"),
    ("sspl-1.0", "server side public|sspl", "sspl 1 0"), ("busl-1.1", "business source", "busl 1 1"), ("elastic-2.0", "elastic", "elastic 2 0"),
    ("llama", "llama (?:2 |3 )?community", "llama"), ("openrail", "(?:bigscience |creativeml )?open ?rail(?: m)?", "openrail"),
)
#: Words of which any mention of a family, long or short, holds one; other families hold their label's first word.
NAMED = {
    "mit": "mit|expat", "apache-2.0": "apache", "apache-1.1": "apache", "gpl-2.0": "general public|gpl", "gpl-3.0": "general public|gpl",
    "gpl": "general public|gpl", "lgpl-2.1": "lesser general public|lgpl", "lgpl": "lesser general public|library general public|lgpl",
    "agpl-3.0": "affero general public|agpl", "gfdl": "free documentation|gfdl", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
    "bsd-4-clause": "bsd", "bsd": "bsd|berkeley software distribution", "0bsd": "bsd|0bsd", "isc": "isc|internet systems consortium",
    "mpl-2.0": "mozilla|mpl", "mpl-1.1": "mozilla|mpl", "mpl": "mozilla|mpl", "epl-2.0": "eclipse|epl", "epl-1.0": "eclipse|epl", "epl": "eclipse|epl",
    "cddl-1.0": "common development|cddl", "cpl-1.0": "common public|cpl", "libpng": "libpng|png reference", "bsl-1.0": "boost|bsl",
    "wtfpl": "do what the|wtfpl", "cc0-1.0": "cc0|creative commons zero", "cc-by-4.0": "attribution|cc by", "cc-by-3.0": "attribution|cc by",
    "cc-by-sa-4.0": "attribution|cc by sa", "cc-by-sa-3.0": "attribution|cc by sa", "cc-by-nc-4.0": "attribution|cc by nc",
    "cc-by-nc-sa-4.0": "attribution|cc by nc sa", "cc-by-nd-4.0": "attribution|cc by nd", "cc-by-nc-nd-4.0": "attribution|cc by nc nd",
    "cc": "creative commons|cc by", "eupl-1.2": "european union public|eupl", "osl-3.0": "open software|osl", "afl-3.0": "academic free|afl",
    "ms-pl": "microsoft public|ms pl", "ms-rl": "microsoft reciprocal|ms rl", "python-2.0": "python software foundation|psf",
    "odbl-1.0": "open database|odbl", "ofl-1.1": "open font|ofl", "sspl-1.0": "server side public|sspl", "busl-1.1": "business source|busl",
    "openrail": "openrail|open rail|open railm|openrailm",
}
#: Families with versions: labels, name before or after whose "license" the version stands, whole words
#: of which any such mention holds one, and a short name that needs no "license" ("" if it would be ambiguous).
VERSIONED = (
    (("gpl-2.0", "gpl-3.0"), "(?:gnu )?(?<!lesser )(?<!library )(?<!affero )(?:general public|gpl)", "general public|gpl", "gpl"),
    (("lgpl-2.1", "lgpl-3.0"), "(?:gnu )?(?:(?:lesser|library) general public|lesser gpl|lgpl)", "lesser general public|library general public|lesser gpl|lgpl", "lgpl"),
    (("agpl-3.0",), "(?:gnu )?(?:affero general public|affero gpl|agpl)", "affero general public|affero gpl|agpl", "agpl"),
    (("apache-2.0", "apache-1.1"), "apache(?: software)?", "apache", ""), (("mpl-2.0", "mpl-1.1"), "(?:mozilla public|mpl)", "mozilla public|mpl", "mpl"),
    (("epl-2.0", "epl-1.0"), "(?:eclipse public|epl)", "eclipse public|epl", "epl"), (("artistic-2.0",), "(?:perl )?artistic", "artistic", ""),
    (("cddl-1.0",), "(?:common development and distribution|cddl)", "common development|cddl", "cddl"), (("cpl-1.0",), "(?:common public|cpl)", "common public|cpl", "cpl"),
    (("bsl-1.0",), "boost(?: software)?", "boost", ""), (("cc0-1.0",), "(?:creative commons zero|cc0)", "creative commons zero|cc0", "cc0"),
    (("eupl-1.2",), "(?:european union public|eupl)", "european union public|eupl", "eupl"), (("osl-3.0",), "(?:open software|osl)", "open software|osl", "osl"),
    (("afl-3.0",), "(?:academic free|afl)", "academic free|afl", "afl"), (("python-2.0",), "(?:python software foundation|psf)", "python software foundation|psf", ""),
    (("php-3.01",), "php", "php", ""), (("odbl-1.0",), "(?:open database|odbl)", "open database|odbl", "odbl"), (("ofl-1.1",), "(?:sil )?(?:open font|ofl)", "open font|ofl", "ofl"),
    (("sspl-1.0",), "(?:server side public|sspl)", "server side public|sspl", "sspl"), (("busl-1.1",), "(?:business source|busl)", "business source|busl", "busl"),
    (("elastic-2.0",), "elastic", "elastic", ""),
)
#: The raw text of a match "... under ..." holds one of these.
GRANTS = ("licensed", "released", "distributed", "available", "published", "provided")
#: How a family is mentioned: pattern around its name, keyword, priority, score.
FORMS = (
    ("spdx license identifier (?:{short})", "spdx", 1, 1.0),
    ("(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?(?: (?:version |v )?[0-9]+(?: [0-9]+)?)?", "under", 2, 0.95),
    ("(?:{name}) licen[cs]e (?:version |v )?[0-9]+(?: [0-9]+)?", "licen", 3, 0.9),
    ("(?:{name}) licen[cs]e", "licen", 4, 0.8),
    ("licen[cs]e (?:is |type )?(?:{short}|{name})", "licen", 5, 0.6),
)
#: Sentences that stand in the licenses themselves.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("mit", "the software is provided as is without warranty of any kind", "warranty"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd-3-clause", "neither the name of (?:\\S+ ){1,12}may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance"),
    ("apache-2.0", "http www apache org licenses license 2 0", "apache"),
    ("gpl", "this program is free software you can redistribute it and or modify", "redistribute"),
    ("gpl", "this program is distributed in the hope that it will be useful", "hope"),
    ("gpl", "you should have received a copy of the gnu general public license", "received"),
    ("lgpl", "this library is free software you can redistribute it and or modify", "redistribute"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "domain"),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty"),
    ("bsl-1.0", "boost software license version 1 0", "boost"),
    ("cc", "this work is licensed under (?:a|the) creative commons", "commons"),
    ("proprietary", "all rights reserved", "reserved"),
    ("proprietary", "confidential and proprietary", "proprietary"),
    ("proprietary", "unauthorized copying of this file", "unauthorized"),
)


AT = "(?:version |v ?)?"
UNDER = "(?:(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?)?"
#: An exact version after or before "license", and with short names, also glued as in gplv2, without it.
VERSION_FORMS = ("{under}{name} (?:licen[cs]e {at}{exact}|{at}{exact} licen[cs]e)(?: only| or later)?", "{under}(?:gnu )?{short}(?: licen[cs]e)? ?{at}{exact}(?: only| or later)?")


def exact(label: str) -> str:
    """The version of a label. A minor 0 may be left out, if no other minor follows."""
    major, minor = label.rsplit("-", 1)[1].split(".")
    return f"(?:{major} 0|{major}(?! [0-9] ))" if minor == "0" else f"{major} {minor}"


def other(label: str) -> str:
    """What follows a name is no version but the label's own."""
    return f"(?!(?: licen[cs]e)?(?! {AT}{exact(label)}(?= )) {AT}[0-9]{{1,2}}(?= ))"


@lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """All rules in order: exact versions, every family in every form, the sentences, the base phrases."""
    named = lambda label: tuple(f" {n} " for n in NAMED.get(label, label.split("-")[0]).split("|"))
    rules = [Signature(label, form.format(under=UNDER, name=name, short=short, at=AT, exact=exact(label)), "licen" if form is VERSION_FORMS[0] else short, 2, 0.95,
                       tuple(f" {n} " for n in words.split("|")) if form is VERSION_FORMS[0] else ())
             for form in VERSION_FORMS for labels, name, words, short in VERSIONED for label in labels if short or form is VERSION_FORMS[0]]
    versions = {label for labels, *_ in VERSIONED for label in labels}
    rules += [Signature(label, form.format(name=f"(?:{name}){other(label)}" if label in versions else name, short=short), keyword, priority, score, named(label))
              for form, keyword, priority, score in FORMS for label, name, short in FAMILIES]
    rules += [Signature(label, pattern, keyword, 3, 0.85) for label, pattern, keyword in BODIES]
    rules += [Signature(label, phrase, "license", 0, 0.5) for label, phrase in BASE]
    return tuple(rules)


WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOUND = "array<struct<rule:int,place:int,gap:int,hit:int>>"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detect(line: Column, rules: Sequence[Signature]) -> Column:
    """Matches of the rules whose keyword occurs, as words before (since the last match) and inside.

    A match takes the blank before it and ends before one, so counting blanks counts words.
    """
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.keyword).alias("k"), F.lit(f" (?:{r.pattern})(?= )").alias("p"),
                              F.array(*[F.lit(n) for n in r.names]).cast("array<string>").alias("n")) for i, r in enumerate(rules)])

    def one(r):
        gaps = F.transform(F.split(line, r["p"], -1), _blanks)
        hits = F.transform(F.regexp_extract_all(line, r["p"], F.lit(0)), _blanks)
        return F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")),
                           lambda z, i: F.struct(r["i"].alias("rule"), i.alias("place"), z["g"].alias("gap"), z["h"].alias("hit")))

    likely = F.filter(table, lambda r: F.contains(line, r["k"]) & (
        (F.size(r["n"]) == 0) | F.exists(r["n"], lambda n: F.contains(line, n))))
    return F.filter(F.flatten(F.transform(likely, one)), lambda m: m["hit"].isNotNull())


def scan(docs: DataFrame, rules: Sequence[Signature] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two frames: texts (uid, doc_id, n_words) and detections (uid, rule, start, end in words)."""
    rules = rules or signatures()
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # short names stand inside many other words, so they are looked for at the start of one
    short = {k for *_, k in VERSIONED if k}
    starts = sorted(short & {r.keyword for r in rules})
    keywords = sorted({k for r in rules if r.keyword not in short for k in (GRANTS if r.keyword == "under" else (r.keyword,))})
    keywords = [k for k in keywords if not any(o != k and o in k for o in keywords)]

    def gate(t):
        low, opened = F.lower(t), F.lit(False)
        return bind(low, lambda x: _any([F.contains(x, F.lit(k)) for k in keywords] + [x.rlike(f"(?:^|{GAPS[:-1]})(?:{'|'.join(starts)})")] * bool(starts)))

    def _any(tests):
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    line = F.concat(F.lit(" "), F.translate(F.trim(F.regexp_replace("_text", GAPS, " ")), UPPER, UPPER.lower()), F.lit(" "))
    table = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
                   .select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                           F.regexp_count("_text", F.lit(WORDS)).cast("long").alias("n_words"),
                           F.when(gate(F.col("_text")), bind(line, lambda x: detect(x, rules))).otherwise(F.array().cast(FOUND)).alias("found")))
    hits = table.where(F.size("found") > 0).select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    before = W.partitionBy("uid", "rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    spans = (hits.withColumn("_last", F.sum(F.col("gap") + F.col("hit")).over(before))
             .select("uid", "rule", (F.col("_last") - F.col("hit")).alias("start"), F.col("_last").alias("end")))
    return table.select("uid", "doc_id", "n_words"), spans


def resolve(spans: DataFrame, rules: Sequence[Signature] | None = None) -> DataFrame:
    """Adds `kept`. Sorted by start, longest first, then rank: whatever may hold a detection comes
    before it, so the furthest end so far at its rank or above tells whether it is contained."""
    rules = rules or signatures()
    ranks = F.array(*[F.lit(r.priority) for r in rules])
    ranked = spans.withColumn("rank", F.get(ranks, F.col("rule")))
    before = W.partitionBy("uid").orderBy("start", F.desc("end"), "rank", "rule").rowsBetween(W.unboundedPreceding, -1)
    fallen = F.lit(False)
    for rank in sorted({r.priority for r in rules} - {0}):
        far = F.max(F.when((F.col("rank") <= rank) & (F.col("rank") > 0), F.col("end"))).over(before)
        fallen = fallen | ((F.col("rank") == rank) & (F.coalesce(far, F.lit(-1)) >= F.col("end")))
    return ranked.withColumn("kept", ~fallen)


def licenses(docs: DataFrame, rules: Sequence[Signature] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and `detections` (what stands after suppression: start, end, label).

    The score is that of the best detection kept, 0 without one. A null text is an empty one;
    repeated rows and copies get equal results; an empty table gives an empty one.
    """
    rules = rules or signatures()
    texts, spans = scan(docs, rules)
    labels = F.array(*[F.lit(r.label) for r in rules])
    scores = F.array(*[F.lit(r.score) for r in rules])
    base = F.col("rank") == 0
    seen = resolve(spans, rules).where("kept").withColumn("label", F.get(labels, F.col("rule"))).groupBy("uid").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("_base"), F.collect_set("label").alias("_all"),
        F.max(F.get(scores, F.col("rule"))).alias("score"),
        F.array_sort(F.collect_list(F.when(~base, F.struct("start", "end", "label")))).alias("detections"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return texts.join(seen, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        joined(F.col("_base")).alias("base_labels"), joined(F.col("_all")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "detections")
