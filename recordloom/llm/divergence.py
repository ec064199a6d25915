"""Distribution divergence: documents against references of their language.

A document is two histograms: its characters over eight classes, and its words over the common
words of all languages given, plus one bucket for every other word. A language's reference is the
sum of these histograms over all its documents that are long enough. The Jensen-Shannon distance
(base 2, 0 to 1) between document and reference tells odd mixtures of characters or words. Guards
on length keep short documents, whose histograms say little, out of judgement and references.

Only DataFrame functions are used. Histograms are taken in one scan and written as a narrow table;
the references have one row per listed language and one for the rest, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import SPACE, bind, prepare, words
from recordloom.session import stored

#: Common words of four languages.
COMMON = {
    "en": "the of and to a in is that it for on was with as be this by are at from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au sur par pas avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split(),
    "es": "de la que el en y los se del las un por con no una para su es al lo".split(),
}
#: Character classes, taken out one after the other; what is left is the last class.
CLASSES = (("small", "[a-z]+"), ("space", SPACE), ("beyond_ascii", r"[^\x00-\x7F]+"), ("capital", "[A-Z]+"),
           ("point", "[.,;:!?'\"()-]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"))
SYMBOL = [n for n, _ in CLASSES].index("symbol")
SPACES = [n for n, _ in CLASSES].index("space")
MIN_CHARS = 200
MIN_WORDS = 60
MOST_CLASS_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.315
OTHER = ""


def class_histogram(text: Column) -> Column:
    """Characters in each class, by the length that each removal takes away."""
    lengths, left = [F.length(text)], text
    for _, pattern in CLASSES:
        left = F.regexp_replace(left, pattern, "")
        lengths.append(F.length(left))
    return F.array(*[(a - b).cast("long") for a, b in zip(lengths, lengths[1:])], lengths[-1].cast("long"))


def word_histogram(found: Column, common: Sequence[str]) -> Column:
    """How often each common word stands among the words, and all others in the last place.

    The common words are filtered out and joined with two blanks between them, so each can be
    counted by the length its removal takes away.
    """
    hits = F.concat(F.lit(" "), F.array_join(F.filter(found, lambda w: w.isin(*common)), "  "), F.lit(" "))
    return bind(hits, lambda h: F.transform(
        F.array(*[F.lit(f" {w} ") for w in common]),
        lambda w: (F.length(h) - F.length(F.replace(h, w, F.lit("")))) / F.length(w)).cast("array<long>"))


def repeated_words(found: Column, span: int = 8) -> Column:
    """Words inside windows of `span` words that occur twice or more in the text.

    A hash per window shows that most texts repeat nothing; only otherwise windows are compared
    as texts, sorted with their places, so neighbours tell repeats.
    """
    def positions(w):
        return F.sequence(F.lit(0), F.size(w) - span)

    def covered(places):
        # each place adds the words up to the next place, `span` at most
        return F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 1), F.lit(0).cast("long"),
            lambda total, i: total + F.when(i == F.size(places) - 1, F.lit(span)).otherwise(
                F.least(F.lit(span), F.get(places, i + 1) - F.get(places, i))))

    def exact(w):
        windows = F.array_sort(F.transform(positions(w), lambda i: F.struct(
            F.array_join(F.slice(w, i + 1, span), " ").alias("t"), i.alias("i"))))
        return bind(windows, lambda s: bind(
            F.sort_array(F.filter(
                F.transform(s, lambda x, i: F.when(
                    (x["t"] == F.get(s, i - 1)["t"]) | (x["t"] == F.get(s, i + 1)["t"]), x["i"])),
                lambda i: i.isNotNull())),
            lambda places: F.when(F.size(places) > 0, covered(places)).otherwise(F.lit(0).cast("long"))))

    def known(w):
        hashes = F.transform(positions(w), lambda i: F.xxhash64(F.slice(w, i + 1, span)))
        return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(w)))

    return bind(found, lambda w: F.when(F.size(w) < span, F.lit(0).cast("long")).otherwise(known(w)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bind(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
                lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty."""
    def half(a, b, i, j):
        m = (i / a + j / b) / 2
        return F.when(i > 0, i / a * F.log2(i / a / m)).otherwise(F.lit(0.0))

    def total(h):
        return F.aggregate(h, F.lit(0.0), lambda t, x: t + x)

    def measured(a, b):
        parts = F.zip_with(p, q, lambda i, j: (half(a, b, i, j) + half(b, a, j, i)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)))

    return bind(total(p), lambda a: bind(total(q), lambda b: F.when((a > 0) & (b > 0), measured(a, b))))


def histograms(docs: DataFrame, common: Mapping[str, Sequence[str]] = COMMON) -> DataFrame:
    """One row per input row: doc_id, language, counts of the base rules, both histograms."""
    listed = sorted({w for ws in common.values() for w in ws})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("_lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    split = texts.withColumn("_words", words(F.col("_text"))).withColumn("_classes", class_histogram(F.col("_text")))
    hits = bind(F.col("_words"), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), word_histogram(w, listed).alias("hits"), repeated_words(w).alias("again")))
    return split.select(
        "doc_id", F.when(F.col("_lang").isin(*common), F.col("_lang")).otherwise(F.lit(OTHER)).alias("language"),
        F.length("_text").cast("long").alias("n_chars"), repeated_lines(F.col("_text")).alias("n_dup_lines"),
        F.col("_classes").alias("classes"), hits.alias("_h")).select(
        "doc_id", "language", "n_chars", "n_dup_lines", "classes", F.col("_h.n").alias("n_words"),
        F.col("_h.again").alias("n_repeat_words"),
        F.concat("_h.hits", F.array(F.col("_h.n") - F.aggregate("_h.hits", F.lit(0).cast("long"), lambda t, x: t + x))).alias("hits"))


def references(found: DataFrame, n_hits: int, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Sums of both histograms by language, over every document long enough. One row per language."""
    def sums(name, n):
        return F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).cast("array<double>")
    return (found.where((F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words))
            .groupBy("language").agg(sums("classes", len(CLASSES) + 1).alias("_class_ref"), sums("hits", n_hits).alias("_word_ref")))


def judge(docs: DataFrame, common: Mapping[str, Sequence[str]] = COMMON, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
          most_class: float = MOST_CLASS_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance.

    A null text has no words and so fails the base rules. Documents under the guards, and those of
    a language without a reference, have null distances and are not rejected by them. Null or
    unlisted languages share one reference. Repeated rows are judged alike; an empty table gives an
    empty one.
    """
    prepare(docs.sparkSession)
    found = stored(histograms(docs, common))
    n_hits = len({w for ws in common.values() for w in ws}) + 1
    # one row per listed language and one for the rest: bounded by the parameter
    refs = F.broadcast(references(found, n_hits, min_chars, min_words))
    long_enough = (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = found.join(refs, "language", "left").select(
        "doc_id", "n_words", (F.col("n_chars") - F.col("classes")[SPACES]).alias("word_chars"),
        F.col("classes")[SYMBOL].alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(long_enough, distance(F.col("classes").cast("array<double>"), F.col("_class_ref"))).alias("class_distance"),
        F.when(long_enough, distance(F.col("hits").cast("array<double>"), F.col("_word_ref"))).alias("word_distance"))
    near = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= most_class) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= most_word)
    distances = ["class_distance", "word_distance"]
    return measured.select(*[c for c in measured.columns if c not in distances], (~F.col("base_failed") & near).alias("kept"), *distances)
