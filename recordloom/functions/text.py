"""Text measures as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from recordloom import fixed_values as fv
from recordloom.fixed_values import NEGATIVE, POSITIVE, QUESTION_WORDS, STOPWORDS

TOKEN = r"[a-zA-Z'\-]+"


def literal_array(words: Sequence[str]) -> Column:
    """A constant array of strings, made in one call."""
    quoted = ["'" + w.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" for w in words]
    return F.expr("array(" + ",".join(quoted) + ")") if quoted else F.expr("cast(array() as array<string>)")


def among(word: Column, words: Sequence[str]) -> Column:
    return F.array_contains(literal_array(words), word)


def tokenize(text: Column) -> Column:
    """ASCII letter runs with inner apostrophes and hyphens, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[.!?]+"), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(tokenize(text))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping count of a plain substring."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def occurrences_of(text: Column, needles: Sequence[str]) -> Column:
    """Sum of `occurrences` over several needles."""
    return F.aggregate(literal_array(needles), F.lit(0).cast("long"), lambda a, w: a + F.floor(
        (F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)))


def contains_count(text: Column, needles: Sequence[str]) -> Column:
    """How many of the needles occur at all."""
    return F.size(F.filter(literal_array(needles), lambda w: F.contains(text, w)))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return F.exists(literal_array(needles), lambda w: F.contains(text, w))


def lexicon_count(tokens: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: among(t, lexicon)))


def lexicon_score(tokens: Column, lexicon: Sequence[str]) -> Column:
    n = F.size(tokens)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), lexicon_count(tokens, lexicon) / n * 5))


def content_words(tokens: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~among(t, stop))


def is_alpha(token: Column) -> Column:
    return ~(F.contains(token, F.lit("'")) | F.contains(token, F.lit("-")))


def avg_word_length(tokens: Column) -> Column:
    words = F.filter(tokens, is_alpha)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return F.when(F.size(words) == 0, 0.0).otherwise(total / F.size(words))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def sentence_length_variance(text: Column) -> Column:
    """Population standard deviation of the words per sentence."""
    lengths = F.transform(sentences(text), lambda s: F.size(whitespace_words(s)).cast("double"))

    def spread(xs):
        mean = total(xs) / F.size(xs)
        return let(mean, lambda m: F.sqrt(total(F.transform(xs, lambda x: (x - m) * (x - m))) / F.size(xs)))
    return let(lengths, lambda xs: F.when(F.size(xs) < 2, 0.0).otherwise(spread(xs)))


def question_density(text: Column, tokens: Column, words: Sequence[str] = QUESTION_WORDS) -> Column:
    n = F.size(tokens)
    marks = occurrences(text, "?") * 2 + lexicon_count(tokens, words)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), marks / n * 3))


def emotional_valence(tokens: Column, positive: Sequence[str] = POSITIVE,
                      negative: Sequence[str] = NEGATIVE) -> Column:
    pos, neg = lexicon_count(tokens, positive), lexicon_count(tokens, negative)
    return F.when(pos + neg == 0, 0.0).otherwise((pos - neg) / (pos + neg))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# Equal tokens stand side by side once sorted and joined; a pattern then reads whole runs in one
# pass, far cheaper than a lambda per token. The possessive loops neither backtrack nor recurse.
RUN = r"(\S++)(?: \1(?!\S))*+"
REPEATED_RUN = r"(?<!\S)(\S++)(?: \1(?!\S))++"


def _runs(tokens: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.array_join(F.sort_array(tokens), " "), F.lit(pattern), F.lit(0))


def _run_size(run: Column, word: Column) -> Column:
    return (F.length(run) + 1) / (F.length(word) + 1)


def bag(tokens: Column) -> Column:
    """Distinct tokens (without white space) and their counts: array<struct<w,n>>."""
    return F.transform(_runs(tokens, RUN), lambda r: let(F.substring_index(r, " ", 1), lambda w: F.struct(
        w.alias("w"), _run_size(r, w).alias("n"))))


def bag_norm(b: Column) -> Column:
    return F.sqrt(total(F.transform(b, lambda e: e["n"] * e["n"])))


def cosine_bags(a: Column, b: Column) -> Column:
    """Cosine of two bags: shared words end up side by side once both are sorted together."""
    def dot(u):
        pairs = F.when(F.size(u) > 1, F.sequence(F.lit(0), F.size(u) - 2)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.when(
            F.get(u, i)["w"] == F.get(u, i + 1)["w"], F.get(u, i)["n"] * F.get(u, i + 1)["n"]).otherwise(0.0))
    norm = bag_norm(a) * bag_norm(b)
    return F.when(norm == 0, 0.0).otherwise(let(F.sort_array(F.concat(a, b)), dot) / norm)


def sum_squares(tokens: Column) -> Column:
    """Squared length of the token counts; only repeated tokens add to the number of tokens."""
    return F.aggregate(_runs(tokens, REPEATED_RUN), F.size(tokens).cast("double"), lambda a, r: a + let(
        _run_size(r, F.substring_index(r, " ", 1)), lambda n: n * n - n))


def cosine_tokens(a: Column, b: Column, a2: Column | None = None, b2: Column | None = None) -> Column:
    """Cosine of the token counts of two arrays, from |a + b|^2 = |a|^2 + |b|^2 + 2ab.

    `a2` and `b2` are their squared lengths where already known. Each root is taken by itself, as norms are in
    SQL: the root of the product may differ in the last digit and so cross a threshold.
    """
    lengths = F.struct((sum_squares(a) if a2 is None else a2).alias("a"), (sum_squares(b) if b2 is None else b2).alias("b"))
    return let(lengths, lambda n: F.when((n["a"] == 0) | (n["b"] == 0), 0.0).otherwise(
        (sum_squares(F.concat(a, b)) - n["a"] - n["b"]) / 2 / (F.sqrt(n["a"]) * F.sqrt(n["b"]))))


def keyword_tokens(tokens: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    """Alphabetic tokens longer than two letters that are not stop words."""
    return F.filter(tokens, lambda t: is_alpha(t) & (F.length(t) > 2) & ~among(t, stop))


def top_words(tokens: Column, k: int) -> Column:
    """The k most frequent tokens with counts; ties go to the earlier first appearance.

    First appearances are looked up only for words frequent enough to make the list.
    """
    def ranked(t, b, floor):
        best = F.filter(b, lambda e: e["n"] >= floor)
        return F.slice(F.sort_array(F.transform(best, lambda e: F.struct(
            (-e["n"]).alias("neg"), F.array_position(t, e["w"]).alias("p"), e["w"].alias("w")))), 1, k)
    found = let(tokens, lambda t: let(bag(t), lambda b: let(
        F.coalesce(F.get(F.sort_array(F.transform(b, lambda e: e["n"]), False), F.lit(k - 1)), F.lit(0.0)),
        lambda floor: ranked(t, b, floor))))
    return F.transform(found, lambda e: F.struct(e["w"].alias("w"), (-e["neg"]).cast("long").alias("n")))


def top_keywords(text: Column, k: int = 10, stop: Sequence[str] = STOPWORDS) -> Column:
    return top_words(keyword_tokens(tokenize(text), stop), k)


def words_of(counted: Column) -> Column:
    return F.transform(counted, lambda e: e["w"])


def topic_signature(text: Column, k: int = 3) -> Column:
    """Top content words, sorted and joined; empty when there are none."""
    return F.array_join(F.sort_array(words_of(top_keywords(text, k))), "+")


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def excerpt(text: Column, n: int) -> Column:
    return F.array_join(F.slice(whitespace_words(text), 1, n), " ")


def overlap_or_neutral(query: Column, record: Column) -> Column:
    """Share of the query's names that the record carries; 0.5 when either side names nothing."""
    return (F.when((F.size(query) == 0) | (F.size(record) == 0), 0.5)
            .otherwise(F.size(F.array_intersect(query, record)) / F.size(F.array_distinct(query))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct items found in b."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def entities(text: Column, cap: int = 12) -> Column:
    """Identifier-like tokens: with an underscore, an inner capital, a dot or a digit; sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0)),
                        lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    kept = F.filter(found, lambda w: (F.length(w) > 2) & w.rlike(r"_|^.+[A-Z]|\.|[0-9]"))
    return F.slice(F.sort_array(F.array_distinct(kept)), 1, cap)


def keywords(text: Column, k: int = 10, stop: Sequence[str] = STOPWORDS) -> Column:
    """The k most frequent tokens that are not stop words."""
    return words_of(top_words(content_words(tokenize(text), stop), k))


def salience(text: Column) -> Column:
    """Self-assigned weight from identifier count and variety of words."""
    return let(tokenize(text), lambda t: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        0.2 + 0.04 * F.size(entities(text)) + 0.4 * F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1))))), 3))


def explicit_indices(query: Column) -> Column:
    """Record numbers a text names ("record 3", "indices 4 and 5", "#6"), in order, once each."""
    lists = F.regexp_extract_all(query, F.lit(fv.REFERENCE_BY_WORD), F.lit(1))
    named = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0))))
    hashed = F.regexp_extract_all(query, F.lit("(?U)" + fv.REFERENCE_BY_HASH), F.lit(1))
    return F.array_distinct(F.transform(F.concat(named, hashed), lambda n: n.cast("bigint")))


def is_holistic(query: Column, verbs: Sequence[str] = fv.HOLISTIC_VERBS) -> Column:
    """Does the text ask for work on a document as a whole?"""
    stems = [v[:-1] if v.endswith("e") else v for v in verbs]
    return F.lower(query).rlike(r"(?U)\b(?:(?:" + "|".join(verbs) + r")(?:s|d|ed)?|(?:" + "|".join(stems) + r")ing)\b")


def redact_secrets(text: Column) -> tuple[Column, Column]:
    """(masked text, number of replacements); patterns apply in order to the running text."""
    count = F.lit(0)
    for pattern, mask in fv.SECRETS:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, mask)
    return text, count


def recency(age_ms: Column, half_life_days: Column) -> Column:
    return F.when(half_life_days <= 0, 0.0).otherwise(
        F.pow(F.lit(0.5), F.greatest(age_ms, F.lit(0)) / 1000.0 / (half_life_days * 86400.0)))


def compact_age(age_ms: Column) -> Column:
    s = F.greatest(age_ms, F.lit(0)).cast("long")
    unit = lambda ms, name: F.concat(F.floor(s / ms).cast("string"), F.lit(name))
    return (F.when(s < 3_600_000, unit(60_000, "m")).when(s < 86_400_000, unit(3_600_000, "h"))
            .when(s < 14 * 86_400_000, unit(86_400_000, "d")).otherwise(unit(7 * 86_400_000, "w")))


def humanize_delta(seconds: Column) -> Column:
    s = seconds.cast("long")
    d = F.floor(s / 86400)

    def ago(n, unit):
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""), F.lit(" ago"))
    return (F.when(s < 5, "just now").when(s < 60, F.concat(s.cast("string"), F.lit(" seconds ago")))
            .when(s < 3600, ago(F.floor(s / 60), "minute")).when(s < 86400, ago(F.floor(s / 3600), "hour"))
            .when(d < 7, ago(d, "day")).when(d < 30, ago(F.floor(d / 7), "week"))
            .when(d < 365, ago(F.floor(d / 30), "month")).otherwise(ago(F.floor(d / 365), "year")))


def absolute_time(ts_ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def squeeze(text: Column) -> Column:
    """White space runs to single blanks."""
    return F.array_join(whitespace_words(text), " ")


def snippet(rec_type: Column, content: Column) -> Column:
    """One line of at most 220 characters: who said what."""
    said, text = F.get_json_object(content, "$.context"), F.get_json_object(content, "$.text")
    files = F.array_join(F.from_json(F.get_json_object(content, "$.attachments[*].filename"), "array<string>"), ",")
    parts = F.array_compact(F.array(
        F.when(said != "", F.concat(F.lit("user: "), F.substring(squeeze(said), 1, 90))),
        F.when(text != "", F.when(rec_type == "response", F.concat(F.lit("agent: "), F.substring(squeeze(text), 1, 90)))
               .otherwise(F.substring(squeeze(text), 1, 120)))))
    parts = F.when(F.size(parts) == 0, F.array(F.substring(squeeze(content), 1, 110))).otherwise(parts)
    parts = F.when(files.isNotNull(), F.concat(parts, F.array(F.concat(F.lit("[attached: "), files, F.lit("]"))))).otherwise(parts)
    return F.substring(F.array_join(parts, " | "), 1, 220)


def handle(content: Column) -> Column:
    """First non-blank of summary, text, response, objective and function."""
    fields = [F.get_json_object(content, f"$.{n}") for n in ("summary", "text", "response", "objective", "function")]
    return F.coalesce(*[F.when(strip(f) != "", f) for f in fields])


def embed_text(rec_type: Column, content: Column) -> Column:
    """The text a record is embedded by."""
    part = lambda n: F.coalesce(F.get_json_object(content, f"$.{n}"), F.lit(""))
    kind = F.coalesce(F.get_json_object(content, "$.kind"), part("mime_type"))
    return F.when(rec_type.isin("file", "attachment"), F.concat(
        F.lit("[file "), part("filename"), F.lit(" "), kind, F.lit("] "), part("extracted_text"))).otherwise(
        F.concat(F.lit("["), rec_type, F.lit("] "), content))


# --- paths -------------------------------------------------------------------------

def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(ext: Column) -> Column:
    return F.try_element_at(F.expr("map(" + ",".join(f"'{k}','{v}'" for k, v in fv.LANGUAGES.items()) + ")"), F.lower(ext))


def path_role(path: Column, ext: Column) -> Column:
    """Role of a file by its path; the first rule that holds wins."""
    parts = F.transform(_parts(path), lambda p: F.lower(p))
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    inside = lambda role: F.arrays_overlap(parts, literal_array(fv.ROLE_DIRS[role]))
    return (F.when(inside("generated"), "generated").when(inside("vendor"), "vendor")
            .when(inside("test") | stem.rlike(r"^test_|_test$|\.test$|\.spec$"), "test")
            .when(inside("docs") | ext.isin(fv.DOC_EXTENSIONS), "docs")
            .when(ext.isin(fv.CONFIG_EXTENSIONS) | name.isin(fv.CONFIG_NAMES), "config")
            .when(language(ext).isNotNull(), "source").otherwise("other"))


def path_proximity(rel: Column, path_hint: Column, dir_hint: Column) -> Column:
    """1 for the hinted file, 0.8 inside the hinted folder, else 0.6 x shared leading parts / parts of the hint."""
    has_path, has_dir = F.coalesce(path_hint, F.lit("")) != "", F.coalesce(dir_hint, F.lit("")) != ""
    exact = (rel == path_hint) | F.endswith(rel, F.concat(F.lit("/"), path_hint)) | (
        F.element_at(_parts(path_hint), -1) == F.element_at(_parts(rel), -1))
    inside = F.startswith(rel, F.concat(F.rtrim(dir_hint, F.lit("/")), F.lit("/")))
    hint = _parts(F.when(has_path, path_hint).otherwise(dir_hint))
    equal = F.zip_with(_parts(rel), hint, lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal))
    partial = 0.6 * shared / F.greatest(F.size(hint), F.lit(1))
    return (F.when((F.coalesce(rel, F.lit("")) == "") | ~(has_path | has_dir), 0.0)
            .when(has_path & exact, 1.0).when(~has_path & inside, 0.8).otherwise(partial))
