"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a single blank, and every n-gram of 1 to 4 code
points (n-grams reach over blanks, so word ends count) falls into one of a fixed number of buckets. Each
task counts (language, bucket) over all its teaching rows, the JVM adds the counts up, and the smoothed
log-probabilities, languages by buckets and so of a fixed size, are broadcast. A text is scored as a sparse row of
bucket entries against this matrix, many texts at once in numpy.

Log-probabilities are whole multiples of 2**-20, so sums are exact: equal texts score alike however they are
sliced and batched. Long texts are taken in slices that overlap by an n-gram; no text is shortened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import prepare

BITS = 16
ORDERS = 4
#: Languages a model may tell apart; with 2**16 buckets its counts then fill 0.3 GB. More raise an error.
MOST_LANGUAGES = 256
SMOOTHING = 0.5
SCALE = 1 << 20
#: Matrix entries gathered at once.
CELLS = 1 << 19
UNKNOWN = "und"
FACTOR, SALT = 0x100000001B3, 0x9E3779B97F4A7C15
BLANK = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def cleaned(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with one blank for each stretch without letters and at both ends; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    after = np.concatenate([[False], is_letter[:-1]])
    body = np.where(is_letter, codes, BLANK)[is_letter | after].astype(np.uint32)  # a blank is kept behind a letter only
    return np.concatenate([[BLANK], body, [BLANK] if is_letter[-1] else []]).astype(np.uint32)


def slices(texts: Iterable[str | None], size: int, orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, owner, begins): stretches of about `size` code points with the number of the text of each, and whether
    n-grams begin there (not so in the overlap of the slices of a long text)."""
    held, total = [], 0

    def joined():
        return (np.concatenate([c for _, c, _ in held]), np.concatenate([np.full(len(c), k) for k, c, _ in held]),
                np.concatenate([np.arange(len(c)) < own for _, c, own in held]))
    for k, text in enumerate(texts):
        codes = cleaned(text)
        for at in range(0, len(codes), size):
            part = codes[at:at + size + orders - 1]
            held.append((k, part, min(size, len(codes) - at)))
            total += len(part)
            if total >= size:
                yield joined()
                held, total = [], 0
    if held:
        yield joined()


def buckets(codes: np.ndarray, owner: np.ndarray, begins: np.ndarray, bits: int = BITS, orders: int = ORDERS) -> Iterator[np.ndarray]:
    """For n = 1, 2, ...: the bucket of the n-gram that begins at each code point, 2**bits where none does."""
    none, c = 1 << bits, codes.astype(np.uint64)
    h = c + np.uint64(1)
    for n in range(1, orders + 1):
        if n > 1:
            if len(codes) < n:
                return
            h = h[:-1] * np.uint64(FACTOR) + c[n - 1:]
        out = np.full(len(codes), none, np.int64)
        # the top bits of a product depend on all bits below
        at = ((h ^ np.uint64(n << 56)) * np.uint64(SALT)) >> np.uint64(64 - bits)
        right = begins[:len(h)] & (owner[:len(h)] == owner[n - 1:]) & ((codes != BLANK) if n == 1 else True)
        np.copyto(out[:len(h)], at.astype(np.int64), where=right)
        yield out


def count(docs: DataFrame, bits: int = BITS, orders: int = ORDERS) -> DataFrame:
    """lang, bucket, n over rows of (text, lang); bucket -1 counts the texts with a letter. Rows with a null lang teach nothing."""
    prepare(docs.sparkSession)
    size = 1 << bits

    def rows(batches):
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            kinds = sorted(set(langs))
            number = {v: i for i, v in enumerate(kinds)}
            of = np.array([number[v] for v in langs], np.int64)
            for lang in kinds:
                sums.setdefault(lang, np.zeros(size, np.int64))
            seen = np.zeros(len(langs), bool)
            for codes, owner, begins in slices((t.as_py() for t in batch.column(0)), CELLS, orders):
                seen[owner] = True
                which = of[owner] * (size + 1)
                for found in buckets(codes, owner, begins, bits, orders):
                    n = np.bincount(which + found, minlength=len(kinds) * (size + 1)).reshape(len(kinds), size + 1)
                    for i, lang in enumerate(kinds):
                        sums[lang] += n[i, :size]
            for i, k in enumerate(np.bincount(of[seen], minlength=len(kinds)).tolist()):
                texts[kinds[i]] = texts.get(kinds[i], 0) + k
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            at, n = np.concatenate([at, [-1]]), np.concatenate([n[at], [texts[lang]]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])
    taught = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return taught.mapInArrow(rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, bits: int = BITS, orders: int = ORDERS, smoothing: float = SMOOTHING,
          most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages by code point, start scores, scores[bucket, language]); None if no row has a language and a letter.

    Every teaching row is counted. Only the sums reach the driver: languages x buckets, of a size fixed by
    `most` (more languages raise a ValueError before anything is collected).
    """
    counts = count(docs, bits, orders)
    names = [r[0] for r in docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string")).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} languages: pass a larger `most` or fewer `bits`")
    table = counts.toArrow()
    bucket, n, lang = table["bucket"].to_numpy(), table["n"].to_numpy(), table["lang"].combine_chunks().dictionary_encode()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    kinds = lang.dictionary.to_pylist()
    rows = np.zeros((len(kinds), (1 << bits) + 1), np.int64)
    if kinds:
        rows[lang.indices.to_numpy(zero_copy_only=False), bucket] = n  # bucket -1 is the last place
    order = sorted((i for i in range(len(kinds)) if rows[i, -1]), key=lambda i: kinds[i])
    if not order:
        return None
    rows = rows[order].astype(np.float64)
    texts, grams = rows[:, -1], rows[:, :-1]
    chance = np.log(grams + smoothing) - np.log(grams.sum(axis=1, keepdims=True) + smoothing * (1 << bits))
    scores = np.vstack([np.rint(chance.T * SCALE), np.zeros(len(order))])  # the last row: no n-gram
    return [kinds[i] for i in order], np.rint(np.log(texts / texts.sum()) * SCALE), scores


def score_texts(texts: list[str | None], model, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Exact score of each text and language, and whether the text has a letter."""
    names, start, scores = model
    bits = (len(scores) - 1).bit_length() - 1
    total = np.tile(start, (len(texts), 1))
    lettered = np.zeros(len(texts), bool)
    for codes, owner, begins in slices(texts, max(4096, CELLS // len(names)), orders):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        who = owner[first]
        lettered[who] = True
        for found in buckets(codes, owner, begins, bits, orders):
            total[who] += np.add.reduceat(scores[found], first, axis=0)  # whole numbers under 2**53: exact
    return total, lettered


def predict(docs: DataFrame, model, orders: int = ORDERS) -> DataFrame:
    """row (all input columns), lang_pred, score (posterior probability of it).

    Only `text` is read. Null texts, texts without a letter, and all texts where there is no model get
    `und` with score 0. Ties go to the language that is first by code point; equal texts get equal values.
    """
    spark = prepare(docs.sparkSession)
    row = docs.select(F.struct(*docs.columns).alias("row"))
    if model is None:
        return row.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    box = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def rate(texts):
        import pandas as pd
        names = box.value[0]
        total, lettered = score_texts(texts.tolist(), box.value, orders)
        best = total.argmax(axis=1) if len(total) else np.zeros(0, np.int64)
        chance = 1 / np.exp((total - total.max(axis=1, keepdims=True)) / SCALE).sum(axis=1) if len(total) else np.zeros(0)
        said = [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return pd.DataFrame({"lang_pred": said, "score": np.where(lettered, chance, 0.0)})
    rated = row.withColumn("rated", rate(F.col("row.text").cast("string")))
    return rated.select("row", "rated.lang_pred", "rated.score")


def identify(docs: DataFrame, held_out: Column, bits: int = BITS, orders: int = ORDERS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row, taught by all rows that are not held out.

    A row whose `held_out` is null (a null doc_id) counts as not held out. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = learn(rows.where(~F.col("held_out")), bits, orders)
    rated = predict(rows.select("doc_id", "held_out", "text"), model, orders)
    return rated.select("row.doc_id", "row.held_out", "lang_pred", "score")
