"""Quality by ordinal cumulative-link regression on graded ratings.

A grade g of 0..G-1 has P(grade <= g) = sigmoid(b_g - x.w): one weight vector over hashed text
features, shared by all thresholds b_0 < b_1 < ... The weights order documents on one scale, the
thresholds cut it into grades, and both the expected grade and the tail probability of reaching a
grade follow. Fitting uses a bounded sample of rated documents, as a documented parameter; scoring
reads every document whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.llm.common import prepare

BUCKETS = 1 << 20
#: At most so many rated documents are used for fitting, taken in hashed order.
SAMPLE = 8_192
#: A feature needs so large a share of the sample, and three documents, to get a weight.
MIN_SHARE = 0.0025
ROUNDS = 300
RATE = 0.3
SHRINK = 1e-3
MIN_TAIL = 0.5
EDGES = b".,;:!?'\"()[]{}#*$%&|<>-_"
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
MARKS = b"#*$%&|<>!"


def _steps(name: bytes, share: float, cuts: Sequence[float]) -> list[bytes]:
    return [b"\0" + name + b"%d" % i for i, c in enumerate(cuts) if share >= c]


def tokens(text: str | None) -> set[bytes]:
    """Distinct words without case and edge marks, their first five bytes, and steps of shares that words alone do not show:
    capitals, marks, words seen before, neighbours alike, and length. White space is ASCII's."""
    raw = (text or "").encode("utf-8")
    low = raw.lower().split()
    found = set(low)
    n, size = max(1, len(low)), max(1, len(raw))
    letters = max(1, size - len(raw.translate(None, LETTERS)))
    alike = sum(map(bytes.__eq__, low, low[1:]))
    out = {w.strip(EDGES) for w in found}
    out.discard(b"")
    out.update([b"\0stem" + w[:5] for w in out if len(w) > 5])
    out.update(_steps(b"upper", (size - len(raw.translate(None, UPPER))) / letters, (0.1, 0.3, 0.6)))
    out.update(_steps(b"marks", (size - len(raw.translate(None, MARKS))) / n, (0.05, 0.2, 0.5, 1.0)))
    out.update(_steps(b"again", 1 - len(found) / n, (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)))
    out.update(_steps(b"alike", alike / n, (0.1, 0.3, 0.6)))
    out.update(_steps(b"words", len(low), (5, 20, 50, 200, 1000)))
    return out


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(t) % buckets for t in tokens(text)), np.int64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(rows: Sequence[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int = BUCKETS, min_share: float = MIN_SHARE,
        rounds: int = ROUNDS, rate: float = RATE, shrink: float = SHRINK) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch ascent with adaptive steps (repeats exactly).

    Thresholds are a first one plus positive gaps, so they stay ordered. Features of fewer
    than `min_share` of the rows, or three, get no weight.
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    often = np.bincount(flat, minlength=buckets) >= max(3, round(min_share * len(rows)))
    keep = often[flat]
    flat, row = flat[keep], row[keep]
    n = len(rows)
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, n)
    start = np.log((share + 1e-3) / (1 - share + 1e-3))
    w, theta = np.zeros(buckets), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w_sum, t_sum = np.zeros(buckets), np.zeros(len(theta))
    for _ in range(rounds):
        b = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]), [np.inf]])
        eta = np.bincount(row, w[flat], minlength=n)
        up, down = sigmoid(b[grades + 1] - eta), sigmoid(b[grades] - eta)
        p = np.maximum(up - down, 1e-12)
        slope = up + down - 1  # of the log likelihood along eta
        grad = np.bincount(flat, slope[row], minlength=buckets) / n - shrink * w
        by_up, by_down = up * (1 - up) / p, -down * (1 - down) / p
        by_b = (np.bincount(grades, by_up, minlength=n_grades)[:-1] + np.bincount(grades, by_down, minlength=n_grades)[1:]) / n
        by_theta = np.concatenate([[by_b.sum()], [np.exp(theta[k]) * by_b[k:].sum() for k in range(1, len(theta))]])
        w_sum += grad ** 2
        t_sum += by_theta ** 2
        w += rate * grad / (np.sqrt(w_sum) + 1e-6)
        theta += rate * by_theta / (np.sqrt(t_sum) + 1e-6)
    return w, theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])


def grade(quality: Column, toxic: Column) -> Column:
    """Ratings of one scale: 0 poor, 1 good but toxic, 2 good. Null without a quality label."""
    return F.when(quality == 0, F.lit(0)).when((quality == 1) & (toxic == 1), F.lit(1)).when(quality == 1, F.lit(2))


def _bounded(texts: DataFrame, chosen: DataFrame, sample: int) -> DataFrame:
    """doc_id, grade, text: at most `sample` rows of distinct texts of rated documents."""
    # copies fall in the tasks before the shuffle, by a digest in place of the text
    distinct = (texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
                .withColumn("_d", F.sha2(F.coalesce("text", F.lit("")), 256)).groupBy("doc_id", "_d").agg(F.first("text").alias("text")))
    # a document needs no more than `sample` texts; Spark limits a rank before the shuffle
    ranked = distinct.withColumn("_at", F.row_number().over(W.partitionBy("doc_id").orderBy("_d"))).where(F.col("_at") <= sample)
    return (ranked.join(F.broadcast(chosen), "doc_id").orderBy("_at", F.xxhash64("doc_id", F.lit("sample")), "doc_id", "grade", "nth").limit(sample)
            .select("doc_id", "grade", "text"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE,
          buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on `ratings` (doc_id, grade); several ratings of a document count as several rows.

    The sample is the first `sample` ratings in hashed order, so it is the same in every run and no
    source or label is favoured. It is small by its bound, so it is broadcast to the documents and
    fitted in one task; only the weights that are not zero reach the driver. None without ratings.

    Copies of a document's text are one row for each of its ratings, and of the rows that result the
    first `sample` are fitted: by the rank of the text in its rating, then in hashed order, so that a
    document with many texts does not displace others. The bound thus holds for what the task gets.
    """
    prepare(docs.sparkSession)
    chosen = (ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "grade").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # a rating keeps its number among equal ones, so that several of a document stay several rows
    chosen = chosen.groupBy("doc_id", "grade").agg(F.count("*").alias("_n")).select("doc_id", "grade", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("nth"))

    def hashed(batches):
        for batch in batches:
            rows = [features(t, buckets).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "grade", "x"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "grade"], kind="stable")
        w, b = fit([np.asarray(x, np.int64) for x in pdf["x"]], pdf["grade"].to_numpy(np.int64), n_grades, buckets)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at], "w": [w[at]], "b": [b]})

    rated = _bounded(texts, chosen, sample).mapInArrow(hashed, "doc_id long, grade int, x array<int>")
    model = rated.groupBy(F.lit(0).alias("all")).applyInPandas(one, "at array<int>, w array<double>, b array<double>").collect()
    if not model:
        return None
    weights = np.zeros(buckets)
    weights[np.array(model[0]["at"], np.int64)] = model[0]["w"]
    return weights, np.array(model[0]["b"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, tail: int | None = None) -> DataFrame:
    """row (all input columns), expected (mean grade), tail (probability of grade `tail` or better, by
    default the best). A null text is an empty one. Without a model both are null."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    if model is None:
        return row.select("row", F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("tail"))
    w, b = model
    at = len(b) if tail is None else tail
    box = prepare(docs.sparkSession).sparkContext.broadcast((w, b))

    @F.pandas_udf("struct<expected:double,tail:double>")
    def rate(texts: pd.Series) -> pd.DataFrame:
        weights, cuts = box.value
        eta = np.array([weights[features(t, len(weights))].sum() for t in texts], np.float64)
        reach = sigmoid(eta[:, None] - cuts[None, :])  # P(grade > k)
        return pd.DataFrame({"expected": reach.sum(axis=1), "tail": reach[:, at - 1] if at else np.ones(len(eta))})

    rated = row.withColumn("rated", rate(F.col("row.text").cast("string")))
    return rated.select("row", F.col("rated.expected").alias("expected"), F.col("rated.tail").alias("tail"))


def good(min_tail: float = MIN_TAIL) -> Column:
    return F.coalesce("tail", F.lit(1.0)) >= min_tail


def model_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model from a table of doc_id, quality, toxic; rows with a null quality are no ratings."""
    return train(docs, labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")), sample=sample)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_tail: float = MIN_TAIL) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_probability, kept.

    Without any rating all documents are kept with null scores. Copies get equal scores; an empty
    table gives an empty one.
    """
    rated = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_of(docs, labels, sample))
    return rated.select("row.doc_id", F.col("expected").alias("expected_grade"), F.col("tail").alias("tail_probability"), good(min_tail).alias("kept"))


def select_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_tail: float = MIN_TAIL) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return score(docs, model_of(docs, labels, sample)).where(good(min_tail)).select("row.*")
