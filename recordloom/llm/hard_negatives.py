"""Hard-negative mining by segment summaries.

Vectors of whole numbers are cut into segments. The index stores the mean and the deviation of each
segment; with m places in a segment, x.y lies within sum(m mean_x mean_y) +- sum(dev_x dev_y), where dev is the
root of the summed squares of what is left of x without its mean. Coarse segments (joined from fine ones, which
needs no vector) bound all pairs of a block first, fine segments bound what remains, and only pairs that
the bounds can't rule out are scored exactly.

Anchors and all rows meet in tiles: a block of anchors and a cell of rows, both of fixed size, so that
nothing grows in a task and nothing passes through the driver. A tile returns its best few rows of each anchor,
and a window ranks them over all tiles. Bounds only save work; results are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.llm.common import prepare
from recordloom.session import stored

FINE, COARSE = 4, 16
TILE, CELL = 2048, 4096
#: Anchors bounded at once in a tile, and pairs scored at once.
STEP, PAIRS = 128, 1 << 16
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative is hard.
LOW, HIGH = 50, 95
#: Of the product of two norms: above the rounding of sums of doubles.
SLACK = 1e-9


def summaries(x: np.ndarray, width: int = FINE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of `width` places; the last one is filled up with zeros."""
    n, size = x.shape
    parts = np.zeros((n, -(-size // width) * width or width))
    parts[:, :size] = x
    parts = parts.reshape(n, -1, width)
    mean = parts.mean(axis=2)
    return mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))


def coarser(mean: np.ndarray, dev: np.ndarray, width: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of segments `times` as wide, from those of `width`."""
    n, size = mean.shape
    pad = -size % times
    m = np.pad(mean, ((0, 0), (0, pad))).reshape(n, -1, times)
    d = np.pad(dev, ((0, 0), (0, pad))).reshape(n, -1, times)
    wide = m.mean(axis=2)
    return wide, np.sqrt((d ** 2).sum(axis=2) + width * ((m - wide[:, :, None]) ** 2).sum(axis=2))


class Block:
    """Some rows of the index as matrices."""

    def __init__(self, table: pa.Table):
        matrix = lambda name: self.rows_of(table[name])
        self.id = table["vec_id"].to_numpy()
        self.row = table["row"].to_numpy()
        self.x = matrix("x").astype(np.int64)
        mean, dev = matrix("mean"), matrix("dev")
        wide, rest = coarser(mean, dev, FINE, COARSE // FINE)
        self.levels = [(wide * COARSE ** 0.5, rest), (mean * FINE ** 0.5, dev)]
        self.norm = np.sqrt((self.levels[1][0] ** 2).sum(axis=1) + (dev ** 2).sum(axis=1))

    @staticmethod
    def rows_of(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _thresholds(low: np.ndarray, high: np.ndarray, who: np.ndarray, n: int, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Of each anchor: the k-th largest lower bound of pairs that surely lie between `least` and `most`, else `least`."""
    sure = np.flatnonzero((low >= least[who]) & (high <= most[who]))
    out = least.astype(np.float64)
    if len(sure):
        order = sure[np.lexsort((-low[sure], who[sure]))]
        first = np.searchsorted(who[order], np.arange(n))
        at = first + k - 1
        there = at < np.searchsorted(who[order], np.arange(n), side="right")
        out[there] = np.maximum(out[there], low[order[at[there]]])
    return out


def _open(low: np.ndarray, high: np.ndarray, who: np.ndarray, n: int, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Which pairs may be among the k best of some range of their anchor."""
    keep = np.zeros(len(who), bool)
    for j in range(least.shape[1]):
        edge = _thresholds(low, high, who, n, least[:, j], most[:, j], k)
        keep |= (high >= edge[who]) & (low <= most[:, j][who])
    return keep


def best(anchors: Block, cell: Block, allowed: Callable[[slice], np.ndarray], least: np.ndarray, most: np.ndarray, k: int):
    """(anchor, range, place in cell, score) of the k best allowed rows of each range least[a, j]..most[a, j].

    Best is the higher score, then the smaller id.
    """
    out = []
    for begin in range(0, len(anchors.id), STEP):
        part = slice(begin, begin + STEP)
        lo, hi = least[part], most[part]
        n = len(lo)
        (s, d), (t, e) = ((m[part], v[part]) for m, v in anchors.levels)
        (sc, dc), (tc, ec) = cell.levels
        middle, spread = s @ sc.T, d @ dc.T + SLACK * np.outer(anchors.norm[part], cell.norm) + SLACK
        who, what = np.nonzero(allowed(part) & (middle + spread >= lo.min(axis=1)[:, None])
                               & (middle - spread <= hi.max(axis=1)[:, None]))
        middle, spread = middle[who, what], spread[who, what]
        keep = _open(middle - spread, middle + spread, who, n, lo, hi, k)
        who, what = who[keep], what[keep]
        low, high = np.zeros(len(who)), np.zeros(len(who))
        for at in range(0, len(who), PAIRS):
            w, c = who[at:at + PAIRS], what[at:at + PAIRS]
            middle = np.einsum("ij,ij->i", t[w], tc[c])
            spread = np.einsum("ij,ij->i", e[w], ec[c]) + SLACK * anchors.norm[part][w] * cell.norm[c] + SLACK
            low[at:at + PAIRS], high[at:at + PAIRS] = middle - spread, middle + spread
        keep = _open(low, high, who, n, lo, hi, k)
        who, what = who[keep], what[keep]
        x = anchors.x[part]
        score = np.concatenate([np.zeros(0, np.int64)] + [np.einsum("ij,ij->i", x[who[at:at + PAIRS]], cell.x[what[at:at + PAIRS]])
                                                          for at in range(0, len(who), PAIRS)])
        order = np.lexsort((cell.id[what], -score, who))
        who, what, score = who[order], what[order], score[order]
        for j in range(lo.shape[1]):
            fit = np.flatnonzero((score >= lo[:, j][who]) & (score <= hi[:, j][who]))
            place = np.arange(len(fit)) - np.searchsorted(who[fit], who[fit])
            fit = fit[place < k]
            out.append((who[fit] + begin, np.full(len(fit), j), what[fit], score[fit]))
    return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def index(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label (string), dim, x, mean, dev of (vec_id, label, x array<long>), stored in the shared folder.

    `row` numbers the rows; rows with a null in any column take no part.
    """
    spark = prepare(vectors.sparkSession)

    def rows(batches):
        for batch in batches:
            column = batch.column(3)
            sizes = np.diff(column.offsets.to_numpy())
            if batch.num_rows and (sizes == sizes[0]).all():
                groups = [(slice(None), Block.rows_of(column))]
            else:
                groups = [(np.array([i]), np.array([column[i].as_py()]).reshape(1, -1)) for i in range(batch.num_rows)]
            mean, dev = [None] * batch.num_rows, [None] * batch.num_rows
            for at, x in groups:
                a, b = summaries(x.astype(np.float64))
                for k, i in enumerate(np.arange(batch.num_rows)[at]):
                    mean[i], dev[i] = a[k], b[k]
            as_list = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean, as_list), pa.array(dev, as_list)],
                                             ["row", "vec_id", "label", "x", "mean", "dev"])
    whole = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("x").cast("array<bigint>").alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull()))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    numbered = whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x")
    made = numbered.mapInArrow(rows, f"row long, vec_id {kind}, label string, x array<long>, mean array<double>, dev array<double>")
    return stored(made.withColumn("dim", F.size("x")))


def _codes(one: pa.ChunkedArray, two: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    number: dict[str, int] = {}
    code = lambda column: np.array([number.setdefault(v, len(number)) for v in column.to_pylist()], np.int64)
    return code(one), code(two)


def _tiles(anchors: DataFrame, rows: DataFrame, tiles: int, cells: int, meet, schema: str) -> DataFrame:
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # the rows hold the same columns
    left = own.withColumn("tile", F.pmod("row", F.lit(tiles)).cast("int")).withColumn("cell", span(cells))
    right = rows.withColumn("cell", F.pmod("row", F.lit(cells)).cast("int")).withColumn("tile", span(tiles))
    key = ["dim", "tile", "cell"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and x (array of whole numbers). An anchor's positives are its best other rows of
    the same label; for each of them the best rows of another label follow whose score lies between `low` and `high` percent of
    the positive's. Ties go to the smaller vec_id. Each row stands for itself, so a repeated row is another row,
    and repeated anchors repeat their results. Only vectors of equal length meet. Rows with a null take no part,
    an empty table gives an empty one, other columns are ignored. Scores are 64-bit and wrap beyond.
    """
    table = index(vectors)
    anchors = table.where(is_anchor)
    sizes = table.agg(F.count("*"), F.count_if(is_anchor)).first()
    cells, tiles = max(1, -(-sizes[0] // CELL)), max(1, -(-sizes[1] // TILE))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32()

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = Block(left), Block(right)
        la, lc = _codes(left["label"], right["label"])
        far = np.full((len(a.id), 1), np.inf)
        same = lambda part: (la[part][:, None] == lc) & (a.row[part][:, None] != c.row)
        who, _, what, score = best(a, c, same, -far, far, positives)
        return pa.table({"row": a.row[who], "positive_id": pa.array(c.id[what], arrow_kind), "other": c.row[what], "positive_score": score})

    def met(fn, schema):
        """Tiles with one side empty have no pairs."""
        def run(left, right):
            return fn(left, right) if left.num_rows and right.num_rows else schema.empty_table()
        return run
    found = _tiles(anchors, table, tiles, cells, met(alike, pa.schema([("row", pa.int64()), ("positive_id", arrow_kind), ("other", pa.int64()), ("positive_score", pa.int64())])),
                   f"row long, positive_id {kind}, other long, positive_score long")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "other"))
    chosen = found.withColumn("place", place).where(F.col("place") <= positives)
    # at most `positives` a row
    chosen = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("chosen"))
    wanted = anchors.join(chosen, "row")

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = Block(left), Block(right)
        la, lc = _codes(left["label"], right["label"])
        listed = left["chosen"].to_pylist()
        least, most = (np.full((len(listed), positives), v) for v in (1 << 62, -1 << 62))  # no positive: an empty range
        ids, scores = np.zeros((len(listed), positives), np.int64), np.zeros((len(listed), positives), np.int64)
        for i, some in enumerate(listed):
            for j, p in enumerate(some):
                ids[i, j], s = p["positive_id"], p["positive_score"]
                scores[i, j], least[i, j], most[i, j] = s, -(-low * s // 100), high * s // 100
        differ = lambda part: la[part][:, None] != lc
        who, j, what, score = best(a, c, differ, least, most, negatives)
        return pa.table({"row": a.row[who], "anchor_id": pa.array(a.id[who], arrow_kind), "place": pa.array(j, pa.int32()), "positive_id": pa.array(ids[who, j], arrow_kind),
                         "positive_score": scores[who, j], "negative_id": pa.array(c.id[what], arrow_kind), "negative_score": score})
    names = pa.schema([("row", pa.int64()), ("anchor_id", arrow_kind), ("place", pa.int32()), ("positive_id", arrow_kind), ("positive_score", pa.int64()), ("negative_id", arrow_kind), ("negative_score", pa.int64())])
    hard = _tiles(wanted, table, tiles, cells, met(unlike, names),
                  f"row long, anchor_id {kind}, place int, positive_id {kind}, positive_score long, negative_id {kind}, negative_score long")
    rank = F.row_number().over(W.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(embeddings: DataFrame, classes: int = 10, moved: int = 7, scale: int = 256) -> DataFrame:
    """vec_id, label, x as the query's contract takes them from (vec_id, embedding, label): rows with a null label or vector
    or a component that is null or not finite are left out, labels of every `moved`-th id go on by one, components become whole."""
    value = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    fit = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return fit.select("vec_id", label.alias("label"), F.transform(value, lambda c: F.floor(scale * c)).alias("x"))
