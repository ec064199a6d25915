"""Chunkers. Packing is greedy, so each document is walked once; documents spread over tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.fixed_values import CHUNK_CHARS, CHUNK_TOKENS

_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE_END = re.compile(r"[.!?]['\")\]]?(?=\s+)")


def _sentences(paragraph: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE_END.finditer(paragraph):
        piece = paragraph[at:m.end()].strip()
        at = m.end()
        if piece:
            yield piece
    if paragraph[at:].strip():
        yield paragraph[at:].strip()


def _units(text: str, target: int, hard: int) -> Iterator[tuple[str, str]]:
    """(glue, piece): paragraphs glue with a blank line, sentences of a long one with a blank.

    An empty glue marks a piece that stands alone and None a forced break.
    """
    for para in _PARAGRAPH.split(text):
        para = para.strip()
        if not para:
            continue
        if len(para) <= target:
            yield "\n\n", para
            continue
        yield None, ""
        for s in _sentences(para):
            if len(s) <= hard:
                yield " ", s
            else:
                for i in range(0, len(s), hard):
                    yield "", s[i:i + hard]
        yield None, ""


def pack(text: str, target: int, hard: int) -> list[str]:
    """Chunks of about `target` characters, broken at paragraphs, then sentences, then anywhere."""
    if not text or not text.strip():
        return [""]
    if len(text) <= target:
        return [text]
    done, open_ = [], ""
    for glue, piece in _units(text, target, hard):
        if glue:
            if len(open_) + len(piece) + len(glue) <= target:
                open_ = f"{open_}{glue}{piece}".strip()
                continue
        if open_.strip():
            done.append(open_.strip())
        open_ = piece if glue else ""
        if glue == "":
            done.append(piece)
    if open_.strip():
        done.append(open_.strip())
    return done or [""]


def chunk_text(df: DataFrame, text: str, target: int = CHUNK_CHARS, hard: int | None = None,
               header: str | None = None) -> DataFrame:
    """One row per chunk: chunk_index (from 0), chunk_count, chunk. A header column is set before each chunk."""
    hard = hard or target

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([[h + p for p in pack(t or "", target - len(h), hard)] for t, h in zip(texts, heads)])

    pieces = split(F.col(text), F.lit("") if header is None else F.coalesce(F.col(header), F.lit("")))
    return (df.withColumn("_pieces", pieces)
            .select(*df.columns, F.size("_pieces").alias("chunk_count"), F.posexplode("_pieces").alias("chunk_index", "chunk")))


_LINE_END = re.compile("\r\n|[\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029]")
#: Chunks in one Arrow batch of `chunk_lines`.
CHUNKS_PER_BATCH = 64


def line_ends(text: str) -> np.ndarray:
    """Offset after each line, its terminator included; empty for an empty text."""
    ends = np.fromiter((m.end() for m in _LINE_END.finditer(text)), np.int64)
    return ends if not text or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def cut_points(ends: np.ndarray, target: int, least: int, most: int) -> np.ndarray:
    """Offsets where line-aware chunks begin, and last the text's end (a token is four characters).

    A line over `most` tokens is a stretch of its own and cut every `4 * most` characters. Between
    such lines a chunk reaches to the last line end that keeps it within `target`, at least one line.
    A last chunk under `least` joins the one before if both together stay within `most`.
    """
    if not len(ends):
        return np.zeros(2, np.int64)
    starts = np.append(0, ends[:-1])
    wide = (ends - starts) // 4 > most
    stretches = np.unique(np.concatenate([starts[wide], ends[wide], [0, ends[-1]]]))
    sliced = np.isin(stretches, starts[wide])
    cuts: list[int] = []
    for at, stop, by_size in zip(stretches[:-1].tolist(), stretches[1:].tolist(), sliced):
        if by_size:
            cuts.extend(range(at, stop, 4 * most))
            continue
        while at < stop:
            cuts.append(at)
            own = np.searchsorted(ends, at, "right")
            fits = np.searchsorted(ends, at + 4 * (target + 1), "left") - 1
            at = min(int(ends[max(own, fits)]), stop)
    cuts.append(int(ends[-1]))
    if len(cuts) > 2 and max(1, (cuts[-1] - cuts[-2]) // 4) < least and (cuts[-1] - cuts[-3]) // 4 <= most:
        del cuts[-2]
    return np.array(cuts, np.int64)


def chunk_lines(df: DataFrame, key: str, text: str, target: int = CHUNK_TOKENS["target"],
                least: int = CHUNK_TOKENS["min"], most: int = CHUNK_TOKENS["max"]) -> DataFrame:
    """Line-aware chunks: key, chunk_index (from 1), chunk_of, line_start, line_end, tokens_upto (of the chunks so far), content.

    Two passes: the cuts come from line offsets alone, then slices leave in batches of
    CHUNKS_PER_BATCH, so beside the text only its offsets and one batch are held. A null or empty
    text gives one empty chunk.
    """
    key_type = df.schema[key].dataType
    schema = f"{key} {key_type.simpleString()}, chunk_index int, chunk_of int, line_start int, line_end int, tokens_upto long, content string"

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                body = t.as_py() or ""
                ends = line_ends(body)
                cuts = cut_points(ends, target, least, most)
                first = np.searchsorted(ends, cuts[:-1], "right") + 1
                last = np.searchsorted(ends, cuts[1:], "left") + 1
                n = len(first)
                upto = np.cumsum(np.maximum(1, np.diff(cuts) // 4))
                for lo in range(0, n, CHUNKS_PER_BATCH):
                    hi = min(lo + CHUNKS_PER_BATCH, n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k.as_py()] * (hi - lo), kind), pa.array(np.arange(lo + 1, hi + 1), pa.int32()),
                        pa.array(np.full(hi - lo, n), pa.int32()), pa.array(first[lo:hi], pa.int32()),
                        pa.array(last[lo:hi], pa.int32()), pa.array(upto[lo:hi], pa.int64()),
                        pa.array([body[i:j] for i, j in zip(cuts[lo:hi], cuts[lo + 1:hi + 1])], pa.string())],
                        names=[key, "chunk_index", "chunk_of", "line_start", "line_end", "tokens_upto", "content"])
    return df.select(key, text).mapInArrow(run, schema)


def chunk_table_function(target: int = CHUNK_CHARS):
    """A table function text -> (chunk_index, chunk) for lateral use in SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, chunk string")
    class Chunks:
        def eval(self, text: str):
            yield from enumerate(pack(text or "", target, target))
    return Chunks
