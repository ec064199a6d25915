"""Line-aware chunks of text files that are read in byte ranges.

No file is ever one cell: Spark's text reader splits a large file into byte ranges that begin at lines,
and rows are lines. The chunk rule is greedy along a file, so a range alone cannot tell where its chunks begin;
what it needs from the text before is one number, the characters of the chunk that is open at its start. Hence
three steps:

1. Each range is read once and gives a small map from that number to the number at its end (with the
   chunks begun between). The map is a short list, since greedy cuts from different starts soon meet:
   only the lines within one chunk of the range's start can be its first cut.
2. The maps of a file are folded in order: a stream of one small row for each range, with one carried state.
3. Each range is read again with its state and cut. Chunks inside a range leave at once; only the pieces of
   chunks that cross an edge, at most two for each range, are put together by a shuffle.

Cuts equal those of `functions.chunking.chunk_lines` on the whole text.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import text as tx
from recordloom.functions.chunking import line_ends
from recordloom.session import shared_dir
from recordloom.sources.files import _quote

RANGE_BYTES = 64 << 20
#: Tasks for each core, at most; a task reads several ranges, one after the other.
TASKS_PER_CORE = 8
#: States of up to so many ranges (about 100 bytes each) are broadcast; more are joined and the lines sorted.
BROADCAST_RANGES = 100_000
LINES_PER_BATCH = 8192
_STATE = "file string, block long, chunks long, open long, lines long, final boolean, chop boolean, merged boolean"


class Rule:
    """The greedy rule as a state machine: `chunks` begun so far, `open` characters of the last one (0: closed),
    characters and lines passed, and where the last two chunks began."""

    def __init__(self, target: int, least: int, most: int):
        self.limit, self.least, self.most, self.slice = 4 * (target + 1), least, most, 4 * most

    def wide(self, length):
        return length // 4 > self.most

    def begin(self) -> dict:
        return {"chunks": 0, "open": 0, "at": 0, "lines": 0, "bytes": 0, "last": -1, "prior": -1}

    def line(self, s: dict, length: int) -> None:
        if self.wide(length):
            for k in range(0, length, self.slice):
                s["prior"], s["last"] = s["last"], s["at"] + k
                s["chunks"] += 1
            s["open"] = 0
        elif s["open"] and s["open"] + length < self.limit:
            s["open"] += length
        else:
            s["prior"], s["last"] = s["last"], s["at"]
            s["chunks"] += 1
            s["open"] = length
        s["at"] += length
        s["lines"] += 1

    def summary(self, lengths: np.ndarray) -> dict:
        """What a stretch of lines does, for every first cut it may have. Places count from its start."""
        ends = np.cumsum(lengths)
        starts, n = ends - lengths, len(lengths)
        wide = np.append(np.flatnonzero(self.wide(lengths)), n)
        after: dict[int, tuple[int, int, int, int]] = {}  # line -> chunks, open, last, prior

        def step(i: int) -> tuple[int, int, int, int]:
            """From a chunk that begins at line i: the next one's line, chunks begun, and the last two of their places."""
            if self.wide(int(lengths[i])):
                k = -(-int(lengths[i]) // self.slice)
                last = int(starts[i]) + (k - 1) * self.slice
                return i + 1, k, last, last - self.slice if k > 1 else -1
            fits = np.searchsorted(ends, starts[i] + self.limit, "left")
            return max(i + 1, min(int(fits), int(wide[np.searchsorted(wide, i)]))), 1, int(starts[i]), -1
        firsts = 0 if not n else min(int(np.searchsorted(ends, self.limit - 1, "left")), int(wide[0]), n - 1)
        for first in range(firsts, -1, -1) if n else ():
            path, i = [], first
            while i < n and i not in after:
                path.append((i, *step(i)))
                i = path[-1][1]
            for i, following, k, last, prior in reversed(path):
                if following < n:
                    more, left, l2, p2 = after[following]
                    after[i] = (k + more, left, l2, p2 if p2 >= 0 else last)
                else:
                    after[i] = (k, 0 if self.wide(int(lengths[i])) else int(ends[-1] - starts[i]), last, prior)
        rows = [after[i] for i in range(firsts + 1)] if n else []
        return {"lines": n, "chars": int(ends[-1]) if n else 0, "ends": ends[:firsts + 1].tolist(), "first_wide": int(wide[0]),
                **{name: [r[k] for r in rows] for k, name in enumerate(("chunks", "open", "last", "prior"))}}

    def apply(self, s: dict, m: dict) -> None:
        """Pass a stretch by its summary."""
        if not m["lines"]:
            return
        first = min(int(np.searchsorted(m["ends"], self.limit - s["open"], "left")), m["first_wide"]) if s["open"] else 0
        if first >= m["lines"]:  # all lines fit into the open chunk
            s["open"] += m["chars"]
        else:
            base = s["at"]
            s["prior"], s["last"] = (base + m["prior"][first] if m["prior"][first] >= 0 else s["last"]), base + m["last"][first]
            s["chunks"] += m["chunks"][first]
            s["open"] = m["open"][first]
        s["at"] += m["chars"]
        s["lines"] += m["lines"]

    def merges(self, s: dict) -> bool:
        """Whether a finished file's last chunk joins the one before."""
        return s["chunks"] > 1 and max(1, (s["at"] - s["last"]) // 4) < self.least and (s["at"] - s["prior"]) // 4 <= self.most


def _session(spark: SparkSession, range_bytes: int) -> SparkSession:
    """A session of its own, so that both readings split alike and no setting of other work changes."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    if own.conf.get("spark.checkpoint.dir", None) is None:
        own.conf.set("spark.checkpoint.dir", shared_dir(spark))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    own.conf.set("spark.sql.files.minPartitionNum", "1")  # else splits follow the executors at hand
    # splits stay as they are, but small ones share tasks: a task for each would cost more than its lines
    own.conf.set("spark.sql.files.maxPartitionNum", str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(LINES_PER_BATCH))
    return own


def _lines(own: SparkSession, root: str, exts: Sequence[str] | None, skip: Sequence[str]) -> DataFrame:
    """value, file (path below the root), block (its range's first byte), size (of the file), n (order of lines)."""
    raw = F.col("value").cast("binary")
    rows = (own.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root)
            .select("value", F.regexp_replace("_metadata.file_path", "^.*?" + _quote(root.rstrip("/").split(":", 1)[-1].lstrip("/")) + "/", "").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")))
    rows = rows.where(~F.arrays_overlap(F.split("file", "/"), tx.literal_array(list(skip))))
    rows = rows if exts is None else rows.where(tx.extension(F.col("file")).isin(list(exts)))
    # a line that is not UTF-8 is read as Latin-1
    return rows.select(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(raw, "ISO-8859-1")).alias("value"),
                       F.octet_length(raw).cast("long").alias("octets"), "file", "block", "size", F.monotonically_increasing_id().alias("n"))


def _stretches(batch: pa.RecordBatch):
    """(file, block, from, to) of neighbouring rows of one range."""
    if not batch.num_rows:
        return
    file = batch.column(batch.schema.get_field_index("file")).dictionary_encode()
    block = batch.column(batch.schema.get_field_index("block")).to_numpy()
    code = file.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield file.dictionary[int(code[a])].as_py(), int(block[a]), a, b


def _text(batch: pa.RecordBatch, a: int, b: int) -> str:
    return "\n".join(batch.column(batch.schema.get_field_index("value"))[a:b].to_pylist()) + "\n"


def _summaries(lines: DataFrame, rule: Rule) -> DataFrame:
    """One row for each range: its map without its last line, and that line's length (it may lack its terminator)."""
    def rows(batches):
        held: dict = {}

        def made():
            lengths = np.concatenate(held["lengths"])
            m = rule.summary(lengths[:-1])
            row = {"file": held["file"], "block": held["block"], "size": held["size"], "octets": held["octets"], "last_length": int(lengths[-1]),
                   **{k if k in ("lines", "chars", "first_wide") else f"m_{k}": v for k, v in m.items()}}
            return pa.RecordBatch.from_pylist([row], schema=schema)
        for batch in batches:
            octets, size = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("octets", "size"))
            for file, block, a, b in _stretches(batch):
                if held and (held["file"], held["block"]) != (file, block):
                    yield made()
                    held = {}
                held = held or {"file": file, "block": block, "size": int(size[a]), "octets": 0, "lengths": []}
                ends = line_ends(_text(batch, a, b))
                held["lengths"].append(np.diff(ends, prepend=0))
                held["octets"] += int(octets[a:b].sum()) + b - a
        if held:
            yield made()
    number, many = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("file", pa.string()), *((c, number) for c in ("block", "size", "octets", "last_length", "lines", "chars", "first_wide")),
                        *((f"m_{c}", many) for c in ("ends", "chunks", "open", "last", "prior"))])
    spec = "file string, " + ", ".join(f"{c} long" for c in schema.names[1:8]) + ", " + ", ".join(f"{c} array<long>" for c in schema.names[8:])
    return lines.drop("n").mapInArrow(rows, spec)


def _fold(summaries: DataFrame, rule: Rule) -> DataFrame:
    """The state before each range, and under block -1 the state at the end of each file."""
    def rows(batches):
        s, file, size, kept, before = rule.begin(), None, 0, None, None

        def row(block, s, **flags):
            return {"file": file, "block": block, "chunks": s["chunks"], "open": s["open"], "lines": s["lines"],
                    **{k: flags.get(k, False) for k in ("final", "chop", "merged")}}

        def finish():
            """The file's last range: only now is it known whether the last line has its terminator."""
            chop = s["bytes"] == size + 1
            rule.line(s, kept - chop)
            merged = rule.merges(s)
            return [row(*before, final=True, chop=chop), row(-1, {**s, "chunks": s["chunks"] - merged}, merged=merged)]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if file is not None and r["file"] != file:
                    out += finish()
                    s, before = rule.begin(), None
                elif before is not None:
                    rule.line(s, kept)
                    out.append(row(*before))
                file, size, kept = r["file"], r["size"], r["last_length"]
                before = (r["block"], dict(s))
                s["bytes"] += r["octets"]
                rule.apply(s, {"lines": r["lines"], "chars": r["chars"], "first_wide": r["first_wide"], **{k[2:]: v for k, v in r.items() if k.startswith("m_")}})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file is not None:
            yield pa.RecordBatch.from_pylist(finish(), schema=schema)

    schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("block", "chunks", "open", "lines")), *((c, pa.bool_()) for c in ("final", "chop", "merged"))])
    return summaries.repartition("file").sortWithinPartitions("file", "block").mapInArrow(rows, _STATE)


def _cut(lines: DataFrame, rule: Rule) -> DataFrame:
    """Chunks and pieces of chunks of every range, from lines that carry their range's state."""
    schema = pa.schema([("file", pa.string()), ("chunk_index", pa.int64()), ("chunk_of", pa.int64()), ("line_start", pa.int64()), ("line_end", pa.int64()),
                        ("whole", pa.bool_()), ("block", pa.int64()), ("nth", pa.int64()), ("content", pa.string())])

    class Range:
        def __init__(self, file, block, row):
            self.file, self.block, self.row = file, block, row
            self.chunks, self.open, self.at_line = row["chunks"], row["open"], row["lines"]
            self.parts, self.first, self.inside, self.nth, self.out = [], self.at_line + 1, False, 0, []

        def close(self, whole):
            if self.parts:
                last = self.row["total"]
                self.out.append({"file": self.file, "chunk_index": min(self.chunks, last), "chunk_of": last, "line_start": self.first, "line_end": self.at_line,
                                 "whole": whole and self.inside and self.chunks < last, "block": self.block, "nth": self.nth, "content": "".join(self.parts)})
                self.nth += 1
            self.parts = []

        def begin(self):
            self.chunks, self.first, self.inside = self.chunks + 1, self.at_line + 1, True

        def line(self, text):
            if rule.wide(len(text)):
                self.close(True)
                for k in range(0, len(text), rule.slice):
                    self.begin()
                    self.at_line += 1
                    self.parts = [text[k:k + rule.slice]]
                    self.close(True)
                    self.at_line -= 1
                self.open = 0
            elif self.open and self.open + len(text) < rule.limit:
                self.parts.append(text)
                self.open += len(text)
            else:
                self.close(True)
                self.begin()
                self.parts, self.open = [text], len(text)
            self.at_line += 1

    def rows(batches):
        now, spare = None, None

        def end():
            if spare is not None:
                now.line(spare[:-1] if now.row["final"] and now.row["chop"] else spare)
            now.close(False)
            return now.out
        for batch in batches:
            out = []
            for file, block, a, b in _stretches(batch):
                if now is None or (now.file, now.block) != (file, block):
                    if now is not None:
                        out += end()
                    row = {c: batch.column(batch.schema.get_field_index(c))[a].as_py() for c in ("chunks", "open", "lines", "final", "chop", "total")}
                    if row["total"] is None:
                        raise RuntimeError(f"{file}: the file or its split changed between the two readings")
                    now, spare = Range(file, block, row), None
                text = _text(batch, a, b)
                at = 0
                for e in line_ends(text).tolist():
                    if spare is not None:
                        now.line(spare)
                    spare, at = text[at:e], e
                out += now.out
                now.out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist(end(), schema=schema)
    return lines.mapInArrow(rows, "file string, chunk_index long, chunk_of long, line_start long, line_end long, whole boolean, block long, nth long, content string")


def _written(reader: SparkSession, df: DataFrame) -> DataFrame:
    """A durable table made by one session and read by another (small ranges are for the text files alone)."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return reader.read.schema(df.schema).parquet(path)


def chunk_files(spark: SparkSession, root: str, exts: Sequence[str] | None = None, skip: Sequence[str] = fv.SKIP_DIRS,
                target: int = fv.CHUNK_TOKENS["target"], least: int = fv.CHUNK_TOKENS["min"], most: int = fv.CHUNK_TOKENS["max"],
                range_bytes: int = RANGE_BYTES, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """file (path below `root`), chunk_index (from 1), chunk_of, line_start, line_end, content of every text file.

    A task reads ranges of `range_bytes` of a file, twice, and holds one open chunk and the line lengths of one range. An empty
    file has no line and gives no chunk, a last line need not have a terminator, and a file that changes
    between the readings raises an error. A single line must fit into a row (2 GB).
    """
    rule, own = Rule(target, least, most), _session(spark, range_bytes)
    lines = _lines(own, root, exts, skip)
    states = _written(spark, _fold(_written(spark, _summaries(lines, rule)), rule))
    totals = states.where("block = -1").select("file", F.col("chunks").alias("total"))
    ranges = _written(own, states.where("block >= 0").drop("merged").join(totals, "file"))
    text = lines.select("value", "file", "block", "n")
    if ranges.count() <= broadcast_ranges:
        ready = text.join(F.broadcast(ranges), ["file", "block"], "left")
    else:
        ready = text.join(ranges.hint("merge"), ["file", "block"], "left").sortWithinPartitions("file", "block", "n")
    pieces = _written(spark, _cut(ready.drop("n"), rule))
    names = ["file", "chunk_index", "chunk_of", "line_start", "line_end", "content"]
    # a chunk's pieces hold together no more characters than a chunk
    edges = (pieces.where(~F.col("whole")).groupBy("file", "chunk_index", "chunk_of")
             .agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
                  F.array_sort(F.collect_list(F.struct("block", "nth", "content"))).alias("_p"))
             .select(*names[:-1], F.array_join(F.transform("_p", lambda p: p["content"]), "").alias("content")))
    return pieces.where("whole").select(*names).unionByName(edges)
