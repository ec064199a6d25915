"""A log table whose appends are guarded: compare and set on the heads of the chains.

A batch is prepared against one version of the table: its rows are judged, linked onto the heads of that version and written
to a folder of their own. It becomes part of the log only by the manifest of the next version, a small
file that can be created once. Whoever creates it first wins; the other's folder is dropped and its batch prepared again on
the new heads, so both end up on one valid chain. Nothing is visible before its manifest, and a job that
dies half way leaves only a folder that no manifest names.

Rows that may not be appended are kept with the reason: a revision of a record that is not there or lies in a
protected zone, or, if the writer insists on the head it saw, a chain that has moved on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.operators.blocks import SPAN, positions
from recordloom.operators.meta import resolve_meta, revision_verdicts
from recordloom.sources import logs

REJECT_SCHEMA = "chain_id long, seq long, rec_type string, content_json string, writer string, target long, reason string"
HEAD_SCHEMA = "chain_id long, idx long, record_hash string"
#: Other writers may win this often before an append gives up.
TRIES = 16


@dataclass(frozen=True)
class Attempt:
    """A prepared batch: the version it stands on, and its folder."""
    base: int
    name: str

    @classmethod
    def new(cls, base: int) -> Attempt:
        return cls(base, uuid.uuid4().hex)


class Commits:
    """Folders of rows that count from the moment a manifest names them. `path` is a folder that all executors share, in a file
    system that creates a file at most once."""

    #: Tables that an attempt writes, each into a folder of the attempt's name.
    kinds: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = f"{self.path}/manifest"

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def attempts(self, version: int | None = None) -> list[tuple[int, str]]:
        """(version, folder) of every commit, one name each; rows are never listed here."""
        upto = self.version() if version is None else version
        files = [f"{self._manifests}/{v}" for v in range(1, upto + 1)]
        lines = [r["value"] for r in self.spark.read.text(files).collect()] if files else []
        return sorted((int(v), name) for v, name in (line.split("-", 1) for line in lines))

    def version(self) -> int:
        path, files = self._file(self._manifests)
        return max((int(s.getPath().getName()) for s in files.listStatus(path) if s.getPath().getName().isdigit()), default=0) if files.exists(path) else 0

    def _table(self, kind: str, schema, version: int | None) -> DataFrame:
        folders = [f"{self.path}/{kind}/{name}" for _, name in self.attempts(version)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def publish(self, attempt: Attempt) -> bool:
        """Make a prepared batch the next version; false if that version exists already."""
        path, files = self._file(f"{self._manifests}/{attempt.base + 1}")
        try:
            out = files.create(path, False)
        except Exception as e:  # the JVM's own error: the file exists
            if "FileAlreadyExists" in str(e) or files.exists(path):
                return False
            raise
        out.write(f"{attempt.base + 1}-{attempt.name}\n".encode())
        out.close()
        return True

    def drop(self, attempt: Attempt) -> None:
        for kind in self.kinds:
            path, files = self._file(f"{self.path}/{kind}/{attempt.name}")
            files.delete(path, True)


class GuardedLog(Commits):
    """The log table: rows of records, heads of the chains that each commit touched, and rejects."""
    kinds = ("judged", "rejects", "data", "heads")

    def read(self, version: int | None = None) -> DataFrame:
        return self._table("data", logs.LOG_SCHEMA, version)

    def rejects(self, version: int | None = None) -> DataFrame:
        return self._table("rejects", REJECT_SCHEMA, version)

    def heads(self, version: int | None = None) -> DataFrame:
        """Each commit keeps the heads of the chains it touched, so that the log itself is not read for them."""
        return (self._table("heads", HEAD_SCHEMA, version).groupBy("chain_id")
                .agg(F.max_by(F.struct("idx", "record_hash"), "idx").alias("h")).select("chain_id", "h.*"))

    # -- appending --------------------------------------------------------------------------

    def judge(self, rows: DataFrame, version: int, insist: bool = False) -> DataFrame:
        """Adds `reason`: why a row may not be appended, else null.

        `rows` are those of `logs.append` with `target` (index of the record that a revision corrects, else
        null) and, for a writer that insists on the head it saw, `expects` (its index, -1 for an empty chain).
        """
        asked = rows.where("target is not null").select("chain_id", F.col("target").alias("idx")).distinct()
        # chains of the asked records are what the zones need; contents of others are not read further
        there = revision_verdicts(resolve_meta(self.read(version).join(asked, ["chain_id", "idx"], "left_semi"))).select(
            "chain_id", F.col("idx").alias("target"), "allowed", F.col("reason").alias("_why"))
        out = rows.join(there, ["chain_id", "target"], "left")
        reason: Column = F.when(F.col("target").isNotNull() & F.col("allowed").isNull(), "no such record").when(
            F.col("target").isNotNull() & ~F.col("allowed"), F.col("_why"))
        if insist:
            now = self.heads(version).select("chain_id", F.col("idx").alias("_now"))
            out = out.join(now, "chain_id", "left")
            reason = F.when(F.coalesce("_now", F.lit(-1)) != F.col("expects"), "chain has moved on").otherwise(reason)
        return out.withColumn("reason", reason).select(*rows.columns, "reason")

    def prepare(self, rows: DataFrame, insist: bool = False) -> Attempt:
        """Judge, link and write a batch on the newest version; it is not part of the log yet."""
        attempt = Attempt.new(self.version())
        base, name = attempt.base, attempt.name
        judged = self.judge(rows, base, insist)
        judged.write.parquet(f"{self.path}/judged/{name}")  # judged once, however often it is read below
        judged = self.spark.read.schema(judged.schema).parquet(f"{self.path}/judged/{name}")
        judged.where("reason is not null").select(*[c.split()[0] for c in REJECT_SCHEMA.split(", ")]).write.parquet(f"{self.path}/rejects/{name}")
        # places close up where rows were rejected
        kept = positions(judged.where("reason is null").withColumnRenamed("seq", "_seq"), ["chain_id"], F.expr(f"_seq div {SPAN}"), ["_seq"], "seq").drop("_seq")
        logs.append(kept, self.heads(base)).write.parquet(f"{self.path}/data/{name}")
        linked = self.spark.read.schema(logs.LOG_SCHEMA).parquet(f"{self.path}/data/{name}")
        linked.groupBy("chain_id").agg(F.max_by(F.struct("idx", "record_hash"), "idx").alias("h")).select("chain_id", "h.*").write.parquet(f"{self.path}/heads/{name}")
        return attempt

    def append(self, rows: DataFrame, insist: bool = False, tries: int = TRIES) -> int:
        """Append a batch; after a lost race it is judged and linked anew on the winner's heads. The new version."""
        for _ in range(tries):
            attempt = self.prepare(rows, insist)
            if self.publish(attempt):
                return attempt.base + 1
            self.drop(attempt)
        raise RuntimeError(f"other writers were faster {tries} times")
