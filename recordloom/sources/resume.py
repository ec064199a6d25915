"""Ingest of file tasks that can break off and go on.

A task (chain) has numbered files. Files are sealed in waves of neighbouring numbers; a wave's blocks and its part of the
ledger, one row for each file with its digest, become visible together by a manifest. A run takes the files that the ledger
lacks, continues each chain's index and running state from its last sealed block, and ends with the rows
that an unbroken run would have made. A report says how far each task is and whether what is sealed is coherent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom import fixed_values as fv
from recordloom.operators import ingest
from recordloom.sources.guarded import Attempt, Commits

WAVE = 4096
LEDGER = "chain_id long, file_index long, relative_path string, digest string, blocks long"
RUNNING = ("chunks_sealed", "approx_tokens_ingested", "items_done")


class TaskIngest(Commits):
    """`files` are frames of chain_id, file_index (dense from 0), relative_path, text."""
    kinds = ("rows", "ledger")

    def __init__(self, spark, path: str, wave: int = WAVE, target: int = fv.CHUNK_TOKENS["target"],
                 least: int = fv.CHUNK_TOKENS["min"], most: int = fv.CHUNK_TOKENS["max"]):
        super().__init__(spark, path)
        self.wave, self.rule, self.most = wave, (target, least, most), most
        self._schema = None

    def ledger(self) -> DataFrame:
        return self._table("ledger", LEDGER, None)

    def rows(self) -> DataFrame | None:
        """All sealed blocks; None before the first wave."""
        folders = [f"{self.path}/rows/{name}" for _, name in self.attempts()]
        return self.spark.read.parquet(*folders) if folders else None

    def state(self) -> DataFrame | None:
        """Last block of each task; the content of blocks is not read."""
        rows = self.rows()
        return None if rows is None else ingest.task_state(rows)

    def pending(self, files: DataFrame) -> DataFrame:
        """Files that are not sealed. A sealed file that has changed since is reported, not sealed twice."""
        return files.join(self.ledger().select("chain_id", "file_index"), ["chain_id", "file_index"], "left_anti")

    def prepare(self, files: DataFrame) -> Attempt | None:
        """Write the next wave of pending files without making it visible; None if nothing is pending."""
        base = self.version()
        todo = self.pending(files)
        first = todo.agg(F.min(F.expr(f"file_index div {self.wave}"))).first()[0]
        if first is None:
            return None
        attempt = Attempt.new(base)
        made = ingest.blocks(todo.where(F.expr(f"file_index div {self.wave}") == first), 0, *self.rule)
        before = self.state()
        if before is not None:
            old = before.select("chain_id", (F.col("idx") + 1).alias("_idx"), *[F.col(c).alias(f"_{c}") for c in RUNNING])
            made = made.join(old, "chain_id", "left")
            for name in ("idx", *RUNNING):
                made = made.withColumn(name, F.col(name) + F.coalesce(f"_{name}", F.lit(0)))
            made = made.drop("_idx", *[f"_{c}" for c in RUNNING])
        made.write.parquet(f"{self.path}/rows/{attempt.name}")
        sealed = self.spark.read.parquet(f"{self.path}/rows/{attempt.name}")
        (sealed.groupBy("chain_id", "file_index").agg(F.first("relative_path").alias("relative_path"), F.first("file_content_hash").alias("digest"), F.count("*").alias("blocks"))
         .write.parquet(f"{self.path}/ledger/{attempt.name}"))
        return attempt

    def run(self, files: DataFrame, waves: int | None = None) -> int:
        """Seal pending files wave by wave, all or `waves` of them; the number sealed. Another runner's wave counts as done."""
        done = 0
        while waves is None or done < waves:
            attempt = self.prepare(files)
            if attempt is None:
                break
            if not self.publish(attempt):
                self.drop(attempt)
            done += 1
        return done

    def violations(self) -> DataFrame:
        """Blocks whose state does not follow from the block before."""
        return ingest.task_violations(self.rows().select("chain_id", "idx", "approx_tokens", *RUNNING), self.most)

    def report(self, files: DataFrame) -> DataFrame:
        """chain_id, files, sealed, changed, next_file, incoherent, status of every task of `files`.

        Status: incoherent (sealed blocks do not follow from each other, or the ledger counts other blocks than there are), changed (a
        sealed file is not what it was), complete, resumable (some are sealed), or new.
        """
        ledger = self.ledger().select("chain_id", "file_index", "digest", "blocks")
        seen = files.select("chain_id", "file_index", F.sha2("text", 256).alias("now")).join(ledger, ["chain_id", "file_index"], "left")
        out = seen.groupBy("chain_id").agg(
            F.count("*").alias("files"), F.count("digest").alias("sealed"), F.count_if(F.col("digest") != F.col("now")).alias("changed"),
            F.min(F.when(F.col("digest").isNull(), F.col("file_index"))).alias("next_file"))
        if (rows := self.rows()) is not None:
            counted = rows.groupBy("chain_id").agg(F.count("*").alias("_n"), F.max("idx").alias("_last"))
            promised = ledger.groupBy("chain_id").agg(F.sum("blocks").alias("_blocks"))
            bad = self.violations().groupBy("chain_id").agg(F.count("*").alias("_bad"))
            out = out.join(counted, "chain_id", "left").join(promised, "chain_id", "left").join(bad, "chain_id", "left")
            odd = (F.coalesce("_n", F.lit(0)) != F.coalesce("_blocks", F.lit(0))) | (F.coalesce("_last", F.lit(-1)) + 1 != F.coalesce("_n", F.lit(0)))
            out = out.withColumn("incoherent", F.coalesce("_bad", F.lit(0)) + odd.cast("long")).drop("_n", "_last", "_blocks", "_bad")
        else:
            out = out.withColumn("incoherent", F.lit(0).cast("long"))
        status = (F.when(F.col("incoherent") > 0, "incoherent").when(F.col("changed") > 0, "changed").when(F.col("next_file").isNull(), "complete")
                  .when(F.col("sealed") > 0, "resumable").otherwise("new"))
        return out.select("chain_id", "files", "sealed", "changed", "next_file", "incoherent", status.alias("status"))
