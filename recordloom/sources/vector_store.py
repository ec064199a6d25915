"""A chunk store that knows which vector space its vectors are of.

Every commit names the identity of the embedder that made it. A reader or writer says the identity it works with; another
one is refused, or the store is built anew. Commits only add rows, and a rebuild is a commit that starts a new snapshot, so
readers of an older version go on undisturbed until old snapshots are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.sources.guarded import Attempt, Commits

CHUNKS = "chain_id long, idx long, vector array<float>"
FACTS = "identity string, fresh boolean"


class IdentityMismatch(ValueError):
    """The store's vectors are of another space."""


class VectorStore(Commits):
    kinds = ("chunks", "facts")

    def history(self, version: int | None = None) -> list[tuple[int, str, str, bool]]:
        """(version, folder, identity, begins a snapshot) of every commit."""
        names = self.attempts(version)
        if not names:
            return []
        facts = {r["_name"]: r for r in self.spark.read.schema(FACTS).parquet(*[f"{self.path}/facts/{n}" for _, n in names]).select(
            "*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("_name")).collect()}  # one row a commit
        return [(v, n, facts[n]["identity"], facts[n]["fresh"]) for v, n in names]

    def _snapshot(self, version: int | None) -> list[tuple[int, str, str, bool]]:
        rows = self.history(version)
        begins = max((i for i, r in enumerate(rows) if r[3]), default=0)
        return rows[begins:]

    def identity(self, version: int | None = None) -> str | None:
        rows = self._snapshot(version)
        return rows[-1][2] if rows else None

    def open(self, identity: str, version: int | None = None) -> DataFrame:
        """The chunks of a version's snapshot; of a record indexed again the newest commit counts. Refuses another identity."""
        rows = self._snapshot(version)
        if rows and rows[-1][2] != identity:
            raise IdentityMismatch(f"the store holds {rows[-1][2]}, not {identity}")
        if not rows:
            return self.spark.createDataFrame([], CHUNKS)
        parts = [self.spark.read.schema(CHUNKS).parquet(f"{self.path}/chunks/{n}").withColumn("_v", F.lit(v)) for v, n, *_ in rows]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        if len(parts) == 1:
            return whole.drop("_v")
        newest = whole.groupBy("chain_id", "idx").agg(F.max("_v").alias("_v"))
        return whole.join(newest, ["chain_id", "idx", "_v"], "left_semi").drop("_v")

    def _commit(self, rows: DataFrame, identity: str, fresh: bool) -> int:
        attempt = Attempt.new(self.version())
        rows.select("chain_id", "idx", "vector").write.parquet(f"{self.path}/chunks/{attempt.name}")
        self.spark.createDataFrame([(identity, fresh)], FACTS).coalesce(1).write.parquet(f"{self.path}/facts/{attempt.name}")
        if not self.publish(attempt):
            self.drop(attempt)
            raise RuntimeError("another writer was faster; index again")
        return attempt.base + 1

    def index(self, log: DataFrame, text: Column, embed: Callable[[Column], Column], identity: str, rebuild: bool = False) -> int:
        """Embed the records that the store lacks, or all of them into a new snapshot if the identity differs and `rebuild` allows it."""
        held = self.identity()
        fresh = held != identity
        if held is not None and fresh and not rebuild:
            raise IdentityMismatch(f"the store holds {held}, not {identity}; rebuild it or open it as what it is")
        todo = log if fresh else log.join(self.open(identity).select("chain_id", "idx").distinct(), ["chain_id", "idx"], "left_anti")
        return self._commit(todo.withColumn("vector", embed(text)), identity, fresh)

    def prune(self) -> int:
        """Remove the folders of snapshots before the newest; the number removed. Readers of older versions end here."""
        rows = self.history()
        begins = max((i for i, r in enumerate(rows) if r[3]), default=0)
        gone = 0
        for _, name, *_ in rows[:begins]:
            path, files = self._file(f"{self.path}/chunks/{name}")
            gone += bool(files.delete(path, True))
        return gone
