"""Incremental jobs over micro-batches that reuse the batch operators.

What one micro-batch hands to the next lies in tables under `state_dir` (a folder all
executors share), one version per batch. A batch that is run again after a failure
reads the version before it and overwrites its own output, so results do not double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators import ingest, mining
from recordloom.operators.governance import supersedes_links
from recordloom.operators.log import blob_entries


class Versions:
    """A table kept as one folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def before(self, batch: int) -> DataFrame:
        if batch <= 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={batch - 1}")

    def write(self, batch: int, df: DataFrame) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/v={batch}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v=*")


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def index_stream(stream: DataFrame, embed, out: str, state_dir: str, checkpoint: str) -> StreamingQuery:
    """Embeds records without chunk rows. `embed` maps a text column to a vector, or null on
    failure; failed records wait in the state table and are tried again with the next batch."""
    spark = stream.sparkSession
    waiting = Versions(spark, f"{state_dir}/waiting", stream.schema)
    store = Versions(spark, out, "chain_id long, idx long, vector array<float>")

    def work(batch: DataFrame, n: int) -> None:
        rows = waiting.before(n).unionByName(batch.select(*stream.columns))
        fresh = rows if n == 0 else ingest.missing_chunks(rows, _earlier(store, n))
        done = fresh.withColumn("vector", embed(F.col("content_json")))
        store.write(n, done.where("vector is not null"))
        stored = spark.read.schema(store.schema).parquet(f"{store.path}/v={n}")
        waiting.write(n, fresh.join(stored.select("chain_id", "idx"), ["chain_id", "idx"], "left_anti"))
    return _start(stream, work, checkpoint)


def _earlier(table: Versions, n: int) -> DataFrame:
    return table.spark.read.schema(table.schema).parquet(*[f"{table.path}/v={i}" for i in range(n)])


TOPICS = "chain_id long, signature string, batch long"


def mine_stream(stream: DataFrame, out: str, state_dir: str, checkpoint: str, lookback: int = 500, **rules) -> StreamingQuery:
    """Mines the chains that a micro-batch brings, over their new records and `lookback` earlier ones.

    The loop is closed: topics proposed by earlier batches are state, so a topic that comes up again is a recurrence and
    not a second proposal. Each batch adds its own records and topics under its number and reads those of smaller
    numbers, so a batch that is run again changes nothing, and nothing is rewritten.
    """
    spark = stream.sparkSession
    tail, topics = Versions(spark, f"{state_dir}/tail", stream.schema), Versions(spark, f"{state_dir}/topics", TOPICS)

    def work(batch: DataFrame, n: int) -> None:
        tail.write(n, batch)
        fresh = spark.read.schema(tail.schema).parquet(f"{tail.path}/v={n}")
        rows, known = fresh, spark.createDataFrame([], TOPICS)
        if n > 0:
            chains = fresh.groupBy("chain_id").agg(F.min("idx").alias("_first"))
            old = _earlier(tail, n).join(chains, "chain_id").where(F.col("idx") >= F.col("_first") - lookback)
            rows = old.select(*tail.schema.names).unionByName(fresh)
            known = _earlier(topics, n)
        found = mining.mine(rows, **rules)
        told = known.groupBy("chain_id", "signature").agg(F.min("batch").alias("_since"))
        found = found.join(told, ["chain_id", "signature"], "left").withColumns({
            "decision": F.when(F.col("_since").isNotNull(), "recurrence").otherwise(F.col("decision")), "batch": F.lit(n).cast("long")}).drop("_since")
        found.write.mode("overwrite").parquet(f"{out}/v={n}")
        topics.write(n, spark.read.schema(found.schema).parquet(f"{out}/v={n}").where("decision = 'proposal'").select("chain_id", "signature", "batch").distinct())
    return _start(stream, work, checkpoint)


SIGHTING = "chain_id long, target long, origin boolean, seen long"
_MARKS = "chain_id long, high long"


def _sightings(rows: DataFrame) -> DataFrame:
    """Per proposal: whether it is among the rows, and how often it recurs in them."""
    origin = F.col("rec_type") == "proposal"
    target = F.when(origin, F.col("idx")).otherwise(F.get_json_object("content_json", "$.recurs_proposal_index").cast("long"))
    hits = rows.where(F.col("rec_type").isin("proposal", "proposal_recurrence")).select("chain_id", target.alias("target"), origin.alias("origin"))
    return hits.where("target is not null").groupBy("chain_id", "target").agg(F.max("origin").alias("origin"), F.count_if(~F.col("origin")).alias("seen"))


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def backfill_indexes(log: DataFrame, out: str) -> None:
    """Build the link tables from a log that has none yet. Each chain's last record is its high-water mark; a stream
    that starts afterwards skips what lies at or below it."""
    supersedes_links(log).write.mode("overwrite").parquet(f"{out}/supersedes/v=-1")
    blob_entries(log).write.mode("overwrite").parquet(f"{out}/blobs/v=-1")
    _sightings(log).write.mode("overwrite").parquet(f"{out}/recurrence/v=-1")
    log.groupBy("chain_id").agg(F.max("idx").alias("high")).write.mode("overwrite").parquet(f"{out}/marks")


def side_index_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the derived link tables in step with appends: supersedes, blobs and recurrences. Each batch adds its own part
    only (counts as increments by proposal), and overwrites it if it is run again, so nothing counts twice."""
    def work(batch: DataFrame, n: int) -> None:
        rows, spark = batch, batch.sparkSession
        if _there(spark, f"{out}/marks"):
            marks = spark.read.schema(_MARKS).parquet(f"{out}/marks")
            rows = batch.join(marks, "chain_id", "left").where(F.col("high").isNull() | (F.col("idx") > F.col("high"))).drop("high")
        supersedes_links(rows).write.mode("overwrite").parquet(f"{out}/supersedes/v={n}")
        blob_entries(rows).write.mode("overwrite").parquet(f"{out}/blobs/v={n}")
        _sightings(rows).write.mode("overwrite").parquet(f"{out}/recurrence/v={n}")
    return _start(stream, work, checkpoint)


def recurrence_index(spark: SparkSession, out: str) -> DataFrame:
    """chain_id, idx, sightings of every proposal, from the increments kept on append."""
    parts = spark.read.schema(SIGHTING).parquet(f"{out}/recurrence/v=*")
    return (parts.groupBy("chain_id", "target").agg(F.max("origin").alias("origin"), F.sum("seen").alias("seen")).where("origin")
            .select("chain_id", F.col("target").alias("idx"), (F.col("seen") + 1).alias("sightings")))
