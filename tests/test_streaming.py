import pandas as pd
from conftest import rows_of
from pyspark.sql import functions as F

from recordloom.operators import integrity, merkle
from recordloom.sources import logs
from recordloom.streaming import batches, keyed, stateful


def feed(spark, df, path, parts, by="idx"):
    """Write a frame as `parts` files in order and read it as a stream, one file per batch."""
    rows = df.orderBy(by).toPandas()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows.iloc[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, path, mode="append"):
    q = (stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "cp"))
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(str(path / "out"))


def sample(make_rows, n=30):
    kinds = ["observation", "response", "reflection"]
    return logs.append(make_rows([(c, i, kinds[i % 3] if i else "genesis", '{"i":%d}' % i, i % 3 == 1) for c in (1, 2) for i in range(n)]))


def test_verify_stream_equals_batch(spark, make_rows, tmp_path):
    log = sample(make_rows).withColumn("content_json", F.when((F.col("chain_id") == 2) & (F.col("idx") == 17), '{"x":1}').otherwise(F.col("content_json")))
    log = log.where(~((F.col("chain_id") == 1) & (F.col("idx") == 15)))
    got = drain(keyed.verify_stream(feed(spark, log, tmp_path / "in", 4)), tmp_path)
    assert rows_of(got, "chain_id", "idx") == rows_of(integrity.failures(log), "chain_id", "idx")


def test_seal_stream_equals_batch(spark, make_rows, tmp_path):
    log = sample(make_rows).where("chain_id = 1 or idx <> 11")
    got = drain(keyed.seal_stream(feed(spark, log, tmp_path / "in", 5), size=8), tmp_path)
    cols = ["chain_id", "first_idx", "last_idx", "leaves", "root_hash", "anchor_status"]
    assert rows_of(got.select(*cols), *cols) == rows_of(merkle.seal_batches(log, None, 8, full_only=True).select(*cols), *cols)


def test_late_and_repeated_records(spark, make_rows, tmp_path):
    """Parts in the wrong order and twice give what the log in order gives; a timer judges a hole that stays."""
    log = logs.append(make_rows([(1, i, "observation", "{}", False, 1_000_000 + 1000 * i) for i in range(20)]))
    rows, schema = log.where("idx <> 13").toPandas(), log.schema

    def arrive(low, high):
        spark.createDataFrame(rows[(rows.idx >= low) & (rows.idx < high)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return drain(keyed.verify_stream(stream, delay="30 seconds"), tmp_path)
    for low, high in ((8, 12), (0, 4), (4, 8), (4, 8), (14, 20)):
        arrive(low, high)
    assert run().count() == 0  # 13 is missing: what is behind it waits
    arrive(12, 13)
    assert run().count() == 0
    later = rows[rows.idx == 0].assign(chain_id=9, ts_ms=rows.ts_ms.max() + 60_000)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = rows_of(run().where("chain_id = 1"), "idx")  # another chain's record moves the watermark on
    assert [(r["idx"], r["reason"]) for r in out] == [(14, "index gap")]


def test_chains_share_buckets_and_pages(spark, make_rows, tmp_path):
    """Many chains in few groups: parts in any order, holes and a chain without an id give what the batch operators give."""
    chains = [*range(40), 1 << 60]
    log = logs.append(make_rows([(c, i, "observation", "{}", False, 1000 * i) for c in chains for i in range(9)])).where("idx <> 4 or chain_id % 3 <> 0")
    cols = ["chain_id", "first_idx", "last_idx", "root_hash"]
    stream = feed(spark, log, tmp_path / "in", 3)
    got = drain(keyed.verify_stream(stream, buckets=2), tmp_path / "a")
    assert rows_of(got, "chain_id", "idx") == rows_of(integrity.failures(log), "chain_id", "idx") and got.count() == 14
    got = drain(keyed.seal_stream(stream, size=8, buckets=2), tmp_path / "b").select(*cols)
    assert rows_of(got, *cols) == rows_of(merkle.seal_batches(log, None, 8, full_only=True).select(*cols), *cols)
    rows = [(c, 0, "proposal", "{}") for c in chains] + [(c, i, "proposal_recurrence", '{"recurs_proposal_index":0}') for c in chains for i in range(1, 2 + c % 4)]
    named = logs.unlinked(make_rows(rows)).withColumn("chain_id", F.when(F.col("chain_id") != 3, F.col("chain_id")))
    query = stateful.escalation_stream(feed(spark, named, tmp_path / "in2", 3), buckets=2).writeStream.format("parquet").option(
        "path", str(tmp_path / "c")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r["chain_id"], r["idx"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()]
    assert sorted(got, key=str) == sorted([(None if c == 3 else c, 0) for c in chains if c % 4 > 0], key=str)
    # state is kept by page and not by chain or proposal
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * keyed.PAGES


def test_spine_roots_equal_pairing_layer_by_layer():
    import hashlib
    for n in range(1, 70):
        leaves = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
        spine = {}
        for leaf in leaves:
            keyed.climb(spine, 0, leaf)
        while len(leaves) > 1:
            leaves = [hashlib.sha256(leaves[i] + leaves[min(i + 1, len(leaves) - 1)]).digest() for i in range(0, len(leaves), 2)]
        assert keyed.spine_root(spine) == leaves[0] and len(spine) <= 7, n


def test_index_stream_retries_failures(spark, make_rows, tmp_path):
    log = sample(make_rows, 12).select("chain_id", "idx", "content_json")
    stream = feed(spark, log, tmp_path / "in", 3)
    flag = tmp_path / "down"
    flag.write_text("x")

    def embed(text):
        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            import os
            down = os.path.exists(str(flag))
            if down and s.str.contains('"i":11').any():
                os.remove(str(flag))
            return s.map(lambda t: None if down and '"i":2' in t else [float(len(t))])
        return run(text)
    batches.index_stream(stream, embed, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "v=*"))
    waiting = spark.read.parquet(str(tmp_path / "state" / "waiting" / "v=2"))
    assert got.count() + waiting.count() == 24 and got.select("chain_id", "idx").distinct().count() == got.count()


def test_mine_and_side_index_streams(spark, make_rows, tmp_path):
    import json
    rows = [(1, i, "revision", json.dumps({"text": "scheduler timezone offset wrong", "revises_index": 0})) for i in range(6)]
    log = logs.unlinked(make_rows(rows))
    stream = feed(spark, log, tmp_path / "in", 2)
    batches.mine_stream(stream, str(tmp_path / "m"), str(tmp_path / "s"), str(tmp_path / "c1")).awaitTermination()
    assert [r["hits"] for r in rows_of(spark.read.parquet(str(tmp_path / "m" / "v=*")), "hits")] == [3, 6]
    batches.side_index_stream(stream, str(tmp_path / "x"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "x" / "supersedes" / "v=*")).count() == 6


def test_cadence_and_frames(spark, make_rows, tmp_path):
    log = sample(make_rows, 31).select("chain_id", "idx", "rec_type", "content_json")
    stream = feed(spark, log, tmp_path / "in", 4)
    fired = drain(stateful.cadence_stream(stream, 4, mark_type="genesis"), tmp_path / "a")
    assert [(r["chain_id"], r["idx"]) for r in rows_of(fired, "chain_id", "idx")] == [(c, i) for c in (1, 2) for i in (10, 22)]
    frames = rows_of(drain(stateful.frame_stream(stream, "chain_id", "idx", "content_json", 3), tmp_path / "b"), "chain_id", "idx")
    assert len(frames) == 62 and all(len(r["prior"]) == min(3, r["idx"]) for r in frames)
    assert frames[20]["prior"] == ['{"i":%d}' % i for i in (17, 18, 19)]


def test_escalates_once(spark, make_rows, tmp_path):
    rows = [(1, 0, "proposal", "{}")] + [(1, i, "proposal_recurrence", '{"recurs_proposal_index":%d}' % (0 if i % 2 else 99)) for i in range(1, 12)]
    stream = feed(spark, logs.unlinked(make_rows(rows)), tmp_path / "in", 4)
    got = rows_of(drain(stateful.escalation_stream(stream), tmp_path))
    assert [(r["idx"], r["sightings"] >= 3) for r in got] == [(0, True)]


def test_windows_and_dedup(spark, tmp_path):
    ev = spark.createDataFrame([(i, "a" if i % 2 else "b", i // 2) for i in range(40)], "m int, kind string, op long").select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 600).alias("ts"), "kind", "op")
    stream = feed(spark, ev, tmp_path / "in", 4, by="ts")
    live = drain(stateful.windowed_counts(stream, "ts", "kind"), tmp_path / "a")
    whole = stateful.windowed_counts(ev, "ts", "kind")
    closed = live.agg(F.max("end")).first()[0]
    assert rows_of(live, "start", "kind") == rows_of(whole.where(F.col("end") <= F.lit(closed)), "start", "kind")
    assert stateful.windowed_counts(ev, "ts", "kind", "sliding", "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 80
    assert stateful.windowed_counts(ev, "ts", "kind", "session", "15 minutes").count() == 40
    assert drain(stateful.dedup_stream(stream, "op", "ts"), tmp_path / "b").count() == 20
