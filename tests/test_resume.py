"""A broken ingest that is resumed equals an unbroken one."""

from conftest import rows_of

from recordloom.operators import ingest
from recordloom.sources.resume import TaskIngest

NAMES = ["chain_id", "idx", "file_index", "chunk_index", "content", "chunks_sealed", "approx_tokens_ingested", "items_done", "relative_path"]


def test_resumed_equals_unbroken(spark, tmp_path):
    rows = [(c, i, f"d{c}/f{i}.txt", "".join(f"line {i} {k} of some text\n" for k in range(3 + 40 * (i % 4)))) for c in (1, 2) for i in range(7 + c)]
    files = spark.createDataFrame(rows, "chain_id long, file_index long, relative_path string, text string")
    rule = {"target": 60, "least": 10, "most": 90}
    job = TaskIngest(spark, str(tmp_path / "job"), wave=3, **rule)
    assert rows_of(job.report(files).select("chain_id", "sealed", "status"), "chain_id") == [{"chain_id": c, "sealed": 0, "status": "new"} for c in (1, 2)]
    assert job.run(files, waves=1) == 1
    lost = job.prepare(files)
    assert lost is not None and job.version() == 1
    again = TaskIngest(spark, str(tmp_path / "job"), wave=3, **rule)
    assert again.run(files) == 2 and again.run(files) == 0
    assert not again.publish(lost)
    whole = ingest.blocks(files, 0, *rule.values())
    assert rows_of(again.rows().select(*NAMES), "chain_id", "idx") == rows_of(whole.select(*NAMES), "chain_id", "idx")
    assert again.violations().count() == 0
    assert {r["status"] for r in rows_of(again.report(files))} == {"complete"}
