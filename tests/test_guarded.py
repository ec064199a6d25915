"""Two writers on one guarded log."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from recordloom.operators import integrity
from recordloom.sources import guarded


def batch(make_rows, items, target=None, expects=-1):
    rows = make_rows([(c, s, t, j) for c, s, t, j, *_ in items])
    targets = {(c, s): x[0] for c, s, _, _, *x in items if x}
    key = F.concat_ws("/", "chain_id", "seq")
    asked = F.lit(None).cast("long")
    for (c, s), t in targets.items():
        asked = F.when(key == f"{c}/{s}", F.lit(t).cast("long")).otherwise(asked)
    return rows.withColumn("target", asked).withColumn("expects", F.lit(expects).cast("long"))


@pytest.fixture
def log(spark, tmp_path, make_rows):
    table = guarded.GuardedLog(spark, str(tmp_path / "log"))
    table.append(batch(make_rows, [(c, i, "genesis" if i == 0 else "observation", '{"n":%d}' % i) for c in (1, 2) for i in range(3)]))
    return table


def test_both_writers_end_on_one_chain(log, make_rows):
    one = log.prepare(batch(make_rows, [(1, 0, "observation", '{"by":"a"}'), (1, 1, "revision", '{"by":"a"}', 0), (1, 2, "revision", '{"by":"a"}', 2)]))
    two = batch(make_rows, [(1, 0, "observation", '{"by":"b"}'), (2, 0, "revision", '{"by":"b"}', 7), (1, 1, "revision", '{"by":"b"}', 4)])
    lost = log.prepare(two)
    assert log.publish(one) and not log.publish(lost)
    log.drop(lost)
    assert log.append(two) == 3
    assert rows_of(integrity.verify_log(log.read()).select("chain_id", "n", "ok"), "chain_id") == [
        {"chain_id": 1, "n": 7, "ok": True}, {"chain_id": 2, "n": 3, "ok": True}]
    assert [r["content_json"] for r in rows_of(log.read().where("chain_id = 1 and idx > 2"), "idx")] == ['{"by":"a"}'] * 2 + ['{"by":"b"}'] * 2
    assert [(r["target"], r["reason"]) for r in rows_of(log.rejects(), "target")] == [(0, "protected zone: genesis"), (7, "no such record")]
    assert log.read(1).count() == 6 and log.version() == 3


def test_a_writer_that_insists(log, make_rows):
    seen = batch(make_rows, [(1, 0, "observation", "{}"), (2, 0, "observation", "{}")], expects=2)
    log.append(batch(make_rows, [(1, 0, "observation", '{"x":1}')]))
    log.append(seen, insist=True)
    assert [(r["chain_id"], r["reason"]) for r in rows_of(log.rejects(), "chain_id")] == [(1, "chain has moved on")]
    assert {r["chain_id"]: r["idx"] for r in log.heads().collect()} == {1: 3, 2: 3}


def test_unpublished_work_is_not_seen(log, make_rows):
    log.prepare(batch(make_rows, [(1, 0, "observation", "{}")]))
    assert log.read().count() == 6 and log.version() == 1
    assert log.append(batch(make_rows, [])) == 2 and log.read().count() == 6
