import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from recordloom.session import get_spark
    session = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "7"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def rows_of(df, *order):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple(r[c] for c in order)) if order else out


@pytest.fixture
def make_rows(spark):
    """Unlinked records from (chain_id, seq, rec_type, content_json[, cites_prior[, ts_ms]])."""
    def make(items):
        full = [(c, s, (x[1] if len(x) > 1 else 1000 * s), t, j, [], "w0", bool(x[0]) if x else False) for c, s, t, j, *x in items]
        return spark.createDataFrame(full, "chain_id long, seq long, ts_ms long, rec_type string, content_json string, "
                                           "refs array<string>, writer string, cites_prior boolean")
    return make
