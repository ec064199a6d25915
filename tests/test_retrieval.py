import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from recordloom.functions import text as tx, vectors
from recordloom.operators import budget, ingest, knn as nn, retrieval
from recordloom.plans.context import build_context, fit_context
from recordloom.sources import logs

DAY = 86_400_000


def embedded(log):
    return log.select("chain_id", "idx", vectors.hash_embed(tx.embed_text(F.col("rec_type"), F.col("content_json")), 64).alias("vector"))


def query_on(spark, text, chain=1):
    q = spark.createDataFrame([(1, chain, text)], "query_id long, chain_id long, text string")
    return q.withColumn("vector", vectors.hash_embed(F.col("text"), 64))


@pytest.mark.parametrize("max_queries", [100, 1])
def test_knn_against_brute_force(spark, monkeypatch, max_queries):
    monkeypatch.setattr(nn, "TILE", 2)
    monkeypatch.setattr(nn, "CELL", 9)
    rng = np.random.default_rng(3)
    chunks = [(int(i // 3), int(i % 3), rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)] + [(99, 0, [0.0] * 5)]
    chunks += [(100 + i, 0, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(6)]      # ties
    queries = [(q, rng.normal(size=5).tolist()) for q in range(4)] + [(9, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(chunks, "rec long, chunk_index int, vector array<float>").repartition(4)
    qs = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = [(r["query_id"], r["rec"], round(r["sim"], 6)) for r in rows_of(nn.knn(df, qs, 4, ["rec"], max_queries=max_queries), "query_id", "rank")]
    want = []
    for q, v in queries:
        best = {}
        for rec, _, c in chunks:
            s = float(np.dot(c, v) / ((np.linalg.norm(c) or 1) * (np.linalg.norm(v) or 1)))
            best[rec] = max(best.get(rec, -9), s)
        want += [(q, r, round(s, 6)) for r, s in sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]]
    assert got == want
    assert nn.knn(df, qs, 0, ["rec"]).count() == 0


def test_reflection_outranks_observation(spark, make_rows):
    log = logs.append(make_rows([(1, 0, "genesis", "{}"), (1, 1, "observation", '{"text":"we discussed weather"}'), (1, 2, "reflection", '{"text":"weather"}')]))
    q = query_on(spark, "weather")
    hits = retrieval.hybrid(nn.knn_scoped(embedded(log), q, 20), log, 2000, 3)
    assert rows_of(hits, "rank")[0]["idx"] == 2


def test_superseded_risk_and_epistemic(spark, make_rows):
    body = '{"_meta":{%s},"text":"same words here"}'
    log = logs.unlinked(make_rows([
        (1, 0, "response", body % '"salience":0.5'), (1, 1, "response", body % '"salience":0.5,"poq":{"dimensions":{"risk":0.6}}'),
        (1, 2, "response", body % '"salience":0.5,"epistemic_class":"disputed"'), (1, 3, "revision", body % '"supersedes":0')]))
    cands = spark.createDataFrame([(1, 1, i, 0.8) for i in range(3)], "query_id long, chain_id long, idx long, sim double")
    got = {r["idx"]: r["score"] for r in retrieval.hybrid(cands, log, 0, 5, epistemic=True).collect()}
    base = 0.55 * 0.8 + 0.25 * 0.5 + 0.2
    assert got[0] == pytest.approx(base * 0.97 - 0.3) and got[1] == pytest.approx(base * 0.97 - 0.25) and got[2] == pytest.approx(base * 0.65)


def test_context_pulls_named_revised_and_partner(spark, make_rows):
    rows = [(1, 0, "genesis", "{}")] + [(1, i, "observation", '{"text":"filler %d about nothing"}' % i) for i in range(1, 50)]
    rows += [(1, 50, "observation", '{"text":"target question"}'), (1, 51, "response", '{"text":"target answer"}', True),
             (1, 52, "revision", '{"_meta":{"supersedes":51},"text":"fixed"}'),
             (1, 53, "observation", '{"_meta":{"exposure":"quarantine"},"text":"attack"}'), (1, 54, "response", '{"text":"reply"}', True)]
    rows += [(1, i, "reflection", '{"text":"trailing %d"}' % i) for i in range(55, 80)]
    log = logs.append(make_rows(rows))
    q = query_on(spark, "please show me record 51 again and record 53 and record 54, not record 999")
    seen, hidden = build_context(log, embedded(log), q, 10 * DAY, k=1, n_recent=3)
    got = {r["idx"]: (r["why"], r["pinned"]) for r in seen.collect()}
    assert got[51] == ("explicit", True) and got[52] == ("revision", False) and got[50] == ("partner", True)
    assert {77, 78, 79} <= set(got) and 53 not in got and got[54] == ("explicit", True)
    assert [r["idx"] for r in hidden.collect()] == [53]
    fitted = {r["idx"]: r["kept"] for r in fit_context(seen, log, 300).collect()}
    assert fitted[51] or fitted[54]
    assert sum(fitted.values()) < len(fitted)


@pytest.mark.parametrize("first_always", [True, False])
def test_greedy_budget_against_a_walk(spark, first_always):
    rnd = random.Random(5)
    rows = [(g, i, rnd.choice([1, 2, 3, 5, 8, 40, 90, 150]), rnd.random()) for g in range(6) for i in range(1 if g == 5 else 120)]
    df = spark.createDataFrame(rows, "g long, id long, size long, w double")
    out = budget.fit_greedy(df, ["g"], ["id"], [-F.col("w"), F.col("id")], "size", 100, first_always)
    got = {(r["g"], r["id"]) for r in out.where("kept").collect()}
    want = set()
    for g in range(6):
        used = 0
        for n, (_, i, size, w) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))):
            if used + size <= 100 or (n == 0 and first_always):
                used += size
                want.add((g, i))
    assert got == want and out.count() == len(rows)


def test_prefix_budget(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 0, 50), (2, 1, 1)], "g long, p long, size long")
    got = {(r["g"], r["p"]): (r["kept"], r["truncated"], r["room"]) for r in budget.fit_prefix(df, ["g"], "p", "size", 20).collect()}
    assert got == {(1, 0): (True, False, None), (1, 1): (True, False, None), (1, 2): (False, True, 5), (2, 0): (True, False, None)}


def test_neighbours_and_excerpts(spark):
    chunks = spark.createDataFrame([(1, 7, i) for i in range(10)], "chain_id long, idx long, chunk_index int")
    hit = spark.createDataFrame([(1, 1, 7, 0, 0.9), (1, 1, 7, 4, 0.8), (1, 1, 7, 5, 0.7)], "query_id long, chain_id long, idx long, chunk_index int, sim double")
    got = [(r["chunk_index"], r["tag"]) for r in rows_of(retrieval.excerpt_chunks(chunks, hit), "chunk_index")]
    assert got == [(0, "matched"), (1, "context"), (3, "context"), (4, "matched"), (5, "matched"), (6, "context")]


def test_path_hints(spark):
    case = [("src/a/b.py", "b.py", None, 1.0), ("src/a/b.py", None, "src/a", 0.8), ("src/x/b.py", None, "src/a", 0.3), ("src/x/c.py", "src/a/b.py", None, 0.2), ("a.py", None, None, 0.0)]
    df = spark.createDataFrame(case, "rel string, p string, d string, want double")
    for r in df.withColumn("got", tx.path_proximity(F.col("rel"), F.col("p"), F.col("d"))).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_ancestry_levels(make_rows):
    log = logs.append(make_rows([(1, i, "response", "{}", i > 0) for i in range(6)]))
    seed = log.where("idx = 4").select("chain_id", "record_hash")
    assert {r["idx"]: r["level"] for r in retrieval.ancestry(log, seed, 3).collect()} == {4: 1, 3: 2, 2: 3}


def test_source_verdict_and_changes(spark):
    live = spark.createDataFrame([(1, "a.txt", "new"), (1, "b.txt", "same"), (1, "c.txt", "fresh")], "chain_id long, relative_path string, text string")
    old = spark.createDataFrame([(1, 0, "a.txt", "x"), (1, 1, "b.txt", "old"), (1, 2, "b.txt", "same")], "chain_id long, idx long, relative_path string, t string").withColumn(
        "file_content_hash", F.sha2("t", 256))
    assert sorted(r["relative_path"] for r in ingest.changed_files(live, old).collect()) == ["a.txt", "c.txt"]
