import hashlib
import hmac
import json

import pytest
from conftest import rows_of
from pyspark.sql import Window as W, functions as F

from recordloom.functions.hashing import hmac_sha256
from recordloom.operators import blocks, governance, integrity, log as lg, merkle, meta, quorum, semantic, stats
from recordloom.sources import logs

ZEROS = "0" * 64


def canon(o):
    return json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def by_hand(items):
    """The hash chain of (content, cites_prior) computed one record at a time."""
    prior, out = ZEROS, []
    for i, (kind, content, cites, ts) in enumerate(items):
        ch = hashlib.sha256(canon(content).encode()).hexdigest()
        msg = {"index": i, "prior_hash": prior, "timestamp": ts, "type": kind, "content": content,
               "refs": [prior] if cites else [], "pubkey": "w0", "content_hash": ch}
        h = hashlib.sha256(canon(msg).encode()).hexdigest()
        out.append((prior, ch, h))
        prior = h
    return out


def test_chain_matches_hand_computation(make_rows):
    items = [("genesis", {"v": 1}, False, 5)] + [
        ("response", {"text": t, "n": i, "a": [1, {"z": None, "b": True}]}, i % 2 == 0, 10 * i)
        for i, t in enumerate(["héllo", "日本語", "🌊 wave", 'Ω "alpha" β\n\t\\ /', ""] * 5)]
    rows = make_rows([(1, i, k, json.dumps(c), cites, ts) for i, (k, c, cites, ts) in enumerate(items)])
    got = rows_of(logs.append(rows), "idx")
    assert [(r["prior_hash"], r["content_hash"], r["record_hash"]) for r in got] == by_hand(items)
    assert integrity.verify_log(logs.append(rows)).first()["message"] == f"chain ok ({len(items)} records)"


def test_append_continues_many_chains(make_rows):
    whole = [(c, s, "observation", '{"i":%d}' % s) for c in (1, 2, 3) for s in range(20)]
    one = rows_of(logs.append(make_rows(whole)), "chain_id", "idx")
    first = logs.append(make_rows([r for r in whole if r[1] < 8]))
    later = make_rows([(c, s - 8, t, j, False, 1000 * s) for c, s, t, j in whole if s >= 8])
    second = logs.append(later, logs.heads(first))
    assert rows_of(first.unionByName(second), "chain_id", "idx") == one


@pytest.mark.parametrize("harm,reason,at", [
    ("content", "content_hash mismatch", 3), ("prior", "prior_hash mismatch", 3), ("deleted", "index gap", 4),
    ("rehashed", "record_hash mismatch", 3), ("writer", "unexpected pubkey", 3)])
def test_first_failure_is_named(make_rows, harm, reason, at):
    log = logs.append(make_rows([(1, i, "observation", '{"i":%d}' % i) for i in range(9)] + [(2, 0, "genesis", "{}")]))
    hit = (F.col("chain_id") == 1) & (F.col("idx") == 3)
    change = {"content": ("content_json", F.lit('{"i":99}')), "prior": ("prior_hash", F.lit("f" * 64)),
              "rehashed": ("ts_ms", F.lit(7).cast("long")), "writer": ("writer", F.lit("w9"))}
    if harm == "deleted":
        log = log.where(~hit)
    else:
        name, value = change[harm]
        log = log.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    got = {r["chain_id"]: r for r in rows_of(integrity.verify_log(log, writer="w0", span=2))}
    assert (got[1]["reason"], got[1]["first_bad"]) == (reason, at) and not got[1]["ok"]
    assert got[2]["ok"]


def test_proof_of_work_check(make_rows):
    log = logs.append(make_rows([(1, 0, "genesis", '{"_pow":{"difficulty":9,"nonce":0}}'), (1, 1, "genesis", '{"_pow":{"difficulty":0}}')]))
    assert rows_of(integrity.failures(log)) == [{"chain_id": 1, "idx": 0, "reason": "proof-of-work below target"}]


# --- blocked windows equal plain windows, also when one key holds a third of the rows ------
def skewed(spark, n=300):
    rows = [(0 if i % 3 == 0 else i % 17, i, i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t long, v long")


def test_positions_and_running_sum(spark):
    df = skewed(spark)
    w = W.partitionBy("k").orderBy("t")
    want = rows_of(df.withColumn("p", F.row_number().over(w) - 1).withColumn("s", F.sum("v").over(w)).withColumn("p", F.col("p").cast("long")), "k", "t")
    got = blocks.positions(df, ["k"], F.expr("t div 10"), ["t"], "p")
    got = blocks.running_sum(got, ["k"], F.expr("p div 4"), ["p"], {"s": F.col("v")})
    assert rows_of(got.select("k", "t", "v", "p", "s"), "k", "t") == want


def test_preceding_across_block_edges(spark):
    df = blocks.positions(skewed(spark), ["k"], F.expr("t div 10"), ["t"], "p")
    w = W.partitionBy("k").orderBy("p")
    want = df.withColumn("l", F.lag("v").over(w)).withColumn("f", F.collect_list("t").over(w.rowsBetween(-3, -1)))
    got = blocks.with_preceding(df, ["k"], "p", 3, {"l": lambda x: F.lag("v").over(x), "f": lambda x: F.collect_list("t").over(x.rowsBetween(-3, -1))}, span=4)
    assert rows_of(got, "k", "p") == rows_of(want, "k", "p")


def test_global_positions(spark):
    df = spark.range(0, 200).select((F.col("id") * 37 % 199).alias("x"), "id").repartition(5)
    got = rows_of(blocks.global_positions(df, ["x", "id"], "n"), "x", "id")
    assert [r["n"] for r in got] == list(range(1, 201))


# --- Merkle ------------------------------------------------------------------------------------
def root_by_hand(leaves):
    layer = list(leaves)
    while len(layer) > 1:
        layer = [hashlib.sha256(a + b).digest() for a, b in zip(layer[::2], layer[1::2] + ([layer[-1]] if len(layer) % 2 else []))]
    return layer[0]


def test_roots_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 4)
    monkeypatch.setattr(merkle, "FAN_LEVELS", 2)
    sizes = [1, 2, 3, 4, 5, 7, 8, 11, 16, 17, 21, 33, 63, 64, 65, 100]
    leaves = {n: [hashlib.sha256(f"{n}:{i}".encode()).digest() for i in range(n)] for n in sizes}
    df = spark.createDataFrame([(n, i, h.hex()) for n in sizes for i, h in enumerate(leaves[n])], "g long, pos long, h string")
    got = {r["g"]: (r["leaves"], r["root"]) for r in rows_of(merkle.merkle_roots(df, ["g"], "pos", "h"))}
    assert got == {n: (n, root_by_hand(leaves[n]).hex()) for n in sizes}


def test_sealing_and_proofs(make_rows, spark):
    log = logs.append(make_rows([(c, i, "observation", '{"i":%d}' % i) for c, n in ((1, 10), (2, 27)) for i in range(n)]))
    first = merkle.seal_batches(log.where("idx < 8"), size=8)
    rest = merkle.seal_batches(log, first, size=8)
    batches = first.unionByName(rest)
    assert sorted((r["chain_id"], r["first_idx"], r["last_idx"]) for r in batches.collect()) == [
        (1, 0, 7), (1, 8, 9), (2, 0, 7), (2, 8, 15), (2, 16, 23), (2, 24, 26)]
    hashes = [bytes.fromhex(r["record_hash"]) for r in rows_of(log.where("chain_id = 2 and idx between 16 and 23"), "idx")]
    assert batches.where("chain_id = 2 and first_idx = 16").first()["root_hash"] == root_by_hand(hashes).hex()
    proofs = merkle.inclusion_proofs(log, batches, size=8)
    assert proofs.count() == 37 and merkle.verify_proofs(proofs).where("not ok").count() == 0
    wrong = proofs.withColumn("record_hash", F.sha2("record_hash", 256))
    assert merkle.verify_proofs(wrong).where("ok and size(proof) > 0").count() == 0
    one = merkle.inclusion_proofs(log, batches, spark.createDataFrame([(1, 5)], "chain_id long, idx long"), size=8)
    assert [r["idx"] for r in one.collect()] == [5]
    assert len(rows_of(merkle.seal_batches(log, None, 8, full_only=True))) == 4


# --- meaning, statuses, witnesses -----------------------------------------------------------------
def test_semantic_violations(make_rows):
    rows = make_rows([(1, 0, "observation", "{}"), (1, 1, "response", "{}"), (1, 2, "revision", '{"_meta":{"supersedes":0}}')])
    assert semantic.semantic_violations(logs.unlinked(rows)).count() == 0
    bad = logs.unlinked(make_rows([
        (1, 0, "observation", "{}"), (1, 1, "revision", '{"_meta":{"supersedes":999}}'), (1, 2, "proposal_recurrence", '{"recurs_proposal_index":0}'),
        (1, 3, "proposal_status", '{"marks_proposal_index":"2"}'), (1, 4, "reflection", '{"covers_indices":[3,9]}'),
        (1, 5, "proposal", '{"evidence_indices":[1,77]}'), (1, 6, "revision", "{}"), (1, 7, "proposal", '{"evidence":[0]}')]))
    got = {r["idx"]: r["message"] for r in rows_of(semantic.semantic_violations(bad))}
    assert got == {1: "target past the chain", 2: "target is observation (expected 'proposal')", 3: "no integer target",
                   4: "range [3, 9] is outside the chain", 5: "evidence outside the chain: 77", 6: "no supersedes pointer"}


def test_recurrence_and_status(make_rows):
    log = logs.unlinked(make_rows([
        (1, 0, "proposal", '{"status":"open","topic_signature":"a"}'), (1, 1, "proposal_recurrence", '{"recurs_proposal_index":0}'),
        (1, 2, "proposal_recurrence", '{"recurs_proposal_index":0}'), (1, 3, "proposal", '{"title":"scheduler timezone offset","escalated":true}'),
        (1, 4, "proposal_status", '{"marks_proposal_index":0,"new_status":"declined"}'), (1, 5, "proposal", '{"topic_signature":"a"}')]))
    assert {r["idx"]: r["sightings"] for r in governance.recurrence_counts(log).collect()} == {0: 3, 3: 1, 5: 1}
    assert sorted(r["idx"] for r in governance.escalated(log).collect()) == [0, 3]
    topics = {r["signature"]: r["idx"] for r in governance.open_topics(log).collect()}
    assert topics == {"a": 5, "offset+scheduler+timezone": 3}
    assert {r["idx"]: r["status"] for r in governance.effective_status(log, as_of=3).collect()} == {0: "open", 3: "open"}


def test_hmac_and_quorum(spark, make_rows):
    keys = [("w0", "ab" * 16), ("w1", "00ff" * 8), ("w2", "01" * 16)]
    df = spark.createDataFrame([(k, m) for _, k in keys for m in ("", "7:abc", "é" * 80)], "k string, m string")
    for r in df.select("k", "m", hmac_sha256(F.col("k"), F.col("m")).alias("h")).collect():
        assert r["h"] == hmac.new(bytes.fromhex(r["k"]), r["m"].encode(), hashlib.sha256).hexdigest()
    log = logs.append(make_rows([(c, i, "observation", "{}") for c in (1, 2, 3) for i in range(4)]))
    votes = quorum.attest_heads(log, keys)
    votes = votes.where(~((F.col("chain_id") == 2) & (F.col("witness") == "w0"))).where(~((F.col("chain_id") == 3) & F.col("witness").isin("w0", "w1")))
    got = {r["chain_id"]: (r["valid"], r["status"]) for r in quorum.quorum_report(log, votes, keys).collect()}
    assert got == {1: (3, "OK"), 2: (2, "OK"), 3: (1, "FAIL")}
    forged = log.withColumn("content_json", F.lit('{"forged":1}'))
    assert {r["status"] for r in quorum.quorum_report(forged, votes, keys).collect()} == {"FAIL"}
    twice = votes.unionByName(votes.withColumns({"mac": F.lit("x"), "seq": F.lit(1).cast("long")}))
    assert quorum.quorum_report(log, twice, keys).where("chain_id = 1").first()["valid"] == 3


def test_meta_versions(make_rows):
    log = logs.unlinked(make_rows([
        (1, 0, "genesis", '{"v":1}'), (1, 1, "revision", '{"revises_index":0}'), (1, 2, "response", '{"_meta":{}}'),
        (1, 3, "odd", '{"_meta":{"salience":0.9,"exposure":"shared","schema_version":2,"modalities_activated":["b"]}}'), (1, 4, "reflection", "[1]")]))
    got = [r["meta"] for r in meta.resolve_meta(log).orderBy("idx").collect()]
    assert [(m["schema_version"], m["confidence"], m["supersedes"], m["exposure"], m["salience"]) for m in got] == [
        (1, 1.0, None, "summary", 0.75), (1, 0.8, 0, "private", 0.8), (3, 1.0, None, "private", 0.4), (2, 1.0, None, "shared", 0.9), (1, 0.8, None, "private", 0.85)]
    assert got[3]["modalities_activated"] == ["b"] and got[0]["is_default"] and not got[2]["is_default"]


def test_blobs(make_rows, spark):
    sha = lambda c: c * 64
    log = logs.unlinked(make_rows([
        (1, 0, "file", '{"blob_sha256":"%s","filename":"old"}' % sha("a")), (1, 1, "file", '{"blob_sha256":"%s","filename":"new"}' % sha("a")),
        (1, 2, "response", '{"attachments":[{"blob_sha256":"%s","filename":"x"}]}' % ("aaaaaaaab" + "c" * 55))]))
    index = lg.blob_index(log)
    assert {(r["sha"][:9], r["filename"]) for r in index.collect()} == {("a" * 9, "new"), ("aaaaaaaab", "x")}
    asked = spark.createDataFrame([("aaaaaaaab…",), ("aaaaaaaa",), ("aaaa",)], "prefix string")
    got = {r["prefix"]: r["sha"] for r in lg.blobs_by_prefix(index, asked).collect()}
    assert got["aaaaaaaab…"].startswith("aaaaaaaabc") and got["aaaaaaaa"] is None and got["aaaa"] is None


def test_watermark_counts(make_rows, spark):
    log = logs.unlinked(make_rows([(1, i, "response", "{}") for i in range(5)]))
    marks = lambda n: spark.createDataFrame([(1, n)], "chain_id long, watermark long")
    assert [stats.turns_since_watermark(log, marks(n)).first()["n"] for n in (0, 3, 5, 9)] == [5, 2, 0, 5]


@pytest.mark.parametrize("span", [4, 16, 4096])
def test_preceding_over_holes_at_block_edges(spark, span):
    """Edge rows and whole blocks are missing; results equal those of the plain window."""
    kept = [i for i in range(60) if i not in {7, 15, 16, 31} and not 32 <= i < 40 and not 44 <= i < 49]
    df = spark.createDataFrame([(c, i) for c in (1, 2) for i in kept], "chain_id long, idx long")
    make = {"last": lambda w: F.lag("idx", 1).over(w), "third": lambda w: F.lag("idx", 3).over(w)}
    plain = W.partitionBy("chain_id").orderBy("idx")
    want = df.select("chain_id", "idx", *[f(plain).alias(n) for n, f in make.items()])
    got = blocks.with_preceding(df, ["chain_id"], "idx", 3, make, span)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
