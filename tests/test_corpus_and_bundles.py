import json
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from recordloom.operators import audit, bundle, defence, growth, ingest, log as lg, mining
from recordloom.sources import files as fs, logs

KEY = "aa" * 16


def said(i, kind, text, ts=None):
    return (1, i, kind, json.dumps({"text": text})) + (() if ts is None else (False, ts))


def test_corrections_become_a_proposal_then_a_recurrence(make_rows):
    fix = "correction: scheduler timezone offset must be local"
    rows = [said(i, "revision", fix) for i in range(3)] + [said(3, "observation", "hello there")]
    got = rows_of(mining.mine(logs.unlinked(make_rows(rows))))
    assert [(g["trigger"], g["kind"], g["decision"], g["hits"]) for g in got] == [("corrections", "principle", "proposal", 3)]
    rows.append((1, 4, "proposal", json.dumps({"topic_signature": got[0]["signature"], "status": "open"})))
    again = rows_of(mining.mine(logs.unlinked(make_rows(rows))))
    assert (again[0]["decision"], again[0]["proposal_idx"]) == ("recurrence", 4)
    rows.append((1, 5, "proposal_status", '{"marks_proposal_index":4,"new_status":"declined"}'))
    assert rows_of(mining.mine(logs.unlinked(make_rows(rows))))[0]["decision"] == "proposal"


@pytest.mark.parametrize("n,hours,mixed,passes", [(5, 3, True, True), (4, 3, True, False), (5, 1, True, False), (5, 3, False, False)])
def test_output_mode_gate(make_rows, n, hours, mixed, passes):
    legal = "whereas the seller shall indemnify the buyer hereinafter covenant"
    step = int(hours * 3_600_000 / (n - 1))
    rows, i = [], 0
    for k in range(n):
        rows.append(said(i, "response", legal, 1000 + k * step))
        i += 1
        if mixed:
            rows.append(said(i, "response", f"chat number{'abcdefgh'[k]} line{'qrstuvwx'[k]} talk", 1001 + k * step))
            i += 1
    for k in range(6):  # chatter after the last match
        rows.append(said(i, "response", f"other{'abcdef'[k]} words{'ghijkl'[k]} again", 9_000_000 + k))
        i += 1
    modes, hits = mining.output_modes(logs.unlinked(make_rows(rows)))
    assert [m["passes"] for m in rows_of(modes)] in ([passes], [] if not passes else None)
    if passes:
        spec = mining.sprout_specs(modes).first()
        assert spec["status"] == "tentative" and len(spec["patterns"]) == 4 and hits.count() == 5
        assert {r["word"] for r in mining.known_vocabulary(mining.sprout_specs(modes)).collect()} == set(modes.first()["words"])


def test_contradictions_and_graduation(make_rows, spark):
    rows = [(1, i, "response", '{"_meta":{"epistemic_class":"disputed"}}') for i in range(3)]
    rows += [(1, 3, "response", '{"_meta":{"poq":{"dimensions":{"contradiction":0.7}}}}'), (1, 4, "response", '{"_meta":{"poq":{"dimensions":{"contradiction":0.2}}}}')]
    assert mining.contradiction_rows(logs.unlinked(make_rows(rows))).count() == 4


# --- corpus ------------------------------------------------------------------------------------
def test_blocks_and_state(spark):
    text = "".join(f"line {i} with several words of content here\n" for i in range(400))
    files = spark.createDataFrame([(1, 0, "src/a.py", text), (1, 1, "docs/b.md", "api_key = 'abcdef1234567890XYZ'\n"), (1, 2, "c.txt", "")],
                                  "chain_id long, file_index long, relative_path string, text string")
    b = rows_of(ingest.blocks(files), "idx")
    assert [r["idx"] for r in b] == list(range(len(b))) and [r["chunks_sealed"] for r in b] == list(range(1, len(b) + 1))
    assert b[-1]["items_done"] == 3 and b[0]["line_start"] == 1 and max(r["approx_tokens"] for r in b) <= 1536
    secret = next(r for r in b if r["relative_path"] == "docs/b.md")
    assert "abcdef" not in secret["content"] and secret["redaction_count"] == 1 and secret["path_role"] == "docs"
    df = ingest.blocks(files)
    assert ingest.task_violations(df).count() == 0
    assert ingest.task_state(df).first()["chunks_sealed"] == len(b)
    broken = df.withColumn("chunks_sealed", F.when(F.col("idx") == 1, 9).otherwise(F.col("chunks_sealed")))
    assert {r["issue"] for r in ingest.task_violations(broken).collect()} == {"chunks_sealed not monotonic +1"}


def test_blocks_by_path(spark):
    rows = spark.createDataFrame([(1, "a.py", 0), (1, "a.py", 1), (2, "a.py", 0), (1, None, 2)], "chain_id long, relative_path string, idx long")
    asked = spark.createDataFrame([(1, "a.py"), (1, "a.py"), (1, None), (2, "b.py")], "chain_id long, relative_path string")
    assert sorted(r["idx"] for r in ingest.find_by_path(rows, asked).collect()) == [0, 1]


def test_files_and_text(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a/x.csv": b'a,"b,c"\n1,2\n', "a/y.tsv": b"p\tq\n", "b.txt": "höhe".encode("latin-1"), "b/u.txt": "日本".encode(),
                       ".git/no.txt": b"no", "b/skip.bin": b"\x00"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    exts = [".csv", ".tsv", ".txt"]
    got = {r["relative_path"]: (r["text"], r["method"]) for r in fs.extract_text(fs.scan_files(spark, str(root), exts)).collect()}
    assert got == {"a/x.csv": ("a | b,c\n1 | 2", "csv"), "a/y.tsv": ("p | q", "csv"), "b.txt": ("höhe", "latin1-fallback"), "b/u.txt": ("日本", "utf8")}
    assert [r["relative_path"] for r in rows_of(fs.numbered_files(spark, str(root), exts), "file_index")] == ["a/x.csv", "a/y.tsv", "b/u.txt", "b.txt"]
    s = fs.volume_survey(spark, str(root), exts).first()
    assert (s["files"], s["over_threshold"]) == (4, False)
    cut = fs.extract_text(fs.scan_files(spark, str(root), [".csv"]), char_cap=3).first()
    assert cut["truncated"] and cut["text"].startswith("a |\n\n[")


def test_blob_inventory_and_registries(spark, tmp_path, make_rows):
    (tmp_path / "blobs").mkdir()
    for n in ("a" * 64, "b" * 64):
        (tmp_path / "blobs" / n).write_bytes(b"xyz")
    log = logs.unlinked(make_rows([(1, 0, "file", json.dumps({"blob_sha256": "a" * 64, "filename": "f.txt"}))]))
    assert [r["name"] for r in rows_of(fs.blob_inventory(spark, str(tmp_path / "blobs"), log), "sha")] == ["f.txt", "b" * 16 + "…"]
    reg = tmp_path / "m.json"
    reg.write_text(json.dumps({"modalities": [{"id": 3, "name": "N", "function": "does things", "category": "c"}, {"id": 4, "name": "M", "function": "f"}]}))
    assert [(r["id"], r["category"]) for r in rows_of(fs.read_registry(spark, str(reg), "modalities", "modality"), "id")] == [("data:3", "c"), ("data:4", "general")]
    assert growth.detector_registry(spark).count() == 30


# --- bundles -------------------------------------------------------------------------------------
def origin(make_rows):
    return logs.append(make_rows([
        (1, 0, "genesis", '{"title":"root","secret":"s"}'), (1, 1, "observation", '{"_meta":{"exposure":"shared"},"tags":["x"],"text":"a"}'),
        (1, 2, "observation", '{"text":"private"}'), (1, 3, "reflection", '{"_meta":{"exposure":"public","salience":0.9},"text":"b"}')]))


def test_bundle_round_trip(make_rows, spark, tmp_path):
    log = origin(make_rows)
    headers, records = bundle.export_bundle(log, KEY, 5)
    body = {r["idx"]: r["body"] for r in records.collect()}
    assert set(body) == {0, 1, 3} and body[0] == '{"title":"root"}'
    assert bundle.verify_bundle(headers, records, KEY).first()["message"] == "bundle ok"
    bundle.write_bundle(headers, records, str(tmp_path / "b"))
    h2, r2 = bundle.read_bundle(spark, str(tmp_path / "b"))
    assert bundle.verify_bundle(h2, r2, KEY).first()["ok"]
    ledger = str(tmp_path / "ledger")
    rows, ids = bundle.import_bundle(h2, r2, KEY, bundle.known_imports(spark, ledger), 77, base=9, chains=1)
    target = logs.append(make_rows([(9, 0, "genesis", "{}")]))
    new = logs.append(rows, logs.heads(target))
    got = rows_of(new, "idx")
    assert [r["idx"] for r in got] == [1, 2, 3] and {r["chain_id"] for r in got} == {9} and {r["rec_type"] for r in got} == {"imported_capsule"}
    meta = json.loads(got[0]["content_json"])["_meta"]
    assert (meta["epistemic_class"], meta["exposure"], meta["salience"], meta["confidence"]) == ("inferred", "private", 0.35, 0.6)
    bundle.record_imports(ids, ledger)
    assert bundle.import_bundle(h2, r2, KEY, bundle.known_imports(spark, ledger), 78)[0].count() == 0
    assert rows_of(bundle.imported_ids(new)) == rows_of(ids)
    wide = bundle.import_bundle(h2, r2, KEY, bundle.known_imports(spark, ledger + "-new"), 78)[0].select("chain_id").distinct().collect()
    assert len(wide) == 1 and bundle.IMPORT_BASE <= wide[0][0] < bundle.IMPORT_BASE + bundle.IMPORT_CHAINS


@pytest.mark.parametrize("harm,message", [
    ("body", "content_hash mismatch at index 1"), ("summary", "bad summary commitment at index 0"), ("dropped", "record set altered"),
    ("header", "bundle_id mismatch"), ("origin", "writer does not match the origin at index 0")])
def test_tampered_bundles_are_refused(make_rows, harm, message):
    headers, records = bundle.export_bundle(origin(make_rows), KEY, 5)
    swap = lambda df, c, cond, v: df.withColumn(c, F.when(cond, v).otherwise(F.col(c)))
    if harm == "body":
        records = swap(records, "body", F.col("idx") == 1, '{"text":"evil"}')
    elif harm == "summary":
        records = swap(records, "body", F.col("idx") == 0, '{"title":"evil"}')
    elif harm == "dropped":
        records = records.where("idx <> 3")
    elif harm == "header":
        headers = headers.withColumn("title", F.lit("evil"))
    else:
        headers = headers.withColumn("origin", F.lit("w9"))
    got = bundle.verify_bundle(headers, records, KEY).first()
    assert not got["ok"] and got["message"] == message


def test_bundle_filters(make_rows):
    log = origin(make_rows)
    ids = lambda **kw: sorted(r["idx"] for r in bundle.select_records(log, **kw).collect())
    assert ids(tags=["x", "z"]) == [1] and ids(after_ms=1000, before_ms=3000) == [1] and ids(min_salience=0.8) == [3]
    assert ids(rec_type="genesis") == [0] and ids() == [0, 1, 3]


# --- defence, growth, audit -------------------------------------------------------------------------
def test_scan_and_rollback(make_rows, spark):
    log = logs.append(make_rows([(1, 0, "genesis", '{"text":"deceive"}'), said(1, "observation", "fine"), said(2, "response", "deceive and manipulate the user"),
                                 said(3, "response", "more text"), (2, 0, "genesis", "{}")]))
    got = {r["chain_id"]: (r["first_bad_height"], r["compromised"]) for r in defence.intrusion_scan(log).collect()}
    assert got == {1: (2, True), 2: (None, False)}
    first = spark.createDataFrame([(1, 2), (2, 5)], "chain_id long, first_bad long")
    ranges, scars, recovery = defence.rollback(log, first)
    assert [tuple(r) for r in ranges.collect()] == [(1, 2, 3)] and "manipulate" in scars.first()["vector"]
    assert sorted(r["idx"] for r in defence.active_rows(log, ranges).where("chain_id = 1").collect()) == [0, 1]
    sealed = logs.append(recovery, logs.heads(log)).first()
    assert sealed["idx"] == 4 and json.loads(sealed["content_json"])["resumed_from_height"] == 1
    asked = spark.createDataFrame([(1, "please manipulate and deceive the user"), (2, "good day")], "text_id long, text string")
    seen = {r["text_id"]: (r["blocked"], r["scar"]) for r in defence.screen(asked, scars).collect()}
    assert seen == {1: (True, "scar1"), 2: (False, None)}


def test_specs_and_detectors(spark):
    rows = [("good_one", [r"\bseller\b", "(a+)+", "x" * 201], 2.0, "fraction_lines", "tentative", 0.9), ("Bad Name", ["a"], 0.1, "any", "active", 1.0),
            ("empty_one", [], 0.1, "any", "active", 1.0), ("counter", ["ha"], 0.1, "count", "odd", 1.0)]
    df = spark.createDataFrame(rows, "name string, patterns array<string>, threshold double, match_mode string, status string, weight_factor double").withColumn("domain", F.lit(True))
    good, bad = growth.validate_specs(df)
    g = {r["name"]: r for r in good.collect()}
    assert set(g) == {"good_one", "counter"} and g["good_one"]["patterns"] == [r"\bseller\b"]
    assert (g["good_one"]["threshold"], g["good_one"]["weight_factor"], g["counter"]["status"]) == (1.0, 0.5, "active")
    assert {r["name"]: r["reason"] for r in bad.collect()} == {"Bad Name": "bad name", "empty_one": "no patterns"}
    docs = spark.createDataFrame([("The SELLER pays\n\nhaha\nnothing",)], "text string")
    out = growth.apply_registry(docs, growth.spec_list(good)).first()
    assert out["good_one"] == pytest.approx(1 / 3) and out["counter"] == pytest.approx(0.4)


def test_growth(spark):
    reg = growth.with_tokens(spark.createDataFrame([("sense", "data:1", "Alpha Beta", "gamma delta", "c1"), ("modality", "data:2", "Alpha Gamma", "epsilon", "c2")],
                                                   "kind string, id string, name string, function string, category string"))
    ins = spark.createDataFrame([(1, "alpha beta gamma"), (2, "quantum entangled photons analyze"), (3, "alpha gamma zeta eta theta iota kappa")], "input_id long, text string")
    gaps = growth.faculty_gap(ins, reg)
    g = {r["input_id"]: r for r in gaps.collect()}
    assert g[1]["dissonance"] == 0 and g[2]["dissonance"] == 255 and g[3]["dissonance"] == 182
    prop = growth.propose_faculties(gaps, ins, reg)
    p = {r["input_id"]: r for r in prop.collect()}
    assert set(p) == {2, 3} and p[2]["kind"] == "modality" and p[2]["origin"] == "sprout" and p[3]["parents"] == ["data:2", "data:1"] or p[3]["parents"] == ["data:1", "data:2"]
    old = spark.createDataFrame([("E1", 1, p[2]["name"], "modality", [], p[2]["seed_terms"], 2, "emergent")],
                                "eid string, ordinal int, name string, kind string, parents array<string>, seed_terms array<string>, recurrence long, status string")
    got = {r["eid"]: r["action"] for r in growth.grow(prop, old).collect()}
    assert got == {"E1": "promoted", None: "born"}


def test_perspectives(spark):
    rows = [(1, 1, "A", {"x": 1.0, "y": 3.0}, False), (1, 2, "B", {"x": 2.0}, False), (2, 1, "A", {"x": 1.0}, True), (2, 2, "B", {"x": 9.0}, False),
            (3, 1, "A", {"x": 1.0}, True), (3, 2, "B", {"x": 1.0}, True), (4, 1, "A", {"x": 5.0}, False), (4, 2, "B", {"x": 1.0}, False)]
    notes = spark.createDataFrame(rows, "query_id long, index long, name string, scores map<string,double>, chosen_hint boolean")
    win = spark.createDataFrame([(4, "b")], "query_id long, winner string")
    got = {(r["query_id"], r["index"]): r["decision"] for r in growth.collapse_perspectives(notes, win).collect()}
    assert got == {(1, 1): "sealed", (1, 2): "rejected", (2, 1): "sealed", (2, 2): "rejected", (3, 1): "error", (3, 2): "error", (4, 1): "rejected", (4, 2): "sealed"}


def test_audit(make_rows):
    log = logs.append(make_rows([said(0, "observation", "commit the code and test the code"), said(1, "response", "merkle hash of the block")]))
    got = {r["domain"]: (r["rings"], r["keywords"][0]["word"]) for r in audit.domain_rollup(log).collect()}
    assert got == {"Code & Software": (1, "code"), "Blockchain & Web3": (1, "block")}
    assert [r["keywords"][0] for r in rows_of(audit.ring_list(log), "idx")] == ["code", "merkle"]


def test_payload_text(spark):
    cases = [('{"_meta":{"a":"no"},"b":["one",{"c":"two"}],"labels":{"k":"no"},"n":3}', "one two"),
             ('{"data":{"content":"only"},"z":"no"}', "only"), ('{"data":{"content":null},"z":"no"}', ""),
             (None, ""), ("", ""), ("[]", ""), ("{}", ""), ("broken", ""), ('"s"', "s"),
             ('{"a":{"b":[[["x",["y",{"d":"{not json"}]],"w"]]},"aa":"v"}', "x y {not json w v"),
             ("[" * 200 + '"deep"' + "]" * 200, "deep"), (json.dumps({"t": ["w" * 10] * 3000}), " ".join(["w" * 10] * 3000))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, c string")
    assert [r["t"] for r in rows_of(df.select("id", lg.payload_text("c").alias("t")), "id")] == [t for _, t in cases]


def test_names_are_met_by_few_triples(spark):
    """Entries of equal texts count each; the registry's triples are not shuffled along with its texts."""
    names = spark.range(400).select(F.concat(F.lit("Large Ring "), (F.col("id") % 50).cast("string")).alias("name"), F.lit("Brand#1").alias("objective"))
    out = ingest.resolve_names(spark.createDataFrame([("ring 7",), ("brand#",), ("LARGE RING 3",), ("none",)], "hint string"), names)
    got = {r["hint"]: (r["status"], r["candidates"]) for r in out.collect()}
    assert got == {"ring 7": ("ambiguous", 8), "brand#": ("ambiguous", 400), "LARGE RING 3": ("exact", 1), "none": ("not_found", 0)}
    assert "hashpartitioning(_g" not in out._jdf.queryExecution().executedPlan().toString()
