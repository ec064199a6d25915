"""Language identification, periodic runs and hard negatives against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recordloom.llm import hard_negatives, language_id, periodic_runs

DOCS = "doc_id long, text string, lang string, source string, row string, owner string, bucket int, runs string, score string"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", "r", "o", 3, "u", "x") for i, t, lang in rows], DOCS)


# ---- periodic runs

def plain_runs(w, least=24, periods=3):
    n, out = len(w), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = j if j > i else i + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_equal_plain_search(data):
    kinds = data.draw(st.sampled_from([1, 2, 3, 40]))
    w = data.draw(st.lists(st.integers(0, kinds - 1), max_size=130))
    for _ in range(data.draw(st.integers(0, 3))):
        if w:
            a, p, m = data.draw(st.integers(0, len(w) - 1)), data.draw(st.integers(1, max(1, len(w) // 4))), data.draw(st.integers(1, len(w)))
            for i in range(a + p, min(len(w), a + m)):
                w[i] = w[i - p]
    ids = np.array(w, np.int64)
    assert periodic_runs.runs(ids) == plain_runs(w)
    assert periodic_runs.runs(ids, 6, 3) == plain_runs(w, 6, 3)
    assert periodic_runs.runs(ids, 8, 4) == plain_runs(w, 8, 4)


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(w) if k not in gone)))


def test_runs_of_documents(spark):
    rng = random.Random(3)
    word = lambda k: f"w{rng.randrange(k)}é"
    rows = [(i, " ".join(word(400) for _ in range(rng.randrange(300))), "en") for i in range(150)]
    rows += [(1000, "a " * 500 + "b", "en"), (1000, "a " * 500 + "b", "en"), (1001, " \n".join(["x y z"] * 9 + ["q"] + ["x y z"] * 9), None),
             (1002, None, "en"), (1003, "", "en"), (1004, "\x1c " * 40, "en"), (1005, " ".join(["p q"] * 15 + [f"n{i}" for i in range(40)] * 4), "en"),
             (None, "k l m " * 20, "en"), (1006, "one", "en")]
    rows.append((1007, " ".join(word(9000) for _ in range(3000)) + " tick tock" * 30_000, "en"))
    out = periodic_runs.digest(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in out:
        if r["doc_id"] == 1007:
            assert r["period"] in (1, 2) or r["n_runs"] == 1
        elif r["doc_id"] is not None:
            assert tuple(r)[1:] == plain_digest(r["doc_id"], texts[r["doc_id"]]), r
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and next(r["n_runs"] for r in out if r["doc_id"] == i) for i in range(150))
    assert [r["n_runs"] for r in out if r["doc_id"] is None] == [1]
    assert periodic_runs.digest(documents(spark, [])).collect() == []


def test_collapsed_text(spark):
    row = periodic_runs.find(documents(spark, [(5, "start " + "ab cd " * 20 + "end", "en")])).first()
    assert row["collapsed"] == "start ab cd end" and [tuple(r) for r in row["runs"]] == [(1, 40, 2)]


def test_many_marks_with_different_words_before():
    phrase = list(range(20))
    w = [x for k in range(2000) for x in [100 + k, *phrase]]
    assert periodic_runs.runs(np.array(w, np.int64)) == []


# ---- language identification

def plain_grams(text, orders=4):
    s, out = (text or "").lower(), []
    t = " " + " ".join(x for x in re.split(" +", "".join(c if c.isalpha() else " " for c in s)) if x) + " "
    if t.strip(" ") == "":
        return []
    for n in range(1, orders + 1):
        out += [t[i:i + n] for i in range(len(t) - n + 1) if t[i:i + n] != " "]
    return out


def bucket_of(gram):
    h = ord(gram[0]) + 1
    for c in gram[1:]:
        h = (h * language_id.FACTOR + ord(c)) % (1 << 64)
    return (((h ^ (len(gram) << 56)) * language_id.SALT) % (1 << 64)) >> (64 - language_id.BITS)


PHRASES = {"en": "the cat sat on the mat and it was there", "de": "der hund und die katze sind schon über nacht", "fr": "le chat est à la maison où il dort"}


@pytest.fixture(scope="module")
def speech(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        lang = sorted(PHRASES)[i % 3]
        rows.append((i, " ".join(rng.choice(PHRASES[lang].split()) for _ in range(rng.randrange(1, 30))), lang))
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 ?!", None), (203, "the mat the mat", None), (None, "le chat", "fr"), (204, "DER HUND, 7 Nächte", "xx"),
             (204, "DER HUND, 7 Nächte", "xx"), (205, "über " * 60_000, None), (206, "日本語 x", "ja")]
    return documents(spark, rows), rows


def test_language_scores_equal_plain_bayes(speech):
    df, rows = speech
    teach = [(t, lang) for i, t, lang in rows if i is not None and i % 4 and lang is not None]
    counts, texts = {}, Counter()
    for t, lang in teach:
        grams = plain_grams(t)
        if grams:
            texts[lang] += 1
            counts.setdefault(lang, Counter()).update(map(bucket_of, grams))
    names = sorted(texts)
    size = 1 << language_id.BITS

    def expect(t):
        grams = plain_grams(t)
        if not grams:
            return "und", 0.0
        by = {}
        for lang in names:
            total = sum(counts[lang].values()) + 0.5 * size
            by[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((counts[lang][bucket_of(g)] + 0.5) / total) for g in grams)
        top = max(by.values())
        return min(n for n in names if by[n] == top), 1 / sum(math.exp(v - top) for v in by.values())
    small = df.where("doc_id <> 205")
    out = language_id.identify(df, F.coalesce(F.col("doc_id") % 4 == 0, F.lit(True))).collect()
    assert len(out) == len(rows) and small.count() == len(rows) - 2
    texts_of = {i: t for i, t, _ in rows}
    for r in out:
        if r["doc_id"] != 205:
            lang, score = expect(texts_of[r["doc_id"]])
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3, r
        else:
            assert r["lang_pred"] == "de" and r["score"] > 0.99
        assert r["held_out"] == (r["doc_id"] is None or r["doc_id"] % 4 == 0)


def test_slices_do_not_change_scores(speech):
    df, rows = speech
    model = language_id.learn(df)
    texts = [t for _, t, _ in rows]
    one, _ = language_id.score_texts(texts, model)
    cells, language_id.CELLS = language_id.CELLS, 1
    try:
        two, _ = language_id.score_texts(texts, model)
    finally:
        language_id.CELLS = cells
    assert (one == two).all()


def test_language_without_teachers(spark, speech):
    df, _ = speech
    assert language_id.identify(documents(spark, []), F.lit(False)).collect() == []
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(df, F.lit(True)).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        language_id.learn(df, most=2)


def test_language_of_held_out_rows(speech):
    df, rows = speech
    lang = {i: v for i, _, v in rows}
    out = [r for r in language_id.identify(df, F.col("doc_id") % 4 == 2).collect() if r["held_out"] and r["doc_id"] < 120]
    assert len(out) == 30 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 28


# ---- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, row string, tile string, mean string"


def plain_negatives(rows):
    ready = []
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        ready.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a, (i, label, x) in enumerate(ready):
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, other) for b, (j, other, y) in enumerate(ready) if b != a and len(y) == len(x)]
        for s, j, _ in sorted(v[:2] + (0,) for v in scored if v[2] == label)[:5]:
            hard = sorted((t, k) for t, k, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(hard, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, "r", "t", "m") for i, x, label in rows], VECTORS)


def mined(df):
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.whole_numbers(df), F.col("vec_id") % 50 == 0).collect()))


def test_hard_negatives_equal_full_scoring(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(10, 24))
    rows = []
    for i in range(700):
        label = int(rng.integers(10))
        x = centers[label] * rng.uniform(0, 1) + rng.normal(size=24) * 0.6
        rows.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), label))
    rows += [(1000 + i, [0.25] * 24, i % 3) for i in range(120)]  # equal vectors: ties
    rows += [(2000, [0.0] * 24, 1), (2050, None, 1), (2100, [0.5] * 23 + [None], 1), (2150, [0.5] * 23 + [float("nan")], 2),
             (2200, [0.5] * 23 + [float("inf")], 2), (2250, [0.5] * 24, None), (2300, [0.5, 0.5], 3), (2301, [0.5, 0.4], 3), (2302, [0.4, 0.4], 4), (2350, [], 3)]
    monkeypatch.setattr(hard_negatives, "CELL", 300)
    monkeypatch.setattr(hard_negatives, "TILE", 8)
    assert mined(vectors(spark, rows)) == plain_negatives(rows)


def test_hard_negatives_edges(spark):
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(50, [0.1, 0.2], 1)])) == []
    same = [(50, [0.5, 0.5], 1), (50, [0.5, 0.5], 1), (51, [0.4, 0.3], 2)]
    assert mined(vectors(spark, same)) == plain_negatives(same) and len(plain_negatives(same)) == 2


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x = rng.integers(-300, 300, size=(40, 37)).astype(float)
    exact = x @ x.T
    mean, dev = hard_negatives.summaries(x)
    wide, rest = hard_negatives.coarser(mean, dev, 4, 4)
    full, left = hard_negatives.summaries(x, 16)
    assert np.allclose(wide, full) and np.allclose(rest, left)
    gaps = []
    for m, d, width in ((mean, dev, 4), (wide, rest, 16)):
        middle, spread = width * m @ m.T, d @ d.T
        assert (np.abs(exact - middle) <= spread + 1e-6 * np.abs(exact).max()).all()
        gaps.append(spread.mean())
    assert gaps[0] < gaps[1]
