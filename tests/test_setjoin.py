"""Word sets against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from recordloom.operators import setjoin

WORDS = st.lists(st.sampled_from("abcdefghijklmno"), max_size=12, unique=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=25), WORDS, st.integers(1, 4), st.sampled_from([setjoin.by_matches, setjoin.by_overlap]))
def test_top_entries_equal_full_counting(entries, words, k, score):
    rows = [{"kind": "k" if i % 2 else "j", "id": f"{i:03}", "name": f"n{i}", "tokens": t} for i, t in enumerate(entries)]
    hits, known = setjoin.Index(rows).top(words, k, score)
    full = []
    for r in rows:
        m = len(set(words) & set(r["tokens"]))
        if m:
            full.append((-float(score(np.array([m]), len(words), np.array([len(r["tokens"])]))[0]), r["kind"], r["id"], m))
    assert [(-h[1], h[2], h[3], h[0]) for h in hits] == sorted(full)[:k]
    assert known == [w for w in words if any(w in t for t in entries)]


def rows_of_sets(rng, n):
    return [(i, sorted(rng.choice(list("abcdefghijklmnop"), rng.integers(0, 9), replace=False).tolist())) for i in range(n)]


@pytest.mark.parametrize("least", [0.5, 0.7, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    rng = np.random.default_rng(6)
    left, right = rows_of_sets(rng, 60), rows_of_sets(rng, 50)
    got = setjoin.similar_sets(spark.createDataFrame(left, "l long, words array<string>"), spark.createDataFrame(right, "r long, words array<string>"), least)
    want = {(i, j) for i, a in left for j, b in right if a and b and len(set(a) & set(b)) >= least * len(set(a) | set(b))}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cells_do_not_change_results(spark):
    rng = np.random.default_rng(7)
    entries = [("k", f"e{i}", f"n{i}", w) for i, w in rows_of_sets(rng, 40)]
    registry = spark.createDataFrame(entries, "kind string, id string, name string, tokens array<string>")
    texts = spark.createDataFrame([*rows_of_sets(rng, 30), (99, None)], "t long, words array<string>")
    one = setjoin.match_registry(texts, "t", registry, 3)
    many = setjoin.match_registry(texts, "t", registry, 3, words=30)
    assert len(setjoin.cells_of(registry, 30)) > 3
    plain = lambda df: sorted((r["t"], str(r["hits"]), tuple(sorted(r["covered"]))) for r in df.collect())
    assert plain(one) == plain(many)
