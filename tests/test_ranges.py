"""Files in byte ranges against the whole-text chunker."""

import random

import pytest

from recordloom.functions.chunking import chunk_lines
from recordloom.sources import ranges


def file_text(rng, kind):
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", " ", "\x85"] if kind % 3 == 0 else ["\n"]
    lines = []
    for _ in range(rng.randrange(1, 120)):
        size = rng.choice([0, 3, 10, 40, 40, 80, 200]) if rng.random() < 0.97 else rng.randrange(300, 1500)
        lines.append("".join(rng.choice("abc é日 def") for _ in range(size)) + rng.choice(ends))
    text = "".join(lines)
    return text.rstrip("\n\r") + ("x" if kind % 2 else "\n")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng, texts = tmp_path_factory.mktemp("tree"), random.Random(8), {}
    for k in range(9):
        folder = root / f"source=s{k % 3}"
        folder.mkdir(exist_ok=True)
        texts[f"source=s{k % 3}/f{k}.txt"] = file_text(rng, k)
    texts["source=s0/empty.txt"] = ""
    texts["source=s0/one.txt"] = "one line"
    texts["source=s0/wide.txt"] = "w" * 5000 + "\n" + "v" * 401 + "\nshort"
    for name, text in texts.items():
        (root / name).write_bytes(text.encode())
    (root / "node_modules").mkdir()
    (root / "node_modules" / "no.txt").write_text("left out\n")
    (root / "latin.md").write_bytes(b"caf\xe9\nplain\n")
    return str(root), texts


@pytest.mark.parametrize("range_bytes, broadcast", [(701, 100_000), (1500, 0)])
def test_ranges_cut_like_whole_texts(spark, tree, range_bytes, broadcast):
    root, texts = tree
    rule = {"target": 64, "least": 20, "most": 96}
    got = ranges.chunk_files(spark, root, [".txt"], range_bytes=range_bytes, broadcast_ranges=broadcast, **rule)
    whole = chunk_lines(spark.createDataFrame(sorted(x for x in texts.items() if x[1]), "file string, text string"), "file", "text", **rule)
    order = lambda df: sorted(tuple(r) for r in df.select("file", "chunk_index", "chunk_of", "line_start", "line_end", "content").collect())
    assert order(got) == order(whole)


def test_other_files(spark, tree):
    root, _ = tree
    assert [r["content"] for r in ranges.chunk_files(spark, root, [".md"]).collect()] == ["café\nplain\n"]
    assert ranges.chunk_files(spark, root, [".none"]).collect() == []


def test_summary_equals_line_by_line():
    rng, rule = random.Random(2), ranges.Rule(8, 3, 12)
    for _ in range(2000):
        before, inside = ([rng.choice([1, 2, 5, 9, 20, 30, 36, 60, 130]) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        a = rule.begin()
        for length in before:
            rule.line(a, length)
        b = dict(a)
        for length in inside:
            rule.line(a, length)
        import numpy as np
        rule.apply(b, rule.summary(np.array(inside, np.int64)))
        assert a == b, (before, inside)


def test_small_ranges_share_tasks(spark, tree):
    root, texts = tree
    lines = ranges._lines(ranges._session(spark, 101), root, [".txt"], [])
    most = ranges.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert lines.select("file", "block").distinct().count() > 2 * most >= lines.rdd.getNumPartitions()
    rule = {"target": 64, "least": 20, "most": 96}
    order = lambda df: sorted(tuple(r) for r in df.select("file", "chunk_index", "content").collect())
    fine, coarse = (ranges.chunk_files(spark, root, [".txt"], range_bytes=n, **rule) for n in (101, 1 << 20))
    assert order(fine) == order(coarse)
