"""Runs (maximal repetitions) in the word sequence of every document.

A run is a stretch whose smallest period q divides it at least three times and that no neighbouring
word extends. Two equal stretches w[i:i+l] = w[j:j+l], with i < j, that can be extended neither to the left
nor to the right are a maximal pair. If their distance d = j - i is at most l / 2, then [i, j+l) has period d,
length l + d >= 3 d, and no word beside it keeps the period: the pair is a run as it stands, nothing
has to be extended. A run shows up once for each multiple d of its period that fits three times; the
smallest d is its period.

Maximal pairs come from the LCP-interval tree of the document's suffixes, walked bottom up. A pair
of one node is two suffixes of different children (not extendable to the right) that differ in the word on
their left. Each node holds its suffixes in one sorted list, and each suffix has the class of its left
word. By the periodicity lemma all suffixes of a node that lie within l / 2 of a suffix p stand
in one arithmetic progression inside one run, so all but the run's first have one left class: only the
first of the stretch has to be looked at on the left of p, and on the right either all pair with p or none
does. Lists are joined smaller into larger, so a document of n words takes O(n log n) searches, and
there are at most as many pairs as the runs' exponents add up to, which is linear in n.

A run of length L >= max(24, 3q) has l = L - q >= 16. Documents without any 16 words that come
twice are thus passed on at once, and in the others only intervals of 16 words or more are walked.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import prepare

LEAST_LENGTH = 24
LEAST_PERIODS = 3
#: Odd multiplier of the window hashes.
SALT = 0x9E3779B97F4A7C15


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The word sequence with the period that the query's contract plants in a tenth of the documents."""
    n = len(words)
    if not n or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[:n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    number = dict(zip(dict.fromkeys(words), range(len(words))))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeats_window(ids: np.ndarray, size: int) -> bool:
    """Whether some `size` neighbouring words may come twice (by 64-bit hashes: never a false no)."""
    if len(ids) <= size:
        return False
    h, have, factor = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(SALT), 1, SALT
    h ^= h >> np.uint64(29)
    while have < size:  # twice as many words a round, or as many as are still wanted
        step = min(have, size - have)
        h = h[:len(h) - step] * np.uint64(factor) + h[step:]
        have += step
        factor = factor * factor % (1 << 64)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in an order that keeps common prefixes together, and the common prefix of neighbours.

    Ranks by 1, 2, 4, ... words; only suffixes whose rank is still shared are sorted again. The ranks of all
    rounds give the common prefixes by steps of falling powers of two.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, width = [rank], 1
    while True:
        shared = ~(new & np.concatenate([new[1:], [True]]))
        at = np.flatnonzero(shared)
        if not len(at):
            break
        who = order[at]
        ahead = who + width
        behind = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        sub = np.lexsort((behind, rank[who]))
        order[at], behind, old = who[sub], behind[sub], rank[who[sub]]
        fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (behind[1:] != behind[:-1])])
        new[at] = fresh
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[order[at]] = first
        levels.append(rank)
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        live = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[live] = levels[k][a[live]] == levels[k][b[live]]
        # suffixes that end within the step have a rank of their own, so equal ranks are whole steps
        step = np.where(same, 1 << k, 0)
        common += step
        a += step
        b += step
    return order, common


def _join(length: int, one: list[int], two: list[int], left: list[int], least: int, periods: int, found: dict) -> list[int]:
    """Report the maximal pairs between two children of a node of `length` words, and join their lists."""
    if len(one) < len(two):
        one, two = two, one
    reach = length // (periods - 1)
    for p in two:
        k = bisect_left(one, p - reach)
        if k < len(one) and (x := one[k]) < p and left[x] != left[p] and length + p - x >= least:
            span = (x, p + length)
            if found.get(span, p + 1) > p - x:
                found[span] = p - x
        k = bisect_right(one, p)
        while k < len(one) and (y := one[k]) <= p + reach and left[y] != left[p]:
            if length + y - p >= least:
                span = (p, y + length)
                if found.get(span, y + 1) > y - p:
                    found[span] = y - p
            k += 1
    if len(two) <= 4:
        for p in two:
            insort(one, p)
    else:
        one += two
        one.sort()  # two sorted stretches: merged in linear time
    return one


def runs(ids: np.ndarray, least: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and `periods` periods, by start, then period."""
    shortest = least - least // periods  # of the common prefix of a pair
    if len(ids) < least or not repeats_window(ids, shortest):
        return []
    order, common = suffix_array(ids)
    inside = np.flatnonzero(common >= shortest)
    if not len(inside):
        return []
    left = np.concatenate([[-1], ids[:-1]]).tolist()
    found: dict[tuple[int, int], int] = {}
    cuts = np.flatnonzero(np.diff(inside) > 1) + 1
    for block in np.split(inside, cuts):  # one subtree of the interval tree each
        stack: list[tuple[int, list[int]]] = []
        suffixes = order[block[0]:block[-1] + 2].tolist()
        for suffix, following in zip(suffixes, [*common[block].tolist(), 0]):
            held = [suffix]
            while stack and stack[-1][0] > following:
                length, positions = stack.pop()
                held = _join(length, positions, held, left, least, periods, found)
            if stack and stack[-1][0] == following:
                stack[-1] = (following, _join(following, stack[-1][1], held, left, least, periods, found))
            elif following:
                stack.append((following, held))
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run, or only in a first period of runs."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties by start, then period."""
    best = None
    for run in found:  # they come by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find(docs: DataFrame, least: int = LEAST_LENGTH, periods: int = LEAST_PERIODS, change=None) -> DataFrame:
    """doc_id, runs (array of start, length, period), collapsed (text without the repeats): one row per input row.

    Words are runs free of ASCII white space. `change(words, doc_id)` may replace the words first. A
    null or empty text has no words, no runs and an empty `collapsed`; copies get equal rows, a null doc_id stays null,
    and an empty table gives an empty one. Rows need no shuffle; other columns are ignored. Memory
    follows the longest text of a batch (about 300 bytes a word where it repeats, 60 else).
    """
    prepare(docs.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches):
        for batch in batches:
            keys, out, texts = batch.column(0).to_pylist(), [], []
            for k, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if change is not None:
                    words = change(words, keys[k])
                found = runs(numbered(words), least, periods)
                out.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(without_repeats(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(run_type)), pa.array(texts, pa.binary()).cast(pa.string())],
                                             ["doc_id", "runs", "collapsed"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        rows, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: the strongest run, and digests of all runs and of the collapsed text."""
    found = find(docs, change=planted)
    # exact comparison of length / period: cross products, the earlier one wins a tie
    best = F.aggregate("runs", F.element_at("runs", 1), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("b"), listed.alias("listed"))
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"),
                      F.col("b.period").alias("period"), F.expr("1000 * b.length div b.period").alias("exponent_milli"),
                      F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
