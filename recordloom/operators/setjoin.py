"""Texts as word sets against a registry of word sets.

The registry is met in cells of bounded size. A cell is an inverted index that is broadcast; texts stream past one cell after
the other, and each text carries its best entries and covered words with it. So no row is made for a
text and an entry that share a word, and nothing is shuffled, whatever the texts or the registry hold.

Inside a cell words are taken from the rarest on. Once `k` entries have more matches than there are words left, an entry
not yet seen cannot come in, so the long postings of common words are only asked about entries already met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words of all entries of a cell: about 60 MB of index.
CELL_WORDS = 1_000_000
HIT = pa.struct([("matched", pa.int64()), ("score", pa.float64()), ("kind", pa.string()), ("id", pa.string()), ("name", pa.string())])
HIT_DDL = "array<struct<matched: bigint, score: double, kind: string, id: string, name: string>>"


class Index:
    """Entries in order of (kind, id), and the entries of each word."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["kind"] or "", r["id"] or ""))
        self.kind, self.id, self.name = ([r[c] for r in rows] for c in ("kind", "id", "name"))
        self.size = np.array([len(r["tokens"] or ()) for r in rows], np.int64)
        self.word: dict[str, int] = {}
        place = [(self.word.setdefault(w, len(self.word)), e) for e, r in enumerate(rows) for w in dict.fromkeys(r["tokens"] or ())]
        pairs = np.array(sorted(place), np.int64).reshape(-1, 2)
        self.entry = pairs[:, 1]
        self.begin = np.searchsorted(pairs[:, 0], np.arange(len(self.word) + 1))

    def top(self, words: list[str], k: int, score) -> tuple[list[tuple], list[str]]:
        """The k best entries by `score`(matches, words of the text, words of the entry), and the words that any entry has.

        A score that rises with the matches, by less than one for all else, makes the bound on unseen entries exact.
        """
        known = [w for w in words if w in self.word]
        if not known:
            return [], known
        at = np.array([self.word[w] for w in known], np.int64)
        often = self.begin[at + 1] - self.begin[at]
        order = at[np.argsort(often, kind="stable")]
        counts: dict[int, int] = {}
        for n, w in enumerate(order.tolist()):
            posting, left = self.entry[self.begin[w]:self.begin[w + 1]], len(order) - n
            # matches of the k-th best so far; those left could at most make an unseen entry reach `left`
            if len(counts) >= k and len(posting) > len(counts) and np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -k)[-k] > left:
                met = np.fromiter(counts, np.int64, len(counts))
                found = posting[np.minimum(np.searchsorted(posting, met), len(posting) - 1)] == met
                for e in met[found].tolist():
                    counts[e] += 1
            else:
                for e in posting.tolist():
                    counts[e] = counts.get(e, 0) + 1
        entry = np.fromiter(counts, np.int64, len(counts))
        matched = np.fromiter(counts.values(), np.int64, len(counts))
        value = score(matched, len(words), self.size[entry])
        best = np.lexsort((entry, -value))[:k]
        return [(int(matched[i]), float(value[i]), self.kind[entry[i]], self.id[entry[i]], self.name[entry[i]]) for i in best], known


def by_matches(matched, n_text, n_entry):
    return matched.astype(np.float64)


def by_overlap(matched, n_text, n_entry):
    """Shared words, then the share of both sets that they make."""
    return matched + matched / (n_text + n_entry - matched)


def cells_of(registry: DataFrame, words: int = CELL_WORDS) -> list[Column]:
    """Filters that cut a registry (kind, id, name, tokens) into cells of about so many words."""
    total = registry.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // words))
    return [F.pmod(F.xxhash64("kind", "id"), F.lit(n)) == i for i in range(n)]


def match_registry(texts: DataFrame, key: str, registry: DataFrame, k: int, score=by_matches, words: int = CELL_WORDS) -> DataFrame:
    """key, words, hits (the k best entries as structs, best first; ties by kind, then id), covered (words that any entry has).

    `texts` has the key and `words`, an array of distinct words; null counts as empty.
    """
    spark = texts.sparkSession
    kind = texts.schema[key].dataType
    out = texts.select(key, F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.array().cast(HIT_DDL).alias("hits"),
                       F.array().cast("array<string>").alias("covered"))
    for cell in cells_of(registry, words):
        # a cell has a bounded number of words
        rows = registry.where(cell).select("kind", "id", "name", "tokens").collect()
        box = spark.sparkContext.broadcast(Index(rows))

        def meet(batches, box=box):
            for batch in batches:
                hits, covered = [], []
                for ws, old, had in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    new, known = box.value.top(ws, k, score)
                    both = [tuple(h.values()) for h in old] + new
                    hits.append([dict(zip(HIT.names, h)) for h in sorted(both, key=lambda h: (-h[1], h[2] or "", h[3] or ""))[:k]])
                    covered.append(list(dict.fromkeys(had + known)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.list_(HIT)), pa.array(covered, pa.list_(pa.string()))],
                                                 [key, "words", "hits", "covered"])
        out = out.mapInArrow(meet, f"`{key}` {kind.simpleString()}, words array<string>, hits {HIT_DDL}, covered array<string>")
    return out


def similar_sets(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(l, r) of all pairs of non-empty word sets with Jaccard similarity of at least `least`: left (l, words), right (r, words).

    Words are ordered by how many right sets hold them, rare ones first. Two sets that similar share a word of the first
    n - ceil(least * n) + 1 of each, so only these words are joined, and sizes are compared before the sets are.
    """
    often = right.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        sets = df.select(name, F.array_distinct("words").alias("words")).where(F.size("words") > 0)
        ranked = (sets.select(name, F.explode("words").alias("w")).join(often, "w", "left").groupBy(name)
                  .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("s")))
        kept = F.slice("s", F.lit(1), (F.size("s") - F.ceil(F.size("s") * least) + 1).cast("int"))
        return ranked.select(name, F.transform("s", lambda x: x["w"]).alias(f"_{name}"), F.explode(F.transform(kept, lambda x: x["w"])).alias("w"))
    a, b = F.size("_l"), F.size("_r")
    shared = F.size(F.array_intersect("_l", "_r"))
    return (prefixes(left, "l").join(prefixes(right, "r"), "w").where((a >= least * b) & (b >= least * a))
            .where(shared >= least * (a + b - shared)).select("l", "r").distinct())
