"""Language-model scoring with a log-frequency Bloom filter.

The filter holds n-gram counts, quantised by their logarithm: an n-gram seen c times enters
1 + floor(log2 c) times, once under each level from 1 up. A lookup probes level after level until a
miss; the last level found gives the count back, and errors can only raise it. Probabilities are
bigrams smoothed with unigrams, both from probes.

N-grams are keyed by 64-bit hashes of their words, so every word of the corpus and every bigram
enters, however rare; no vocabulary is collected for the model. Segments of the filter grow in number
with the text that teaches and are sized for their own entries, of which none is left out. No task or
driver holds a filter, and n-grams travel once: texts are taken in chunks of a bounded number of
tokens, which send their distinct n-grams to the segments, with the number of times that teaching
texts hold them. A segment sums these, is built, and answers all chunks in the order asked. What a
chunk needs besides (its words by number, and their hashes) goes along and meets the answers.

Words travel as they are and are counted exactly; the segments answer those counts too. A pair needs
40 bits inside its segment, where some 10^6 entries make an equal one less likely by far than a false hit
of the filter.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import prepare
from recordloom.llm.near_dedup import Hasher
from recordloom.session import stored

#: Characters of teaching texts for each segment, so that segments grow in number and not in size.
SEGMENT_CHARS = 1 << 23
BITS_PER_ENTRY = 12
HASHES = 4
#: Segments at least.
SEGMENTS = 256
UNIGRAM_SHARE = 0.4
#: Tokens of a chunk of texts, whose n-grams are sent together; a longer text is a chunk by itself.
CHUNK = 1 << 20
#: Bytes that travel of a pair's key, and of the words' hashes that it is made from.
KEY_BYTES = 5
#: No word holds white space, so this one is free for the end of a text.
END = "\n"
BEGIN, _SINGLE, _STEP = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words with ASCII letters in lower case, then the end."""
    return [*(text or "").encode("utf-8").lower().split(), END.encode()]


def count_at(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 at level 0."""
    return np.where(level > 0, 0.75 * 2.0 ** level - 0.5, 0.0)


def segment_of(keys: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(0x51)) % np.uint64(segments)).astype(np.int64)


def bits_of(keys: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """The k-th bit, inside its segment, of an n-gram at a level."""
    seed = np.uint64((level * HASHES + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(mix(keys.astype(np.uint64)) + seed) % np.uint64(bits)).astype(np.int64)


def build_segment(keys: np.ndarray, levels: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = keys[levels >= level]
        for k in range(HASHES):
            out[bits_of(some, level, k, bits)] = True
    return np.packbits(out, bitorder="little").tobytes()


class Filter:
    """Finished segments, all of a filter or one alone: `table` is (segments, bytes)."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level reached without a miss, for each n-gram."""
        out = np.zeros(len(keys), np.int64)
        alive, segments, level = np.arange(len(keys)), segment_of(keys, len(self.table)), 1
        while len(alive):
            for k in range(HASHES):
                bit = bits_of(keys[alive], level, k, self.bits)
                alive = alive[self.table[segments[alive], bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
            out[alive] = level
            level += 1
        return out


def hashes_of(words: list[bytes], hasher: Hasher) -> np.ndarray:
    get, new = hasher.known.get, hasher.word
    return np.array([get(w) or new(w) for w in words], np.uint64)


def single_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ _SINGLE).view(np.int64)


def pairs_of(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, segments: int) -> tuple[np.ndarray, ...]:
    """Of a chunk's tokens (numbers of words, whose hashes are given): the distinct pairs' keys, each token's
    place among them, their segments and the order by segment. BEGIN stands before each text."""
    h = hashes[ids]
    before = np.concatenate([h[:1], h[:-1]])
    before[starts] = BEGIN
    keys, back = np.unique(mix(before * _STEP + mix(h)).view(np.int64), return_inverse=True)
    segment = segment_of(keys, segments)
    return keys, back, segment, np.argsort(segment, kind="stable")


def pack(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def unpack(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def shortened(x: np.ndarray) -> bytes:
    """The lower KEY_BYTES of 64-bit numbers."""
    return x.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def lengthened(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of bytes, of which the upper ones are nearly all 0, compressed."""
    return pack(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


#: A row for each chunk and segment: pairs, words and how often each is taught; and one for the chunk, at a segment of
#: its own below 0: its tokens, where texts start, the words' hashes and the texts' rows.
SENT = pa.schema([("segment", pa.int64()), ("chunk", pa.int64()), ("pairs", pa.binary()), ("pair_times", pa.binary()), ("words", pa.binary()), ("word_times", pa.binary()),
                  ("ids", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("outs", pa.list_(pa.bool_()))])
SENT_DDL = ("segment long, chunk long, pairs binary, pair_times binary, words binary, word_times binary, "
            "ids binary, starts binary, hashes binary, doc_ids array<long>, outs array<boolean>")
#: The answers, and the chunk's own row as it came. The first row of a segment says what it was taught.
ANSWER = pa.schema([("segment", pa.int64()), ("chunk", pa.int64()), ("pair_levels", pa.binary()), ("word_levels", pa.binary()), ("word_counts", pa.binary()),
                    ("types", pa.int64()), ("total", pa.int64()), ("mass", pa.float64()),
                    ("ids", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("outs", pa.list_(pa.bool_()))])
ANSWER_DDL = ("segment long, chunk long, pair_levels binary, word_levels binary, word_counts binary, types long, total long, mass double, "
              "ids binary, starts binary, hashes binary, doc_ids array<long>, outs array<boolean>")


def batch_of(schema: pa.Schema, n: int, **columns):
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def sent(texts: DataFrame, segments: int, chunk: int = CHUNK) -> DataFrame:
    """The rows of SENT for texts (doc_id, text, held_out)."""
    def rows(batches):
        hasher, at = Hasher(), TaskContext.get().partitionId() << 40
        number, tokens, ids, outs, n = defaultdict(), [], [], [], 0
        number.default_factory = number.__len__

        def flush():
            sizes, all_ = [len(x) for x in tokens], np.concatenate(tokens)
            starts = np.cumsum([0, *sizes[:-1]])
            # numbered by frequency, which makes the numbers small and similar
            ranked, words = np.argsort(-np.bincount(all_), kind="stable"), list(number)
            all_, words = np.argsort(ranked)[all_], [words[i] for i in ranked]
            hashes = hashes_of(words, hasher)
            packed = shortened(hashes)
            taught = np.repeat(~np.array(outs, bool), sizes).astype(np.float64)
            keys, back, segment, order = pairs_of(all_, starts, lengthened(packed), segments)
            times = np.bincount(back, weights=taught, minlength=len(keys))[order]
            of_word = segment_of(single_keys(lengthened(packed)), segments)
            word_order = np.argsort(of_word, kind="stable")
            word_times = np.bincount(all_, weights=taught, minlength=len(words))[word_order]
            met = np.unique(np.concatenate([segment, of_word]))
            cut, word_cut = ([*np.searchsorted(x, met).tolist(), len(x)] for x in (segment[order], of_word[word_order]))
            ranges = list(zip(cut[:-1], cut[1:], word_cut[:-1], word_cut[1:]))
            yield batch_of(SENT, len(met), segment=met, chunk=[at] * len(met), pairs=[shortened(keys[order[a:b]]) for a, b, _, _ in ranges],
                           pair_times=[planes(times[a:b]) for a, b, _, _ in ranges],
                           words=[pack(b" ".join([words[i] for i in word_order[c:d]])) for _, _, c, d in ranges],
                           word_times=[planes(word_times[c:d]) for _, _, c, d in ranges])
            yield batch_of(SENT, 1, segment=[-1 - at], chunk=[at], ids=[planes(all_)], starts=[planes(starts)], hashes=[packed], doc_ids=[ids], outs=[outs])

        for batch in batches:
            for i, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                if tokens and n + len(words) > chunk:
                    yield from flush()
                    number.clear()
                    tokens, ids, outs, n, at = [], [], [], 0, at + 1
                tokens.append(np.array([number[w] for w in words], np.int64))
                ids.append(i)
                outs.append(out)
                n += len(words)
        if tokens:
            yield from flush()

    return texts.select("doc_id", "text", "held_out").mapInArrow(rows, SENT_DDL)


class Segment:
    """What all chunks sent to a segment: its distinct pairs and words, their places in the rows, exact counts, and the filter."""

    def __init__(self, group: pa.Table):
        rows = {c: group[c].to_pylist() for c in ("pairs", "pair_times", "words", "word_times")}
        self.pair_ends = np.cumsum([len(x) // KEY_BYTES for x in rows["pairs"]])
        pairs, self.pair_at = np.unique(lengthened(b"".join(rows["pairs"])).view(np.int64), return_inverse=True)
        word_times = [from_planes(x) for x in rows["word_times"]]
        self.word_ends = np.cumsum([len(x) for x in word_times])
        words = [w for x, t in zip(rows["words"], word_times) if len(t) for w in unpack(x).split(b" ")]
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.words, self.word_at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        pair_counts = np.bincount(self.pair_at, weights=np.concatenate([from_planes(x) for x in rows["pair_times"]]), minlength=len(pairs))
        self.counts = np.bincount(self.word_at, weights=np.concatenate(word_times), minlength=len(self.words)).astype(np.int64)
        self.keys = np.concatenate([single_keys(hashes_of(self.words, Hasher())), pairs])
        # the exponent of a count is its level
        self.levels = np.frexp(np.concatenate([self.counts, pair_counts]))[1]
        self.bits = 8 * max(128, math.ceil(int(self.levels.sum()) * BITS_PER_ENTRY / 8))
        self.filter = build_segment(self.keys, self.levels, self.bits)

    def answers(self, group: pa.Table) -> pa.Table:
        found = Filter(np.frombuffer(self.filter, np.uint8).reshape(1, -1), self.bits).levels(self.keys).astype(np.uint8)
        n = len(self.words)
        pairs, words, counts = found[n:][self.pair_at], found[:n][self.word_at], self.counts[self.word_at]
        mass = float(count_at(self.levels[:n].astype(np.float64)).sum())
        rest = [0] * (len(group) - 1)
        return pa.Table.from_batches([batch_of(
            ANSWER, len(group), segment=group["segment"].to_pylist(), chunk=group["chunk"].to_pylist(),
            pair_levels=[pack(x.tobytes()) for x in np.split(pairs, self.pair_ends[:-1])],
            word_levels=[pack(x.tobytes()) for x in np.split(words, self.word_ends[:-1])],
            word_counts=[planes(x) for x in np.split(counts, self.word_ends[:-1])],
            types=[int((self.counts > 0).sum()), *rest], total=[int(self.counts.sum()), *rest], mass=[mass, *rest])])


def build(texts: DataFrame, segments: int) -> DataFrame:
    """segment, bits, words, counts: the filter of all words, ends included, and all bigrams of texts (by the lower
    KEY_BYTES of their keys), and the words' exact counts."""
    def one(group: pa.Table) -> pa.Table:
        made = Segment(group)
        return pa.table({"segment": group["segment"][:1], "bits": pa.array([made.filter], pa.binary()),
                         "words": pa.array([[w.decode() for w in made.words]], pa.list_(pa.string())), "counts": pa.array([made.counts], pa.list_(pa.int64()))})

    all_ = texts.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("held_out"))
    return (sent(all_, segments).where("segment >= 0").groupBy("segment")
            .applyInArrow(one, "segment long, bits binary, words array<string>, counts array<long>"))


def answered(rows: DataFrame) -> DataFrame:
    """The rows of ANSWER for those of SENT: a segment is built of all its rows and answers each of them."""
    def one(group: pa.Table) -> pa.Table:
        if group["segment"][0].as_py() >= 0:
            return Segment(group).answers(group)
        return pa.table([group[f.name] if f.name in group.column_names else pa.nulls(len(group), f.type) for f in ANSWER], schema=ANSWER)

    return rows.groupBy("segment").applyInArrow(one, ANSWER_DDL)


def score(docs: DataFrame, held_out: Column, frequent: int = 0, model_words: int | None = None,
          segment_chars: int = SEGMENT_CHARS, chunk: int = CHUNK, broadcast_bytes: int = 0) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where `held_out` is false or null teach, all rows are scored. A null text is an empty one,
    whose only token is the end. Repeated rows teach as often as they stand. Without any training
    token counts are 0 and probabilities those of smoothing alone. base_score is exact; score is the
    model's log10 probability. `frequent`, `model_words` and `broadcast_bytes` are taken for older callers and limit nothing.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.coalesce(held_out, F.lit(False)).alias("held_out"))
    segments = max(SEGMENTS, 1 + source.where(~F.col("held_out")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // segment_chars)
    table = stored(answered(sent(source, segments, chunk)))
    types, total, mass = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "total", "mass")]).first()

    def one(group: pa.Table) -> pa.Table:
        own = group.filter(pc.less(group["segment"], 0)).to_batches()[0]
        answers = group.filter(pc.greater_equal(group["segment"], 0)).sort_by("segment")
        ids, starts = from_planes(own["ids"][0].as_py()), from_planes(own["starts"][0].as_py())
        hashes = lengthened(own["hashes"][0].as_py())
        keys, back, _, order = pairs_of(ids, starts, hashes, segments)
        word_order = np.argsort(segment_of(single_keys(hashes), segments), kind="stable")
        level, single, c = np.zeros(len(keys)), np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        level[order] = np.frombuffer(b"".join(unpack(x) for x in answers["pair_levels"].to_pylist()), np.uint8)
        single[word_order] = np.frombuffer(b"".join(unpack(x) for x in answers["word_levels"].to_pylist()), np.uint8)
        c[word_order] = np.concatenate([from_planes(x) for x in answers["word_counts"].to_pylist()])
        single = count_at(single)
        # the beginning is a context once for each end, so it shares the end's unigram
        context = np.concatenate([ids[:1], ids[:-1]])
        context[starts] = ids[-1]
        share = np.minimum(1.0, count_at(level)[back] / np.maximum(1.0, single[context]))
        alone = (single + 0.5) / (mass + 0.5 * (types + 1))
        each = np.log10((1 - UNIGRAM_SHARE) * share + UNIGRAM_SHARE * alone[ids])
        base = np.log10((c + 0.5) / (total + 0.5 * (types + 1)))[ids]
        n = len(starts)
        return pa.table({"doc_id": own["doc_ids"].flatten(), "held_out": own["outs"].flatten(), "n_tokens": np.diff([*starts, len(ids)]),
                         "n_known": np.add.reduceat((c > 0)[ids].astype(np.int64), starts), "train_tokens": np.full(n, total, np.int64),
                         "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(each, starts)})

    return table.groupBy("chunk").applyInArrow(
        one, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
