"""Near duplicates by one-permutation MinHash with optimal densification.

1. Sets: a document's distinct 5-word shingles as 64-bit hashes. Documents with equal sets form a
   class, found by a 128-bit digest of the sorted set; only one of each class goes on.
2. Signature: one hash per shingle; its top bits choose one of K bins, each bin keeps its least
   hash. An empty bin takes over the bin that its own sequence of hashed guesses meets first among
   the bins with content (the same guesses for all documents), so equal sets get equal signatures
   and each bin agrees with the probability of the sets' similarity.
3. Bands of R bins make buckets. With K = 192 and R = 6 a pair at similarity 0.85 misses every one
   of the 32 bands with probability (1 - 0.85^6)^32, about 3e-7.
4. Stars: a bucket offers only the pairs of its center with the rest, so pairs grow with members, not
   with their square. The center is the member with most bucket mates, which in a group of copies
   is the text that they were made from. Sizes that rule out the threshold are dropped at once.
   Links are confirmed on full sets and components taken. A bucket whose members do not all
   lie in one component gets further centers, GROWTH times as many each round, each paired with
   members of other components, until no such pair is left untried: pairs inside one component
   cannot change it, so nothing is lost and nothing is capped. Most buckets need one or two rounds.
   After the first round only shingles held in two components count: they bound the
   intersection of each pair, so noisy copies below the threshold are not sent to be confirmed.
   From then on a bucket is dealt into tiles of TILE by TILE ranks, so the number of tasks does not
   grow with the square of a hot bucket's bytes.

Sets and texts are never gathered: only the documents in candidate pairs are hashed again for the
confirming join. Equal keys are split by adaptive skew joins, and rows are pre-aggregated.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordloom.llm.common import prepare
from recordloom.session import discard, stored

SHINGLE = 5
BINS = 192
BAND = 6
PERCENT = 85
#: Centers of a bucket grow by this factor from round to round. A round costs several small jobs, so
#: few rounds with pairs still linear in the bucket's members are better than many.
GROWTH = 64
#: Bits of a set's occupancy map, see `possible`.
MAP_BITS = 256
#: The same for the few documents that go on after the first round, see `reachable`.
NEXT_BITS = 1024
#: Ranks of a bucket that meet as many others in one task after the first round, see `tiled`.
TILE = 2048
#: Bits of the map of documents whose sets are wanted (8 MB whatever their number; a full one lets all pass).
WANTED_BITS = 1 << 26
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (each input bit reaches all output bits)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Shingle sets of texts. Word hashes are kept between texts, up to a bound."""

    def __init__(self, shingle: int = SHINGLE, most_words: int = 100_000):
        self.shingle, self.most_words = shingle, most_words
        self.known: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self.known) >= self.most_words:
            self.known.clear()
        self.known[w] = h
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; fewer words than a shingle make one of them all, none make none."""
        words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and white space only
        if not words:
            return np.zeros(0, np.uint64)
        get, new = self.known.get, self.word
        h = np.array([get(w) or new(w) for w in words], np.uint64)
        n = min(self.shingle, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
        return np.unique(out)


def guesses(bins: int, tries: int) -> np.ndarray:
    """(bins, tries): the sequence of bins that each bin would take over."""
    seed = np.arange(bins * tries, dtype=np.uint64).reshape(bins, tries) + np.uint64(0x5EED)
    return (mix(mix(seed)) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """Least hash in each bin, empty bins filled from the first non-empty guess."""
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    place = mix(hashes)
    np.minimum.at(least, (place % np.uint64(bins)).astype(np.int64), place)
    full = np.zeros(bins, bool)
    full[(place % np.uint64(bins)).astype(np.int64)] = True
    todo, start = np.flatnonzero(~full), 0
    while len(todo) and start < order.shape[1]:
        tried = order[todo, start:start + 16]
        hit = full[tried]
        met = hit.any(axis=1)
        least[todo[met]] = least[tried[met, hit[met].argmax(axis=1)]]
        todo, start = todo[~met], start + 16
    least[todo] = least[np.flatnonzero(full)[0]]
    return least


def bands(sig: np.ndarray, band: int) -> np.ndarray:
    """One 64-bit key for each band."""
    out = np.arange(len(sig) // band, dtype=np.uint64)
    for k in range(band):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[k::band][:len(out)])
    return out.view(np.int64)


def occupancy(hashes: np.ndarray, size: int = MAP_BITS) -> np.ndarray:
    """One bit for each of `size` slots that any hash falls into, as 64-bit words."""
    met = np.zeros(size, bool)
    met[(mix(hashes) >> np.uint64(20)) % np.uint64(size)] = True
    return np.packbits(met).view(np.int64)


def possible(map_x: str, map_y: str, n_x: str, n_y: str, percent: int, size: int = MAP_BITS,
             left_x: str | None = None, left_y: str | None = None) -> Column:
    """False only for sets that cannot be similar enough: each slot that one set fills and the other
    does not holds at least one hash of its own, which bounds the intersection from above. With `left`,
    the maps are of so many hashes of each set, and those alone can be in the intersection."""
    def alone(one: str, other: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.get(one, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(i)))))
                                       for i in range(size // 64)]).cast("long")
    most = F.least(F.col(left_x or n_x) - alone(map_x, map_y), F.col(left_y or n_y) - alone(map_y, map_x))
    return most * (100 + percent) >= (F.col(n_x) + F.col(n_y)) * percent


def sketch(docs: DataFrame, bins: int = BINS, band: int = BAND, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), digest (null for an empty set), keys (one per band), slots (occupancy map)."""
    order = guesses(bins, 32 * bins)

    def rows(batches):
        hasher = Hasher(shingle)
        for batch in batches:
            sizes, digests, keys, slots = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = hasher.shingles(text)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(bands(signature(found, bins, order), band) if len(found) else np.zeros(0, np.int64))
                slots.append(occupancy(found))
            ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))),
                 pa.array(slots, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "keys", "slots"])

    prepare(docs.sparkSession)
    return _texts(docs).mapInArrow(rows, "doc_id long, n long, digest binary, keys array<long>, slots array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _slot(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(WANTED_BITS))


def wanted_map(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each doc_id, in bytes. Parts of it are made in the tasks; its size is fixed."""
    out = np.zeros(WANTED_BITS // 8, np.uint8)
    parts = (ids.select((_slot("doc_id") + 1).alias("at"))
             .groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    for r in parts.collect():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[(r["part"] - 1) * len(bits):r["part"] * len(bits)] = bits
    return out


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, wanted: np.ndarray | None = None) -> DataFrame:
    """doc_id and its whole set. With a `wanted` map, of the documents in it alone (and the few that share their bits),
    so that no text is moved to find them."""
    box = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches):
        hasher = Hasher(shingle)
        for batch in batches:
            if box is not None:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array(box.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            sets = [hasher.shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))],
                ["doc_id", "members"])
    return _texts(docs).where("doc_id is not null").withColumn("at", _slot("doc_id")).mapInArrow(rows, "doc_id long, members array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of `pairs` whose sets (of a and b) are similar enough: two joins, each splittable at a hot key.

    The center's set meets the others' in the task; it is never copied per pair through a shuffle.
    """
    b = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("_b"))
    a = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("_a"))
    joined = pairs.hint("merge").join(b.hint("merge"), "b").join(a.hint("merge"), "a")
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    counted = joined.select(*pairs.columns, common.alias("_c"), (F.size("_a") + F.size("_b")).cast("long").alias("_t"))
    return counted.where(F.col("_c") * 100 >= (F.col("_t") - F.col("_c")) * percent).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that can be reached. Labels spread along links and then jump to their
    label's label, so long chains halve; each round is written down, so lost executors cost little."""
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                  .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = stored(both.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("node"), F.least("u", "_v").alias("root")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("_near")))
        met = (labels.join(near, labels["node"] == near["u"]).select("node", "root", F.least("root", "_near").alias("_to")))
        jump = labels.select(F.col("node").alias("_to"), F.col("root").alias("_far"))
        fresh = stored(met.join(jump, "_to").select("node", "_far", F.col("root").alias("_was")))
        labels = fresh.select("node", F.col("_far").alias("root"))
        if fresh.where(F.col("_far") != F.col("_was")).isEmpty():
            return labels


def moved(rows: DataFrame, roots: DataFrame, label: str) -> DataFrame:
    """Rows with their label replaced by its root, where it has one."""
    to = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return (rows.join(to, rows[label] == to["_node"], "left")
            .withColumn(label, F.coalesce("_root", label)).drop("_node", "_root"))


def open_buckets(rows: DataFrame) -> DataFrame:
    """Rows (key, root, ...) of the buckets that hold more than one component."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi")
    return rows.join(mixed.select("key"), "key", "left_semi")


def reachable(rows: DataFrame, sets: DataFrame, percent: int, size: int = NEXT_BITS) -> DataFrame:
    """doc_id, n, left, slots of the sets of documents in `rows` that may yet be similar to one of another root.

    A shingle that the documents of a single root hold is in no intersection with another root's. `left` counts
    the others, of which a link needs `percent` of the set, and `slots` is their occupancy map. A document's
    sets are told apart, since maps of two must not be mixed.
    """
    each = (sets.join(rows.select("doc_id", "root").distinct(), "doc_id")
            .select("doc_id", "root", F.xxhash64("members").alias("_set"), F.size("members").cast("long").alias("n"), F.explode("members").alias("shingle")))
    met = each.groupBy("shingle").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("shingle")
    slot = F.pmod(F.xxhash64("shingle"), F.lit(size))
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    left = (each.drop("root").join(met, "shingle", "left_semi").groupBy("doc_id", "_set", "n")
            .agg(F.count("*").alias("left"), F.array(*[F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(size // 64)]).alias("slots")))
    return left.where(F.col("left") * 100 >= F.col("n") * percent).drop("_set")


def tiled(marked: DataFrame, take: int, percent: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b, ra, rb) of each bucket's first `take` ranks with its members of other roots that may be similar.

    `marked` holds a row for each set of a bucket's member: key, doc_id, root, at (rank from 1), size (of the bucket), n,
    left, slots, and `keys`, the open buckets of the document. A pair that shares several is offered only in the one of
    least key. Tiles are dealt out by name: Spark would split both sides of a hot key by their bytes and run a task for
    each two pieces, which the driver has to keep count of.
    """
    def side(rows: DataFrame, end: str, mine: str, other: str, reach: Column) -> DataFrame:
        tiles = F.floor((reach - 1) / tile)
        return (rows.select("key", *[F.col(c).alias(f"_{c}{end}") for c in ("doc_id", "root", "at", "n", "left", "slots", "keys")],
                            F.floor((F.col("at") - 1) / tile).alias(mine), F.explode(F.sequence(F.lit(0).cast("long"), tiles)).alias(other))
                .repartition("key", "_i", "_j"))
    centers = side(marked.where(F.col("at") <= take), "x", "_i", "_j", F.col("size"))
    crowd = side(marked, "y", "_j", "_i", F.least("size", F.lit(take).cast("long")))
    pairs = (centers.join(crowd, ["key", "_i", "_j"]).where("_rootx <> _rooty")
             .where((F.col("_aty") > take) | (F.col("_doc_idx") < F.col("_doc_idy")))  # two centers meet once
             .where(F.least("_nx", "_ny") * 100 >= F.greatest("_nx", "_ny") * percent)
             .where(F.least("_leftx", "_lefty") * (100 + percent) >= (F.col("_nx") + F.col("_ny")) * percent)
             .where(possible("_slotsx", "_slotsy", "_nx", "_ny", percent, NEXT_BITS, "_leftx", "_lefty"))
             # tested inside the join: a pair that shares many buckets leaves it once
             .where(F.array_min(F.array_intersect("_keysx", "_keysy")) == F.col("key")))
    return pairs.select(F.least("_doc_idx", "_doc_idy").alias("a"), F.greatest("_doc_idx", "_doc_idy").alias("b"),
                        F.least("_rootx", "_rooty").alias("ra"), F.greatest("_rootx", "_rooty").alias("rb")).distinct()


def link(docs: DataFrame, bins: int = BINS, band: int = BAND, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows that share a doc_id are one document. A null or empty text has the empty set, is linked
    with nothing and stays. A row with a null doc_id is linked with nothing: its component is null
    and it stays. An empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    rows = stored(sketch(docs, bins, band, shingle))
    whole = rows.where("n > 0 and doc_id is not null")
    classes = stored(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    # a document with several rows ties their classes together
    ties = (whole.join(classes.select("digest", "rep"), "digest").withColumn("a", F.min("rep").over(W.partitionBy("doc_id")))
            .where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    reps = whole.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest"])
    exploded = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    crowds = exploded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(exploded.join(crowds, "key").select("key", "doc_id", "n", "size"))
    # rank in a bucket: most bucket mates first
    rank = members.groupBy("doc_id").agg(F.sum("size").alias("mates"))
    members = stored(members.join(rank, "doc_id").select("key", "doc_id", "n", (-F.col("mates")).alias("mates")))
    involved = members.select("doc_id").distinct()
    near = shingle_sets(docs, shingle, wanted_map(involved))
    sets = stored(near.join(involved, "doc_id", "left_semi"))
    sketches = stored(reps.join(involved, "doc_id", "left_semi").select("doc_id", "slots"))

    def offered(centers: DataFrame, crowd: DataFrame) -> DataFrame:
        """Pairs of each bucket's center of the first round with its members of other components. ra and rb are the roots."""
        def side(rows: DataFrame, end: str) -> DataFrame:
            return rows.join(sketches, "doc_id").select(
                "key", F.col("doc_id").alias(end), F.col("n").alias(f"_n{end}"), F.col("root").alias(f"_r{end}"), F.col("slots").alias(f"_s{end}"))
        pairs = (side(centers, "x").join(side(crowd, "y"), "key").where("_rx <> _ry")
                 .where(F.least("_nx", "_ny") * 100 >= F.greatest("_nx", "_ny") * percent)
                 .where(possible("_sx", "_sy", "_nx", "_ny", percent)))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
                            F.least("_rx", "_ry").alias("ra"), F.greatest("_rx", "_ry").alias("rb")).distinct()

    # each round's links join components of the round before, so only roots are linked anew
    ties = stored(ties)
    merges = [] if ties.isEmpty() else [components(ties)]
    current = members.withColumn("root", F.col("doc_id"))
    for roots in merges:
        current = moved(current, roots, "root")
    take, spent = 1, []
    while True:
        # the buckets that still hold more than one component, and their next centers
        open_rows = stored(open_buckets(current))
        discard(*spent)  # tables of the round before, of which nothing more is read
        spent = []
        if take > 1 and not open_rows.isEmpty():
            # those that no document of another component can be similar to are tried with none
            fit, before = stored(reachable(open_rows, sets, percent)), open_rows
            bucket = W.partitionBy("key")
            open_rows = stored(open_buckets(before.join(fit, "doc_id", "left_semi"))
                               .withColumn("at", F.row_number().over(bucket.orderBy("mates", "doc_id")).cast("long"))
                               .withColumn("size", F.count("*").over(bucket)))
            discard(before)
        if open_rows.isEmpty():
            break
        # a few pairs of the first round come again in their bucket of least key; to confirm them
        # twice is cheaper than to keep and join away all pairs tried. Centers are done: all their
        # pairs in the bucket have been tried. A pair shut out of a bucket that is not its least one
        # stays in that: a bucket is open as long as it holds two components, so none misses its turn
        if take == 1:
            first = stored(open_rows.groupBy("key").agg(F.min(F.struct("mates", "doc_id", "n", "root")).alias("c"))
                           .select("key", "c.doc_id", "c.n", "c.root"))
            pairs, needed = stored(offered(first, open_rows)), sets
            current = open_rows.join(first.select("key", "doc_id"), ["key", "doc_id"], "left_anti")
            discard(sketches)
            spent = [first]
        else:
            keys = open_rows.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
            marked = stored(open_rows.drop("n", "mates").join(fit.join(keys, "doc_id"), "doc_id"))
            pairs = stored(tiled(marked, take, percent))
            discard(fit, marked)
            ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
            needed = sets.join(ends, "doc_id", "left_semi")  # few by now: the other sets are not moved
            current = open_rows.where(F.col("at") > take).drop("at", "size")
        spent += [open_rows, pairs]
        if not pairs.isEmpty():
            found = stored(confirm(pairs, needed, percent).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
            if not found.isEmpty():
                merges.append(components(found))
                current = moved(current, merges[-1], "root")
        take *= GROWTH
    by_class = classes.select("digest", F.col("rep").alias("component_id"))
    for roots in merges:
        by_class = moved(by_class, roots, "component_id")
    linked = whole.select("doc_id", "n", "digest").join(by_class, "digest").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents with all their columns, one of each component: that of the smallest doc_id.

    Rows that share a doc_id are one document and stay together; rows with a null doc_id all stay.
    """
    kept = link(docs, **settings).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    known = docs.where(F.col("doc_id").isNotNull())
    return known.join(kept, known["doc_id"] == kept["_kept"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
