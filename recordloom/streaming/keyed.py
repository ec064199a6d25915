"""State per chain in a state store: verification and sealing of records as they arrive.

Records may arrive out of order: one whose predecessor is missing waits in the chain's map state. With a `delay` (how late a record may be
by its own time) a timer judges a hole, as the batch operators judge it, once the watermark has passed the record behind it;
without one that is done in the same micro-batch. Records at or below the chain's place were passed
before and are ignored, so a replayed part changes nothing.

Chains are dealt by their hash to a fixed number of buckets, of some pages each. Spark calls a processor, and moves frames to
and from it, once for each bucket, and the state of a page's chains is read and written as one text, so a micro-batch makes no
call, frame or round trip to the store for a chain. It rewrites the pages of the chains it touches and no others.

Hashes are recomputed row-parallel in the JVM; what reaches a chain's state is a narrow row without its content.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from recordloom.fixed_values import GENESIS_PRIOR_HASH, MERKLE_BATCH
from recordloom.operators import integrity

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting rows of one bucket that a task keeps in memory; more of them go to the state store at once.
HELD = 50_000
#: Groups that keys are dealt to, and pages of state in each. State is kept by them, so they stay for a stream's life.
BUCKETS, PAGES = 1024, 16


def use_keyed_state(spark: SparkSession) -> None:
    """Map and list state need the store with an on-disk backend; queries already running keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_buckets(rows: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Adds bucket and page of the keys, and the chain's name: text, as a null would make numbers of other chains inexact."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(buckets * PAGES))
    return rows.select((slot % buckets).cast("int").alias("bucket"), F.floor(slot / buckets).cast("int").alias("page"),
                       F.coalesce(F.col("chain_id").cast("string"), F.lit("")).alias("chain"), *[c for c in rows.columns if c != "chain_id"])


def chain_of(name: str) -> int | None:
    return int(name) if name else None


class Pages:
    """State of many keys: a page of them is one JSON text, read when a key of it comes up and written once if it changed."""

    def __init__(self, handle):
        self.texts = handle.getMapState("pages", "page int", "entries string")
        self.open, self.changed = {}, set()

    def page(self, page: int) -> dict:
        if page not in self.open:
            got = self.texts.getValue((page,))
            self.open[page] = {} if got is None else json.loads(got[0])
        return self.open[page]

    def put(self, page: int, key: str, entry: list) -> None:
        if self.page(page).get(key) != entry:
            self.open[page][key] = entry
            self.changed.add(page)

    def write(self) -> None:
        """At the end of a call, which is that of one bucket."""
        for page in self.changed:
            self.texts.updateValue((page,), (json.dumps(self.open[page], separators=(",", ":")),))
        self.open, self.changed = {}, set()


class Chain:
    """What a call knows of one chain: its place and state, rows in memory and the number of rows in the store."""
    __slots__ = ("page", "name", "following", "stored", "state", "held")

    def __init__(self, page: int, name: str, following: int, stored: int, state: list):
        self.page, self.name, self.following, self.stored, self.state, self.held = page, name, following, stored, state, {}


class InOrder(StatefulProcessor):
    """Hands the rows of each chain on by index. Subclasses say what a row does to its chain's state and emits."""

    #: Payload columns beside idx and their state types.
    payload: tuple[str, ...]
    kinds: str
    output: tuple[str, ...]

    def __init__(self, waits: bool = False):
        self.waits = waits

    def init(self, handle) -> None:
        self.handle, self.passed = handle, None
        self.pages = Pages(handle)
        self.waiting = handle.getMapState("waiting", "page int, chain string, idx long", f"{self.kinds}, ts_ms long")

    def start(self) -> list: ...

    def take(self, chain: int | None, state: list, idx: int, row: tuple, gap: bool) -> list[tuple]: ...

    def load(self, state: list) -> list:
        """The state as `take` changes it, from its stored form; `save` is the way back."""
        return state

    def save(self, state: list) -> list:
        return state

    def _restore(self, page: int, name: str) -> Chain:
        following, stored, *state = self.pages.page(page).get(name) or (0, 0, *self.start())
        return Chain(page, name, following, stored, self.load(state))

    def _store(self, c: Chain) -> None:
        self.pages.put(c.page, c.name, [c.following, c.stored, *self.save(c.state)])

    def _pass(self, c: Chain, idx: int, row: tuple, emit) -> None:
        emit += self.take(chain_of(c.name), c.state, idx, row, idx != c.following)
        c.following = idx + 1

    def _out(self, c: Chain, idx: int) -> tuple:
        """A waiting row out of memory or the store."""
        if idx in c.held:
            return c.held.pop(idx)
        row = tuple(self.waiting.getValue((c.page, c.name, idx)))
        self.waiting.removeKey((c.page, c.name, idx))
        c.stored -= 1
        return row

    def _advance(self, c: Chain, emit) -> None:
        """Pass on all rows that follow without a hole, from memory or the store."""
        while c.following in c.held or c.stored and self.waiting.containsKey((c.page, c.name, c.following)):
            self._pass(c, c.following, self._out(c, c.following), emit)

    def _stored(self) -> dict:
        """Indexes in the store by page and chain."""
        out: dict = {}
        for page, name, idx in list(self.waiting.keys()):
            out.setdefault((page, name), []).append(int(idx))
        return out

    def _over_holes(self, c: Chain, stored: list, emit, until=None) -> None:
        """Judge what waits, in order, each first row behind a hole as such; with `until`, rows up to that time."""
        for idx in sorted({*c.held, *stored}):
            if until is not None and idx > c.following and self.waiting.getValue((c.page, c.name, idx))[-1] > until:
                break
            row = self._out(c, idx)
            if idx >= c.following:
                self._pass(c, idx, row, emit)

    def _frame(self, emit) -> pd.DataFrame:
        return pd.DataFrame(emit, columns=list(self.output))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chains: dict[tuple, Chain] = {}
        in_memory = 0
        for part in rows:
            emit: list[tuple] = []
            brought: dict[tuple, list] = {}
            for page, name, idx, *row in part[["page", "chain", "idx", *self.payload, "ts_ms"]].itertuples(index=False):
                brought.setdefault((page, name), []).append((int(idx), row))
            for at, found in brought.items():
                c = chains.get(at)
                if c is None:
                    c = chains[at] = self._restore(*at)
                in_memory -= len(c.held)
                for idx, row in sorted(found, key=lambda r: r[0]):
                    if idx == c.following:
                        self._pass(c, idx, tuple(row), emit)
                    elif idx > c.following:
                        c.held.setdefault(idx, tuple(row))
                self._advance(c, emit)
                in_memory += len(c.held)
            if in_memory > HELD:
                for c in chains.values():
                    self._keep(c)
                in_memory = 0
            if emit:
                yield self._frame(emit)
        emit = []
        stored = {} if self.waits or not any(c.stored for c in chains.values()) else self._stored()
        for c in chains.values():
            if self.waits:
                self._keep(c)
            elif c.held or c.stored:
                self._over_holes(c, stored.get((c.page, c.name), []), emit)
            self._store(c)
        self.pages.write()
        if emit:
            yield self._frame(emit)

    def _keep(self, c: Chain) -> None:
        for idx, row in c.held.items():
            if not (c.stored and self.waiting.containsKey((c.page, c.name, idx))):
                self.waiting.updateValue((c.page, c.name, idx), tuple(None if v is None or v != v else v for v in row))
                c.stored += 1
                if self.waits:
                    self.handle.registerTimer(int(row[-1]) + 1)
        c.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first timer of a bucket that has expired does the work of the others
        mark = timerValues.getCurrentWatermarkInMs()
        if self.passed == (tuple(key), mark):
            return
        self.passed = (tuple(key), mark)
        emit: list[tuple] = []
        for at, stored in self._stored().items():  # none if the hole was filled meanwhile
            c = self._restore(*at)
            self._over_holes(c, stored, emit, mark - 1)
            self._store(c)
        self.pages.write()
        if emit:
            yield self._frame(emit)

    def close(self) -> None:
        pass


class Verify(InOrder):
    """State: the hash of the last record passed."""
    payload, kinds = ("prior_hash", "record_hash", "other"), "prior_hash string, record_hash string, other string"
    output = ("chain_id", "idx", "reason")

    def start(self):
        return [GENESIS_PRIOR_HASH]

    def take(self, chain, state, idx, row, gap):
        prior, own, other, _ = row
        reason = "index gap" if gap else "prior_hash mismatch" if prior != state[0] else other
        state[0] = own
        return [(chain, idx, reason)] if isinstance(reason, str) else []


def climb(spine: dict[int, bytes], level: int, node: bytes) -> None:
    """Add a finished node to the right spine: two nodes of one level become one of the next."""
    while level in spine:
        node = hashlib.sha256(spine.pop(level) + node).digest()
        level += 1
    spine[level] = node


def spine_root(spine: dict[int, bytes]) -> bytes:
    """Root over what the spine holds; an odd layer pairs its last node with itself."""
    top, last, level = max(spine), None, 0
    while level < top or last is not None and level == top and level in spine:
        if level in spine:
            if level == top and last is None:
                break
            last = hashlib.sha256(spine[level] + (spine[level] if last is None else last)).digest()
        elif last is not None:
            last = hashlib.sha256(last + last).digest()
        level += 1
    return spine[top] if last is None else last


class Seal(InOrder):
    """State: the right spine of the run that is open, at most one hash a level in place of the records' hashes."""
    payload, kinds = ("record_hash",), "record_hash string"
    output = ("chain_id", "first_idx", "last_idx", "leaves", "root_hash", "anchor_status")

    def __init__(self, size: int = MERKLE_BATCH, waits: bool = False):
        super().__init__(waits)
        self.size = size

    def start(self):
        return [""]

    # the spine is stored as text: level:hash for each level, "-" for a run that has a hole (here None)
    def load(self, state):
        return [None if state[0] == "-" else {int(level): bytes.fromhex(node) for level, node in (x.split(":") for x in state[0].split(",") if x)}]

    def save(self, state):
        return ["-" if state[0] is None else ",".join(f"{level}:{node.hex()}" for level, node in state[0].items())]

    def take(self, chain, state, idx, row, gap):
        if idx % self.size == 0:
            state[0] = {}
        elif gap:
            state[0] = None
        if state[0] is None:
            return []
        climb(state[0], 0, bytes.fromhex(row[0]))
        if idx % self.size != self.size - 1:
            return []
        root, state[0] = spine_root(state[0]).hex(), {}
        return [(chain, idx - self.size + 1, idx, self.size, root, "pending")]


def _by_chain(stream: DataFrame, columns: list, processor: InOrder, schema: str, delay: str | None, buckets: int) -> DataFrame:
    use_keyed_state(stream.sparkSession)
    rows = in_buckets(stream.select("chain_id", "idx", *columns, "ts_ms"), buckets, "chain_id")
    if delay is not None:
        rows = rows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "None" if delay is None else "EventTime")


def verify_stream(stream: DataFrame, writer: str | None = None, delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """chain_id, idx, reason of every failing record, as `integrity.failures` finds them on the whole log.

    With a `delay` (such as "10 minutes") holes are given that much time; a record later than that is
    not taken, so its hole stays visible as an index gap.
    """
    columns = ["prior_hash", "record_hash", integrity.own_failure(writer).alias("other")]
    return _by_chain(stream, columns, Verify(delay is not None), "chain_id long, idx long, reason string", delay, buckets)


def seal_stream(stream: DataFrame, size: int = MERKLE_BATCH, delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Sealed batches of complete runs, as `merkle.seal_batches(full_only=True)` gives them. A run with a hole is not sealed."""
    return _by_chain(stream, ["record_hash"], Seal(size, delay is not None),
                     "chain_id long, first_idx long, last_idx long, leaves long, root_hash string, anchor_status string", delay, buckets)
