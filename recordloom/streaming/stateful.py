"""Per-key state in Structured Streaming: cadence, escalate-once, sliding text frames, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordloom.streaming.keyed import BUCKETS, Pages, chain_of, in_buckets, use_keyed_state

FRAME = 10


def _ordered(parts: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """Rows of one key in one micro-batch; the source's batch limit bounds them."""
    return pd.concat(list(parts)).sort_values(by, kind="stable")


def cadence_stream(stream: DataFrame, every: int, mark_type: str = "reflection", turn_type: str = "response") -> DataFrame:
    """Emits (chain_id, idx, turns) whenever `every` turns have passed since the last mark or trigger."""
    def step(key, parts, state: GroupState):
        turns = state.get[0] if state.exists else 0
        fired = []
        for idx, kind in _ordered(parts, "idx")[["idx", "rec_type"]].itertuples(index=False):
            if kind == mark_type:
                turns = 0
            elif kind == turn_type:
                turns += 1
                if turns >= every:
                    fired.append((key[0], idx, turns))
                    turns = 0
        state.update((turns,))
        yield pd.DataFrame(fired, columns=["chain_id", "idx", "turns"])
    return (stream.select("chain_id", "idx", "rec_type").groupBy("chain_id").applyInPandasWithState(
        step, "chain_id long, idx long, turns long", "turns long", "append", GroupStateTimeout.NoTimeout))


class Escalate(StatefulProcessor):
    """State: of each proposal sighted how often it recurred, and whether it was proposed (1) and told (2)."""
    output = ("chain_id", "idx", "sightings")

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle) -> None:
        self.pages = Pages(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        brought: dict[tuple, list] = {}
        for part in rows:
            for page, chain, target, origin in part[["page", "chain", "target", "origin"]].itertuples(index=False):
                one = brought.setdefault((page, chain, int(target)), [0, 0])
                if origin:
                    one[1] = 1
                else:
                    one[0] += 1
        fired = []
        for (page, chain, target), (seen, mark) in brought.items():
            name = f"{chain}/{target}"
            before, marks = self.pages.page(page).get(name, (0, 0))
            seen, marks = before + seen, marks | mark
            if marks == 1 and seen + 1 >= self.threshold:
                marks = 3
                fired.append((chain_of(chain), target, seen + 1))
            self.pages.put(page, name, [seen, marks])
        self.pages.write()
        if fired:
            yield pd.DataFrame(fired, columns=list(self.output))

    def close(self) -> None:
        pass


def escalation_stream(stream: DataFrame, threshold: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """Emits each proposal once, when its sightings first reach the threshold.

    State is per proposal, and proposals are dealt to buckets, so a chain with many of them spreads over tasks and
    no call, frame or round trip to the store is made for a proposal.
    """
    use_keyed_state(stream.sparkSession)
    c = F.from_json("content_json", "recurs_proposal_index bigint")
    hits = (stream.where(F.col("rec_type").isin("proposal", "proposal_recurrence"))
            .select("chain_id", F.when(F.col("rec_type") == "proposal", F.col("idx")).otherwise(c["recurs_proposal_index"]).alias("target"),
                    (F.col("rec_type") == "proposal").alias("origin")).where("target is not null"))
    return (in_buckets(hits, buckets, "chain_id", "target").groupBy("bucket")
            .transformWithStateInPandas(Escalate(threshold), "chain_id long, idx long, sightings long", "Append", "None"))


def frame_stream(stream: DataFrame, key: str, order: str, text: str, reach: int = FRAME) -> DataFrame:
    """Adds the up to `reach` earlier texts of the same key, oldest first."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}

    def step(k, parts, state: GroupState):
        past = list(state.get[0]) if state.exists else []
        rows = []
        for at, t in _ordered(parts, order)[[order, text]].itertuples(index=False):
            rows.append((k[0], at, t, list(past)))
            past = (past + [t])[-reach:]
        state.update((past,))
        yield pd.DataFrame(rows, columns=[key, order, text, "prior"])
    return stream.select(key, order, text).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {order} {kinds[order]}, {text} string, prior array<string>", "past array<string>",
        "append", GroupStateTimeout.NoTimeout)


def dedup_stream(stream: DataFrame, op_id: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Takes every operation id once within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([op_id])


def windowed_counts(stream: DataFrame, ts: str, by: str, kind: str = "tumbling", length: str = "1 hour",
                    slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per event-time window; late rows beyond the watermark are dropped."""
    span = {"tumbling": lambda: F.window(ts, length), "sliding": lambda: F.window(ts, length, slide or length),
            "session": lambda: F.session_window(ts, length)}[kind]()
    timed = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return timed.groupBy(span.alias("w"), by).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
