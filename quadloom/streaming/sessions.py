"""Session state as streams: turn counters, attention with decay, bounded memory. Each has a batch twin in plans.sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Salience lost with each turn, and concepts that a session remembers.
DECAY, MEMORY = 0.1, 50

OUTPUT = "session string, turn long, concept string, attention double"
STATE = "last long, concepts array<string>, turns array<long>"


def _remembered(turns: dict[str, int], now: int) -> dict[str, int]:
    """Concepts with attention left; of these the MEMORY latest, ties to the smaller name."""
    alive = {c: t for c, t in turns.items() if 1 - DECAY * (now - t) > 0}
    return dict(sorted(alive.items(), key=lambda x: (-x[1], x[0]))[:MEMORY])


def track(key: tuple[str], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's attention after its new events: a mention sets 1, each later turn takes DECAY.

    Turns are numbered in the order of (ts, event_id) within what arrives; the state holds at most MEMORY concepts.
    """
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    last, concepts, turns = state.get if state.exists else (-1, [], [])
    held = dict(zip(list(concepts), map(int, turns), strict=True))
    for concept in rows["concept"]:
        last += 1
        held[concept] = last
        held = _remembered(held, last)
    state.update((last, list(held), list(held.values())))
    yield pd.DataFrame({"session": key[0], "turn": last, "concept": list(held), "attention": [round(1 - DECAY * (last - t), 6) for t in held.values()]})


def attention(events: DataFrame) -> DataFrame:
    """Stream of (session, turn, concept, attention) from a stream of (session, ts, event_id, concept).

    Run in update mode: after each batch a session's current values follow.
    """
    return events.groupBy("session").applyInPandasWithState(track, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def first_uses(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each concept of a session once: the history of what was used, with state bounded by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "concept"])
