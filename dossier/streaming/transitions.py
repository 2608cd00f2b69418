"""Workflow rules on a stream of requested transitions, in the order of the requests and not of their arrival."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from dossier.operators.workflow import MATRIX

OUTPUT = "entity_type string, entity_id long, seq long, from_state string, to_state string, outcome string, state string, user_id long, reason string, late boolean"
#: Waiting requests, a column each: many of them are one row of the state store.
HELD = ["entity", "at", "seq", "to_state", "user_id", "reason", "late"]
HELD_SCHEMA = "entity array<string>, at array<long>, seq array<long>, to_state array<string>, user_id array<string>, reason array<string>, late array<boolean>"
INITIAL = "draft"
#: Groups that the entities are dealt over; one group's states and waiting requests are in a task's memory at once.
GROUPS = 1024


def _outcome(entity: str, state: str, target: str) -> str:
    if state == target:
        return "no_op"
    if entity not in MATRIX:
        return "unknown_entity"
    return "accepted" if target in MATRIX[entity].get(state, []) else "rejected"


class Transitions(StatefulProcessor):
    """States of the entities of one group, and their requests that came before it is known that no earlier one is still on its way.

    Requests wait in a list until the watermark reaches their time; one timer stands for the earliest of them. When it
    fires, all whose time has come are judged in ``seq`` order within their entity and the rest wait on. A call of the
    state store costs as much for one request as for many, so entities share their calls by groups.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "entity array<string>, state array<string>")
        self.held = handle.getListState("held", HELD_SCHEMA)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        any_late, earliest = False, None
        for frame in rows:
            frame = frame[frame["to_state"].notna()]  # a row without a state only moves time on
            if len(frame):
                frame = frame.astype({"at": "int64", "seq": "int64"})
                self.held.appendValue(self._packed(frame.assign(late=frame["at"] <= watermark)))
                first = int(frame["at"].min())
                any_late = any_late or first <= watermark
                earliest = first if earliest is None else min(first, earliest)
        if any_late:  # judged now, in order with those whose time has come
            yield from self._drain(watermark)
        elif earliest is not None:
            self._wake(earliest)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(timerValues.getCurrentWatermarkInMs())

    def _drain(self, watermark: int) -> Iterator[pd.DataFrame]:
        chunks = [dict(zip(HELD, chunk, strict=True)) for chunk in self.held.get()]
        held = pd.DataFrame({c: pd.Series([x for chunk in chunks for x in chunk[c]], dtype=object) for c in HELD})
        due = held["at"] <= watermark
        rest = held[~due]
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if len(rest):
            self.held.put([self._packed(rest)])
            self._wake(rest["at"].min())
        else:
            self.held.clear()
        if due.any():
            yield self._judged(held[due])

    def close(self) -> None:
        pass

    @staticmethod
    def _packed(frame: pd.DataFrame) -> tuple:
        return tuple(frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in HELD)

    def _wake(self, at: int) -> None:
        """Keep one timer, for the earliest request that waits."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _judged(self, rows: pd.DataFrame) -> pd.DataFrame:
        states = dict(zip(*self.states.get(), strict=True)) if self.states.exists() else {}
        parts = {name: json.loads(name) for name in rows["entity"].unique()}
        out = []
        for name, _, seq, target, user, reason, late in sorted(rows[HELD].itertuples(index=False, name=None), key=lambda r: r[2]):
            entity, before = parts[name].get("entity_type"), states.get(name, INITIAL)
            outcome = _outcome(entity, before, target)
            after = states[name] = target if outcome == "accepted" else before
            out.append((entity, parts[name].get("entity_id"), seq, before, target, outcome, after, None if user is None else int(user), reason, late))
        self.states.update((list(states), list(states.values())))
        judged = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")], dtype=object)
        return judged.astype({"seq": "int64", "late": "bool", "user_id": "Int64", "entity_id": "Int64"})


def stream_transitions(requests: DataFrame, delay: str = "10 minutes", time: str = "requested_at", groups: int = GROUPS) -> DataFrame:
    """Judge a stream of ``(entity_type, entity_id, seq, to_state, user_id, reason)`` with the time of each request.

    Requests may arrive in any order within ``delay``: each waits until the watermark says that no earlier one can come,
    and the result equals the batch replay. One that is later still is judged with those that
    wait, as it arrives, and marked ``late``: what was judged before stays. A row
    without ``to_state`` is a heartbeat: it moves time on, so that the last requests of a quiet stream are judged, too.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). ``groups`` must stay what it was when
    the checkpoint was made; a few hundred entities in each are a good measure.
    """
    timed = requests.withWatermark(time, delay).withColumn("at", F.unix_millis(time))
    # One name that is never null, and numbers without gaps: pandas turns longs beside a null into floats.
    named = timed.withColumn("entity", F.to_json(F.struct("entity_type", "entity_id"))).withColumn("user_id", F.col("user_id").cast("string"))
    whole = named.withColumn("seq", F.when(F.col("to_state").isNull(), F.lit(0)).otherwise(F.col("seq")))
    grouped = whole.withColumn("group", F.pmod(F.xxhash64("entity"), F.lit(groups)))
    return grouped.select("group", "entity", "seq", "to_state", "user_id", "reason", time, "at").groupBy("group").transformWithStateInPandas(
        statefulProcessor=Transitions(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
