"""Quiz runs as a state machine over events: on a stream with timers, and over a table.

A player is ready, then plays one run of questions, then the run is complete.
``start`` begins a run unless one is being played. ``shown`` opens the question on
display. ``answer`` counts if that question is open and has no answer yet; a right
one moves on at once, a wrong one waits for ``next``. An event that names a
question acts only while that question is on display; one without a name means the
one on display. A run without an event for longer than the idle limit expires.
All other events change nothing.

Events take effect in the order of their time and ordinal, however they arrive:
the stream holds them until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import numbers

RUN_SCHEMA = "player STRING, run INT, status STRING, answered INT, correct INT, score INT, started TIMESTAMP, ended TIMESTAMP"
#: Times are microseconds since 1970, as Spark's timestamps are.
_EVENT = "at BIGINT, ordinal BIGINT, kind STRING, question INT, correct BOOLEAN"
_STATE = "run INT, playing BOOLEAN, question INT, shown BOOLEAN, answered BOOLEAN, answers INT, correct INT, started BIGINT, seen BIGINT"
_RUN = "player STRING, run INT, status STRING, answers INT, correct INT, started BIGINT, ended BIGINT"


@dataclass
class Run:
    """Where one player stands."""

    run: int = 0
    playing: bool = False
    question: int = 0
    shown: bool = False
    answered: bool = False
    answers: int = 0
    correct: int = 0
    started: int = 0
    seen: int = 0

    def _ended(self, status: str, at: int) -> tuple:
        self.playing = False
        return (self.run, status, self.answers, self.correct, self.started, at)

    def expire(self, now: int, idle: int) -> Iterator[tuple]:
        if self.playing and now - self.seen > idle:
            yield self._ended("expired", self.seen + idle)

    def take(self, at: int, kind: str, question: int | None, correct: bool | None, questions: int, idle: int) -> Iterator[tuple]:
        """The runs that one event ends."""
        yield from self.expire(at, idle)
        if not self.playing:
            if kind == "start":
                self.run += 1
                self.playing, self.started, self.seen = True, at, at
                self.question = self.answers = self.correct = 0
                self.shown = self.answered = False
            return
        self.seen = at
        if question is not None and question != self.question:
            return
        moves = kind == "next" and self.answered
        if kind == "shown":
            self.shown = True
        elif kind == "answer" and self.shown and not self.answered:
            moves, self.answered = bool(correct), True
            self.answers += 1
            self.correct += moves
        if moves:
            if self.question == questions - 1:
                yield self._ended("complete", at)
            else:
                self.question += 1
                self.shown = self.answered = False


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _flag(value) -> bool | None:
    return None if pd.isna(value) else bool(value)


class _Runs(StatefulProcessor):
    """One player's state, and the events that the watermark has not passed."""

    def __init__(self, questions: int, idle: int):
        self.questions, self.idle = questions, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)
        self.waiting = handle.getListState("waiting", _EVENT)

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)  # the first millisecond after it

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), int(r.ordinal), r.kind, _whole(r.question), _flag(r.correct)) for batch in rows for r in batch.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self._timer(min(e[0] for e in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = Run(*self.state.get()) if self.state.exists() else Run()
        waiting = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: [(v is not None, v) for v in e])  # nulls first
        ended = []
        for at, _, kind, question, correct in (e for e in waiting if e[0] < now):
            ended += state.take(at, kind, question, correct, self.questions, self.idle)
        later = [e for e in waiting if e[0] >= now]
        ended += state.expire(now, self.idle)
        self.state.update(astuple(state))
        if later:
            self.waiting.put(later)
            self._timer(later[0][0])
        else:
            self.waiting.clear()
        if state.playing:
            self._timer(state.seen + self.idle)
        if ended:
            yield pd.DataFrame([(key[0], *e) for e in ended], columns=[c.split()[0] for c in _RUN.split(", ")])

    def close(self) -> None:
        pass


def _plain(events: DataFrame) -> DataFrame:
    """Times as whole microseconds; events without a player or time are left out."""
    known = events.where("player IS NOT NULL AND ts IS NOT NULL")
    return known.select("ts", F.col("player").cast("string").alias("player"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"), "kind", F.col("question").cast("int").alias("question"), "correct")


def _records(runs: DataFrame) -> DataFrame:
    return runs.select(
        "player", "run", "status", F.col("answers").alias("answered"), "correct", (F.col("correct") * numbers.POINTS).alias("score"),
        F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"),
    )


def live_runs(events: DataFrame, questions: int = numbers.QUESTIONS, idle_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Ended runs (``RUN_SCHEMA``) of a stream of events (ts, player, ordinal, kind, question, correct).

    Events later than ``late`` are dropped. The session's state store must be
    RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    kept = _plain(events.withWatermark("ts", late))
    runs = kept.groupBy("player").transformWithStateInPandas(_Runs(questions, idle_seconds * 1_000_000), outputStructType=_RUN, outputMode="Append", timeMode="EventTime")
    return _records(runs)


def runs_of(events: DataFrame, questions: int = numbers.QUESTIONS, idle_seconds: int = 1800) -> DataFrame:
    """The same runs of a table of events, as they stand at the table's last time.

    Each player's events pass one task in order and are not held: the state is
    all that is kept, however many events a player has. Repeated events are
    taken once each; an empty table has no runs.
    """
    idle = idle_seconds * 1_000_000
    rows = _plain(events).drop("ts")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("at").alias("now")))).repartition("player").sortWithinPartitions("player", "at", "ordinal", "kind", "question", "correct")

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, now, state = None, 0, Run()
        for batch in batches:
            ended = []
            for r in batch.itertuples(index=False):
                if r.player != player:
                    ended += ((player, *e) for e in state.expire(now, idle))
                    player, now, state = r.player, int(r.now), Run()
                ended += ((player, *e) for e in state.take(int(r.at), r.kind, _whole(r.question), _flag(r.correct), questions, idle))
            yield pd.DataFrame(ended, columns=[c.split()[0] for c in _RUN.split(", ")])
        ended = [(player, *e) for e in state.expire(now, idle)]
        yield pd.DataFrame(ended, columns=[c.split()[0] for c in _RUN.split(", ")])

    return _records(rows.mapInPandas(fold, _RUN))
