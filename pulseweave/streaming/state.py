"""Streaming operators that keep state of their own, with timers in event time.

Each holds no more than the windows that are still open (and, for matching, the one
before): a timer set for a window's end releases or drops what was held for it. Keys are
small parts of a window, so no state or task holds a window whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseweave.lineage import path_exists
from pulseweave.operators import events as ev
from pulseweave.operators.ordering import with_row_index
from pulseweave.operators.windows import MIN_POSTS, window_start

WINDOW = ("start_time_ms", "end_time_ms")


def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in types.items()])


def _plain(rows: pd.DataFrame) -> list[tuple]:
    """Rows as the state store takes them: tuples of plain values and lists."""
    each = rows.itertuples(index=False, name=None)
    return [tuple(x.tolist() if hasattr(x, "tolist") else x for x in row) for row in each]


class ReleaseWindows(StatefulProcessor):
    """Holds the rows of a part of a window and hands them on when the window closes."""

    def __init__(self, held: T.StructType) -> None:
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[1])
        for part in rows:
            if timerValues.getCurrentWatermarkInMs() < end:  # later ones come too late
                self.rows.appendList(_plain(part[self.held.names]))
        if not any(True for _ in self.handle.listTimers()) and self.rows.exists():
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = pd.DataFrame(list(self.rows.get()), columns=self.held.names)
        self.rows.clear()
        found.insert(0, WINDOW[1], int(key[1]))
        found.insert(0, WINDOW[0], int(key[0]))
        yield found

    def close(self) -> None:
        pass


def stream_closed_windows(
    posts: DataFrame, event_time: str, span_ms: int, delay: str, post_id: str = "post_id", parts: int = 64
) -> DataFrame:
    """All rows of a window at once, with its bounds, when late posts are no longer awaited.

    However many batches a window's posts were spread over, they leave in one. The state is
    kept in ``parts`` parts of each open window, by hash of ``post_id``.
    """
    held = T.StructType([f for f in posts.schema.fields if f.name != event_time])
    start = window_start(F.unix_millis(event_time), span_ms)
    keyed = posts.withWatermark(event_time, delay).select(
        start.alias(WINDOW[0]), (start + (span_ms - 1)).alias(WINDOW[1]), F.pmod(F.xxhash64(post_id), F.lit(parts)).alias("_part"), event_time, *held.names
    )
    out = T.StructType([T.StructField(c, T.LongType()) for c in WINDOW] + held.fields)
    return keyed.groupBy(*WINDOW, "_part").transformWithStateInPandas(ReleaseWindows(held), out, "Append", "EventTime")


class WindowGate(StatefulProcessor):
    """Counts a window's posts; polls the count when the window closes, and again until it runs or is skipped."""

    def __init__(self, min_posts: int, max_retries: int, poll_ms: int) -> None:
        self.min_posts, self.max_retries, self.poll_ms = min_posts, max_retries, poll_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _struct(n=T.LongType(), retries=T.LongType(), done=T.BooleanType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, retries, done = self.seen.get() if self.seen.exists() else (0, 0, False)
        n += sum(int(part["n"].sum()) for part in rows)
        if not done and not any(True for _ in self.handle.listTimers()):
            # The watermark lags by all looks and a span more, so that no post that a look may see is dropped.
            self.handle.registerTimer(int(key[0]) - 1 - self.max_retries * self.poll_ms)
        self.seen.update((n, retries, done))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, retries, done = self.seen.get()
        if done:
            # The window was decided a while ago; its state goes.
            self.seen.clear()
            return
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        while n < self.min_posts and retries < self.max_retries:
            # Another look later; looks that are due by now see what this one sees.
            retries, at = retries + 1, at + self.poll_ms
            if at > now:
                self.seen.update((n, retries, False))
                self.handle.registerTimer(at)
                return
        self.seen.update((n, retries, True))
        self.handle.registerTimer(max(now, int(key[1])) + 1)
        state = "running" if n >= self.min_posts else "skip"
        yield pd.DataFrame([(int(key[0]), int(key[1]), n, retries, state)], columns=[*WINDOW, "n_posts", "retries", "state"])

    def close(self) -> None:
        pass


def stream_window_states(
    posts: DataFrame, event_time: str, span_ms: int, delay: str, min_posts: int = MIN_POSTS, max_retries: int = 0, poll_ms: int | None = None
) -> DataFrame:
    """One row per window that has posts: ``running`` if it holds enough of them, else ``skip``.

    A window is looked at when it closes, and ``max_retries`` more times, each ``poll_ms``
    (a window's span unless given) of event time later, as posts may still come in; the
    last look that misses the gate skips it. Tasks count their posts before the shuffle.
    """
    start = window_start(F.unix_millis(event_time), span_ms)
    rows = posts.select(start.alias(WINDOW[0]), F.unix_millis(event_time).alias("at"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.groupby(WINDOW[0], as_index=False).agg(n=("at", "size"), at=("at", "max"))

    counted = rows.mapInPandas(count, f"{WINDOW[0]} long, n long, at long").select(
        WINDOW[0], (F.col(WINDOW[0]) + (span_ms - 1)).alias(WINDOW[1]), "n", F.timestamp_millis("at").alias("at")
    )
    out = f"{WINDOW[0]} long, {WINDOW[1]} long, n_posts long, retries long, state string"
    poll = poll_ms or span_ms
    gate = WindowGate(min_posts, max_retries, poll)
    lag = f"{delay} {max_retries * poll + span_ms} milliseconds"
    return counted.withWatermark("at", lag).groupBy(*WINDOW).transformWithStateInPandas(gate, out, "Append", "EventTime")


class MatchTerms(StatefulProcessor):
    """Holds a term's events of one window and meets those of the next with them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = _struct(start_time_ms=T.LongType(), end_time_ms=T.LongType(), event_id=T.StringType(), share=T.DoubleType())
        self.events = handle.getListState("events", fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = set()
        for part in rows:
            self.events.appendList(_plain(part[[*WINDOW, "event_id", "share"]]))
            ends |= set(int(e) + 1 for e in part[WINDOW[1]].unique())
        for at in ends:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() - 1
        held = list(self.events.get()) if self.events.exists() else []
        now = [e for e in held if e[1] == end]
        before = {e[1]: [] for e in held}
        for e in held:
            before[e[1]].append(e)
        pairs = [(e[2], e[0], e[1], p[2], e[3] * p[3]) for e in now for p in before.get(e[0] - 1, ())]
        kept = [e for e in held if e[1] >= end]
        if now and not pairs:
            # The window is over without a match by this term; it is known to have been seen.
            pairs = [(e[2], e[0], e[1], None, 0.0) for e in now]
        if now and kept == now:
            # Nothing newer: these stay for one window more, then go.
            self.handle.registerTimer(end + 1 + (end - now[0][0] + 1))
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()
        yield pd.DataFrame(pairs, columns=["event_id", *WINDOW, "prior_id", "part"])

    def close(self) -> None:
        pass


def stream_match_parts(tags: DataFrame) -> DataFrame:
    """What each term adds to the score of an event against one of the window before.

    ``tags`` has event_id, start_time_ms, end_time_ms, term and share (the term's weight
    among the event's). A window is matched when the first row of a later one has been
    seen; its terms then leave together, with a null ``prior_id`` where no event before has
    the term.
    """
    timed = tags.withColumn("at", F.timestamp_millis(WINDOW[1])).withWatermark("at", "1 millisecond")
    out = f"event_id string, {WINDOW[0]} long, {WINDOW[1]} long, prior_id string, part double"
    return timed.groupBy("term").transformWithStateInPandas(MatchTerms(), out, "Append", "EventTime")


def event_tags_batch(store: str, form: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Forms the events of closed windows; ``form`` gives event_id, the bounds, term and weight.

    Each batch writes its own folder of ``store``, so one that is run again replaces its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = form(batch)
        sums = rows.groupBy("event_id").agg(F.sum("weight").alias("_sum"))
        shares = rows.join(sums, "event_id").select("event_id", *WINDOW, "term", "weight", (F.col("weight") / F.col("_sum")).alias("share"))
        shares.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return write


def end_event_tags(spark: SparkSession, store: str, span_ms: int) -> None:
    """Ends the rows of ``event_tags_batch``: a nameless event after all others lets the last windows be matched.

    For streams that end; it is no row of a batch and has no match of its own.
    """
    rows = spark.read.schema(f"{WINDOW[1]} long").parquet(store)
    last = rows.agg((F.coalesce(F.max(WINDOW[1]), F.lit(0)) + 2 * span_ms).alias(WINDOW[1]))
    end = last.select(
        F.lit("").alias("event_id"), (F.col(WINDOW[1]) - (span_ms - 1)).alias(WINDOW[0]), WINDOW[1],
        F.lit("").alias("term"), F.lit(0).cast("long").alias("weight"), F.lit(0.0).alias("share"),
    )
    end.write.mode("overwrite").parquet(f"{store}/batch=-1")


def event_match_batch(store: str, min_score: float = ev.MIN_MATCH_SCORE) -> Callable[[DataFrame, int], None]:
    """The best earlier event of each event whose window is over: event_id, the bounds, sibling_id, score."""

    def match(batch: DataFrame, batch_id: int) -> None:
        scores = batch.groupBy("event_id", "prior_id").agg(F.round(F.sum("part"), 9).alias("score"))
        best = ev.best_match(scores.filter("prior_id IS NOT NULL"), min_score)
        over = batch.select("event_id", *WINDOW).distinct()
        over.join(best, "event_id", "left").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return match


def govern_batch(store: str, rate: float, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Lets one of every ``ceil(1/rate) + 1`` arrivals through, over all batches as one sequence.

    The rows of a batch get their places in ``order`` by a distributed sort; the only state
    is the number of rows before the batch. A batch writes the rows it lets through to
    ``store/admitted`` and then the new count to ``store/seen``, each in a folder of its
    own, so a batch that is run again finds the count it had and writes the same rows.
    """
    cycle = math.ceil(1 / rate) + 1
    seen_path = f"{store}/seen"

    def govern(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = 0
        if path_exists(spark, seen_path):
            counts = spark.read.schema("seen long, batch long").parquet(seen_path)
            before = counts.where(F.col("batch") < batch_id).agg(F.max("seen")).first()[0] or 0
        indexed = with_row_index(batch, order, "_arrival")
        admitted = indexed.where((F.col("_arrival") + before) % cycle == cycle - 1).drop("_arrival")
        admitted.write.mode("overwrite").parquet(f"{store}/admitted/batch={batch_id}")
        total = spark.createDataFrame([(before + indexed.count(),)], "seen long")
        total.write.mode("overwrite").parquet(f"{seen_path}/batch={batch_id}")

    return govern
