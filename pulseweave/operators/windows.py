"""Tumbling windows of posts and the gates that decide what runs on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.lineage import broadcast_if_small

MINUTE_MS = 60_000
DEFAULT_SPAN_MS = 30 * MINUTE_MS
MIN_POSTS = 1000
MAX_ERRORS = 10

# What runs on each window by default.
DEFAULT_MONITORS = (
    ("text", "en", 0.65),
    ("text", "ar", 0.65),
    ("hashtag", None, None),
    ("image", None, 0.39),
)


def window_start(ms: Column, span_ms: int, origin_ms: int = 0) -> Column:
    return ms - F.pmod(ms - F.lit(origin_ms), F.lit(span_ms))


def tumbling_windows(
    df: DataFrame, span_ms: int = DEFAULT_SPAN_MS, origin_ms: int = 0, time: str = "timestamp_ms"
) -> DataFrame:
    """Adds the inclusive bounds of the window each row falls in."""
    start = window_start(F.col(time), span_ms, origin_ms)
    return df.withColumn("start_time_ms", start).withColumn(
        "end_time_ms", F.col("start_time_ms") + (span_ms - 1)
    )


def window_counts(windowed: DataFrame) -> DataFrame:
    return windowed.groupBy("start_time_ms", "end_time_ms").agg(F.count("*").alias("n_posts"))


def window_min_posts_gate(windowed: DataFrame, min_posts: int = MIN_POSTS) -> DataFrame:
    return window_counts(windowed).where(F.col("n_posts") >= min_posts)


def max_retries(span_ms: int, multiplier: float = 1, poll_ms: int = MINUTE_MS) -> float:
    return span_ms * multiplier / poll_ms


def window_retry_state(
    polls: DataFrame, limit: float, min_posts: int = MIN_POSTS, window: Sequence[str] = ("window_id",)
) -> DataFrame:
    """State of each window after its polls.

    ``polls`` holds ``poll`` (0, 1, 2, …) and ``n_posts`` seen at that poll. A
    window runs at the first poll that meets the gate, unless it was skipped
    before: poll number ``limit`` that still misses the gate skips it.
    """
    hit = F.min(F.when(F.col("n_posts") >= min_posts, F.col("poll")))
    seen = polls.groupBy(*window).agg(hit.alias("first_hit"), F.max("poll").alias("last_poll"))
    if limit == int(limit):
        runs = F.coalesce(F.col("first_hit") <= limit, F.lit(False))
        skipped = F.col("last_poll") >= limit
    else:  # the retry count never equals a fraction, so nothing is skipped
        runs, skipped = F.col("first_hit").isNotNull(), F.lit(False)
    retries = (
        F.when(runs, F.col("first_hit"))
        .when(skipped, F.lit(int(limit)))
        .otherwise(F.col("last_poll") + 1)
    )
    return seen.select(
        *window,
        F.when(runs, "running").when(skipped, "skip").otherwise("new").alias("state"),
        retries.cast("long").alias("retries"),
    )


def expand_monitors(windows: DataFrame, settings: DataFrame) -> DataFrame:
    """One monitor per window and configured featurizer.

    The settings are configuration, a handful of rows, so each window row is
    expanded in place from an array of them.
    """
    entry = F.struct(*[F.col(c) for c in settings.columns])
    bundle = settings.agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return (
        windows.withColumn("entry", F.explode(bundle.scalar()))
        .select(windows["*"], "entry.*")
        .withColumn("state", F.lit("new"))
    )


def select_batch(
    posts: DataFrame, monitors: DataFrame, bucket_ms: int, state: str = "new"
) -> DataFrame:
    """Posts of each monitor: by time range, featurizer and, for text, language.

    A monitor is listed under every time bucket it touches, so the join is on
    equal buckets and featurizers and the exact range is checked afterwards.
    """
    buckets = F.sequence(
        F.floor(F.col("start_time_ms") / bucket_ms), F.floor(F.col("end_time_ms") / bucket_ms)
    )
    m = monitors.withColumn("bucket", F.explode(buckets)).alias("m")
    p = (
        posts.where(F.col("state") == state)
        .withColumn("bucket", F.floor(F.col("timestamp_ms") / bucket_ms))
        .alias("p")
    )
    on = (
        (F.col("p.bucket") == F.col("m.bucket"))
        & (F.col("p.featurizer") == F.col("m.featurizer"))
        & F.col("p.timestamp_ms").between(F.col("m.start_time_ms"), F.col("m.end_time_ms"))
        & ((F.col("m.featurizer") != "text") | (F.col("p.lang") == F.col("m.lang")))
    )
    return p.join(broadcast_if_small(m), on).select("m.monitor_id", "p.*").drop("bucket")


def all_done_gate(monitors: DataFrame, window: Sequence[str]) -> DataFrame:
    """Windows whose monitors, the linker aside, are all done."""
    work = monitors.where(F.col("featurizer") != "linker")
    return (
        work.groupBy(*window)
        .agg(F.bool_and(F.col("state") == "done").alias("ready"), F.count("*").alias("n_monitors"))
        .where("ready")
        .drop("ready")
    )


# The stage that follows each state.
NEXT_STATE = {"new": "preprocessed", "preprocessed": "featurized", "featurized": "done"}
NEXT_LINK_STATE = {"new": "done"}


def advance_state(df: DataFrame, link: str = "featurizer") -> DataFrame:
    """Moves each row to its next state; finished rows stay as they are."""

    def step(mapping: dict[str, str]) -> Column:
        out = F.col("state")
        for old, new in mapping.items():
            out = F.when(F.col("state") == old, F.lit(new)).otherwise(out)
        return out

    return df.withColumn(
        "state", F.when(F.col(link) == "linker", step(NEXT_LINK_STATE)).otherwise(step(NEXT_STATE))
    )


def monitor_error_summary(
    errors: DataFrame, monitor: str, order: str, message: str, limit: int = MAX_ERRORS
) -> DataFrame:
    """The first errors of each monitor in one comma-joined line."""
    w = Window.partitionBy(monitor).orderBy(order)
    first = errors.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.col(message).alias("msg"))))
    return first.groupBy(monitor).agg(
        F.array_join(F.transform(listed, lambda e: e["msg"]), ",").alias("error")
    )
