"""Structured Streaming jobs; each gives what the batch operator gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseweave.lineage import new_path, path_exists
from pulseweave.operators import hashtags as ht
from pulseweave.operators.ingest import POST_KEY, ingest
from pulseweave.operators.windows import MIN_POSTS
from pulseweave.sources.tweets import TRACK, mentions_any

PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def _few_state_parts(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Streams that start within have no more state partitions than tasks run at a time.

    Each partition has a store, and with state in Python a worker too, to be opened in every
    batch however few its rows are; stores may grow beyond memory. What is given ends this for
    other jobs once the stream has taken its settings. A stream that goes on from a checkpoint
    keeps the number it began with.
    """
    parts = spark.conf.get(PARTITIONS)

    def end() -> None:
        spark.conf.set(PARTITIONS, parts)

    spark.conf.set(PARTITIONS, str(min(int(parts), spark.sparkContext.defaultParallelism)))
    try:
        yield end
    finally:
        end()


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything there is now, and reads its output table back."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", new_path(spark, f"{label}-offsets"))
        .trigger(availableNow=True)
    )
    with _few_state_parts(spark):
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], label: str, offsets: str | None = None) -> None:
    """Runs ``each`` on every micro batch of what there is now.

    A batch is written once and ``each`` is given the table, read in the session of
    ``stream``: what holds state runs once, and jobs over the batch plan adaptively, which
    the stream's own session does not. ``offsets`` names the checkpoint of an earlier run
    that this one goes on from.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        settled()
        path = new_path(spark, f"{label}-batch")
        batch.write.parquet(path)
        each(spark.read.schema(batch.schema).parquet(path), batch_id)

    with _few_state_parts(spark) as settled:
        query = (
            stream.writeStream.foreachBatch(run)
            .option("checkpointLocation", offsets or new_path(spark, f"{label}-offsets"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def stream_ingest(raw: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Validate, normalise, fold in quotes, fan out and drop repeats, post by post."""
    return (
        ingest(raw).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(POST_KEY))
    )


def stream_window_counts(
    posts: DataFrame, event_time: str, span: str, delay: str, min_posts: int = MIN_POSTS
) -> DataFrame:
    """Windows that hold enough posts, emitted once late posts are no longer awaited."""
    counted = (
        posts.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, span))
        .agg(F.count("*").alias("n_posts"))
    )
    start = F.unix_millis(F.col("window.start"))
    return counted.where(F.col("n_posts") >= min_posts).select(
        start.alias("start_time_ms"),
        (F.unix_millis(F.col("window.end")) - 1).alias("end_time_ms"),
        "n_posts",
    )


def stream_keyword_track(posts: DataFrame, track: Sequence[str] = TRACK, text: str = "text") -> DataFrame:
    return posts.where(mentions_any(F.col(text), track))


def stream_tag_groups(posts: DataFrame, event_time: str, span: str, delay: str) -> DataFrame:
    """Tags counted per closed window; the row without a term counts the window's posts.

    A window's rows come all at once, after late posts are no longer awaited, however
    many batches its posts were spread over.
    """
    tagged = posts.withWatermark(event_time, delay).where(F.col("hashtags").isNotNull())
    every = F.concat(F.array(F.lit(None).cast("string")), F.transform("hashtags", F.lower))
    counted = (
        tagged.select(event_time, F.explode(every).alias("term"))
        .groupBy(F.window(event_time, span), "term")
        .agg(F.count("*").alias("size"))
    )
    return counted.select(
        F.unix_millis(F.col("window.start")).alias("start_time_ms"),
        (F.unix_millis(F.col("window.end")) - 1).alias("end_time_ms"), "term", "size",
    )


DAY_MS = 24 * 3600 * 1000


def hashtag_score_batch(
    store: str, span_ms: int, min_posts: int, threshold: float = ht.LIKELIHOOD_THRESHOLD, prior_ms: int = ht.PRIOR_MS
) -> Callable[[DataFrame, int], None]:
    """Scores the closed windows of ``stream_tag_groups`` against the clusters stored so far.

    ``store`` is the cluster table, by batch and day. Each batch writes its own
    folder of it, so a batch that is run again replaces its own rows; only the days
    of the look-back are read.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        totals = batch.where("term IS NULL").select("end_time_ms", F.col("size").alias("total_posts"))
        groups = batch.where(F.col("term").isNotNull() & (F.col("size") >= min_posts))
        fresh = groups.join(totals, "end_time_ms").select(*ht.WINDOW, "term", "size", "total_posts")
        known = fresh.withColumn("fresh", F.lit(True))
        stored = _stored(spark, store, batch_id)
        if stored is not None:
            first = batch.agg(F.min("start_time_ms")).first()[0]
            low = (first or 0) - prior_ms
            past = stored.where((F.col("day") >= low // DAY_MS) & (F.col("end_time_ms") >= low))
            past = past.select(*ht.WINDOW, "term", "size", "total_posts")
            known = known.unionByName(past.withColumn("fresh", F.lit(False)))
        scored = ht.hashtag_likelihood(ht.hashtag_priors(known, span_ms, prior_ms)).where("fresh")
        rows = scored.drop("fresh").withColumn(
            "is_unlikely", F.when(F.col("likelihood") > threshold, 1).otherwise(0)
        )
        day = F.floor(F.col("end_time_ms") / DAY_MS)
        path = f"{store}/batch={batch_id}"
        rows.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(path)

    return score


#: Columns that the scores need of earlier batches.
STORED = "start_time_ms long, end_time_ms long, term string, size long, total_posts long, batch long, day long"


def _stored(spark: SparkSession, store: str, batch_id: int) -> DataFrame | None:
    """Rows written by earlier batches, none before there are any."""
    if not path_exists(spark, store):
        return None
    return spark.read.schema(STORED).parquet(store).where(F.col("batch") < batch_id)
