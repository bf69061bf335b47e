"""Streams against the batch operators on the same rows."""

from pyspark.sql import functions as F

from pulseweave.lineage import new_path
from pulseweave.operators import hashtags as ht
from pulseweave.operators import windows as wn
from pulseweave.streaming import jobs, state

HOUR = 3_600_000


def test_windows_split_over_batches_score_like_a_batch(spark):
    rows = [(i, i * HOUR // 3, ["A", f"t{i % 3}"] if i % 5 else ["a", "a"]) for i in range(120)]
    posts = spark.createDataFrame(rows, "post_id long, timestamp_ms long, hashtags array<string>")
    posts = posts.withColumn("ts", F.timestamp_millis("timestamp_ms"))
    path = new_path(spark, "split-windows")
    for i in range(0, 120, 25):  # windows of twelve posts, files of twenty-five
        posts.where((F.col("post_id") >= i) & (F.col("post_id") < i + 25)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = new_path(spark, "split-store")
    groups = jobs.stream_tag_groups(stream, "ts", "4 hours", "1 hour")
    jobs.run_batches(groups, jobs.hashtag_score_batch(store, 4 * HOUR, 2, prior_ms=12 * HOUR), "split")
    cols = ["end_time_ms", "term", "size", "total_posts", "prior_alpha", "prior_beta", "is_unlikely"]
    got = sorted(map(tuple, spark.read.parquet(store).select(*cols).collect()))
    want = ht.hashtag_clusters(wn.tumbling_windows(posts, 4 * HOUR), 4 * HOUR, 2, prior_ms=12 * HOUR)
    closed = rows[-1][1] - HOUR
    assert got == sorted(tuple(r) for r in want.where(F.col("end_time_ms") < closed).select(*cols).collect())
    assert len({r[0] for r in got}) > 5


def arrive(spark, rows, schema, batches, run):
    """Runs a stream again and again as its rows come in."""
    path = new_path(spark, "arrivals")
    for low, high in batches:
        spark.createDataFrame(rows[low:high], schema).repartition(3).write.mode("append").parquet(path)
        run(spark.readStream.schema(schema).parquet(path))


def test_admission_counts_over_batches(spark):
    rows = [(i, i // 3) for i in range(100)]
    store, offsets = new_path(spark, "governed"), new_path(spark, "govern-offsets")
    govern = state.govern_batch(store, 0.5, ["t", "id"])
    arrive(spark, rows, "id long, t long", [(0, 7), (7, 8), (8, 50), (50, 100)], lambda s: jobs.run_batches(s, govern, "govern", offsets))
    assert sorted(r["id"] for r in spark.read.parquet(f"{store}/admitted").collect()) == list(range(2, 100, 3))
    # A batch that is run again writes the same rows.
    govern(spark.createDataFrame(rows[7:8], "id long, t long"), 1)
    govern(spark.createDataFrame(rows[8:50], "id long, t long"), 2)
    assert sorted(r["id"] for r in spark.read.parquet(f"{store}/admitted").collect()) == list(range(2, 100, 3))


def test_windows_leave_whole(spark):
    rows = [(i, HOUR * 4000 + i * HOUR // 4, [f"t{i % 2}"] if i % 3 else None) for i in range(60)] + [(99, 4001 * HOUR, ["late"])]
    schema = "post_id long, ms long, tags array<string>"
    store, offsets = new_path(spark, "closed"), new_path(spark, "closed-offsets")

    def run(stream):
        posts = stream.withColumn("ts", F.timestamp_millis("ms"))
        closed = state.stream_closed_windows(posts, "ts", 4 * HOUR, "1 hour", parts=3)
        jobs.run_batches(closed, lambda df, i: df.write.mode("overwrite").parquet(f"{store}/batch={i}"), "closed", offsets)

    arrive(spark, rows, schema, [(0, 10), (10, 37), (37, 60), (60, 61)], run)
    got = spark.read.parquet(store)
    assert got.groupBy("start_time_ms").agg(F.count_distinct("batch").alias("n")).filter("n > 1").count() == 0
    want = [(r[1] // (4 * HOUR) * 4 * HOUR, *r) for r in rows[:60] if r[1] // (4 * HOUR) * 4 * HOUR + 4 * HOUR <= rows[59][1] - HOUR]
    assert sorted(map(tuple, got.select("start_time_ms", "post_id", "ms", "tags").collect())) == sorted(want)


def test_windows_run_or_are_skipped(spark):
    """The window from hour 4 misses the gate at its first look and meets it at the second, by posts that come late."""
    first = [(m * HOUR // 4,) for m in range(0, 16)] + [(5 * HOUR,), (9 * HOUR,)] + [(10 * HOUR,)]
    late = [(6 * HOUR + i,) for i in range(5)] + [(17 * HOUR,)]
    rows = [(4000 * HOUR + r[0],) for r in first + late + [(40 * HOUR,)]]
    out, offsets = new_path(spark, "states"), new_path(spark, "states-offsets")

    def run(stream):
        posts = stream.withColumn("ts", F.timestamp_millis("ms"))
        states = state.stream_window_states(posts, "ts", 4 * HOUR, "0 seconds", min_posts=5, max_retries=2)
        jobs.run_batches(states, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), "states", offsets)

    arrive(spark, rows, "ms long", [(0, 19), (19, 25), (25, 26)], run)
    got = sorted((r["start_time_ms"] // HOUR - 4000, r["n_posts"], r["retries"], r["state"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 16, 0, "running"), (4, 6, 1, "running"), (8, 2, 2, "skip"), (16, 1, 2, "skip")]


def test_events_match_over_batches(spark):
    tags = [("a", 0, "x", 0.5), ("a", 0, "y", 0.5), ("b", 0, "z", 1.0), ("c", 1, "x", 0.25), ("c", 1, "z", 0.75), ("d", 1, "w", 1.0), ("e", 3, "x", 1.0), ("f", 4, "x", 1.0), ("f", 4, "q", 0.0), ("g", 6, "x", 1.0)]
    rows = [(e, (4000 + w) * HOUR, (4001 + w) * HOUR - 1, t, s) for e, w, t, s in tags]
    schema = "event_id string, start_time_ms long, end_time_ms long, term string, share double"
    store, offsets = new_path(spark, "matched"), new_path(spark, "match-offsets")
    match = state.event_match_batch(store, 0.2)
    arrive(spark, rows, schema, [(0, 3), (3, 5), (5, 6), (6, 8), (8, 10)], lambda s: jobs.run_batches(state.stream_match_parts(s), match, "match", offsets))
    got = sorted((r["event_id"], r["sibling_id"], r["score"]) for r in spark.read.parquet(store).collect())
    assert got == [("a", None, None), ("b", None, None), ("c", "b", 0.75), ("d", None, None), ("e", None, None), ("f", "e", 1.0)]


def test_registered_match_holds_the_last_windows(spark, tmp_path):
    """Every event of the batch chain is there, also those of the windows that no post comes after."""
    from pulseweave.operators import events as ev
    from workload import load
    from workload import views as v

    docs = [(i, "some words", "en" if i % 2 else "fr", f"s{i % 2}") for i in range(48)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    events = spark.range(48).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id * 10800000) AS ts", "id AS user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    ec = v.doc_ec(spark, str(tmp_path))
    want = ev.match_prior_events(ev.event_rollup(ec), ev.event_hashtags(ec), min_score=0.2)
    want = {(r["event_id"], r["sibling_id"]) for r in want.collect()}
    assert len({e.split("|")[0] for e, _ in want}) == 4 and any(s for _, s in want)
    rows = load().QUERIES["stream_event_match"](spark, str(tmp_path)).collect()
    assert {(r["event_id"], r["sibling_id"]) for r in rows} == want
    assert len(rows) == len(set(rows)) == ev.event_hashtags(ec).count()


def test_state_has_no_more_parts_than_tasks_run(spark):
    """Few rows do not open a store per shuffle partition, a batch is made once, and other jobs keep their settings."""
    import os

    tags = [(f"e{i}", i * HOUR, (i + 1) * HOUR - 1, f"t{i % 3}", 1.0) for i in range(4000, 4006)]
    path, offsets, made = new_path(spark, "few-parts"), new_path(spark, "few-offsets"), []
    spark.createDataFrame(tags, "event_id string, start_time_ms long, end_time_ms long, term string, share double").coalesce(1).write.parquet(path)
    found = state.stream_match_parts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def each(batch, batch_id):
        made.append((batch.sparkSession.conf.get("spark.sql.shuffle.partitions"), len(batch.inputFiles()) > 0))

    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        jobs.run_batches(found, each, "few", offsets)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(made) == 2 and set(made) == {("50", True)}
    parts = [x for x in os.listdir(f"{offsets.removeprefix('file:')}/state/0") if x.isdigit()]
    assert len(parts) == min(50, spark.sparkContext.defaultParallelism)
