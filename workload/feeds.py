"""Sources: files made of the given tables, read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.lineage import new_path
from pulseweave.sources import feeds, tweets
from workload import views as v
from workload.registry import case

BROKEN = 7


def tweet_folder(spark, sf):
    """Documents as tweet lines; every seventh line breaks off."""
    d = v.table(spark, sf, "documents")
    tags = F.struct(F.array(F.struct(F.col("source").alias("text"))).alias("hashtags"))
    tweet = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id_str"), "text", "lang", tags.alias("entities")))
    line = F.when(F.col("doc_id") % BROKEN == 0, F.substring(tweet, F.lit(1), F.length(tweet) - 1)).otherwise(tweet)
    path = new_path(spark, "tweets")
    d.select(line.alias("value")).write.text(path)
    return path


@case(
    "read_tweet_json_lines",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id_str, md5(text) AS text_md5, source AS tag FROM documents
    WHERE lang = 'en' AND doc_id % {BROKEN} <> 0""",
)
def read_tweet_json_lines(spark, sf):
    found = tweets.read_tweet_json_lines(spark, tweet_folder(spark, sf), "en", "*.txt")
    return found.select("id_str", F.md5("text").alias("text_md5"), F.get("entities.hashtags", F.lit(0))["text"].alias("tag"))


@case(
    "tweet_line_counts",
    f"""SELECT CASE WHEN doc_id % {BROKEN} <> 0 THEN lang END AS lang, doc_id % {BROKEN} = 0 AS broken, count(*) AS n_lines
    FROM documents GROUP BY ALL""",
)
def tweet_line_counts(spark, sf):
    """What was read and what had to be left out."""
    # Lines that break off may have shown a language before they did.
    counts = tweets.line_counts(tweets.tweet_lines(spark, tweet_folder(spark, sf), "*.txt"))
    lang = F.when(~F.col("broken"), F.col("lang")).alias("lang")
    return counts.groupBy(lang, "broken").agg(F.sum("n_lines").alias("n_lines"))


@case(
    "rss_source",
    """SELECT url AS guid, 'page ' || page_id AS title, url || '#' || page_id AS link, 'Html' AS "extractType", false AS processed,
      epoch_ms(make_timestamp(2020, 1, 1, 0, 0, 0)) + page_id * 60000 AS timestamp_ms FROM pages""",
)
def rss_source(spark, sf):
    """Pages as items of feeds, a feed of up to 500 in a file."""
    at = F.timestamp_seconds(F.lit(1577836800) + F.col("page_id") * 60)
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(
        F.lit("<item><guid>"), escaped, F.lit("</guid><title>page "), F.col("page_id").cast("string"), F.lit("</title><link>"), escaped, F.lit("#"),
        F.col("page_id").cast("string"), F.lit("</link><pubDate>"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("</pubDate></item>"),
    )
    path = new_path(spark, "feeds")
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("value")
    by_feed = v.table(spark, sf, "pages").select(item.alias("item"), F.floor(F.col("page_id") / 500).alias("feed")).groupBy("feed").agg(feed)
    by_feed.select("value", "feed").write.partitionBy("feed").text(path)
    items = feeds.rss_source(spark, path, "Html")
    ms = F.unix_millis(F.to_timestamp("pubdate", "yyyy-MM-dd HH:mm:ss"))
    return items.select("guid", "title", "link", "extractType", "processed", ms.alias("timestamp_ms"))


@case(
    "binary_image_source",
    """SELECT 'lang=' || lang AS folder, count(*) > 0 AS has_bytes, sum(octet_length(encode(text)) + 1) AS n_bytes
    FROM documents WHERE lang IN ('en', 'de') GROUP BY lang""",
)
def binary_image_source(spark, sf):
    """Files by folder with their bytes; files of other kinds are left out."""
    path = new_path(spark, "pictures")
    d = v.table(spark, sf, "documents")
    by_lang = d.where("lang IN ('en', 'de')").select("text", "lang")
    by_lang.write.partitionBy("lang").text(path)
    d.where("lang = 'fr'").select("text").write.text(f"{path}/lang=xx", compression="gzip")
    files = feeds.binary_image_source(spark, path, "*.txt").withColumn("folder", F.regexp_extract("path", "(lang=[^/]+)/", 1))
    return files.groupBy("folder").agg((F.sum(F.octet_length("content")) > 0).alias("has_bytes"), F.sum("length").alias("n_bytes"))
