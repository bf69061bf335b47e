import json

import pytest
from pyspark.sql import functions as F

from pulseweave.operators import ingest as ig
from pulseweave.operators import windows as wn
from pulseweave.sources import feeds, tweets

TWEET = {
    "id_str": "1", "text": "march on", "lang": "en", "created_at": "Wed Aug 27 13:08:45 +0000 2008",
    "user": {"id_str": "7", "screen_name": "ann"},
    "entities": {"hashtags": [{"text": "A"}], "urls": [{"expanded_url": "http://u"}]},
}


def quoting(**quoted):
    return {**TWEET, "quoted_status": quoted}


def as_posts(spark, *rows):
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return tweets.tweet_ingest(tweets.parse_tweets(raw))


def test_tweet_fields(spark):
    row = as_posts(spark, TWEET).first()
    assert row.post_url == "https://twitter.com/ann/status/1"
    assert row.hashtags == ["A"] and row.image_urls[0].expanded_url == "http://u"


def test_quoted_text_needs_quoted_tags(spark):
    rows = as_posts(
        spark,
        quoting(text="more", entities={"hashtags": [{"text": "B"}], "media": [{"expanded_url": "http://m"}]}),
        quoting(text="more", entities={}),
        quoting(text="more", entities={"hashtags": []}),
    )
    out = ig.merge_quoted_status(rows).collect()
    assert [r.text for r in out] == ["march on more", "march on", "march on more"]
    assert out[0].hashtags == ["A", "B"] and out[1].hashtags == ["A"]
    assert [u.expanded_url for u in out[0].image_urls] == ["http://u", "http://m"]
    assert "quoted_status" not in out[0].asDict()


def test_ingest_fans_out_and_parses_time(spark):
    out = ig.ingest(as_posts(spark, TWEET)).collect()
    assert sorted(r.featurizer for r in out) == ["hashtag", "image", "text"]
    assert {r.timestamp_ms for r in out} == {1219842525000}


@pytest.mark.parametrize(
    "text, ms",
    [
        ("1219842525000", 1219842525000),
        ("2008-08-27T13:08:45Z", 1219842525000),
        ("Wed, 27 Aug 2008 13:08:45 GMT", 1219842525000),
        ("not a time", None),
    ],
)
def test_time_formats(spark, text, ms):
    assert spark.createDataFrame([(text,)], "t string").select(ig.time_to_ms(F.col("t"))).first()[0] == ms


def test_validate_names_missing_fields(spark):
    schema = "post_id string, post_type string, post_url string, timestamp_ms string"
    ok, bad = ig.validate_posts(
        spark.createDataFrame([("1", "t", "u", "5"), ("2", "t", None, "5"), (None, "t", None, "5")], schema)
    )
    assert [r.post_id for r in ok.collect()] == ["1"]
    assert sorted(r.reasons for r in bad.collect()) == [["post_id", "post_url"], ["post_url"]]


def test_dedupe_keeps_first(spark):
    rows = spark.createDataFrame(
        [("1", "text", 2, "b"), ("1", "text", 1, "a"), ("1", "image", 3, "c")],
        "post_id string, featurizer string, at int, text string",
    )
    assert sorted(r.text for r in ig.dedupe_posts(rows, "at").collect()) == ["a", "c"]


def test_govern(spark):
    rows = spark.range(20).repartition(5)
    assert sorted(r.id for r in ig.govern_traffic(rows, 0.3, ["id"]).collect()) == [4, 9, 14, 19]
    assert ig.govern_traffic(rows, None, ["id"]).count() == 20
    assert ig.govern_traffic(rows, 0.3, ["id"], on=False).count() == 20
    assert ig.govern_traffic(rows, 0.3, ["id"], drop_all=True).count() == 0
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            ig.govern_traffic(rows, bad, ["id"])


def test_row_index_is_dense_with_ties(spark):
    from pulseweave.operators.ordering import with_row_index

    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(7)
    got = [(r.k, r.id) for r in with_row_index(rows, ["k", "id"]).orderBy("row_index").collect()]
    assert got == sorted(got) and len(got) == 1000


def test_rss_items(spark, tmp_path):
    item = "<item><guid>{}</guid><title>t</title><link>http://l</link><description>d</description><pubDate>Wed, 27 Aug 2008 13:08:45 GMT</pubDate></item>"
    (tmp_path / "f.xml").write_text(
        "<rss><channel>" + item.format(1) + item.format(2) + item.format(1) + "</channel></rss>"
    )
    items = feeds.rss_source(spark, str(tmp_path), "Html")
    assert items.count() == 3
    none = items.limit(0)
    fresh = ig.feed_item_dedupe(items, none, "pubdate")
    assert sorted(r.guid for r in fresh.collect()) == ["1", "2"]
    assert "dc:date.taken" not in fresh.columns
    posts = ig.feed_to_posts(fresh).collect()
    assert posts[0].timestamp_ms == 1219842525000 and posts[0].lang == "en"
    assert ig.feed_to_posts(ig.mark_processed(fresh)).count() == 0


def test_tweet_lines_skip_broken(spark, tmp_path):
    lines = [json.dumps(TWEET), "{broken", json.dumps({**TWEET, "lang": "fr"}), json.dumps({"text": "x"})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    assert tweets.read_tweet_json_lines(spark, str(tmp_path), "en").count() == 1


def test_keyword_track_whole_words(spark):
    rows = spark.createDataFrame([("a #Riot!",), ("patriot",), ("Police.",)], "text string")
    assert [r.text for r in tweets.keyword_track(rows).collect()] == ["a #Riot!", "Police."]


def test_retry_states(spark):
    polls = spark.createDataFrame(
        [(1, 0, 5), (1, 1, 20), (2, 0, 1), (2, 1, 1), (2, 2, 1), (3, 0, 1)],
        "window_id int, poll int, n_posts int",
    )
    out = {r.window_id: (r.state, r.retries) for r in wn.window_retry_state(polls, 2, 10).collect()}
    assert out == {1: ("running", 1), 2: ("skip", 2), 3: ("new", 1)}


def test_bounded_relation_is_checked(spark):
    from pulseweave.operators.query import include_relation

    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, "a"), (1, "b")], "pid int, x string")
    got = include_relation(parents, children, "id", "pid", "kids", max_children=2).collect()
    assert sorted((r.id, [k.x for k in r.kids]) for r in got) == [(1, ["a", "b"]), (2, [])]
    assert include_relation(parents, children, "id", "pid", "kids").count() == 3
    with pytest.raises(Exception, match="more than 1 kids"):
        include_relation(parents, children, "id", "pid", "kids", max_children=1).collect()


def test_filter_with_relations(spark):
    from pulseweave.operators.query import Relation, apply_filter

    parents = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id long, name string, n long")
    kids = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "pid long, age long")
    spec = {"where": {"n": {"lt": 7}}, "order": "n desc", "fields": ["id", "name"], "include": "kids"}
    nested = apply_filter(parents, spec, {"kids": Relation(kids, "id", "pid", 2)}).collect()
    assert {r.id: [k.age for k in r.kids] for r in nested} == {1: [10, 11], 2: []}
    rows = apply_filter(parents, {"include": ["kids"]}, {"kids": Relation(kids, "id", "pid")})
    assert sorted((r.id, r.kids.age if r.kids else None) for r in rows.collect() if r.id != 2) == [(1, 10), (1, 11), (3, 12)]


def test_ranks_and_order_statistics(spark):
    from pulseweave.operators.ordering import kth_value, with_rank

    rows = [(g, i * 7 % 50) for g in ("a", None, "b") for i in range(50 if g == "a" else 9)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(5)
    got = {(r.g, r.x): r.position for r in with_rank(df, ["g"], ["x"]).collect()}
    assert got == {(g, x): sorted(b for a, b in rows if a == g).index(x) + 1 for g, x in rows}
    values = [0.5] * 40 + [0.25, -1.0, 7.5, 0.5000000000000001] + [i / 7 for i in range(30)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 1, 20, 45, 60, len(values) - 1):
        value, smaller = kth_value(frame, "v", k, bins=8)
        assert value == sorted(values)[k] and smaller == sum(v < value for v in values)
    assert kth_value(frame, "v", len(values)) is None


def test_names_of_every_length(spark):
    from pulseweave.operators import enrich as en

    long = " ".join(f"w{i}" for i in range(40))
    names = [("new york", "LOCATION"), ("york", "PERSON"), (long, "ORGANIZATION"), ("the new york times", "ORGANIZATION")]
    gazetteer = spark.createDataFrame(names, "label string, tag string")
    texts = [(1, "The New York Times in York"), (2, "x " + long + " y"), (3, "new, york"), (4, ""), (5, None), (6, "york new york")]
    docs = spark.createDataFrame(texts, "id long, text string")
    want = {(1, "new york"), (1, "york"), (1, "the new york times"), (2, long), (3, "new york"), (3, "york"), (6, "york"), (6, "new york")}
    for most in (10_000, 1):
        found = en.name_starts(gazetteer, most)
        assert set(found) == {1, 2, 4, 40} and found[40] == ["w0"]
        assert {(r.id, r.label) for r in en.extract_entities(docs, "id", "text", gazetteer).collect()} == want
    assert {(r.id, r.label) for r in en.extract_entities(docs, "id", "text", gazetteer, longest=1).collect()} == {w for w in want if " " not in w[1]}
