"""Schemas of the tables and messages the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def fields(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


LINK_REF = fields(expanded_url=STR)

POST = fields(
    post_id=STR,
    post_type=STR,
    post_url=STR,
    author_id=STR,
    screen_name=STR,
    author_image_url=STR,
    lang=STR,
    text=STR,
    hashtags=T.ArrayType(STR),
    image_urls=T.ArrayType(LINK_REF),
    primary_image_url=STR,
    timestamp_ms=LONG,
    state=STR,
    featurizer=STR,
    quote_post_id=STR,
    broadcast_post_id=STR,
    reply_to_post_id=STR,
    campaigns=T.ArrayType(STR),
)

_ENTITIES = fields(
    hashtags=T.ArrayType(fields(text=STR)),
    urls=T.ArrayType(LINK_REF),
    media=T.ArrayType(LINK_REF),
)

TWEET = fields(
    id_str=STR,
    text=STR,
    lang=STR,
    created_at=STR,
    user=fields(id_str=STR, screen_name=STR, profile_image_url=STR),
    entities=_ENTITIES,
    quoted_status=fields(text=STR, entities=_ENTITIES),
    quoted_status_id_str=STR,
    retweeted_status=fields(id_str=STR),
    in_reply_to_status_id_str=STR,
)

CLUSTER = fields(
    cluster_id=STR,
    data_type=STR,
    start_time_ms=LONG,
    end_time_ms=LONG,
    term=STR,
    size=LONG,
    is_unlikely=T.IntegerType(),
)
CLUSTER_MEMBER = fields(cluster_id=STR, data_type=STR, end_time_ms=LONG, post_id=STR)
FEED = fields(feed_id=STR, url=STR, feedType=STR, extractType=STR, active=BOOL)
FEED_ITEM = fields(
    guid=STR, title=STR, description=STR, link=STR, pubdate=STR, extractType=STR, processed=BOOL
)
SETTING = fields(key=STR, type=STR, value=STR)
