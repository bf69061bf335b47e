"""Epoch-millisecond and ISO time columns (all UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: feed timestamps look like 2014-08-10T01:59:31.979Z; the last five
# characters (millis and zone) are cut before parsing.
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
ISO_TAIL = 5


def ms_from_ts(ts: Column) -> Column:
    """Epoch millis truncated to whole seconds."""
    return F.unix_seconds(ts.cast("timestamp")) * 1000


def ts_from_iso(text: Column) -> Column:
    """ISO text to timestamp; anything in another format gives null."""
    return F.try_to_timestamp(
        text.substr(F.lit(1), F.length(text) - ISO_TAIL), F.lit(ISO_SECONDS)
    )


def ms_from_iso(text: Column) -> Column:
    return ms_from_ts(ts_from_iso(text))


def ts_from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def ms_between(later: Column, earlier: Column) -> Column:
    """Difference in millis, in whole seconds truncated toward zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return (micros / 1_000_000).cast("long") * 1000


def iso_from_ms(ms: Column) -> Column:
    """ISO text without zone; millis shown only where they are not zero."""
    ts = F.timestamp_millis(ms)
    return F.when(
        ms % 1000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
