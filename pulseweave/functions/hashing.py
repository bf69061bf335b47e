"""Small stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier and word size of the node-id string hash.
HASH_FACTOR = 31
WORD = 1 << 32


def string_hash32(text: Column) -> Column:
    """Signed 32-bit rolling hash over UTF-16 units, as used for graph node ids."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1)
    folded = F.aggregate(
        units,
        F.lit(0).cast("long"),
        lambda acc, u: F.pmod(acc * HASH_FACTOR + F.conv(u, 16, 10).cast("long"), F.lit(WORD)),
    )
    return F.when(folded >= WORD // 2, folded - WORD).otherwise(folded)


def sample_key(item: Column, seed: str) -> Column:
    """Order key of a repeatable random sample."""
    return F.md5(F.concat(item.cast("string"), F.lit(seed)))
