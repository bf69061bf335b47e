"""Dense positions in a global order without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.lineage import materialize

_LOCAL_BITS = 33


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Zero-based position of each row in ``order``.

    Rows are range partitioned and sorted inside their partition; the only data
    seen by one task is the table of partition sizes. The sorted table is
    written once, so positions stay the same if a task is run again.
    """
    seq = F.monotonically_increasing_id()
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", seq)
        .withColumn("_part", F.shiftright("_seq", _LOCAL_BITS))
    )
    ranged = materialize(ranged, "row-index")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    local = F.col("_seq").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_seq", "_part", "_before")
    )


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Place of each row (from 1) among the rows that share ``by``, in ``order``.

    Ranks have two levels, the place in one global order and the first place of each
    group, so a huge group is spread over tasks like any other rows.
    """
    indexed = with_row_index(df, [*by, *order], "_index")
    first = indexed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_index").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    placed = indexed.join(first, same).withColumn(name, (F.col("_index") - F.col("_first") + 1).cast("int"))
    return placed.select(*df.columns, name)


def kth_value(values: DataFrame, column: str, k: int, bins: int = 4096) -> tuple[float, int] | None:
    """The value of a number column at place ``k`` (from 0, ascending), and how many rows are smaller.

    Each pass counts rows in at most ``bins`` bins of what is left; the bin that holds the
    place is narrowed until a single value is in it.
    """
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 0 <= k < (n or 0):
        return None
    smaller = 0
    while low < high:
        width = (high - low) / bins
        inside = values.where(F.col(column).between(low, high))
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counts = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for b in counts.orderBy("bin").collect():
            if k < smaller + b["n"]:
                break
            smaller += b["n"]
        if (b["low"], b["high"]) == (low, high):
            # Neighbouring numbers that no bin can part: a handful of values.
            for value, n in inside.groupBy(column).count().orderBy(column).collect():
                if k < smaller + n:
                    return value, smaller
                smaller += n
        low, high = b["low"], b["high"]
    return low, smaller
