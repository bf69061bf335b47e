"""Lines that other documents hold already, as bitmaps of the lines to keep.

Every line of some length becomes a 128-bit hash of its key with the document and the
line's position. These slim rows are range-partitioned by hash and sorted inside a
partition by hash, document and position, so the first document of a hash comes first
and the others stream past it. What leaves the stream are the positions that later
documents lose, gathered into one bitmap per document; texts are never sorted, and are
read again only where a caller wants the lines that stay.

A hash with more rows than a part of one task's share is decided by itself: its first
document comes from an aggregate that is combined before the shuffle, and the table of
such hashes is joined with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.lineage import broadcast_if_small, materialize
from pulseweave.llm.common import lower_ascii, task_count

#: ASCII white space, stripped from both ends of a line.
BLANK = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
#: Code points a key holds at least; shorter lines always stay.
LEAST_CHARS = 10
ROWS_PER_TASK = 500_000
#: A hash is hot from this part of a task's rows on, so there are at most so many hot hashes a task.
HOT_PARTS = 8
WORD_BITS = 64
#: All lines of a word of the bitmap are kept.
ALL = -1


def text_lines(text: Column) -> Column:
    """Lines between line feeds; a null text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _documents(documents: DataFrame) -> DataFrame:
    """``doc_id``, the text's hash (which tells rows with one id apart) and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def line_rows(documents: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``doc_id``, ``text_hash``, ``pos`` of each line long enough to be compared."""
    lowered = _documents(documents).select("doc_id", "text_hash", F.posexplode(text_lines(lower_ascii(F.col("text")))).alias("pos", "line"))
    keys = lowered.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(BLANK)).alias("key"))
    hashes = F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    return keys.filter(F.char_length("key") >= LEAST_CHARS).select(*hashes, "doc_id", "text_hash", "pos")


def later_lines(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``doc_id``, ``text_hash``, ``pos`` of the lines whose hash an earlier document holds.

    The earliest document is that with the least ``doc_id``, null last. ``rows`` should be
    a written table, as it is read three times.
    """
    total = rows.count()
    tasks = task_count(rows, total, rows_per_task)
    limit = max(2, total // tasks // HOT_PARTS)
    counts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("hot_first"))
    # At most HOT_PARTS rows a task: the counts of all hashes add up to the total.
    hot = materialize(counts.filter(F.col("n") > limit).drop("n"), "hot-lines")
    marked = rows.join(broadcast_if_small(hot.withColumn("hot", F.lit(True))), ["h1", "h2"], "left")
    is_later = lambda first: ~F.col("doc_id").eqNullSafe(F.col(first))
    known = marked.filter("hot").filter(is_later("hot_first"))
    rest = marked.filter("hot IS NULL").select("h1", "h2", "doc_id", "text_hash", "pos")
    # The range partitioning serves the window, which adds the secondary sort only.
    ranged = rest.repartitionByRange(tasks, "h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    passed = ranged.withColumn("first_doc", F.first("doc_id").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    columns = ("doc_id", "text_hash", "pos")
    return known.select(*columns).unionByName(passed.filter(is_later("first_doc")).select(*columns))


def keep_bitmaps(documents: DataFrame) -> DataFrame:
    """The bitmap of each document that loses a line: ``doc_id``, ``text_hash``, ``n_dropped``, ``words``.

    ``words`` is an array of (word, keep), ordered: bit i of the word w stands for line
    64 w + i and is 1 if the line stays. Words not listed keep all their lines, and
    documents not listed too.

    A line's key is the line without ASCII white space at both ends, A to Z in lower
    case. Of a key with at least ``LEAST_CHARS`` code points all lines go but those of the
    least ``doc_id`` that holds it. Rows with one id count as one document, rows with a
    null id as one document after all others; repeated rows stay repeated and share a
    bitmap. Other columns are left out.
    """
    rows = materialize(line_rows(documents), "line-hashes")
    later = later_lines(rows)
    bit = F.expr(f"shiftleft(1L, pos % {WORD_BITS})")
    words = later.groupBy("doc_id", "text_hash", F.expr(f"int(pos div {WORD_BITS})").alias("word")).agg(F.bit_or(bit).alias("gone"))
    each = F.struct("word", F.bitwise_not("gone").alias("keep"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("gone").cast("long")).alias("n_dropped"), F.sort_array(F.collect_list(each)).alias("words")
    )


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines`` (before), ``n_dropped`` and the ``kept`` text of every row of ``documents``."""
    lost = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("text_hash").alias("b_hash"), "n_dropped", "words")
    same = F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("text_hash") == F.col("b_hash"))
    found = _documents(documents).join(lost, same, "left").withColumn("lines", text_lines(F.col("text")))
    # The listed words and the gaps between them side by side, so that a line finds its word at once.
    gap = lambda w, i: w["word"] - F.coalesce(F.get("words", i - 1)["word"], F.lit(-1)) - 1
    dense = F.flatten(F.transform("words", lambda w, i: F.concat(F.array_repeat(F.lit(ALL).cast("long"), gap(w, i)), F.array(w["keep"]))))
    found = found.withColumn("dense", dense)
    word = lambda i: F.coalesce(F.get("dense", F.floor(i / WORD_BITS).cast("int")), F.lit(ALL))
    stays = lambda line, i: F.getbit(word(i), i % WORD_BITS) == 1
    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.filter("lines", stays), "\n"))
    return found.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept")
    )


def dedup_lines(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` without the lines that an earlier document holds; see above.

    A null or empty text is one empty line, which stays. An empty table gives an empty result.
    """
    return apply_bitmaps(documents, keep_bitmaps(documents))
