"""License scans by the digest of canonical texts.

Texts that differ only in case, punctuation, white space, copyright lines or
equivalent spellings have the same canonical form; its digest is looked up in a hash
join with the digests of known license texts. Everything runs as Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseweave.llm.common import lower_ascii
from pulseweave.llm.license_texts import KNOWN

#: Spellings that count as one (fixed values, from the public license matching guidelines).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("sub licence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

#: A copyright line: it names a holder or a year, or reserves all rights.
COPYRIGHT_LINE = r"(?:^|\n)[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[12][0-9][0-9][0-9]|<|\[)|\(c\)[ \t]|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PUNCTUATION_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

#: Title lines of license texts (fixed values, in lower case).
TITLES = (
    "0bsd license", "2-clause bsd license", "3-clause bsd license", "boost software license - version 1.0 - august 17th, 2003",
    "boost software license", "bsd 2-clause license", "bsd 3-clause license", "bsd license", "bsd zero clause license", "expat license",
    "isc license", "mit license", "mit no attribution license", "modified bsd license", "new bsd license", "simplified bsd license",
    "unlicense", "zlib license", "zlib/libpng license",
)
#: A line that is a title and nothing else; "m" lets the ends match at line breaks.
TITLE_LINE = (
    r"(?m)^[ \t]*(?:the )?(?:"
    + "|".join(t.replace(".", "[.]").replace("license", "licen[cs]e") for t in TITLES)
    + r")(?: [(][a-z0-9 .-]+[)])?[ \t\r.:]*$"
)


def _marked(text: Column) -> Column:
    """Words in lower case between single blanks, and line breaks as words; the equivalents within lines are replaced."""
    text = lower_ascii(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, COPYRIGHT_LINE, "\n")
    # Every title has these letters. "d": no other character ends a line.
    text = F.when(text.contains("licen"), F.regexp_replace(text, TITLE_LINE.replace("(?m)", "(?md)"), "")).otherwise(text)
    text = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" \n ")), PUNCTUATION_IN_LINE, " ")
    return _replaced(text, EQUIVALENT)


def _replaced(text: Column, pairs) -> Column:
    """Words or phrases exchanged for their equivalents in a text of words between single blanks."""
    # Two blanks between words, so that neighbouring words can both be replaced.
    text = F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit("  "))
    for given, kept in pairs:
        text = F.replace(text, F.lit(f" {given} ".replace(" ", "  ")[1:-1]), F.lit(f" {kept} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def _whole(marked: Column) -> Column:
    """The canonical form of a text from its marked one: phrases may go on over a line break."""
    return _replaced(F.trim(F.replace(F.concat(F.lit(" "), marked), F.lit(" \n"), F.lit(""))), [(a, b) for a, b in EQUIVALENT if " " in a])


def _lines(marked: Column) -> Column:
    """The canonical forms of the lines that have words."""
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def canonical(text: Column) -> Column:
    """Canonical form: words in lower case with one blank between; null counts as empty.

    Copyright lines and lines that are the title of a license are left out.
    """
    return _whole(_marked(text))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """``digest`` and ``license`` of the known texts, or of a table (license, text) of one's own.

    If several licenses share a canonical text, the least identifier stands for it.
    """
    if known is None:
        known = spark.createDataFrame([(k, t) for k, texts in KNOWN.items() for t in texts], "license string, text string")
    digests = known.filter("license IS NOT NULL AND text IS NOT NULL").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return digests.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licenses of every document, as a whole and among its lines.

    One row per row of ``documents``: ``doc_id``, ``digest`` (of the whole canonical text),
    ``license`` (if that is a known text, else null), ``n_lines`` (lines with words),
    ``n_license_lines`` (lines that are a known text) and ``line_licenses`` (sorted
    identifiers). Each text and each line is looked up whole. Null and empty texts have the
    digest of the empty form and no license; other columns are left out. Known texts are
    few: those built in, or the caller's, whose join Spark plans by size.
    """
    spark = documents.sparkSession
    digests = known_digests(spark, known).filter(F.col("digest") != F.sha2(F.lit(""), 256))
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Each text is put in canonical form once; its lines are cut from that.
    marked = docs.select("row", "doc_id", _marked(F.col("text")).alias("marked"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), _whole(F.col("marked")).alias("form")))
    lines = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("form")))
    cut = marked.select("row", "doc_id", "marked", _lines(F.col("marked")).alias("lines"))
    parts = cut.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.inline(F.concat(whole, lines)))
    parts = parts.select("row", "doc_id", "n_lines", "whole", F.sha2("form", 256).alias("digest"))
    found = parts.join(digests.withColumnRenamed("digest", "known"), F.col("digest") == F.col("known"), "left")
    # Lines that are no known text end here: nothing of them is shuffled.
    found = found.filter(F.col("whole") | F.col("license").isNotNull())
    line = ~F.col("whole") & F.col("license").isNotNull()
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
            F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
            F.max("n_lines").alias("n_lines"),
            F.count_if(line).alias("n_license_lines"),
            F.sort_array(F.collect_set(F.when(line, F.col("license")))).alias("line_licenses"),
        )
        .drop("row")
    )
