"""Table jobs over text: token tables, document frequency, vectors, word clouds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.functions import text as tx
from pulseweave.functions.vector import dot, norm, scale, sum_vector, usable
from pulseweave.lineage import broadcast_if_small, materialize
from pulseweave.operators.ordering import kth_value, with_rank, with_row_index
from pulseweave.operators.vectorjobs import strips

TOP_IDF = 3
#: Documents that one task holds against as many others.
PROBE_BLOCK = 4096
#: A word vector task trains on no fewer and about no more than so many tokens.
MIN_TOKENS_PER_TASK, TOKENS_PER_TASK = 10_000, 20_000_000


def token_rows(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """One row per document and token.

    The outer form with a check afterwards keeps the optimizer from testing the
    array for size first, which would tokenize each text twice.
    """
    return docs.select(doc_id, F.explode_outer(tokens).alias("token")).where("token is not null")


def stopword_filter(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Token rows whose word is not in the stop table (column ``word``).

    The stop table is written first: only its true size tells that it can be broadcast,
    where a join by token would send and sort all rows, those of a frequent token in one task.
    """
    stop = materialize(stopwords.select(F.col("word").alias("token")), "stopwords")
    return tokens.join(broadcast_if_small(stop), "token", "left_anti")


def document_frequency(tokens: DataFrame) -> DataFrame:
    """Documents per token; tokens are unique per document already."""
    return tokens.groupBy("token").agg(F.count("*").alias("df"))


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"))


def idf_weights(
    df: DataFrame, n_docs: DataFrame, min_df: int = 100, max_share: float = 0.95
) -> DataFrame:
    """ln(N/df) of the tokens that are neither rare nor everywhere."""
    total = n_docs.select("n_docs").scalar()
    return (
        df.withColumn("n_docs", total)
        .where((F.col("df") > min_df) & (F.col("df") / F.col("n_docs") < max_share))
        .select("token", "df", F.log(F.col("n_docs") / F.col("df")).alias("idf"))
    )


def train_word_vectors(docs: DataFrame, tokens: str, dim: int = 100, min_count: int = 100, **kw):
    """Word vectors of a token column; gives the fitted model.

    Unless the caller says otherwise, there is a partition for each core or so many tokens.
    The column is written first, as training reads it more than once.
    """
    from pyspark.ml.feature import Word2Vec

    docs = materialize(docs.select(tokens), "word-lists")
    if "numPartitions" not in kw:
        total = docs.agg(F.sum(F.size(tokens))).first()[0] or 0
        cores = docs.sparkSession.sparkContext.defaultParallelism
        kw["numPartitions"] = max(1, min(cores, total // MIN_TOKENS_PER_TASK), total // TOKENS_PER_TASK)
    return Word2Vec(
        inputCol=tokens, outputCol="doc_vector", vectorSize=dim, minCount=min_count, **kw
    ).fit(docs)


def word_model_table(model) -> DataFrame:
    """A fitted word model as (token, vector) rows."""
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(
        F.col("word").alias("token"), vector_to_array("vector").alias("vector")
    )


def idf_scaled_word_vectors(model: DataFrame, idf: DataFrame) -> DataFrame:
    return model.join(idf, "token").select("token", scale(F.col("vector"), F.col("idf")).alias("vector"))


def text_vectors(
    tokens: DataFrame, docs: DataFrame, model: DataFrame, doc_id: str, dim: int, min_tokens: int = 3
) -> DataFrame:
    """Sum of the model vectors of each document's known tokens.

    Every document of ``docs`` is in the result. One with fewer than
    ``min_tokens`` tokens is not scoreable and has an empty vector; a scoreable
    one without known tokens has a zero vector.
    """
    known = broadcast_if_small(model.select("token", "vector"))
    scoreable = tokens.groupBy(doc_id).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_tokens)
    sums = tokens.join(known, "token").groupBy(doc_id).agg(sum_vector(F.col("vector")).alias("vector"))
    zero = F.array_repeat(F.lit(0.0), dim)
    scored = scoreable.join(sums, doc_id, "left").select(doc_id, F.coalesce("vector", zero).alias("vector"))
    empty = F.array().cast("array<double>")
    return (
        docs.select(doc_id)
        .join(scored, doc_id, "left")
        .select(doc_id, F.coalesce("vector", empty).alias("vector"))
    )


def text_vector_variants(
    tokens: DataFrame, model: DataFrame, idf: DataFrame, doc_id: str, top: int = TOP_IDF
) -> DataFrame:
    """Plain, idf-weighted, and top-idf vector of each document.

    Weights and model are written first, so that their true sizes decide on a broadcast. The
    three vectors of a token are added up as one.
    """
    weights = broadcast_if_small(materialize(idf.select("token", "idf"), "idf"))
    known = broadcast_if_small(materialize(model.select("token", "vector"), "word-model"))
    by_idf = Window.partitionBy(doc_id).orderBy(F.coalesce("idf", F.lit(0.0)).desc(), "token")
    ranked = (
        tokens.join(weights, "token", "left")
        .withColumn("_rank", F.row_number().over(by_idf))
        .join(known, "token")
    )
    zero = F.lit(0.0)
    weight = F.coalesce("idf", zero)
    top_weight = F.when(F.col("_rank") <= top, weight).otherwise(zero)
    vector = F.col("vector")
    three = F.concat(vector, scale(vector, weight), scale(vector, top_weight))
    sums = ranked.select(doc_id, three.alias("three")).groupBy(doc_id).agg(sum_vector(F.col("three")).alias("three"))
    width = (F.size("three") / 3).cast("int")
    part = lambda i: F.slice("three", width * i + 1, width)
    return sums.select(doc_id, part(0).alias("plain"), part(1).alias("weighted"), part(2).alias("top_weighted"))


def split_by_position(indexed: DataFrame, index: str = "row_index") -> DataFrame:
    """Train, test, train, … by running number; two of three rows train."""
    return indexed.withColumn(
        "split", F.when(F.col(index) % 3 == 1, F.lit("test")).otherwise(F.lit("train"))
    )


def doc_cosines(vectors: DataFrame, doc_id: str, query_id: int | str) -> DataFrame:
    """Cosine of every other document to one; the query is a one-row subquery."""
    probe = vectors.where(F.col(doc_id) == query_id).select("vector").scalar()
    rows = vectors.withColumn("_probe", probe).where(F.col(doc_id) != query_id)
    size = norm(F.col("vector")) * norm(F.col("_probe"))
    return rows.where(size > 0).select(
        doc_id, (dot(F.col("vector"), F.col("_probe")) / size).alias("cosine")
    )


def most_similar_docs(cosines: DataFrame, doc_id: str) -> DataFrame:
    """Most, median and least similar document by (cosine desc, id).

    The median is an order statistic of the cosines; only documents whose cosine is just
    that value are put in order of their ids, by a distributed sort.
    """
    rows = cosines.select(doc_id, F.round("cosine", 9).alias("cosine"))
    falling = rows.select((-F.col("cosine")).alias("down"))
    n = rows.count()
    found = kth_value(falling, "down", n // 2)
    if found is None:
        return rows.select(F.lit("most").alias("which"), doc_id, "cosine")
    value, before = found
    ties = with_row_index(rows.where(F.col("cosine") == -value), [doc_id], "_place")
    median = ties.where(F.col("_place") == n // 2 - before)
    most = rows.orderBy(F.col("cosine").desc(), doc_id).limit(1)
    least = rows.orderBy(F.col("cosine").asc(), F.col(doc_id).desc()).limit(1)
    named = lambda df, which: df.select(F.lit(which).alias("which"), doc_id, "cosine")
    return named(most, "most").unionByName(named(median, "median")).unionByName(named(least, "least"))


def _unit_vectors(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _bin_counts(x: pd.DataFrame, y: pd.DataFrame, same: bool, bin_width: float) -> pd.DataFrame:
    """Pairs per bin of cosine between two blocks; of a block with itself each pair once."""
    a, b = _unit_vectors(x["v"]), _unit_vectors(y["v"])
    total: Counter[int] = Counter()
    for part in strips(len(a), len(b)):
        cosines = a[part] @ b.T
        if same:
            cosines = cosines[x["id"].to_numpy()[part, None] < y["id"].to_numpy()[None, :]]
        # Rounding first keeps values that sit on a bin edge in one bin everywhere.
        slots, n = np.unique(np.floor(np.round(cosines, 9) / bin_width + 1e-9).astype(np.int64), return_counts=True)
        total.update(dict(zip(slots.tolist(), n.tolist())))
    return pd.DataFrame({"bin": list(total.keys()), "n": list(total.values())})


def probe_word_cosines(
    tokens: DataFrame, vectors: DataFrame, doc_id: str, word_a: str, word_b: str,
    bin_width: float = 0.01, first: int | None = None, block_rows: int = PROBE_BLOCK,
) -> DataFrame:
    """Histogram of cosines among the documents with word A, and of A against B.

    All of them, or the ``first`` by id. Documents are dealt into blocks of bounded size;
    each pair of blocks is one task's matrix product, of which only the counts per bin
    leave the task. Vectors without length have no cosine.
    """

    def having(word: str) -> DataFrame:
        ids = tokens.where(F.col("token") == word).select(doc_id).distinct()
        if first is not None:
            ids = ids.orderBy(doc_id).limit(first)
        rows = vectors.join(broadcast_if_small(ids), doc_id).select(F.col(doc_id).alias("id"), F.col("vector").alias("v"))
        return materialize(rows.where(usable(F.col("v"))), "probe-documents")

    a, b = having(word_a), having(word_b)
    blocks_a, blocks_b = (max(1, math.ceil(rows.count() / block_rows)) for rows in (a, b))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda rows, kind, i, j: rows.select("id", "v", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    left = dealt(a, "within", own(blocks_a), every(blocks_a)).where("i <= j").unionByName(dealt(a, "across", own(blocks_a), every(blocks_b)))
    right = dealt(a, "within", every(blocks_a), own(blocks_a)).where("i <= j").unionByName(dealt(b, "across", every(blocks_a), own(blocks_b)))

    def count(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"kind": [], "bin": [], "n": []})
        return _bin_counts(x, y, key[0] == "within" and key[1] == key[2], bin_width).assign(kind=key[0])[["kind", "bin", "n"]]

    keys = ("kind", "i", "j")
    counted = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(count, "kind string, bin long, n long")
    return counted.groupBy("kind", "bin").agg(F.sum("n").alias("n_pairs"))


def vector_sparsity(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Nonzero count per vector, and its index where there is just one."""
    col = F.col(vector)
    hits = F.filter(F.sequence(F.lit(0), F.size(col) - 1), lambda i: F.get(col, i) != 0)
    return vectors.where(F.size(col) > 1).select(
        vec_id,
        F.size(hits).alias("n_nonzero"),
        F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).alias("only_index"),
    )


def sparsity_histogram(profile: DataFrame, width: int = 20) -> DataFrame:
    return profile.groupBy((F.floor(F.col("n_nonzero") / width) * width).alias("bin_start")).agg(
        F.count("*").alias("n_vectors"),
        F.count("only_index").alias("n_single"),
    )


# Words a cloud leaves out, and its font sizes.
CLOUD_STOPWORDS = tuple(
    """
    the for to on my in and is of are he his he's im i'm got not from a at we're was
    us be her her's them they rt you your you're that me has get were it me or so no
    """.split()
)
CLOUD_MIN, CLOUD_MAX = 10.0, 50.0


def cloud_words(text: Column, stopwords: Iterable[str] = CLOUD_STOPWORDS) -> Column:
    """Words of one text as the cloud counts them.

    A stop word is cut together with the blanks around it, so of two in a row
    the second one stays.
    """
    out = F.lower(text)
    for mark in ("#", "@", "http"):
        out = F.regexp_replace(out, mark + r"\S+", " ")
    out = F.regexp_replace(out, rf"\s(?:{'|'.join(stopwords)})\s", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.split(F.translate(out, "!.,:;?", "      "), " ")


def word_cloud(texts: DataFrame, text: str) -> DataFrame:
    """Count and font size per word over all texts.

    The counts are written once, as both the sizes and their maximum need them.
    """
    counts = (
        texts.select(F.explode_outer(cloud_words(F.col(text))).alias("word"))
        .where("word is not null")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    counts = materialize(counts, "word-counts")
    top = counts.agg(F.greatest(F.max("n"), F.lit(1))).scalar()
    c = F.col("n")
    slope = F.when(c <= 1, 0.0).otherwise(c / F.col("top") * (CLOUD_MAX - CLOUD_MIN) + CLOUD_MIN)
    raw = F.least(F.lit(CLOUD_MAX), c / 2 * slope)
    size = F.when(raw == 0, 0.0).otherwise(F.greatest(F.lit(CLOUD_MIN), raw))
    return counts.withColumn("top", top).select("word", "n", size.alias("size"))


def joined_terms(clusters: DataFrame, by: Sequence[str], term: str = "term") -> DataFrame:
    """Distinct terms of each selection of clusters as rows in reading order (``position`` from 1).

    A view joins them with commas; rows have no bound on how many there are.
    """
    rows = clusters.where(F.col(term).isNotNull()).select(*by, F.col(term).alias("part")).distinct()
    return with_rank(rows, by, ["part"])


def joined_texts(posts: DataFrame, by: Sequence[str], order: str, text: str = "text") -> DataFrame:
    """All texts of each selection as rows in reading order."""
    ranked = with_rank(posts.select(*by, F.col(order).alias("_order"), F.col(text).alias("part")), by, ["_order"])
    return ranked.select(*by, "part", "position")


def kinds_of_tokens(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """Display tokens with their kind; url tokens carry a scheme."""
    rows = token_rows(docs, doc_id, tokens)
    kind = tx.word_kind(F.col("token"))
    return rows.select(
        doc_id,
        kind.alias("kind"),
        F.when(kind == "url", tx.url_of(F.col("token"))).otherwise(F.col("token")).alias("token"),
    )


def page_open_graph(
    pages: DataFrame, domains: Sequence[str] | None = None, attribute: str = "property",
    name: str = "og:image",
) -> DataFrame:
    """Image address of each page that names one, profile pictures left out."""
    rows = pages.withColumn("domain", tx.host_of(F.col("url")))
    if domains is not None:
        rows = rows.where(F.col("domain").isin(list(domains)))
    found = rows.withColumn("image_url", tx.meta_content(F.col("html"), attribute, name))
    return found.where(
        F.col("image_url").isNotNull() & ~F.lower("image_url").contains("/profile")
    ).drop("html")
