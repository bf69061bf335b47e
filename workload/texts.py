"""Text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.functions import text as tx
from pulseweave.lineage import materialize
from pulseweave.operators import docvectors as dv
from pulseweave.operators import textjobs as tj
from pulseweave.operators.ordering import with_row_index
from workload import views as v
from workload.registry import case


def docs(spark, sf):
    return v.wide(spark, sf, "documents", "doc_id")


def token_case(name, spark_tokens, sql_tokens, where="true"):
    """Token lists compared as one sorted, joined line per document."""

    @case(
        name,
        f"""SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS words
        FROM (SELECT doc_id, {sql_tokens} AS t FROM documents WHERE {where})""",
    )
    def run(spark, sf):
        t = docs(spark, sf).where(where).select("doc_id", spark_tokens().alias("t"))
        return t.select(
            "doc_id", F.size("t").cast("long").alias("n"),
            F.md5(F.array_join(F.array_sort("t"), " ")).alias("words"),
        )


token_case("tokenize_en", lambda: tx.tokenize_en(F.col("text")), v.tokens_en_sql("text"))
token_case(
    "tokenize_en_keep_stopwords",
    lambda: tx.tokenize_en(F.col("text"), drop_stop=False),
    v.tokens_en_sql("text", stop=False),
)
token_case(
    "tokenize_ar_ru",
    lambda: tx.tokenize_words(F.col("text")),
    rf"""list_distinct(list_filter(regexp_extract_all(array_to_string(list_filter(string_split(
      regexp_replace(lower(text), '{v.SPACE_SQL}', ' ', 'g'), ' '),
      lambda w: length(w) > 0 AND NOT regexp_matches(w, '^[#@]|[#@]$|^\p{{Nd}}+$')), ' '),
      '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[''’.][\p{{L}}\p{{M}}\p{{N}}_]+)*'),
      lambda w: length(w) > 1 AND NOT (length(w) > 4 AND (starts_with(w, 'http') OR starts_with(w, 'www')))))""",
    "lang <> 'en'",
)
token_case(
    "pres_tokenize",
    lambda: tx.display_tokens(F.col("text"), F.lit("en")),
    f"""list_filter(string_split(trim(replace(regexp_replace(lower(text), '{v.SPACE_SQL}', ' ', 'g'),
      '#', ' #')), ' '), lambda w: w <> '')""",
)

RAW_WORDS_SQL = f"unnest(string_split(regexp_replace(text, '{v.SPACE_SQL}', ' ', 'g'), ' '))"


def raw_words(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.explode(F.split(tx.flat_spaces(F.col("text")), " ")).alias("w")
    )


@case(
    "is_special",
    f"""SELECT doc_id, count(*) AS n_words, count(*) FILTER (w = '' OR regexp_matches(w,
      '^[#@]|[#@]$|^\\p{{Nd}}+$')) AS n_special
    FROM (SELECT doc_id, {RAW_WORDS_SQL} AS w FROM documents) GROUP BY doc_id""",
)
def is_special(spark, sf):
    return raw_words(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count_if(tx.is_special(F.col("w"))).alias("n_special")
    )


@case(
    "is_url",
    v.sql(
        """SELECT post_id, count(*) FILTER (length(w) > 4 AND (w LIKE 'http%' OR w LIKE 'www%')) AS n_urls
        FROM (SELECT post_id, unnest(string_split(text, ' ')) AS w FROM text_posts) GROUP BY post_id""",
        "text_posts",
    ),
)
def is_url(spark, sf):
    words = v.text_posts(spark, sf).select("post_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("post_id").agg(F.count_if(tx.is_url(F.col("w"))).alias("n_urls"))


@case(
    "is_scoreable",
    f"SELECT doc_id, len({v.tokens_en_sql('text')}) > 2 AS scoreable FROM documents",
)
def is_scoreable(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.is_scoreable(tx.tokenize_en(F.col("text"))).alias("scoreable")
    )


@case(
    "remove_punctuation",
    r"""SELECT doc_id, md5(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS h FROM documents""",
)
def remove_punctuation(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.remove_punctuation(F.col("text"))).alias("h"))


@case(
    "stopword_filter",
    v.sql(
        """SELECT token, count(*) AS n FROM doc_tokens WHERE token NOT IN (
          SELECT token FROM token_df WHERE df >= (SELECT count(DISTINCT doc_id) * 0.1 FROM doc_tokens))
        GROUP BY token""",
        "doc_tokens",
        "token_df",
    ),
)
def stopword_filter(spark, sf):
    # The stop table: words found in at least a tenth of the documents.
    tokens = materialize(v.doc_tokens(spark, sf), "tokens")
    df = tj.document_frequency(tokens)
    n = tokens.agg(F.count_distinct("doc_id") * 0.1).scalar()
    stop = df.withColumn("n", n).where(F.col("df") >= F.col("n")).select(F.col("token").alias("word"))
    return tj.stopword_filter(tokens, stop).groupBy("token").agg(F.count("*").alias("n"))


@case(
    "strip_non_ascii",
    r"SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS h FROM documents",
)
def strip_non_ascii(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.strip_non_ascii(F.col("text"))).alias("h"))


@case(
    "html_to_text",
    r"""SELECT page_id, md5(t) AS h, length(t) AS n_chars FROM (
      SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(
        regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
        '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
        '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g')) AS t FROM pages)""",
)
def html_to_text(spark, sf):
    t = v.wide(spark, sf, "pages", "page_id").select("page_id", tx.html_to_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("h"), F.length("t").cast("long").alias("n_chars"))


@case(
    "page_open_graph",
    r"""SELECT page_id, domain, image_url FROM (
      SELECT page_id, replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), 'www.', '') AS domain,
        'http://img/' || CASE WHEN contains(html, '<h1>E') THEN 'profile/' ELSE '' END || page_id AS image_url
      FROM pages WHERE contains(html, '<meta charset="utf-8">'))
    WHERE (domain LIKE 'm.%' OR domain LIKE '%.net') AND NOT contains(image_url, '/profile')""",
)
def page_open_graph(spark, sf):
    # The given pages name no picture, so a meta tag is put next to their charset tag.
    folder = F.when(F.col("html").contains("<h1>E"), "Profile/").otherwise("")
    tag = F.concat(
        F.lit('<meta charset="utf-8"><meta property="og:image" content="http://img/'), folder,
        F.col("page_id").cast("string"), F.lit('">'),
    )
    pages = v.wide(spark, sf, "pages", "page_id").select(
        "page_id", "url", F.replace("html", F.lit('<meta charset="utf-8">'), tag).alias("html")
    )
    domain = F.col("domain")
    found = tj.page_open_graph(pages).where(domain.startswith("m.") | domain.endswith(".net"))
    return found.select("page_id", "domain", "image_url")


@case(
    "classify_tokens_by_kind",
    v.sql(
        f"""SELECT kind, token, count(*) AS n FROM (
          SELECT CASE WHEN w LIKE '#%' THEN 'hashtag' WHEN w LIKE '@%' THEN 'mention'
            WHEN w LIKE 'http%' OR w LIKE 'www%' THEN 'url' ELSE 'word' END AS kind,
            CASE WHEN w LIKE 'www%' THEN 'http://' || w ELSE w END AS token
          FROM (SELECT unnest(list_filter(string_split(trim(replace(regexp_replace(lower(text), '{v.SPACE_SQL}', ' ', 'g'),
            '#', ' #')), ' '), lambda x: x <> '')) AS w FROM text_posts WHERE lang = 'en'))
        GROUP BY ALL""",
        "text_posts",
    ),
)
def classify_tokens_by_kind(spark, sf):
    t = v.text_posts(spark, sf)
    kinds = tj.kinds_of_tokens(t, "post_id", tx.display_tokens(F.col("text"), F.col("lang")))
    return kinds.groupBy("kind", "token").agg(F.count("*").alias("n"))


CLOUD_STOP_SQL = "|".join(r"\s" + w.replace("'", "''") + r"\s" for w in tj.CLOUD_STOPWORDS)


@case(
    "word_cloud",
    v.sql(
        rf"""SELECT word, n, CASE WHEN n <= 1 THEN 0.0::DOUBLE
          ELSE greatest(10.0, least(50.0, n / 2 * (n / greatest(max(n) OVER (), 1) * 40 + 10))) END AS size
        FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(translate(trim(regexp_replace(
          regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '#\S+', ' ', 'g'),
          '@\S+', ' ', 'g'), 'http\S+', ' ', 'g'), '({CLOUD_STOP_SQL})', ' ', 'g'), '\s+', ' ', 'g')),
          '!.,:;?', '      '), ' ')) AS word FROM text_posts) GROUP BY word)""",
        "text_posts",
    ),
)
def word_cloud(spark, sf):
    return tj.word_cloud(v.text_posts(spark, sf), "text")


@case(
    "term_joins",
    v.sql(
        """SELECT end_time_ms, 'terms' AS kind, row_number() OVER (PARTITION BY end_time_ms ORDER BY term) AS position, term AS part
        FROM (SELECT DISTINCT end_time_ms, term FROM clusters)
        UNION ALL
        SELECT m.end_time_ms, 'texts', row_number() OVER (PARTITION BY m.end_time_ms ORDER BY p.post_id), p.text
        FROM (SELECT DISTINCT end_time_ms, post_id FROM members) m JOIN posts p ON p.post_id = m.post_id""",
        "clusters",
        "members",
        "posts",
    ),
)
def term_joins(spark, sf):
    terms = tj.joined_terms(v.clusters(spark, sf), ["end_time_ms"])
    picked = v.members(spark, sf).select("end_time_ms", "post_id").distinct()
    texts = tj.joined_texts(picked.join(v.posts(spark, sf).select("post_id", "text"), "post_id"), ["end_time_ms"], "post_id")
    return terms.withColumn("kind", F.lit("terms")).unionByName(texts.withColumn("kind", F.lit("texts")))


@case(
    "profile_and_status_urls",
    v.sql(
        """SELECT post_id, 'https://twitter.com/' || screen_name AS profile,
          'https://twitter.com/' || screen_name || '/statuses/' || broadcast_post_id AS status FROM posts""",
        "posts",
    ),
)
def profile_and_status_urls(spark, sf):
    return v.posts(spark, sf).select(
        "post_id",
        tx.profile_url(F.col("screen_name")).alias("profile"),
        tx.status_url(F.col("screen_name"), F.col("broadcast_post_id")).alias("status"),
    )


@case("document_frequency", v.sql("SELECT token, df FROM token_df", "token_df"))
def document_frequency(spark, sf):
    return tj.document_frequency(v.doc_tokens(spark, sf))


IDF_SQL = """
    SELECT token, df, ln(n_docs / df) AS idf FROM token_df,
      (SELECT count(*) AS n_docs FROM documents WHERE lang = 'en') n
    WHERE df > 20 AND df / n_docs < 0.95"""
v.cte("idf", IDF_SQL, "token_df")


def idf(spark, sf):
    df = tj.document_frequency(v.doc_tokens(spark, sf))
    return tj.idf_weights(df, tj.document_count(docs(spark, sf).where("lang = 'en'")), min_df=20)


@case("idf_weights", v.sql("SELECT token, df, round(idf, 9) AS idf FROM idf", "idf"))
def idf_weights(spark, sf):
    return idf(spark, sf).withColumn("idf", F.round("idf", 9))


@case("train_word_vectors")
def train_word_vectors(spark, sf):
    d = docs(spark, sf).where("lang = 'en'").select(tx.tokenize_en(F.col("text"), unique=False).alias("t"))
    model = tj.train_word_vectors(d, "t", dim=16, min_count=25, seed=7, maxIter=1)
    return tj.word_model_table(model).select(
        "token", *[F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in range(16)]
    )


def model(spark, sf):
    return v.word_model(tj.document_frequency(v.doc_tokens(spark, sf)))


@case(
    "idf_scaled_word_vectors",
    v.sql(
        "SELECT token, " + ", ".join(f"round(vector[{i + 1}] * idf, 8) AS v{i}" for i in range(4))
        + " FROM word_model JOIN idf USING (token)",
        "word_model",
        "idf",
    ),
)
def idf_scaled_word_vectors(spark, sf):
    scaled = tj.idf_scaled_word_vectors(model(spark, sf), idf(spark, sf))
    return scaled.select("token", *[F.round(F.col("vector")[i], 8).alias(f"v{i}") for i in range(4)])


SCOREABLE_SQL = "SELECT doc_id FROM doc_tokens GROUP BY doc_id HAVING count(*) > 2"
v.cte("scoreable", SCOREABLE_SQL, "doc_tokens")
v.cte(
    "doc_vectors",
    "SELECT d.doc_id, s.doc_id IS NULL AS empty, " + ", ".join(
        f"CASE WHEN s.doc_id IS NOT NULL THEN coalesce(sum(vector[{i + 1}]), 0) END AS v{i}" for i in range(4)
    ) + """ FROM documents d LEFT JOIN scoreable s ON s.doc_id = d.doc_id
    LEFT JOIN doc_tokens t ON t.doc_id = s.doc_id LEFT JOIN word_model m ON m.token = t.token
    GROUP BY d.doc_id, s.doc_id""",
    "scoreable", "doc_tokens", "word_model",
)


def text_vector_table(spark, sf, tokens=None):
    # Tokens feed both the model and the vectors: one table, written once.
    tokens = tokens if tokens is not None else materialize(v.doc_tokens(spark, sf), "tokens")
    words = v.word_model(tj.document_frequency(tokens))
    ids = v.table(spark, sf, "documents").select("doc_id")
    return tj.text_vectors(tokens, ids, words, "doc_id", 4)


@case("text_vectors", v.sql("SELECT doc_id, empty, v0, v1, v2, v3 FROM doc_vectors", "doc_vectors"))
def text_vectors(spark, sf):
    return text_vector_table(spark, sf).select(
        "doc_id", (F.size("vector") == 0).alias("empty"),
        *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(4)],
    )


@case(
    "text_vector_variants",
    v.sql(
        """SELECT doc_id, sum(vector[1]) AS p0, sum(vector[2]) AS p1,
          round(sum(vector[1] * coalesce(idf, 0)), 6) AS w0, round(sum(vector[4] * coalesce(idf, 0)), 6) AS w3,
          round(sum(CASE WHEN r <= 3 THEN vector[1] * coalesce(idf, 0) ELSE 0 END), 6) AS t0
        FROM (SELECT t.doc_id, t.token, i.idf, row_number() OVER (PARTITION BY t.doc_id
            ORDER BY coalesce(i.idf, 0) DESC, t.token) AS r
          FROM doc_tokens t LEFT JOIN idf i ON i.token = t.token) x
        JOIN word_model m ON m.token = x.token GROUP BY doc_id""",
        "doc_tokens",
        "word_model",
        "idf",
    ),
)
def text_vector_variants(spark, sf):
    tokens = materialize(v.doc_tokens(spark, sf), "tokens")
    # Both tables of words come from the counts: one table, written once.
    df = materialize(tj.document_frequency(tokens), "token-counts")
    weights = tj.idf_weights(df, tj.document_count(docs(spark, sf).where("lang = 'en'")), min_df=20)
    rows = tj.text_vector_variants(tokens, v.word_model(df), weights, "doc_id")
    return rows.select(
        "doc_id", F.col("plain")[0].alias("p0"), F.col("plain")[1].alias("p1"),
        F.round(F.col("weighted")[0], 6).alias("w0"), F.round(F.col("weighted")[3], 6).alias("w3"),
        F.round(F.col("top_weighted")[0], 6).alias("t0"),
    )


#: Width, counts and epochs as the blueprint trains them.
DOC_VECTORS = dv.Settings(dim=1000, min_count=25, epochs=10)


@case(
    "train_doc_vectors",
    v.sql(
        """, split AS (SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 3 = 1 THEN 'test' ELSE 'train' END AS split
            FROM documents WHERE lang = 'en'),
        known AS (SELECT token FROM doc_tokens JOIN split USING (doc_id) WHERE split = 'train' GROUP BY token HAVING count(*) >= 25)
        SELECT s.doc_id, s.split, 1000 AS width, count(k.token) AS n_words, count(k.token) > 0 AS trained
        FROM split s LEFT JOIN doc_tokens t ON t.doc_id = s.doc_id LEFT JOIN known k ON k.token = t.token GROUP BY s.doc_id, s.split""",
        "doc_tokens",
    ).replace(")\n, split AS", "),\nsplit AS"),
)
def train_doc_vectors(spark, sf):
    """A vector of every English document: two thirds of them trained, the others inferred."""
    d = docs(spark, sf).where("lang = 'en'").select("doc_id", tx.tokenize_en(F.col("text")).alias("t"))
    split = tj.split_by_position(with_row_index(d, ["doc_id"]))
    trained, model = dv.train_doc_vectors(split.where("split = 'train'"), "t", "doc_id", DOC_VECTORS)
    inferred = model.infer(split.where("split = 'test'"), "t", "doc_id")
    rows = trained.withColumn("split", F.lit("train")).unionByName(inferred.withColumn("split", F.lit("test")))
    moved = F.exists("vector", lambda x: x != 0)
    return rows.select("doc_id", "split", F.size("vector").alias("width"), "n_words", moved.alias("trained"))


@case(
    "most_similar_docs",
    v.sql(
        """SELECT which, doc_id, cosine FROM (
          SELECT doc_id, cosine, CASE WHEN r = 1 THEN 'most' WHEN r - 1 = n // 2 THEN 'median' END AS which,
            r, n FROM (SELECT doc_id, cosine, row_number() OVER (ORDER BY cosine DESC, doc_id) AS r,
              count(*) OVER () AS n FROM (
            SELECT d.doc_id, round((d.v0*q.v0 + d.v1*q.v1 + d.v2*q.v2 + d.v3*q.v3)
              / sqrt(d.v0*d.v0 + d.v1*d.v1 + d.v2*d.v2 + d.v3*d.v3)
              / sqrt(q.v0*q.v0 + q.v1*q.v1 + q.v2*q.v2 + q.v3*q.v3), 9) AS cosine
            FROM doc_vectors d, doc_vectors q
            WHERE q.doc_id = 1 AND d.doc_id <> 1 AND d.v0 + d.v1 + d.v2 + d.v3 > 0)))
        WHERE which IS NOT NULL
        UNION ALL SELECT 'least', doc_id, cosine FROM (
          SELECT d.doc_id, round((d.v0*q.v0 + d.v1*q.v1 + d.v2*q.v2 + d.v3*q.v3)
              / sqrt(d.v0*d.v0 + d.v1*d.v1 + d.v2*d.v2 + d.v3*d.v3)
              / sqrt(q.v0*q.v0 + q.v1*q.v1 + q.v2*q.v2 + q.v3*q.v3), 9) AS cosine
            FROM doc_vectors d, doc_vectors q
            WHERE q.doc_id = 1 AND d.doc_id <> 1 AND d.v0 + d.v1 + d.v2 + d.v3 > 0
          ORDER BY cosine, d.doc_id DESC LIMIT 1)""",
        "doc_vectors",
    ),
)
def most_similar_docs(spark, sf):
    vectors = materialize(text_vector_table(spark, sf), "doc-vectors")
    cos = materialize(tj.doc_cosines(vectors, "doc_id", 1), "doc-cosines")
    return tj.most_similar_docs(cos, "doc_id")


@case(
    "probe_word_cosines",
    v.sql(
        """, a AS (SELECT doc_id, v0, v1, v2, v3, sqrt(v0*v0 + v1*v1 + v2*v2 + v3*v3) AS n FROM doc_vectors
            WHERE doc_id IN (SELECT doc_id FROM doc_tokens WHERE token = 'thth')),
        b AS (SELECT doc_id, v0, v1, v2, v3, sqrt(v0*v0 + v1*v1 + v2*v2 + v3*v3) AS n FROM doc_vectors
            WHERE doc_id IN (SELECT doc_id FROM doc_tokens WHERE token = 'reti')),
        p AS (SELECT 'within' AS kind, (x.v0*y.v0 + x.v1*y.v1 + x.v2*y.v2 + x.v3*y.v3) / (x.n * y.n) AS c
            FROM a x JOIN a y ON x.doc_id < y.doc_id WHERE x.n * y.n > 0
          UNION ALL SELECT 'across', (x.v0*y.v0 + x.v1*y.v1 + x.v2*y.v2 + x.v3*y.v3) / (x.n * y.n)
            FROM a x, b y WHERE x.n * y.n > 0)
        SELECT kind, CAST(floor(round(c, 9) / 0.01 + 1e-9) AS BIGINT) AS bin, count(*) AS n_pairs
        FROM p GROUP BY ALL""",
        "doc_vectors",
        "doc_tokens",
    ).replace(")\n, a AS", "),\na AS"),
)
def probe_word_cosines(spark, sf):
    tokens = materialize(v.doc_tokens(spark, sf), "tokens")
    vectors = materialize(text_vector_table(spark, sf, tokens), "doc-vectors")
    return tj.probe_word_cosines(tokens, vectors, "doc_id", "thth", "reti")


SPARSE_SQL = """
    SELECT user_id AS vec_id, list_transform(range(20), lambda i: coalesce(len(list_filter(ks, lambda k: k // 5 = i)), 0)) AS vec
    FROM (SELECT user_id, list(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS ks FROM events GROUP BY user_id)"""


@case(
    "vector_sparsity_profile",
    f"""SELECT vec_id, len(list_filter(vec, lambda x: x <> 0)) AS n_nonzero,
      CASE WHEN len(list_filter(vec, lambda x: x <> 0)) = 1
        THEN list_position(list_transform(vec, lambda x: x <> 0), true) - 1 END AS only_index
    FROM ({SPARSE_SQL})""",
)
def vector_sparsity_profile(spark, sf):
    return tj.vector_sparsity(sparse(spark, sf), "vec_id", "vec")


@case(
    "vector_sparsity_histogram",
    f"""SELECT n // 2 * 2 AS bin_start, count(*) AS n_vectors, count(*) FILTER (n = 1) AS n_single FROM (
      SELECT len(list_filter(vec, lambda x: x <> 0)) AS n FROM ({SPARSE_SQL})) GROUP BY ALL""",
)
def vector_sparsity_histogram(spark, sf):
    return tj.sparsity_histogram(tj.vector_sparsity(sparse(spark, sf), "vec_id", "vec"), 2)


def sparse(spark, sf):
    """Per user, how often each fifth of the property range occurs among the events."""
    e = v.table(spark, sf, "events")
    k = F.floor(F.get_json_object("props", "$.k").cast("long") / 5)
    return e.groupBy(F.col("user_id").alias("vec_id")).agg(
        F.array(*[F.count_if(k == i).cast("double") for i in range(20)]).alias("vec")
    )
