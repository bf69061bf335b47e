"""Token counts through a cache of content digests.

A text is known by the digest of its normalised form and of the tokenizer's file.
Counts that the cache holds are joined; each distinct text that it misses is encoded
once, wherever and however often it occurs, and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseweave.lineage import new_path

OVER_LIMIT = 2048
CACHE_SCHEMA = "key string, n_tokens long"
#: Characters handed to the library at once; a longer text goes alone.
CHARS_AT_ONCE = 200_000
#: Counts of words that a task remembers; beyond, it starts afresh.
WORDS_KEPT = 400_000
_WORD = re.compile(r"[^\x09-\x0D\x20]+")
_LETTERS = re.compile(r"[a-z]+")
#: A word without brackets or bars, as special strings have them, and the marks after it: two pieces.
_MARKED = re.compile(r"([^<|]*[A-Za-z0-9])([.,!?;:]*)")


@dataclass(frozen=True)
class Vocabulary:
    """A public tokenizer file, by name, and whether it works word by word.

    ``by_words`` is right for tokenizers with word ends that lower-case, drop white space
    and part letters from punctuation. There, runs of ASCII blanks never change the
    count, no token reaches over a blank, and a text has as many tokens as its words.
    """

    name: str
    by_words: bool = False

    @property
    def path(self) -> str:
        import public_tokenizers

        return public_tokenizers.path(self.name)

    @property
    def version(self) -> str:
        with open(self.path, "rb") as file:
            return hashlib.sha256(file.read()).hexdigest()

    def counter(self):
        """A function from texts to counts; made in the task that uses it."""
        if self.name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.no_truncation()
        model.no_padding()
        whole = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        return _word_counter(whole, model.model.tokenize) if self.by_words else whole


def _word_counter(whole, pieces):
    """Counts of distinct words. Words of a to z need no normalising and go straight to the model."""

    def count(words: list[str]) -> list[int]:
        plain = [bool(_LETTERS.fullmatch(w)) for w in words]
        rest = iter(whole([w for w, p in zip(words, plain) if not p]))
        return [len(pieces(w)) if p else next(rest) for w, p in zip(words, plain)]

    return count


WORD_BPE = Vocabulary("word_bpe_49k.json", by_words=True)


def normalised(text: Column, vocabulary: Vocabulary) -> Column:
    """The form of a text that its digest is taken of; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")) if vocabulary.by_words else text


def _portions(texts: list[str]) -> Iterator[list[str]]:
    portion, chars = [], 0
    for text in texts:
        if portion and chars + len(text) > CHARS_AT_ONCE:
            yield portion
            portion, chars = [], 0
        portion.append(text)
        chars += len(text)
    if portion:
        yield portion


def _by_words(texts: list[str], count, known: dict[str, int]) -> list[int]:
    """Counts of texts as sums over their words; ``known`` holds the words met before."""
    if len(known) > WORDS_KEPT:
        known.clear()
    words = [_WORD.findall(text) for text in texts]
    fresh = set().union(*words).difference(known)
    parts = {}
    for word in fresh:
        found = _MARKED.fullmatch(word)
        stem, marks = found.groups() if found else (word, "")
        parts[word] = (stem.lower() if found and stem.isascii() else stem, marks)
    pieces = {x for pair in parts.values() for x in pair if x}
    counts: dict[str, int] = {"": 0}
    for part in _portions(list(pieces)):
        counts.update(zip(part, count(part), strict=True))
    known.update((word, counts[stem] + counts[marks]) for word, (stem, marks) in parts.items())
    return [sum(map(known.__getitem__, own)) for own in words]


def _encode(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = None, {}
        for batch in batches:
            count = count or vocabulary.counter()
            by_words = lambda part: _by_words(part, count, known)
            each = by_words if vocabulary.by_words else count
            found = [n for part in _portions(batch.column(1).to_pylist()) for n in each(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "n_tokens"])

    return run


def token_counts(documents: DataFrame, cache_path: str | None = None, vocabulary: Vocabulary = WORD_BPE, limit: int = OVER_LIMIT) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``cache_path`` is a Parquet folder of (key, n_tokens) that is read, if it has
    rows, and appended to; without one a new folder in the shared scratch space
    serves this call. Texts go to the library as they are: special strings inside are
    handled as its default, nothing is added, cut or padded. Null texts count as
    empty, repeated rows keep a row each, other columns are left out. Two jobs that
    append at once may store a key twice; readers take it once.
    """
    spark = documents.sparkSession
    cache_path = cache_path or new_path(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    key = F.sha2(F.concat_ws("\n", F.lit(vocabulary.version), normalised(F.col("text"), vocabulary)), 256)
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))
    misses = keyed.select("key", "text")
    if not stored().isEmpty():
        misses = misses.join(stored(), "key", "left_anti")
    # Copies are reduced to one per task before the shuffle, so a hot text is no hot key.
    misses = misses.groupBy("key").agg(F.first("text").alias("text"))
    misses.mapInArrow(_encode(vocabulary), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key")
    return sized.join(stored(), "key", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
