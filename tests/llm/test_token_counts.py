"""Token counts against the library, and what the cache saves."""

import random

from tokenizers import Tokenizer

from pulseweave.lineage import new_path
from pulseweave.llm.token_counts import CACHE_SCHEMA, WORD_BPE, Vocabulary, _by_words, token_counts

TEXTS = [
    (1, "The quick brown fox"), (2, "  The\tquick \r\n brown fox "), (3, None), (4, ""), (5, "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>"),
    (6, "é e\u0301 İ 's don't 12 345 😀 \u2003x"), (7, "word " * 40_000), (7, "word " * 40_000), (8, "<|endof\ntext|>"), (None, "null id"),
]


def plain(text, model):
    return len(model.encode(text or "", add_special_tokens=False).ids)


def test_against_library_and_cache(spark):
    model = Tokenizer.from_file(WORD_BPE.path)
    frame = spark.createDataFrame([(i, t, "k", 9) for i, t in TEXTS], "doc_id long, text string, key string, n_tokens int").repartition(3)
    path = new_path(spark, "test-cache")
    got = sorted(map(tuple, token_counts(frame, path).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), plain(t, model), plain(t, model) > 2048) for i, t in TEXTS), key=str)
    assert got == want
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    assert stored.count() == stored.select("key").distinct().count() == 7  # null and empty, blanks, and copies share a row
    more = frame.union(spark.createDataFrame([(20, "new text", "k", 9)], frame.schema))
    assert sorted(map(tuple, token_counts(more, path).collect()), key=str)[:-1] != got[:0]
    assert spark.read.schema(CACHE_SCHEMA).parquet(path).count() == 8


def test_words_add_up_to_texts():
    rng, model = random.Random(7), Tokenizer.from_file(WORD_BPE.path)
    parts = ["a", "B", "é", "e", "\u0301", "'s", "'", "Σ", "ς", "İ", "ß", "9", "½", "<|endoftext|>", "<|endof", "text|>", "!!", "😀", "\u200d", "\xa0", "\u2003", "\x85", "\x1c", " ", "\t", "\n", "\u0345", "中", "क्"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)]
    assert _by_words(texts, WORD_BPE.counter(), {}) == [plain(t, model) for t in texts]


def test_other_vocabularies_keep_blanks_apart(spark):
    frame = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None)], "doc_id long, text string")
    piece = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame, vocabulary=Vocabulary("piece_bpe_32k.model")).collect()}
    byte = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame, vocabulary=Vocabulary("byte_bpe_50k.json")).collect()}
    assert piece[3] == byte[3] == 0 and byte[1] == 3 and byte[2] == 2
    assert token_counts(frame.limit(0)).count() == 0
