"""The random field against enumeration, and held-out accuracy."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulseweave.llm import language_crf as crf
from pulseweave.session import tune

SMALL = "/root/testdata/sf0.01/documents.parquet"


def sequential(scores, step):
    """Plain forward-backward of one chain."""
    emit = np.exp(scores)
    ahead, back = [emit[0]], [np.ones(scores.shape[1])]
    for e in emit[1:]:
        ahead.append((ahead[-1] @ step) * e)
        ahead[-1] /= ahead[-1].sum()
    for e in emit[:0:-1]:
        back.append(step @ (e * back[-1]))
        back[-1] /= back[-1].sum()
    both = np.array(ahead) * np.array(back[::-1])
    return both / both.sum(axis=1, keepdims=True)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    want, pairs, total = np.zeros((5, 3)), np.zeros((3, 3)), 0
    for path in itertools.product(range(3), repeat=5):
        w = np.exp(sum(scores[t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, s in enumerate(path):
            want[t, s] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    got, expected = crf.marginals(scores, np.array([5]), trans, pairs=True)
    assert np.allclose(got, want / total) and np.allclose(expected, pairs / total)


def test_blocks_are_exact():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 64, 0, 65, 700, 128])
    scores, trans = rng.normal(size=(lengths.sum(), 4)), rng.normal(size=(4, 4))
    got, _ = crf.marginals(scores, lengths, trans)
    at = 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], sequential(scores[at : at + n], np.exp(trans)))
        at += n


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet(SMALL)
    model = crf.train(*crf.training_rows(docs))
    held = docs.filter(crf.held_out()).select("doc_id", "text", "lang")
    found = crf.predict_languages(held, model, keep=("doc_id", "lang")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame(
        [(1, None, 0.1), (2, "", 0.1), (3, "123 ... 456 ²", 0.1), (4, "—–…", 0.1), (5, "the and of with " * 20_000, 0.1), (6, "the", 0.1), (6, "the", 0.1)],
        "doc_id long, text string, score double",
    )
    got = crf.predict_languages(odd, model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] < 5] == [("und", 0.0)] * 4
    assert {r["lang_pred"] for r in got if r["doc_id"] == 5} == {"en"} and len(got) == 7
    assert crf.predict_languages(odd.limit(0), model).count() == 0


def test_code_switched_words(spark):
    docs = spark.read.parquet(SMALL)
    model = crf.train(*crf.training_rows(docs))
    rows = docs.filter(crf.held_out()).filter("n_chars > 400 AND n_chars < 3000").orderBy("doc_id").collect()
    de, en = ([r["text"] for r in rows if r["lang"] == lang][:15] for lang in ("de", "en"))
    right = total = 0
    mixed = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate(zip(de, en))], "doc_id long, text string")
    count = lambda t: len(crf.split_words(*[np.frombuffer(t.lower().encode(), np.uint8), np.array([0, len(t.lower().encode())])], crf._IN_WORD).start)
    for r in crf.predict_languages(mixed, model, word_labels=True).collect():
        a, b = de[r["doc_id"]], en[r["doc_id"]]
        gold = ["de"] * count(a) + ["en"] * count(b)
        assert len(gold) == len(r["word_langs"])
        right += sum(x == y for x, y in zip(gold, r["word_langs"]))
        total += len(gold)
    assert right / total > 0.9


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in crf.identify_languages(docs).collect()} == {("und", 0.0)}


def test_every_label_is_learned(spark):
    rows = [(100 * k + i, f"w{k}a w{k}b w{k}c " * 4, f"l{k:03d}") for k in range(80) for i in range(12)]
    rows += [(n % 2 + 9000, f"hot {n}", "hot") for n in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    open_labels = {r["lang"] for r in docs.filter(~crf.held_out()).select("lang").distinct().collect()}
    texts, langs = crf.training_rows(docs)
    assert set(langs) == open_labels and len(open_labels) == 81
    assert max(langs.count(x) for x in open_labels) <= crf.ROWS_PER_LANGUAGE * crf.LANGUAGES // 81
    _, few = crf.training_rows(docs, 3)
    assert all(few.count(x) == 3 for x in open_labels)


def test_training_texts_have_a_byte_bound(spark, monkeypatch):
    monkeypatch.setattr(crf, "BYTES_PER_LANGUAGE", 4000)
    rows = [(i, "kurz " * 5, "de") for i in range(40)] + [(100 + i, "x" * (5000 + i), "xx") for i in range(40)] + [(200 + i, "y" * 300 if i % 2 else "y" * 3000, "yy") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = crf.training_rows(frame, 30)
    own = {k: [t for t, n in zip(texts, langs) if n == k] for k in set(langs)}
    assert len(own["de"]) == min(30, len([i for i in held_in(spark, frame) if i < 100]))
    assert len(own["xx"]) == 1 and len(own["xx"][0]) == min(len(t) for i, t, n in rows if n == "xx" and i in held_in(spark, frame))
    assert sum(map(len, own["yy"])) <= 4000 and all(len(t) == 300 for t in own["yy"][:10])


def held_in(spark, frame):
    return {r["doc_id"] for r in frame.filter(~crf.held_out()).collect()}


def test_prediction_takes_little_memory():
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(300)) for _ in range(1000)]
    weights = rng.normal(size=((1 << crf.FEATURE_BITS) + (1 << crf.LEXICON_BITS) + 1, 4)).astype(np.float32)
    model = crf.Model(["a", "b", "c", "d"], np.zeros(1 << crf.LEXICON_BITS, bool), weights, np.zeros((4, 4)))
    batch = pa.record_batch({"t": pa.array(texts), "l": pa.array([True] * len(texts)), "doc_id": pa.array(range(len(texts)))})

    class Shared:
        value = model

    label = crf._label(Shared, False, ["doc_id", "lang_pred", "score"])
    tracemalloc.start()
    found = next(label(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == len(texts) and peak < 80 << 20


def test_batches_of_long_texts_are_cut(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes])})

    texts = tune(spark).range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) < 10 << 20
