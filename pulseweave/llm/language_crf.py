"""Language of texts by a linear-chain conditional random field over their words.

Every word has affix, character n-gram and lexicon features; learned weights turn
them into scores per language, learned transitions say how likely a text switches
between languages from word to word. Forward-backward gives each word's probability
of each language, and a text's language is that of the most expected words.

A chain is cut into blocks of ``BLOCK`` words. The product of a block's matrices is
made for all blocks at once, entry and exit states follow from these products, and
then all blocks run forward and backward side by side: exact, also for long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseweave.lineage import broadcast_if_small, materialize
from pulseweave.llm.textbytes import Hasher, Words, mixed, portions, row_sums, split_words

#: Labelled documents of each language that training takes at most, by hash of their ids.
ROWS_PER_LANGUAGE = 250
#: Bytes of training texts of one language, and of all languages, that the driver takes.
BYTES_PER_LANGUAGE, BYTES_OF_ALL = 4 << 20, 128 << 20
#: Languages up to which each has that sample; with more it shrinks, down to the least. All are learned.
LANGUAGES = 64
LEAST_ROWS = 20
BLOCK = 64
FEATURE_BITS = 17
LEXICON_BITS = 17
#: Occurrences in the sample from which on a word belongs to the lexicon.
LEXICON_LEAST = 3
EPOCHS = 4
BATCH_CHAINS = 256
#: Bytes of texts that are predicted at a time: features and marginals take about a hundred times as much.
PORTION_BYTES = 1 << 18
RATE = 0.3
DECAY = 1e-6
SEED = 11
UNKNOWN = "und"
HELD_OUT = 2

_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("A") : ord("Z") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = True
_IN_WORD[128:] = True
_KINDS = {k: np.uint64(v) for k, v in zip(("one", "two", "three", "prefix", "suffix", "word"), mixed(np.arange(11, 17, dtype=np.uint64)))}


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray


def _slot(codes: np.ndarray, kind: str, bits: int = FEATURE_BITS) -> np.ndarray:
    return (mixed(codes ^ _KINDS[kind]) >> np.uint64(64 - bits)).astype(np.int64)


def word_features(words: Words, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of character places with the places per word, and each word's own slots.

    Place features are n-grams of one to three bytes with a mark at word ends. A word's
    slots are its prefix and suffix of four bytes and the whole word (for the lexicon).
    """
    length = words.end - words.start
    at = np.repeat(words.start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    byte = words.data[at].astype(np.uint64)
    first = np.zeros(len(at), bool)
    last = np.zeros(len(at), bool)
    if len(length):
        ends = np.cumsum(length)
        first[ends - length] = True
        last[ends - 1] = True
    left = np.where(first, np.uint64(0), np.roll(byte, 1))
    right = np.where(last, np.uint64(0), np.roll(byte, -1))
    two = (left << np.uint64(8)) | byte
    places = np.stack([_slot(byte, "one"), _slot(two, "two"), _slot((two << np.uint64(8)) | right, "three")], axis=1)
    code = hasher.spans(words.data, words.start, words.end)
    head = hasher.spans(words.data, words.start, np.minimum(words.start + 4, words.end))
    tail = hasher.spans(words.data, np.maximum(words.end - 4, words.start), words.end)
    own = np.stack([_slot(head, "prefix"), _slot(tail, "suffix"), _slot(code, "word", LEXICON_BITS)], axis=1)
    return places, length, own


def emissions(model: Model, words: Words, hasher: Hasher) -> np.ndarray:
    """Scores of each word for each language."""
    places, length, own = word_features(words, hasher)
    by_place = model.weights[places].sum(axis=1)
    scores = row_sums(by_place, length) / np.maximum(length, 1)[:, None].astype(np.float32)
    known = np.where(model.lexicon[own[:, 2]], (1 << FEATURE_BITS) + own[:, 2], (1 << FEATURE_BITS) + (1 << LEXICON_BITS))
    return scores + model.weights[own[:, 0]] + model.weights[own[:, 1]] + model.weights[known]


def marginals(scores: np.ndarray, per_row: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's language by forward-backward; with ``pairs`` the expected transitions too.

    ``scores`` has the words of all chains in order, ``per_row`` the length of each
    chain. All languages are as likely before a chain's first word.
    """
    n_langs = scores.shape[1]
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    blocks_of = (per_row + BLOCK - 1) // BLOCK
    n_blocks = int(blocks_of.sum())
    first_block = np.cumsum(blocks_of) - blocks_of
    chain = np.repeat(np.arange(len(per_row)), blocks_of)
    nth = np.arange(n_blocks) - first_block[chain]
    start = (np.cumsum(per_row) - per_row)[chain] + nth * BLOCK
    size = np.minimum(BLOCK, per_row[chain] - nth * BLOCK)
    place = start[:, None] + np.arange(BLOCK)[None, :]
    live = np.arange(BLOCK)[None, :] < size[:, None]
    grid = emit[np.where(live, place, 0)]
    product = np.repeat(np.eye(n_langs)[None], n_blocks, axis=0)
    opens = nth == 0
    for t in range(BLOCK):
        moved = (product @ step) * grid[:, t][:, None, :]
        if t == 0:
            moved = np.where(opens[:, None, None], product * grid[:, t][:, None, :], moved)
        moved /= np.maximum(moved.sum(axis=(1, 2), keepdims=True), 1e-300)
        product = np.where(live[:, t][:, None, None], moved, product)
    entry = np.full((n_blocks, n_langs), 1.0 / n_langs)
    leave = np.full((n_blocks, n_langs), 1.0 / n_langs)
    most = int(blocks_of.max()) if len(blocks_of) else 0
    for k in range(1, most):
        here = np.flatnonzero(nth == k)
        v = np.einsum("bi,bij->bj", entry[here - 1], product[here - 1])
        entry[here] = v / v.sum(axis=1, keepdims=True)
    for k in range(most - 1, 0, -1):
        here = np.flatnonzero(nth == k)
        u = np.einsum("bij,bj->bi", product[here], leave[here])
        leave[here - 1] = u / u.sum(axis=1, keepdims=True)
    ahead = np.empty((n_blocks, BLOCK, n_langs))
    state = entry
    for t in range(BLOCK):
        moved = (state @ step) * grid[:, t]
        if t == 0:
            moved = np.where(opens[:, None], state * grid[:, t], moved)
        moved /= np.maximum(moved.sum(axis=1, keepdims=True), 1e-300)
        state = np.where(live[:, t][:, None], moved, state)
        ahead[:, t] = state
    found = np.empty((n_blocks, BLOCK, n_langs))
    expected = np.zeros((n_langs, n_langs))
    state = leave
    for t in range(BLOCK - 1, -1, -1):
        both = ahead[:, t] * state
        found[:, t] = both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)
        weighted = grid[:, t] * state
        if pairs:
            came = ahead[:, t - 1] if t else entry
            pair = came[:, :, None] * step[None] * weighted[:, None, :]
            pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
            counts = live[:, t] & ~opens if t == 0 else live[:, t]
            expected += pair[counts].sum(axis=0)
        moved = weighted @ step.T
        moved /= np.maximum(moved.sum(axis=1, keepdims=True), 1e-300)
        state = np.where(live[:, t][:, None], moved, state)
    return found[live], expected


def _switched_chains(words_of: list[np.ndarray], label_of: list[int], rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Training chains of one block: runs of words from one to three documents each."""
    pieces = [(w[i : i + BLOCK], lang) for w, lang in zip(words_of, label_of) for i in range(0, len(w), BLOCK)]
    rng.shuffle(pieces)
    chains, labels = [], []
    i = 0
    while i < len(pieces):
        n = int(rng.integers(1, 4))
        part = pieces[i : i + n]
        i += n
        if len(part) == 1:
            chains.append(part[0][0])
            labels.append(np.full(len(part[0][0]), part[0][1]))
            continue
        cuts = [w[: max(1, BLOCK // len(part))] for w, _ in part]
        rest = [(w[len(c) :], lang) for (w, lang), c in zip(part, cuts) if len(w) > len(c)]
        chains.append(np.concatenate(cuts))
        labels.append(np.concatenate([np.full(len(c), lang) for c, (_, lang) in zip(cuts, part)]))
        for w, lang in rest:
            chains.append(w)
            labels.append(np.full(len(w), lang))
    return chains, labels


def train(texts: list[str], langs: list[str]) -> Model:
    """Learns weights and transitions from whole labelled texts.

    Chains mix runs of words of several texts, so that switching is learned too. The
    likelihood is climbed by mini-batches with a step size for every weight.
    """
    names = sorted(set(langs))
    n_langs = len(names)
    hasher, rng = Hasher(), np.random.default_rng(SEED)
    places, lengths, owns, words_of, label_of = [], [], [], [], []
    total = 0
    for first, data, offsets in portions(pa.array([t.lower() for t in texts], pa.string())):
        words = split_words(data, offsets, _IN_WORD)
        p, n, o = word_features(words, hasher)
        places.append(p.astype(np.int32))
        lengths.append(n)
        owns.append(o)
        ends = np.cumsum(words.per_row)
        for k, count in enumerate(words.per_row):
            if count:
                words_of.append(np.arange(total + ends[k] - count, total + ends[k]))
                label_of.append(names.index(langs[first + k]))
        total += len(n)
    size = (1 << FEATURE_BITS) + (1 << LEXICON_BITS) + 1
    weights = np.zeros((size, n_langs), np.float32)
    transitions = np.zeros((n_langs, n_langs))
    lexicon = np.zeros(1 << LEXICON_BITS, bool)
    if not total:
        return Model(names, lexicon, weights, transitions)
    place, length, own = np.concatenate(places), np.concatenate(lengths), np.concatenate(owns)
    offset = np.cumsum(length) - length
    lexicon = np.bincount(own[:, 2], minlength=1 << LEXICON_BITS) >= LEXICON_LEAST
    known = np.where(lexicon[own[:, 2]], (1 << FEATURE_BITS) + own[:, 2], size - 1)
    squares, moved = np.full((size, n_langs), 1e-6, np.float32), np.full((n_langs, n_langs), 1e-6)
    for _ in range(EPOCHS):
        chains, labels = _switched_chains(words_of, label_of, rng)
        order = rng.permutation(len(chains))
        for i in range(0, len(order), BATCH_CHAINS):
            chosen = order[i : i + BATCH_CHAINS]
            word = np.concatenate([chains[c] for c in chosen])
            gold = np.concatenate([labels[c] for c in chosen])
            per_row = np.array([len(chains[c]) for c in chosen])
            n = length[word]
            at = np.repeat(offset[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            slots = place[at]
            scores = row_sums(weights[slots].sum(axis=1), n) / n[:, None] + weights[own[word, 0]] + weights[own[word, 1]] + weights[known[word]]
            found, expected = marginals(scores, per_row, transitions, pairs=True)
            found[np.arange(len(gold)), gold] -= 1.0
            by_place = np.repeat(found / n[:, None], n, axis=0)
            keys = np.concatenate([slots[:, 0], slots[:, 1], slots[:, 2], own[word, 0], own[word, 1], known[word]])
            touched, where = np.unique(keys, return_inverse=True)
            parts = np.concatenate([by_place, by_place, by_place, found, found, found])
            slope = np.stack([np.bincount(where, parts[:, k], len(touched)) for k in range(n_langs)], axis=1) / len(per_row)
            slope += DECAY * weights[touched]
            squares[touched] += slope**2
            weights[touched] -= (RATE * slope / np.sqrt(squares[touched])).astype(np.float32)
            seen = np.zeros((n_langs, n_langs))
            last = np.cumsum(per_row) - 1
            inner = np.ones(len(gold), bool)
            inner[last] = False
            np.add.at(seen, (gold[:-1][inner[:-1]], gold[1:][inner[:-1]]), 1)
            slope = (expected - seen) / len(per_row)
            moved += slope**2
            transitions -= RATE * slope / np.sqrt(moved)
    return Model(names, lexicon, weights, transitions)


def training_rows(documents: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled documents that are not held out, whole texts, for every language.

    A language has at most ``rows`` texts and ``BYTES_PER_LANGUAGE`` bytes of them, all
    languages ``BYTES_OF_ALL``; one whose texts are all longer has its shortest.

    Ids are ranked by hash within their language before any text is read. Distinct ids
    of the languages are counted first, and only ids whose hash lies in the share that
    holds about four times the sample are ranked, so that ranking has few rows whatever
    the table's size. Of ids with several rows, each has one before any has two.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    usable = own.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    # An estimate will do: the share is four times the sample, and the ranking is exact.
    common = materialize(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("count")), "languages")
    languages = max(1, common.count())
    rows = min(rows, max(LEAST_ROWS, rows * LANGUAGES // languages))
    most = min(BYTES_PER_LANGUAGE, BYTES_OF_ALL // languages)
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) / F.lit(1 << 52)
    by_hash = Window.partitionBy("lang").orderBy("place", "doc_id")
    ranked = usable.select("doc_id", "lang", place.alias("place")).join(broadcast_if_small(common), "lang")
    ranked = ranked.filter(F.col("place") < 4 * rows / F.col("count")).select("doc_id", "lang", "place").distinct()
    ids = ranked.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= rows).select("doc_id", "lang")
    ids = broadcast_if_small(materialize(ids, "training-ids"))
    chosen = usable.join(ids, ["doc_id", "lang"]).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    of_id = Window.partitionBy("lang", "doc_id").orderBy("h")
    chosen = chosen.withColumn("copy", F.row_number().over(of_id)).filter(F.col("copy") <= rows)
    of_language = Window.partitionBy("lang").orderBy("copy", "doc_id", "h")
    chosen = chosen.withColumn("nth", F.row_number().over(of_language)).filter(F.col("nth") <= rows)
    # Texts that would take much of the bytes come last, the shortest of them first.
    size = F.octet_length("text").cast("long")
    by_size = Window.partitionBy("lang").orderBy(F.when(size > most // 8, size).otherwise(0), "nth").rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("before", F.coalesce(F.sum(size).over(by_size), F.lit(0))).filter((F.col("before") == 0) | (F.col("before") + size <= most))
    found = chosen.select("doc_id", "lang", "text", "h").orderBy("doc_id", "lang", "h").collect()
    return [r["text"] for r in found], [r["lang"] for r in found]


def held_out() -> Column:
    """True for documents that are kept out of training, by checksum of the id."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == HELD_OUT


def _label(shared, word_labels: bool, names_out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, Hasher()
        for batch in batches:
            rows = batch.num_rows
            pred = np.full(rows, UNKNOWN, object)
            score = np.zeros(rows)
            per_word: list[list[str]] = [[] for _ in range(rows)]
            for first, data, offsets in portions(batch.column(0), PORTION_BYTES):
                words = split_words(data, offsets, _IN_WORD)
                if not len(words.start) or not model.languages:
                    continue
                found, _ = marginals(emissions(model, words, hasher), words.per_row, model.transitions)
                share = row_sums(found, words.per_row) / np.maximum(words.per_row, 1)[:, None]
                for k in np.flatnonzero(words.per_row):
                    best = int(share[k].argmax())
                    pred[first + k] = model.languages[best]
                    score[first + k] = min(1.0, max(0.0, float(share[k, best])))
                if word_labels:
                    names = np.array(model.languages, object)[found.argmax(axis=1)]
                    for k, part in enumerate(np.split(names, np.cumsum(words.per_row)[:-1])):
                        per_word[first + k] = list(part)
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            pred[~letters] = UNKNOWN
            score[~letters] = 0.0
            out = [*batch.columns[2:], pa.array(pred, pa.string()), pa.array(score)]
            if word_labels:
                out.append(pa.array(per_word, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(out, names_out)

    return run


def predict_languages(documents: DataFrame, model: Model, word_labels: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document with ``lang_pred`` and ``score``.

    ``score`` is the expected share of words in the predicted language. Texts that are
    null or have no letter get ``und`` and score 0, as do all if nothing was learned.
    With ``word_labels`` the language of each word comes as ``word_langs``. Words are
    runs of ASCII letters and characters beyond ASCII, in lower case. Repeated rows get
    a row each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    lowered = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = documents.select(
        lowered.alias("_lowered"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
        *keep,
    )
    fields = [T.StructField(f.name, f.dataType) for f in documents.select(*keep).schema]
    fields += [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if word_labels:
        fields.append(T.StructField("word_langs", T.ArrayType(T.StringType())))
    return rows.mapInArrow(_label(shared, word_labels, [f.name for f in fields]), T.StructType(fields))


def identify_languages(documents: DataFrame, rows: int = ROWS_PER_LANGUAGE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from the labelled documents that are not held out, and predicts all."""
    return predict_languages(documents, train(*training_rows(documents, rows)), keep=keep)
