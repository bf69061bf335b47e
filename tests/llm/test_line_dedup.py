"""Line dedup against plain Python, hot lines on both ways included."""

import random

from pyspark.sql import functions as F

from pulseweave.llm import line_dedup as ld

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    key = lambda line: line.strip(BLANK).translate(UPPER)
    rank = lambda doc: (doc is None, doc or 0)
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), rank(doc)), rank(doc))
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), rank(doc)) == rank(doc)]
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


def samples():
    rng = random.Random(2)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["short", "", "   ", "ten chars!", " TEN chars!\t", "nine char", "éàüßÉÀÜSSx", "ÉÀÜSSéàüßx", "\x0bLine Number 3 of the pool\r"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)) + [f"only of document {i}"] * rng.randint(0, 2))) for i in range(60)]
    rows += [(i, "a very common line\nsecond common line " + str(i % 2)) for i in range(100, 400)]
    rows += [(500, "\n".join(f"line {i} of a long text" for i in range(700))), (501, "\n".join(f"line {i} of a long text" for i in range(0, 1400, 3)))]
    rows += [(None, "a very common line\nnull document's own"), (None, "null document's own\nmore"), (None, None), (7, None), (7, "a second text of seven\nline number 3 of the pool")]
    rows += [(8, "repeated row, held by itself")] * 3 + [(9, "repeated row, held by itself")] * 2 + [(-5, "LINE NUMBER 3 OF THE POOL"), (601, "\n\n"), (602, "")]
    return rows


def test_against_plain_python(spark):
    rows = samples()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("pos", "words", "n", "hot", "key", "line")})
    got = [tuple(r) for r in ld.dedup_lines(frame.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_both_ways_agree(spark):
    rows = ld.line_rows(spark.createDataFrame(samples(), "doc_id long, text string")).cache()
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    ways = [order(ld.later_lines(rows, n)) for n in (10, 200, 10**6)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 600


def test_bitmaps(spark):
    rows = [(1, "\n".join(f"line {i:03d} is unique" for i in range(200))), (2, "line 070 is unique\nx\nline 199 is unique"), (3, "\n".join(["x"] * 130 + ["line 000 is unique"]))]
    got = {r["doc_id"]: r for r in ld.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 3}
    assert [tuple(w) for w in got[2]["words"]] == [(0, ~0b101)] and [tuple(w) for w in got[3]["words"]] == [(2, ~0b100)]
    assert got[2]["n_dropped"] == 2


def test_empty_table(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
