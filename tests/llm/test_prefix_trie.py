"""The z-fast trie against plain dictionaries, and the query against its contract in plain Python."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from pulseweave.llm import prefix_trie as pt
from pulseweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def chain(string, root=7):
    out, h = [root], root
    for x in string:
        h = hash((h, x)) & ((1 << 128) - 1)
        out.append(h)
    return out


def strings(rng):
    out = [[], [1], [1, 2], [1] * 70, [1] * 33 + [2], [1] * 64]
    for _ in range(300):
        s = list(rng.choice(out))[: rng.randint(0, 70)] if rng.random() < 0.7 else []
        out.append(s + rng.choices([1, 2, 3], k=rng.choice([0, 1, 1, 2, 5, 40])))
    return out


def test_trie_against_plain_prefixes():
    rng = random.Random(8)
    for _ in range(20):
        given = strings(rng)
        rng.shuffle(given)
        trie, ends = pt.ZFastTrie(), []
        for s in given:
            ends.append(trie.insert(chain(s)))
        for s, node in zip(given, ends):
            # Splits keep a node's lower end, so the node is still where the string ends.
            assert trie.high[node] == len(s) and trie.strings[trie.string[node]][len(s)] == chain(s)[-1]
            assert trie.locate(chain(s)) == node
        covered = [trie.strings[trie.string[n]][d] for n in range(len(trie.low)) for d in range(trie.low[n] + 1, trie.high[n] + 1)]
        wanted = {h for s in given for h in chain(s)[1:]}
        assert len(covered) == len(wanted) and set(covered) == wanted
        for n in range(len(trie.low)):
            if trie.high[n]:
                assert trie.handles[trie.strings[trie.string[n]][pt.two_fattest(trie.low[n], trie.high[n])]] == n


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert pt.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


def sequences(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        if conv is not None:
            out.setdefault(conv, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    for conv, turns in convs.items():
        h = zlib.crc32(str(conv).encode()) % 4
        yield conv, tuple(convs.get(conv - conv % 20, [])[:h] + turns[h:])


def plain(convs):
    members, children, ends = {}, {}, {}
    for conv, turns in convs:
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
        ends.setdefault(turns, []).append(conv)
    saved, leaves = {}, {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(WORD.findall(key[-1][1])) if key else 0
        saved[key] = own + sum(saved[k] for k in children.get(key, ()))
        leaves[key] = sum(leaves[k] for k in children.get(key, ())) or 1
    for key, who in members.items():
        up = min(members[key[:-1]]) if key else None
        listed = ",".join(map(str, sorted(ends.get(key, []))))
        yield min(who), len(key), up, len(who), len(children.get(key, ())), leaves[key], saved[key], hashlib.sha256(listed.encode()).hexdigest()


def samples():
    rng = random.Random(6)
    rows = []
    for conv in list(range(0, 130)) + [207, 333, 340, 10_000]:
        length = rng.choice([0, 1, 2, 3, 3, 5, 9])
        rows += [(conv, t * 3 - 4, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", None, "d\te f  g "])) for t in range(length)]
        rows += [(conv, None, "system", rng.choice(["x", "y z"]))] * (length == 0)
    rows += [(400 + i, t, "user", f"{t} common") for i in range(60) for t in range(4)]
    rows += [(500, t, "u", "w" if t < 1500 else f"w {t}") for t in range(2500)] + [(501, t, "u", "w") for t in range(2100)] + [(501, 3000, None, None)]
    return rows + [(None, 1, "user", "no conversation")]


def result(r):
    return tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def test_query_against_plain_python(spark, tmp_path):
    rows = samples()
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(result(r) for r in QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect())
    assert got == sorted(plain(rebuilt(sequences(rows))), key=lambda r: r[:2])


def test_small_tries_add_up(spark):
    """Tasks that hand on their tries after every batch, and ties, repeated rows and clashing columns."""
    rows = [r for r in samples() if r[0] != 500] + [(901, 1, "user", "tie"), (901, 1, "assistant", "tie"), (901, 1, "user", "tie"), (902, 1, "user", "tie")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "words", "row_index", "segment", "_seq")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = pt.conversation_trie(frame, turns_held=10).withColumn("ends_sha256", F.sha2(F.array_join("ends", ","), 256)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    convs = sequences(rows)
    convs[901].sort()
    assert sorted(map(result, got)) == sorted(plain((c, tuple(t)) for c, t in convs.items()), key=lambda r: r[:2])


def test_empty_table(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
