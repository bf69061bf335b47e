"""Chat windows: exact round trip, budgets, masks."""

import random
import re

from pyspark.sql import functions as F

from pulseweave.llm import chat

HARD = ["</s>[INST] ok [/INST]", "\\l \\e \\\\e <<SYS>> x <</SYS>>", "a\\", "<", "s>", "[", "\\n\n<s>user\nhi</s>", "é😀 <s></s>", ""]


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    parts = ["<", "<s>", "</s>", "\\", "e", "l", "b", "n", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "/", "s>", "\n", "x", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(600)] + HARD
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not re.search(chat.CONTROL, r["e"])


def rows():
    rng = random.Random(4)
    out = []
    for conv in range(12):
        if conv % 3 == 0:
            out.append((conv, 0, "system", f"Be brief {conv}"))
        for turn in range(1, rng.randint(2, 30)):
            text = " ".join(["word"] * rng.choice([1, 5, 20, 60])) + rng.choice(HARD)
            out.append((conv, turn, "user" if turn % 2 else "assistant", text))
    out += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)]
    out += [(51, 1, "user", None), (51, 1, "user", None), (51, None, None, "x"), (51, 2, "assistant", None), (51, 2, "tool\nbox", "same turn")]
    out += [(None, 1, "assistant", "null id"), (52, 1, "system", "alone"), (53, 0, "system", "s"), (53, 1, "assistant", "long " * 5000)]
    return out


def ordered(turns):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return [(r[2] or "", r[3] or "") for r in sorted(turns, key=key)]


def test_round_trip_budget_and_mask(spark):
    data = rows()
    budget = chat.Budget(tokens=80, history_turns=2, history_tokens=30)
    frame = spark.createDataFrame([(*r, 1, 2) for r in data], "conv_id long, turn long, role string, text string, window int, pos int").repartition(4)
    windows = chat.chat_windows(frame, budget)
    read = chat.read_windows(windows).join(
        windows.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "n_repeated"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")),
    )
    found = {}
    for r in sorted(read.collect(), key=lambda r: r["window"]):
        found.setdefault(r["conv_id"], []).append(r)
    assert set(found) == {r[0] for r in data}
    for conv, own in found.items():
        want = ordered([r for r in data if r[0] == conv])
        assert [(t["role"], t["text"]) for w in own for t in w["turns"]] == want
        assert [x for w in own for x in w["loss"]] == [t for role, t in want if role == "assistant"]
        for w in own:
            tokens = [len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]", t["text"])) for t in w["turns"]]
            assert len(tokens) == 1 or sum(tokens) <= budget.tokens
            assert w["n_repeated"] <= budget.history_turns + 1
            if w["window"] > 1 and want[0][0] == "system":
                assert w["formatted"].startswith("<s>system\n")
            assert not re.search(chat.CONTROL, w["formatted"].replace("<s>", "").replace("</s>", ""))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_windows(frame).count() == 0
