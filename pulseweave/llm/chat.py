"""Chat formatting into token-budgeted windows of whole turns.

Prefix sums of turn tokens cut a conversation into spans of turns. Each window opens
with the conversation's system turn, repeats a few turns of history, and adds the
turns of its span; only the assistant turns of the span are under the loss mask.
Long conversations are summed in two levels, so none is ever one task's work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Strings with a meaning in chat templates (fixed values); none of them stays in a text as it is.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>"
#: Turn numbers that share a block of prefix sums.
BLOCK_TURNS = 256


@dataclass(frozen=True)
class Budget:
    """Tokens of a window's own turns, and how much history is repeated before them."""

    tokens: int = 2048
    history_turns: int = 2
    history_tokens: int = 256

    @property
    def long_turn(self) -> int:
        """From so many tokens on a turn is a span of its own."""
        return max(1, self.tokens // 4)

    @property
    def stride(self) -> int:
        """Spans start in strides of this many tokens; with a short last turn they keep the budget."""
        return max(1, self.tokens - self.long_turn)


def token_estimate(text: Column) -> Column:
    """Words of ASCII letters and digits, and every other visible character."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]")).cast("long")


def escape(text: Column) -> Column:
    r"""Breaks control strings with a backslash code; ``unescape`` gives the text back.

    The first character of a control string becomes ``\l`` (for ``<``) or ``\b`` (for
    ``[``). A backslash before e, l, b or n becomes ``\e``, so codes stay unambiguous.
    """
    text = F.regexp_replace(text, r"\\(?=[elbn])", r"\\e")
    text = F.regexp_replace(text, rf"<(?=/?s>|</?SYS>>)", r"\\l")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\b", "["), ("\\n", "\n"), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_turn(role: Column, text: Column) -> Column:
    """``<s>``, the role, a line end, the text, ``</s>``."""
    name = F.replace(escape(role), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(OPEN), name, F.lit("\n"), escape(text), F.lit(CLOSE))


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds position and tokens before each turn, first in blocks and then over blocks."""
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    sums = inside.rowsBetween(Window.unboundedPreceding, -1)
    longs = F.sum(F.col("long_turn").cast("long"))
    local = turns.select(
        "*", F.row_number().over(inside).cast("long").alias("nth"),
        F.coalesce(F.sum("tokens").over(sums), F.lit(0)).alias("tokens_in"),
        F.coalesce(longs.over(sums), F.lit(0)).alias("longs_in"),
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), longs.alias("l"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "t", "l")],
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    return local.join(blocks, same).select(
        "conv_id", "role", "text", "tokens", "long_turn",
        (F.col("n_before") + F.col("nth")).alias("pos"),
        (F.col("t_before") + F.col("tokens_in")).alias("before"),
        (F.col("l_before") + F.col("longs_in")).alias("longs"),
    )


def chat_windows(conversations: DataFrame, budget: Budget | None = None) -> DataFrame:
    """Formatted windows of all conversations.

    Columns: ``conv_id``, ``window`` (number of the window's first own turn, from 1),
    ``formatted``, ``n_repeated`` (its leading turns that other windows own), ``n_own``,
    and ``loss_spans``, an array of (start, length) in characters of ``formatted`` from 1:
    the escaped text of the window's own assistant turns.

    Turns are ordered by turn, role and text, nulls first. A null text or role counts as
    empty, rows with a null ``conv_id`` form one conversation, repeated rows are turns
    each. The system turn is the first turn if its role is system. A turn longer than a
    quarter of the budget has a window of its own, and is not cut even beyond the budget.
    """
    budget = budget or Budget()
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", token_estimate(F.col("text")))
    turns = turns.withColumn("long_turn", F.col("tokens") >= budget.long_turn)
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    numbered = _numbered(turns)
    # Turns between two long ones are cut by strides of their prefix sums.
    span = F.struct("longs", "long_turn", F.floor(F.col("before") / budget.stride).alias("stride"))
    own = numbered.withColumn("span", F.when(F.col("long_turn"), F.struct("longs", "long_turn", F.lit(0).cast("long").alias("stride"))).otherwise(span))
    spans = own.groupBy("conv_id", "span").agg(F.min("pos").alias("window"), F.min("before").alias("opens"))
    history = (
        spans.filter(F.col("window") > 1)
        .select(F.col("conv_id").alias("h_conv"), "window", "opens", F.explode(F.sequence(F.lit(1), F.lit(budget.history_turns))).alias("back"))
        .withColumn("h_pos", F.col("window") - F.col("back"))
    )
    text_of = own.select("conv_id", "pos", "before", "role", "text")
    seen = history.join(
        text_of, F.col("conv_id").eqNullSafe(F.col("h_conv")) & (F.col("pos") == F.col("h_pos")) & (F.col("before") >= F.col("opens") - budget.history_tokens)
    )
    system = text_of.filter("pos = 1 AND role = 'system'").select(F.col("conv_id").alias("s_conv"), "role", "text")
    opened = spans.filter(F.col("window") > 1).join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")))
    piece = lambda pos, kind: F.struct(
        pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), "role",
        format_turn(F.col("role"), F.col("text")).alias("turn"), F.char_length(escape(F.col("text"))).cast("long").alias("chars"),
    ).alias("piece")
    s_conv, s_span = F.col("s_c"), F.col("s_s")
    named = spans.select(F.col("conv_id").alias("s_c"), F.col("span").alias("s_s"), "window")
    fresh = own.join(named, F.col("conv_id").eqNullSafe(s_conv) & (F.col("span") == s_span)).select("conv_id", "window", piece(F.col("pos"), 1))
    repeated = seen.filter("pos > 1 OR role <> 'system'").select("conv_id", "window", piece(F.col("pos"), 0))
    heads = opened.select("conv_id", "window", piece(F.lit(1), 0))
    pieces = fresh.unionByName(repeated).unionByName(heads)
    windows = pieces.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("piece")).alias("turns"))
    at = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def mark(state: Column, turn: Column) -> Column:
        head = F.char_length(turn["turn"]).cast("long") - turn["chars"] - len(CLOSE)
        found = F.struct((state["at"] + head).alias("start"), turn["chars"].alias("length"))
        spans = F.when((turn["kind"] == 1) & (turn["role"] == "assistant"), F.concat(state["spans"], F.array(found))).otherwise(state["spans"])
        return F.struct((state["at"] + F.char_length(turn["turn"])).alias("at"), spans.alias("spans"))

    return windows.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["kind"] == 0)).alias("n_repeated"),
        F.size(F.filter("turns", lambda t: t["kind"] == 1)).alias("n_own"),
        F.aggregate("turns", at, mark, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What a reader finds in formatted windows: ``conv_id``, ``window``, ``formatted``, ``turns``, ``loss``.

    ``turns`` is an array of (role, text) without the repeated ones, ``loss`` an array of
    the texts under the mask; all of them unescaped.
    """
    parts = F.slice(F.split("formatted", CLOSE, -1), F.col("n_repeated") + 1, F.col("n_own"))

    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")
        role = F.substring(part, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, cut + 1, F.char_length(part))).alias("text"))

    under_mask = lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))
    return windows.select(
        "conv_id", "window", "formatted", F.transform(parts, turn).alias("turns"), F.transform("loss_spans", under_mask).alias("loss")
    )
