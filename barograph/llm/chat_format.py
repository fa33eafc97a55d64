"""Preference formatting: the turns that a chosen and a rejected conversation share are rendered once, as the prompt.

The longest common prefix of turns is compared turn by turn, on role and text.  Both rests are rendered as
completions, with a mask over their characters: a segment counts in training where it is what the assistant
writes (its text and closing mark), and not where it is another role's turn or a header.  A mask is written as
runs, ``0x9 1x40`` for 9 characters left out and 40 trained.

Only DataFrame functions run.  One groupBy brings the turns of a conversation together, as long as the
conversation is; turns are keyed by conversation, so shared turns cause no skew.

Nulls and edges: rows without a conversation id belong to none; a null role is ``unknown`` and a null text empty;
turns stand by (turn, role, text), null turns first, and repeated rows are kept.  Marks inside a text are made
harmless by a space.  Identical conversations give two empty completions; conversations that share nothing give
an empty prompt.  An empty table gives no rows.  Other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
HEADER = START + "{role}\n"
CLOSE = END + "\n"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: an array of (role, text) in order, from one row a turn (key, turn, role, text)."""
    clean = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "<\\|im_(start|end)\\|>", "<| im_$1|>")
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), clean.alias("text")).alias("t"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("turns")).select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two arrays share from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # the shorter one is filled up with nulls
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(a).cast("long")).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column, trained: str = "assistant") -> Column:
    """The runs of a rendered completion: 0 headers and other roles' turns, 1 the trained role's text with its end."""

    def runs(t: Column) -> Column:
        head, body = F.length(t["role"]) + len(START) + 1, F.length(t["text"]) + len(CLOSE)
        return F.when(t["role"] == trained, F.concat(F.lit("0x"), head.cast("string"), F.lit(" 1x"), body.cast("string"))).otherwise(F.concat(F.lit("0x"), (head + body).cast("string")))

    return F.array_join(F.transform(turns, runs), " ")


def format_preferences(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, shared turns, prompt, and for both sides the completion and its mask, from (key, chosen, rejected): arrays of (role, text)."""
    n = common_turns(F.col("chosen"), F.col("rejected"))
    parts = pairs.select(key, "chosen", "rejected", n.alias("n"))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    parts = parts.select(key, F.col("n").alias("n_shared"), F.slice("chosen", F.lit(1), F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(key, "n_shared", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), rendered(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def with_swapped_answer(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, chosen, rejected: each conversation up to its last answer, against one that answers there as before.

    The rejected side's last assistant turn repeats the conversation's first one, so it is off the point; where
    there is one answer only, the rejected side stops short of it.  Conversations without an answer don't pair.
    """
    turns = F.col("turns")
    answers = F.filter(F.transform(turns, lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == "assistant")
    held = convs.select(key, turns.alias("turns"), answers.alias("a")).where(F.size("a") > 0)
    last, first = F.element_at("a", -1)["i"], F.element_at("a", 1)
    before = F.slice("turns", F.lit(1), last)
    again = F.when(F.size("a") > 1, F.array(F.struct(first["role"].alias("role"), first["text"].alias("text")))).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    return held.select(key, F.slice("turns", F.lit(1), last + 1).alias("chosen"), F.concat(before, again).alias("rejected"))
