"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and that reply alone trainable. Where a conversation
ends with another role, a last example without trainable text holds it whole, so that no turn is lost.

Template: <s>, then for each turn [INST]role[/INST]text</s>. A control string inside a role or text is broken by a backslash after its
first character, and a backslash is doubled; `unescape` turns both back. So control strings in the output are the template's own.

Null role or text: empty. Turns are ordered by (turn, role, text), null turns first; repeated rows are turns each. A null conv_id is a conversation.
An empty table gives no rows. Further columns are ignored. A conversation is one row here, as its digest and its prefixes need it whole;
its examples hold its text once for each assistant turn, which is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"
TARGET = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame, target: str = TARGET) -> DataFrame:
    """conv_id, target_turn (its place from 0), text, loss_start, loss_end (in code points of text; equal where nothing is trainable)."""
    safe = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = turns.select("conv_id", F.struct(F.col("turn").alias("t"), safe("role").alias("r"), safe("text").alias("x")).alias("turn"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    shown = whole.select("conv_id", F.transform("turns", lambda t: F.struct((t["r"] == target).alias("is_target"), F.concat(F.lit(ROLE), escape(t["r"]), F.lit(TEXT)).alias("head"), escape(t["x"]).alias("body"))).alias("turns"))
    split = shown.select("conv_id", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))).alias("parts"), F.posexplode(F.transform("turns", lambda t: F.struct(t["is_target"].alias("is_target"), F.length(t["body"]).alias("n")))).alias("at", "turn"))
    chosen = split.where(F.col("turn.is_target") | (F.col("at") == F.size("parts") - 1))
    text = F.concat(F.lit(BEGIN), F.array_join(F.slice("parts", F.lit(1), F.col("at") + 1), ""))
    made = chosen.select("conv_id", F.col("at").alias("target_turn"), text.alias("text"), "turn")
    end = (F.length("text") - len(END)).cast("long")
    return made.select("conv_id", "target_turn", "text", F.when(F.col("turn.is_target"), end - F.col("turn.n")).otherwise(end).alias("loss_start"), end.alias("loss_end"))


def read_back(text: Column) -> Column:
    """The turns (role, text) of an example."""
    parts = F.slice(F.split(F.substring(text, len(BEGIN) + 1, 2**31 - 1), END), 1, F.size(F.split(text, END)) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, TEXT, 1)
        body = F.substring(part, F.length(head) + len(TEXT) + 1, F.lit(2**31 - 1))
        return F.struct(unescape(F.substring(head, len(ROLE) + 1, 2**31 - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = made.groupBy("conv_id").agg(
        F.max_by("text", "target_turn").alias("text"),
        F.sort_array(F.collect_list(F.struct("target_turn", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    read = whole.select("conv_id", read_back(F.col("text")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
