"""Chat formatting with DataFrame functions only: every assistant turn becomes an example with its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """``<|`` never stands in escaped text: a backslash goes between, and one more where some stood already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One example per assistant turn: all turns before it as context, its reply alone trained.

    ``text`` is the whole example, ``loss_start`` (from 1) and ``loss_chars`` mark the reply in
    it. Turns after the last reply, or a conversation without one, give a last row without a
    loss, so that no turn is lost; ``whole`` marks the row that holds the whole conversation.
    A conversation of n replies is written n times in part, as the method asks: its output
    grows with the square of n, and it is one row until it is expanded.

    Turns stand in the order of turn number, role, text, nulls first; repeated rows are turns
    of their own, equal ones in any order. A null text or role is empty. Rows without a
    conversation id are one conversation. Texts of any length are formatted whole. Returns
    ``conv_id, example, text, loss_start, loss_chars, whole``; an empty table gives an empty
    result; further columns are not read.
    """
    slim = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("t"),
    )
    listed = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    role = lambda t: F.replace(escaped(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit(LINE))
    one = lambda t: F.concat(F.lit(START), role(t), F.lit("\n"), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(END))
    replies = F.expr("filter(sequence(1, size(ts)), i -> coalesce(ts[i - 1].role = 'assistant', false))")
    made = listed.select("conv_id", "ts", F.transform("ts", one).alias("parts"), replies.alias("ends"), F.size("ts").alias("n"))
    with_rest = made.withColumn("ends", F.expr("IF(size(ends) > 0 AND element_at(ends, -1) = n, ends, array_append(ends, n))"))
    each = with_rest.select("conv_id", "ts", "parts", "n", F.posexplode("ends").alias("example", "stop"))
    reply = F.element_at("ts", F.col("stop"))
    loss = F.when(reply["role"] == TRAINED, F.length(escaped(F.coalesce(reply["text"], F.lit("")))).cast("long"))
    cut = each.select("conv_id", "example", F.array_join(F.slice("parts", F.lit(1), F.col("stop")), "").alias("text"), loss.alias("loss_chars"), (F.col("stop") == F.col("n")).alias("whole"))
    return cut.select("conv_id", "example", "text", (F.length("text") - len(END) - F.col("loss_chars") + 1).cast("long").alias("loss_start"), "loss_chars", "whole")


def parsed(text: Column) -> Column:
    """The turns of a formatted text, with roles and texts as they were."""
    body = F.transform(F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != ""), lambda x: F.substr(x, F.lit(len(START) + 1)))
    return F.transform(body, lambda x: F.struct(unescaped(F.replace(F.substring_index(x, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))


def read_back(rows: DataFrame) -> DataFrame:
    """Conversations from their examples: turns as they were, the text under all loss masks, characters of all examples."""
    under = F.when(F.col("loss_chars").isNotNull(), unescaped(F.expr("substring(text, CAST(loss_start AS INT), CAST(loss_chars AS INT))")))
    slim = rows.select("conv_id", "example", under.alias("loss"), F.when(F.col("whole"), parsed(F.col("text"))).alias("turns"), F.length("text").cast("long").alias("chars"))
    listed = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("ls"), F.element_at(F.collect_list("turns"), 1).alias("turns"), F.sum("chars").alias("formatted_chars"))
    return listed.select("conv_id", "turns", F.array_join(F.expr("transform(filter(ls, l -> l.loss IS NOT NULL), l -> l.loss)"), "").alias("loss"), "formatted_chars")
