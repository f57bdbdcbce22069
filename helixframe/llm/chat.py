"""Chat formatting in Spark expressions.

Template: ``<s>`` opens a conversation. A turn is ``[INST]`` role ``[MSG]`` text and ends
in ``</s>`` if its role is trained on, else in ``[/INST]``. Adjacent turns of one role are
merged into one, their texts parted by ``[SEP]``, so that reading back gives the rows.

Control strings inside a role or text get a backslash after their bracket, and those
that have backslashes there already one more; taking one away restores the text. An
escaped text holds no control string and none can form where strings meet, as each
begins with a bracket and holds no other.

The loss mask is given as segments: pieces of the formatted string, in order, with a
flag; only the texts of trained roles have it set.

Nulls: null texts and roles are empty; null turns sort first; a null conversation id is
a conversation. Rows with one turn number sort by role, then text; repeated rows stay.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, OPEN, CLOSE, BODY, PART = "<s>", "</s>", "[INST]", "[/INST]", "[MSG]", "[SEP]"
_CONTROL = r"(?=/?(?:s>|INST\]|MSG\]|SEP\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: its id, ``formatted`` and ``segments`` (array of text, loss)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    last = F.size("turns") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    merged = F.transform("starts", lambda s, k: F.struct(F.get("turns", s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: t["text"]).alias("texts")))

    def laid_out(m: Column, k: Column) -> Column:
        loss = m["role"].isin(*trained)
        head = F.concat(F.when(k == 0, F.lit(BOS)).otherwise(F.lit("")), F.lit(OPEN), escape(m["role"]), F.lit(BODY))
        parts = F.transform(m["texts"], lambda t, j: F.array(F.struct(F.when(j == 0, head).otherwise(F.lit(PART)).alias("text"), F.lit(False).alias("loss")), F.struct(escape(t).alias("text"), loss.alias("loss"))))
        return F.concat(F.flatten(parts), F.array(F.struct(F.when(loss, F.lit(EOS)).otherwise(F.lit(CLOSE)).alias("text"), F.lit(False).alias("loss"))))

    done = grouped.withColumn("starts", starts).withColumn("merged", merged).select("conv_id", F.flatten(F.transform("merged", laid_out)).alias("segments"))
    return done.select(F.col("conv_id").alias(conv_col), F.array_join("segments.text", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), one for each row."""
    bodies = F.filter(F.split(F.regexp_replace(formatted, "^<s>", ""), r"\[INST\]"), lambda x: x != "")
    one = lambda m: F.transform(F.split(F.regexp_replace(F.substring_index(m, BODY, -1), r"(?:</s>|\[/INST\])$", ""), r"\[SEP\]"), lambda t: F.struct(unescape(F.substring_index(m, BODY, 1)).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(bodies, one))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
