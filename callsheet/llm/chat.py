"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are context, and only its
own text is trainable. Turns are marked as
`<|im_start|>role<|im_sep|>text<|im_end|>`; control strings of this and of other
common templates are escaped inside roles and texts, so that no text can pass for a
mark, and the escape can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TARGET_ROLE = "assistant"
#: The beginnings of control strings: <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
_CONTROL = r"([<\[])(?=\||/?s>|</?SYS>>|/?INST\])"
_ESCAPED = r"(?<=[<\[])\\(?=[|/s<I])"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of a control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """What `escape` has been given. A single backslash there can only be its own."""
    return F.replace(F.regexp_replace(text, _ESCAPED, ""), F.lit("\\\\"), F.lit("\\"))


def examples(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per assistant turn, and one for what follows the last of them.

    Columns: `id`, `target` (the turn's place in its conversation, from 1), `text`,
    `loss_start`, `loss_end` (code points of the trainable span) and `is_last`. A
    conversation that does not end with an assistant turn gives one more example, of all
    its turns, without a trainable span.

    Null roles and texts are empty, rows with a null id form a conversation. Turns go by
    turn number, nulls first, then by role and text; equal rows are turns each. A
    conversation has to fit into a row; its examples together have the square of its
    length, which is what prefix expansion means, and are made one at a time.
    """
    role = F.coalesce(F.col(role_column).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    escaped = escape(text)
    turns = conversations.select(
        F.col(id_column).alias("id"),
        F.struct(
            F.col(turn_column).alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.concat(F.lit(START), escape(role), F.lit(SEPARATOR), escaped, F.lit(END)).alias("marked"),
            F.length(escaped).alias("chars"),
        ).alias("t"),
    )
    whole = turns.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    each = whole.select(
        "id",
        F.transform("turns", lambda t: t["marked"]).alias("marked"),
        F.posexplode(
            F.transform(
                "turns", lambda t: F.struct(t["role"].alias("role"), t["chars"].alias("chars"))
            )
        ).alias("place", "t"),
    )
    is_target = F.col("t.role") == TARGET_ROLE
    is_last = F.col("place") + 1 == F.size("marked")
    made = each.where(is_target | is_last).select(
        "id",
        (F.col("place") + 1).alias("target"),
        F.array_join(F.slice("marked", F.lit(1), F.col("place") + 1), "").alias("text"),
        F.when(is_target, F.col("t.chars")).alias("chars"),
        is_last.alias("is_last"),
    )
    end = F.length("text") - F.when(F.col("chars").isNull(), 0).otherwise(len(END))
    return made.select(
        "id",
        "target",
        "text",
        (end - F.coalesce("chars", F.lit(0))).cast("long").alias("loss_start"),
        end.cast("long").alias("loss_end"),
        "is_last",
    )


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def turns_of(text: Column) -> Column:
    """Array of `role` and `text` of the turns of an example, read from its marks."""
    marked = F.filter(F.split(text, r"<\|im_end\|>"), lambda part: part != "")
    return F.transform(
        F.transform(marked, lambda part: F.split(part, r"<\|im_sep\|>")),
        lambda pair: F.struct(
            unescape(F.substr(pair[0], F.lit(len(START) + 1))).alias("role"),
            unescape(pair[1]).alias("text"),
        ),
    )
