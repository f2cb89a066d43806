"""Whole conversations rendered turn by turn (G8, multi-turn form).

A conversation is never one row or one task: every turn becomes a fragment of
the rendered text, with the character at which it begins. The fragments of a
conversation in order of ``char_start`` are its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import CHAT_TEMPLATE
from .sampling import ROW, in_order, partition_of

# What stands between turns of one role that become one message.
JOINT = "\n\n"

# The key of windows and joins is a struct of the conversation, which is never null: both then share one exchange.
_PART, _KEY, _N, _T = "__part", "__key", "__n", "__t"


def conversation_fragments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                           text: str = "text", template: str = CHAT_TEMPLATE, joint: str = JOINT) -> DataFrame:
    """``(conv, turn, role, message, char_start, n_chars, fragment)`` for every turn of every role.

    ``template`` is rendered per message; consecutive turns of one role are one
    message, joined by ``joint``. ``message`` counts from 0 in a conversation;
    ``char_start`` and ``n_chars`` are code points of the rendered conversation.

    Rows are range-partitioned by (conversation, turn). What a turn needs from
    its neighbours is its neighbour's role, and sums over all turns before it:
    both come from inside the partition, and from a table of one row per
    (partition, conversation) for what lies outside. A null text or role is
    empty, a null conversation is one like others, a null turn comes first.
    Repeated turns follow each other by role, length and hash of the text, equal rows all stay.
    """
    d = turns.select(conv, turn, F.coalesce(role, F.lit("")).alias(role), F.coalesce(text, F.lit("")).alias(text))
    d = d.withColumn(_N, F.length(text)).withColumn(_T, F.xxhash64(text))
    placed = in_order(d, (conv,), [turn, role, _N, _T], "turns").withColumns({_PART: partition_of(), _KEY: F.struct(conv)})
    head, tail = template.split("{content}")

    def around(part: str) -> Column:
        return F.replace(F.lit(part), F.lit("{role}"), F.col(role))

    inside = Window.partitionBy(_PART, _KEY).orderBy(ROW)
    parts = Window.partitionBy(_KEY).orderBy(_PART)

    def before(value: Column, window: Window) -> Column:
        return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def flagged(rows: DataFrame, outside: DataFrame) -> DataFrame:
        near = rows.withColumns({"__prev": F.lag(role).over(inside), "__next": F.lead(role).over(inside)})
        prev, after = F.coalesce("__prev", "__before"), F.coalesce("__next", "__after")
        return near.join(outside, [_PART, _KEY]).withColumns({"__opens": prev.isNull() | (prev != F.col(role)),
                                                              "__closes": after.isNull() | (after != F.col(role))}) \
            .withColumn("n_chars", (F.col(_N) + F.when(F.col("__opens"), F.length(around(head))).otherwise(len(joint))
                                    + F.when(F.col("__closes"), F.length(around(tail))).otherwise(0)).cast("bigint"))

    # what lies outside a (partition, conversation), found without reading texts
    narrow = placed.select(_PART, _KEY, ROW, role, _N)
    edges = narrow.groupBy(_PART, _KEY).agg(F.min_by(role, ROW).alias("__first"), F.max_by(role, ROW).alias("__last"))
    edges = edges.select(_PART, _KEY, F.lag("__last").over(parts).alias("__before"), F.lead("__first").over(parts).alias("__after"))
    sums = flagged(narrow, edges).groupBy(_PART, _KEY, "__before", "__after").agg(
        F.sum("n_chars").alias("__chars"), F.sum(F.col("__opens").cast("bigint")).alias("__heads"))
    starts = sums.select(_PART, _KEY, "__before", "__after", before(F.col("__chars"), parts).alias("__char0"),
                         before(F.col("__heads"), parts).alias("__head0"))

    opened = F.sum(F.col("__opens").cast("bigint")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged(placed, starts).select(
        conv, turn, role, (F.col("__head0") + opened - 1).alias("message"),
        (F.col("__char0") + before(F.col("n_chars"), inside)).alias("char_start"), "n_chars",
        F.concat(F.when(F.col("__opens"), around(head)).otherwise(joint), F.col(text),
                 F.when(F.col("__closes"), around(tail)).otherwise("")).alias("fragment"))
