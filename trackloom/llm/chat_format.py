"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it, formatted, are its context,
and its text alone is trainable. ``examples`` gives them: ``text`` and the span of the loss mask in it.
Written out, contexts grow with the square of a conversation's length; that is what the method asks
for. ``expand`` is the same in a form to keep: an example holds what it adds, ``delta`` being the formatted turns
since the previous assistant reply with the header of the reply, ``target`` the formatted reply, and
``rendered`` puts the contexts together again.

Turns after the last reply (or of a conversation without any) make a last row without a target.

Format of a turn: ``<|start|>role<|sep|>text<|end|>``. Control strings inside a role or text are
broken with a backslash after their first character, backslashes are doubled, so that the original
comes back exactly.

Defined cases: a null text or role is the empty string; all rows with a null conv_id are one conversation; turns
are ordered by turn (null first), then role, then text; repeated rows are kept, in any order as they are
equal; a text of any length is read whole, and an example is at most Spark's 2 GB a value; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Strings that have a meaning in this or other common chat templates; none survives in a text.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _literal(s: str) -> str:
    return "".join("\\" + c if c in "\\<>[]|/." else c for c in s)


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    heads = "|".join(f"{_literal(c[0])}(?={_literal(c[1:])})" for c in CONTROL)
    return F.regexp_replace(doubled, f"({heads})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example, first_turn, delta, target (null: none), context_chars, delta_chars, target_chars.

    One row for each assistant turn and one for turns after the last. Turns meet by running sums over a window;
    only those between two replies are put together in a row.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"))
    w = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    reply = F.col("role") == "assistant"
    header = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    placed = turns.select(
        "conv_id",
        (F.row_number().over(w) - 1).alias("place"),
        F.coalesce(F.sum(reply.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("example"),
        F.when(reply, header).otherwise(F.concat(header, escaped(F.col("text")), F.lit(END))).alias("piece"),
        F.when(reply, escaped(F.col("text"))).alias("target"),
    )
    rows = placed.groupBy("conv_id", "example").agg(
        F.min("place").alias("first_turn"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "").alias("delta"),
        F.max("target").alias("target"),  # there is one at most
    )
    rows = rows.withColumns({"delta_chars": F.length("delta").cast("long"), "target_chars": F.length("target").cast("long")})
    added = F.col("delta_chars") + F.coalesce(F.col("target_chars") + len(END), F.lit(0))
    earlier = W.partitionBy("conv_id").orderBy("example").rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.sum(added).over(earlier), F.lit(0).cast("long"))
    return rows.withColumn("context_chars", total + F.col("delta_chars"))


def rendered(examples: DataFrame) -> DataFrame:
    """Examples with the whole ``context`` and ``text``, and the loss span [loss_start, loss_end) in code points.

    The output is as long as the sum of all contexts; use it on the examples that are wanted.
    """
    whole = F.concat(F.col("delta"), F.coalesce(F.concat(F.col("target"), F.lit(END)), F.lit("")))
    earlier = W.partitionBy("conv_id").orderBy("example").rowsBetween(W.unboundedPreceding, -1)
    context = F.concat(F.array_join(F.collect_list(whole).over(earlier), ""), F.col("delta"))
    out = examples.withColumn("context", context)
    return out.withColumns(
        {
            "text": F.concat(F.col("context"), F.coalesce(F.concat(F.col("target"), F.lit(END)), F.lit(""))),
            "loss_start": F.length("context").cast("long"),
            "loss_end": (F.length("context") + F.coalesce(F.length("target"), F.lit(0))).cast("long"),
        }
    )


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, context, target, text, loss_start, loss_end: every example with all preceding turns."""
    return rendered(expand(conversations)).select("conv_id", "example", "context", "target", "text", "loss_start", "loss_end")


def digest(expanded: DataFrame) -> DataFrame:
    """Per conversation, what the formatted examples say when they are parsed back.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples: contexts, targets and
    end marks), n_examples. The turns are those of the last example's text, which has all; the loss is what
    the span of each example marks in its text.
    """
    shown = rendered(expanded)
    marked = F.when(F.col("target").isNotNull(), unescaped(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    per = shown.select("conv_id", "example", "text", marked.alias("loss")).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    # A turn ends with END, and END can't stand inside a role or text.
    cut = F.split("text", _literal(END))
    turns = let(cut, lambda x: F.slice(x, 1, F.size(x) - 1))

    def said(t: Column) -> Column:
        body = F.substring(t, len(START) + 1, 2147483647)
        return F.concat(
            unescaped(F.substring_index(body, SEP, 1)),
            F.lit("\n"),
            unescaped(F.regexp_replace(body, r"(?s)^.*?<\|sep\|>", "")),
            F.lit("\n"),
        )

    loss = F.array_join(F.transform("losses", lambda e: e["loss"]), "")
    return per.select(
        "conv_id",
        let(turns, lambda ts: F.struct(F.size(ts).cast("long").alias("n"), F.sha2(F.array_join(F.transform(ts, said), ""), 256).alias("h"))).alias("t"),
        let(loss, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("h"))).alias("l"),
        "formatted_chars",
        "n_examples",
    ).select(
        "conv_id",
        F.col("t.n").alias("n_turns"),
        F.col("t.h").alias("turns_sha256"),
        F.col("l.n").alias("loss_chars"),
        F.col("l.h").alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
