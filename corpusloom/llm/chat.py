"""Chat examples by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and only its
text is trainable. A conversation that does not end with an assistant turn gets one more
example without a trainable part, so that its last turns are kept too. Built-in column
functions only.

Template of a turn: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``. A control
string inside a role or text gets the symbol U+241B behind its first character, or one
more where it has some; reading takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: what the template, or a common one, would read as control
CONTROLS = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|unk>|pad>|<SYS>>|</SYS>>|/?INST\]"
ESCAPE = "␛"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({ESCAPE}*)({CONTROLS})", rf"$1$2{ESCAPE}$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({ESCAPE}*){ESCAPE}({CONTROLS})", "$1$2$3")


def examples(turns: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """One row per example of ``turns(conv_id, turn, role, text)``:

    ``conv_id``, ``example`` (from 0), ``last`` (it holds the whole conversation),
    ``formatted`` and the place of the trainable text in it, ``loss_start`` and
    ``loss_end`` (code points, end exclusive; equal when nothing is trainable).

    A null text or role is empty; turns of equal number are ordered by role and text, and
    a null number comes first. Rows without conv_id form one conversation without id,
    repeated rows are turns of their own, other columns are ignored. A conversation is
    put together in one row, as its examples need its turns in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    told = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    pieces = F.transform(
        "turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(END))
    )
    size = F.size("turns")
    replies = F.filter(
        F.sequence(F.lit(1), size), lambda i: (F.get("turns", i - 1)["role"] == reply_role) | (i == F.size("turns"))
    )
    rows = convs.select("conv_id", "turns", pieces.alias("pieces"), replies.alias("ends"))
    rows = rows.select("conv_id", "turns", "pieces", F.posexplode("ends").alias("example", "end"))
    piece = F.get("pieces", F.col("end") - 1)
    trained = F.get("turns", F.col("end") - 1)["role"] == reply_role
    rows = rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("end") == size).alias("last"),
        F.array_join(F.slice("pieces", 1, F.col("end")), "").alias("formatted"),
        F.when(
            trained, F.length(piece) - F.length(F.substring_index(piece, MIDDLE, 1)) - len(MIDDLE) - len(END)
        ).otherwise(0).alias("size"),
    )
    stop = F.length("formatted") - len(END)
    return rows.select(
        "conv_id", "example", "last", "formatted",
        (stop - F.col("size")).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end"),
    )


def trainable(rows: DataFrame) -> Column:
    """The text under the loss mask of an example, as it was written."""
    del rows
    part = F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")
    return unescape(part)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``role`` and ``text``."""
    pieces = F.split(formatted, F.lit("<\\|im_end\\|>"), -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, MIDDLE, 1), len(START) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring_index(p, MIDDLE, -1)).alias("text"),
        ),
    )


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation what its examples say, read back from them: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples``."""
    turns = read_turns(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select(
        "conv_id", "example", "last",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), F.size(turns).cast("long")).alias("n_turns"),
        F.when(F.col("last"), F.sha2(told, 256)).alias("turns_sha256"),
        trainable(rows).alias("loss"),
    )
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        loss.alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
