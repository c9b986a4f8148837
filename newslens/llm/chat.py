"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and only its own reply
under the loss mask. The text of an example is a prefix of the formatted conversation, so an example
is cut from it when its row is made and prefixes are never held side by side.

A turn is ``<s>role<|>text</s>``. Control strings inside a role or a text get a backslash after their
first character (and those that already have backslashes there get one more), which
:func:`unescape` takes away again; so control strings mark turns and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, MIDDLE, CLOSE = "<s>", "<|>", "</s>"
# The control strings, as first character and rest.
_ANGLE = r"s>|/s>|\|>"
_SQUARE = r"INST\]|/INST\]"


def escape(text: Column) -> Column:
    """``text`` with no control string left in it."""
    angle = F.regexp_replace(text, rf"<(\\*)({_ANGLE})", r"<\\$1$2")
    return F.regexp_replace(angle, rf"\[(\\*)({_SQUARE})", r"[\\$1$2")


def unescape(text: Column) -> Column:
    """The text that :func:`escape` was given."""
    angle = F.regexp_replace(text, rf"<\\(\\*)({_ANGLE})", r"<$1$2")
    return F.regexp_replace(angle, rf"\[\\(\\*)({_SQUARE})", r"[$1$2")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and the turns' ``spans``.

    Turns are ordered by ``turn`` (null first); equal numbers by role, then text. A null role or text
    counts as empty, null ``conv_id`` is a conversation of its own, repeated rows are repeated turns,
    and further columns are ignored. A conversation is one row, as its digest needs it whole.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    gathered = clean.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    pieces = gathered.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            t["role"].alias("role"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
            F.concat(escape(t["text"]), F.lit(CLOSE)).alias("body"),
        )).alias("pieces"),
    )
    lengths = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]))
    # Running ends: each is the last one plus the next length.
    ends = F.aggregate(
        lengths, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.flatten(F.transform("pieces", lambda p: F.array(p["head"], p["body"]))), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(p["role"].alias("role"), F.length(p["head"]).alias("head"))).alias("marks"),
        ends.alias("ends"),
    )


def expand(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Examples: ``conv_id, example, kind, text, loss_start, loss_end, n_turns``.

    ``text`` is the formatted prefix up to and with the reply; code points from ``loss_start`` to
    before ``loss_end`` (from 0, without the closing mark) are trainable. Conversations that do not
    end in a reply give one more row, ``kind`` "rest": the whole conversation with an empty mask, so
    that the output holds every turn. No conversations give no rows.
    """
    whole = format_conversations(turns)
    count = F.size("marks")
    made = whole.select(
        "conv_id", "formatted", "marks", "ends",
        F.explode(F.filter(
            F.sequence(F.lit(0), count - 1),
            lambda i: (F.get("marks", i)["role"] == trained_role) | (i == count - 1),
        )).alias("at"),
    )
    mark = F.get("marks", F.col("at"))
    end = F.get("ends", F.col("at") + 1)
    reply = mark["role"] == trained_role
    start = F.get("ends", F.col("at")) + mark["head"]
    return made.select(
        "conv_id",
        F.col("at").alias("example"),
        F.when(reply, "reply").otherwise("rest").alias("kind"),
        F.substring("formatted", F.lit(1), end).alias("text"),
        F.when(reply, start).otherwise(end).alias("loss_start"),
        F.when(reply, end - len(CLOSE)).otherwise(end).alias("loss_end"),
        (F.col("at") + 1).alias("n_turns"),
        (F.col("at") + 1 == count).alias("complete"),
    )


def read_turns(text: Column) -> Column:
    """Formatted text back to its turns, as an array of (role, text)."""
    raw = F.split(F.substring(text, F.lit(len(OPEN) + 1), F.length(text) - len(OPEN) - len(CLOSE)), CLOSE + OPEN)
    return F.transform(raw, lambda r: F.struct(
        unescape(F.substring_index(r, MIDDLE, 1)).alias("role"),
        unescape(F.substr(r, F.length(F.substring_index(r, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text"),
    ))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What the loss mask covers, as it was before escaping."""
    return unescape(F.substring(text, start + 1, end - start))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from examples: turns, loss text and lengths with their digests."""
    texts = examples.select(
        "conv_id", "example",
        F.when(F.col("complete"), F.col("text")).alias("whole"),
        F.when(F.col("kind") == "reply", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))).alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    back = texts.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", F.col("loss").alias("loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("loss").alias("n_examples"),
    )
    turns = back.withColumn("turns", read_turns(F.col("whole"))).withColumn(
        "loss", F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
