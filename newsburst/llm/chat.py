"""Chat formatting from an event log: fold each conversation's events into final messages,
render them with a template, and read the output back.

Events (conv_id, message_id, seq, kind, role, text) of a message apply in the order of seq:
``delta`` appends its text, ``edit`` puts its text in place of what was there, ``regenerate``
drops what was there. A role given later replaces an earlier one. Messages follow each other
by message_id.

Template: ``<|start|>role\\ntext<|end|>\\n`` for each message. Inside roles and texts a
backslash becomes two, ``<`` becomes ``\\l``, and in roles a line feed ``\\n``; so no marker can
occur in a text, and unescaping gives back every character.

All steps are DataFrame expressions. Messages are folded under (conversation, message), offsets
come from a window, and a conversation meets in one task only as its own output row.

Defined results: null texts and roles are empty; null ids sort first and count as ids; events of
one seq apply in the order of kind and text; unknown kinds change nothing; repeated events apply
again. A message whose events leave nothing has an empty text. No rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Splitting at double backslashes, left to right, leaves only single ones to read."""
    parts = F.transform(
        F.split(text, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")),
    )
    return F.array_join(parts, "\\")


def as_events(turns: DataFrame) -> DataFrame:
    """The log that a chat service would have streamed for ``turns`` (conv_id, turn, role, text):
    replies arrive as a draft that is regenerated in two deltas, other turns as a draft that is
    edited. Several rows of one turn are several messages, ordered by role and text."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")

    def event(seq: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    first, second = F.substring(text, 1, half), F.substring(text, half + 1, F.length(text) - half)
    reply = F.array(
        event(0, "delta", first), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", second)
    )
    other = F.array(event(0, "delta", second), event(1, "edit", text))
    numbered = turns.select(
        "conv_id", F.struct("turn", F.row_number().over(order).alias("copy")).alias("message_id"), "role", "text"
    )
    log = F.when(F.col("role") == "assistant", reply).otherwise(other)
    return numbered.select("conv_id", "message_id", "role", F.inline(log))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, role, text) after all events of each message."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")))
    last_reset = F.array_max(
        F.transform(
            "log", lambda e, i: F.when(e.kind.isin("edit", "regenerate"), i).otherwise(F.lit(-1))
        )
    )
    kept = F.filter(
        "log", lambda e, i: (e.kind.isin("delta") & (i > last_reset)) | (e.kind.isin("edit") & (i == last_reset))
    )
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    return (
        events.groupBy("conv_id", "message_id")
        .agg(ordered.alias("log"))
        .select(
            "conv_id",
            "message_id",
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(F.transform(kept, lambda e: e.text), "").alias("text"),
        )
    )


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss) per conversation: the rendered text, and the loss mask as
    spans (start, length) of code points that cover the texts of the ``learned`` roles."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        messages.select("conv_id", "message_id", "role", head.alias("head"), body.alias("body"))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    )
    spans = F.struct(
        (F.col("at") + F.length("head")).cast("long").alias("start"),
        F.length("body").cast("long").alias("length"),
    )
    rows = F.array_sort(
        F.collect_list(F.struct("message_id", "piece", F.when(F.col("role").isin(*learned), spans).alias("span")))
    )
    return (
        placed.groupBy("conv_id")
        .agg(rows.alias("rows"))
        .select(
            "conv_id",
            F.array_join(F.transform("rows", lambda r: r.piece), "").alias("formatted"),
            F.filter(F.transform("rows", lambda r: r.span), lambda s: s.isNotNull()).alias("loss"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) from ``render``'s output alone; turns are (role, text)."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    learned = F.transform(
        "loss",
        lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int"))),
    )
    return formatted.select(
        "conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(learned, "").alias("loss_text")
    )


def digest(read: DataFrame) -> DataFrame:
    """Counts and checksums of what was read back."""
    lf = F.lit("\n")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, lf, t.text, lf)), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
