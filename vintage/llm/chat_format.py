"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted by turn. Adjacent
turns of one role become one merged turn with the array of their texts, and the
conversation is the concatenation of its segments:

    <|im_start|>role\\n text [<|im_next|> text ...] <|im_end|>\\n   per merged turn

A segment is a piece of the output with a flag that says whether the loss counts
it; exactly the texts of ``loss_role`` are flagged, markers never are. Control
strings inside texts and roles are escaped: backslashes are doubled, then a
backslash parts ``<`` from ``|``, so that no text holds a marker and
:func:`unescape` gives back what was there. ``<|im_next|>`` keeps the borders of
merged turns, so that :func:`read_back` returns the turns that went in.

All work on a conversation is linear in its length; as one output row it has to
fit in a task, like any row.

Edge cases: a null text or role counts as empty; rows of one turn number are
sorted by role, then text, repeated rows are turns of their own; a null turn
number comes first; rows without a conversation id form one conversation whose
id is null; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: in escaped text only the inserted backslash stands alone between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a line break, which ends the role, becomes ``<`` backslash ``/``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def _merge(turns: Column) -> Column:
    """Runs of one role as ``struct<role, texts>``, from the sorted array of ``struct<turn, role, text>``."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, F.lit(2), n), F.array(n))
    run = lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts"))
    return F.zip_with(starts, ends, run)


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(merged: Column, loss_role: str) -> Column:
    marker = F.lit(False)

    def of_run(run: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(run["role"]), F.lit("\n"))
        texts = F.transform(run["texts"], lambda t, i: F.array(_segment(F.when(i == 0, head).otherwise(NEXT), marker), _segment(escape(t), run["role"] == loss_role)))
        return F.concat(F.flatten(texts), F.array(_segment(F.lit(END), marker)))

    return F.flatten(F.transform(merged, of_run))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, segments array<struct<text, loss>>, formatted`` for ``conversations(conv_id, turn, role, text)``."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turn = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    turns = conversations.select("conv_id", turn.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    merged = turns.select("conv_id", _merge(F.col("turns")).alias("merged"))
    cut = merged.select("conv_id", _segments(F.col("merged"), loss_role).alias("segments"))
    return cut.select("conv_id", "segments", F.array_join(F.col("segments")["text"], "").alias("formatted"))


def read_back(formatted: str | Column = "formatted") -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    literal = lambda marker: "\\Q" + marker + "\\E"
    runs = F.filter(F.split(formatted, literal(END), -1), lambda run: run != "")

    def turns(run: Column) -> Column:
        role = F.substring_index(run, "\n", 1)
        body = F.substr(run, F.length(role) + 2)
        return F.transform(F.split(body, literal(NEXT), -1), lambda t: F.struct(unescape_role(F.replace(role, F.lit(START), F.lit(""))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def loss_text(segments: str = "segments") -> Column:
    """What the loss counts, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def format_report(formatted: DataFrame) -> DataFrame:
    """Digest columns of :func:`format_conversations`, all read back from its output."""
    turns = formatted.select("conv_id", "formatted", read_back().alias("turns"), loss_text().alias("under_loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("under_loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
