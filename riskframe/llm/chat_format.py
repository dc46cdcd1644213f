r"""Chat formatting from an event log: conversations are folded from their events and rendered with a template.

An event is (conv_id, seq, turn, kind, role, text).  Events of a message, that is of a turn of a conversation, apply in the
order of seq:

* ``message`` opens it with a role and a text, ``edit`` replaces its text (and its role if the event has one),
* ``delta`` appends a streamed piece of text,
* ``regenerate`` throws its text away; the deltas that follow make it anew,
* ``delete`` removes it, unless a later event opens it again.

So only the events since the last one that replaces the text count, and their texts are joined.  Messages are rendered as
``<|turn|>role<|text|>text<|end|>`` in the order of their turns.  Control strings inside roles and texts are escaped: those of
the template and the ones in use elsewhere (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<|name|>``) get a backslash after their
first sign, and one more where backslashes stand there already.  That can be undone, and no rendered text holds a control string.
The output is a list of segments (text, loss), only assistants' texts are under the loss; joined they are the formatted text.

Scale: DataFrame functions only.  Events are grouped by (conversation, turn), so a conversation with a third of all events is
folded in many tasks; what a task holds at once is one message's events, whose text is one value in the result.  Only the rendered
messages of a conversation meet in one row, which is the row of the result.  Partial lists are built before the shuffle.

Nulls and other cases: a null text is empty, a null role is empty where no event names one, a null conv_id is a conversation like
others, a null kind is ``message``, other kinds change nothing; null turns come first, null seqs apply first.  Events that agree in
seq apply with ``delta`` last, then in the order of kind, role and text; repeated events apply again.  Messages with no other events than
``delete`` or ``regenerate`` are left out in the first case and empty in the second.  Empty tables give an empty result; other
columns are ignored, their names don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.scalars import let

# The control strings.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|[a-z_]{1,40}\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|[a-z_]{1,40}\|>)"
PIECE, PIECES = 400, 64  # code points of a streamed piece at least, and pieces of a text at most
MESSAGE = ("turn", "number")  # what tells the messages of ``as_events`` apart
ODD_TEXT = "</s>[INST] ok [/INST]"  # fixed value of the query contract


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def folded(events: DataFrame, turn: Sequence[str] = ("turn",)) -> DataFrame:
    """(conv_id, turn, role, text): the final message of each turn; ``turn`` names the columns that tell turns apart, in order."""
    kind = F.coalesce("kind", F.lit("message"))
    known = kind.isin("message", "edit", "delta", "regenerate", "delete")
    rank = F.when(kind == "delta", 1).otherwise(0)
    event = F.struct(F.col("seq").alias("seq"), rank.alias("rank"), kind.alias("kind"), F.col("role").alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    lists = events.where(known).groupBy("conv_id", *turn).agg(F.array_sort(F.collect_list(event)).alias("_events"))
    # number of the last event that replaces what was there; 0 if there is none
    numbered = F.transform("_events", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(0))
    live = let(F.array_max(numbered), lambda last: F.slice("_events", F.greatest(last, F.lit(1)), F.size("_events")))
    role = F.element_at(F.filter(F.transform("_events", lambda e: e["role"]), lambda r: r.isNotNull()), -1)
    rows = lists.select("conv_id", *turn, F.when(F.size(F.filter("_events", lambda e: e["role"].isNotNull())) > 0, role).otherwise("").alias("role"),
                        live.alias("_live"))
    parts = F.transform("_live", lambda e: F.when(e["kind"].isin("regenerate", "delete"), "").otherwise(e["text"]))
    dropped = (F.element_at("_live", 1)["kind"] == "delete") & (F.size("_live") == 1)
    return rows.where(~dropped).select("conv_id", *turn, "role", F.array_join(parts, "").alias("text"))


def rendered(messages: DataFrame, turn: Sequence[str] = ("turn",)) -> DataFrame:
    """conv_id, segments (text, loss) and formatted text of each conversation."""
    under = F.col("role") == "assistant"
    piece = F.struct(F.struct(*turn).alias("turn"), escaped(F.coalesce("role", F.lit(""))).alias("role"),
                     escaped(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(under, F.lit(False)).alias("loss"))
    lists = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("_messages"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("_messages", lambda m: F.array(
        segment(F.concat(F.lit(TURN), m["role"], F.lit(TEXT)), F.lit(False)), segment(m["text"], m["loss"]), segment(F.lit(END), F.lit(False)))))
    out = lists.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def format_conversations(events: DataFrame, turn: Sequence[str] = ("turn",)) -> DataFrame:
    """conv_id, segments, formatted: each conversation of the log, folded and rendered."""
    return rendered(folded(events, turn), turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: what the rendered text and its segments say."""
    pieces = let(F.split("formatted", r"<\|turn\|>"), lambda p: F.slice(p, F.lit(2), F.size(p)))  # nothing comes before the first
    turn = lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
                              unescaped(F.substring_index(F.substring_index(p, END, 1), TEXT, -1)).alias("text"))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text): an assistant's text was streamed in pieces after a first
    piece that was thrown away, any other message was sent and then edited to what it is.  Rows that agree in conv_id and turn
    are messages one after the other: turn and number tell them apart."""
    number = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    turns = conversations.select("conv_id", "turn", number.alias("number"), "role", F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    event = lambda seq, kind, role, text: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    length = F.greatest(F.lit(PIECE), F.ceil(F.char_length("text") / PIECES)).cast("int")
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / length) - 1, F.lit(0)).cast("int"))
    streamed = F.transform(steps, lambda i: event(i + 4, "delta", none, F.substring(F.col("text"), i * length + 1, length)))
    assistant = F.concat(F.array(event(F.lit(1), "message", F.col("role"), F.lit("")), event(F.lit(2), "delta", none, F.substring("text", 1, 8)),
                                 event(F.lit(3), "regenerate", none, none)), streamed)
    other = F.array(event(F.lit(1), "message", F.col("role"), F.substring("text", 1, 8)), event(F.lit(2), "edit", none, F.col("text")))
    rows = turns.select("conv_id", "turn", "number", F.explode(F.when(F.col("role") == "assistant", assistant).otherwise(other)).alias("_e"))
    return rows.select("conv_id", "_e.seq", "turn", "number", "_e.kind", "_e.role", "_e.text")


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text), read back from the formatted text."""
    out = read_back(format_conversations(as_events(conversations), MESSAGE))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))
