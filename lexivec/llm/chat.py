"""Chat formatting: conversations rebuilt from event logs, and rendered with a loss mask, in SQL functions only.

A log row is one event of a conversation; `seq` orders the events of a conversation.

| kind | effect on message `turn` |
| --- | --- |
| message | sets its role and text; anything it held before is gone |
| delta | appends the text; the first delta of a message sets its role |
| edit | replaces the text so far |
| regenerate | empties the message and drops all messages of later turns that were logged before it |

Events are grouped by message with partial aggregation only on what survives; a conversation is gathered
as one row only where it is rendered, as its result is one text.

The template, with fixed control strings: each message is `<s>[ROLE]role[/ROLE]text</s>`. In roles and
texts a backslash becomes two, `<` becomes `\\l` and `[` becomes `\\b`, so that no control string can occur
in them; `unescaped` undoes it.

Defined cases: null roles and texts are empty strings; an unknown or null kind has no effect; events of
equal `seq` are ordered by turn, kind, role and text; a dropped message that is written to again has its old role; a null conversation id is one conversation. A message
whose events were all dropped is absent; a conversation without messages has no row. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.shared import same

OPEN, ROLE_START, ROLE_END, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
LEARNED = "assistant"
RESETS = ("message", "edit", "regenerate")


def escaped(text: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    """Undoes `escaped`: pairs of backslashes are found from the left first."""

    def part(piece: Column) -> Column:
        return F.replace(F.replace(piece, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def messages(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of a log (conv_id, seq, turn, kind, role, text)."""
    events = log.select(
        "conv_id",
        "turn",
        F.struct("seq", F.col("turn").alias("t"), "kind", "role", "text").alias("e"),
    ).filter(F.col("e.kind").isin(*RESETS, "delta"))
    # The latest regeneration of an earlier turn drops what was logged before it.
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow - 1)
    turns = events.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("e.kind") == "regenerate", F.col("e"))).alias("redone"),
        F.max(F.when(F.col("e.kind").isin(*RESETS), F.col("e"))).alias("reset"),
        F.array_sort(F.collect_list("e")).alias("events"),
    )
    placed = turns.withColumn("cut", F.max("redone").over(before))
    start = F.greatest("cut", "reset")
    live = F.filter("events", lambda e: F.coalesce(e >= F.col("start"), F.lit(True)))
    kept = placed.withColumn("start", start).withColumn("live", live).filter(F.size("live") > 0)
    text = F.array_join(F.transform("live", lambda e: F.when(e["kind"] == "regenerate", "").otherwise(F.coalesce(e["text"], F.lit("")))), "")
    # An edit or a regeneration keeps the role that the message had.
    named = F.filter("events", lambda e: e["role"].isNotNull() & e["kind"].isin("message", "delta"))
    return kept.select(
        "conv_id", "turn", F.coalesce(F.get(F.reverse(named), F.lit(0))["role"], F.lit("")).alias("role"), text.alias("text")
    )


def _before(order: str) -> object:
    return Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def rendered(chat: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted, loss_spans (message number, start, end in code points) of messages (conv_id, turn, role, text)."""
    parts = chat.select(
        "conv_id",
        "turn",
        F.concat(F.lit(OPEN + ROLE_START), escaped(F.col("role")), F.lit(ROLE_END)).alias("head"),
        escaped(F.col("text")).alias("body"),
        (F.col("role") == learned).alias("learned"),
    )
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    at = F.coalesce(F.sum(size.cast("long")).over(_before("turn")), F.lit(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    start = at + F.char_length("head")
    span = F.struct(number.alias("message"), start.alias("start"), (start + F.char_length("body")).alias("end"))
    whole = F.concat("head", "body", F.lit(CLOSE)).alias("whole")
    gathered = (
        parts.select("conv_id", F.struct(span.alias("span"), whole, "learned").alias("m"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("m")).alias("ms"))
    )
    spans = F.filter("ms", lambda m: m["learned"])
    return gathered.select("conv_id", F.array_join(F.col("ms")["whole"], "").alias("formatted"), spans["span"].alias("loss_spans"))


def format_chats(log: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Event log to conv_id, formatted, loss_spans."""
    return rendered(messages(log), learned)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, message, role, text, learned (text under the mask, null outside it): read from the formatted texts alone."""
    chunks = formatted.select("conv_id", F.posexplode(F.split("formatted", CLOSE)).alias("message", "chunk")).filter("chunk <> ''")
    at = F.coalesce(F.sum((F.char_length("chunk") + len(CLOSE)).cast("long")).over(_before("message")), F.lit(0))
    spans = formatted.select(F.col("conv_id").alias("id"), F.inline("loss_spans"))
    spans = spans.withColumnRenamed("message", "number")
    placed = chunks.withColumn("at", at).join(
        spans, same(F.col("conv_id"), F.col("id")) & (F.col("message") == F.col("number")), "left"
    )
    masked = F.substring("chunk", (F.col("start") - F.col("at") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    split = F.split(F.substring("chunk", F.lit(len(OPEN + ROLE_START) + 1), F.char_length("chunk")), r"\[/ROLE\]")
    return placed.select(
        "conv_id",
        "message",
        unescaped(split[0]).alias("role"),
        unescaped(split[1]).alias("text"),
        unescaped(masked).alias("learned"),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: an empty message and one delta for each row.

    Rows that repeat a turn are messages of their own, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order).cast("long"))
    event = lambda kind, step, text: F.struct(
        (2 * F.col("n") + step).alias("seq"), F.col("n").alias("turn"), F.lit(kind).alias("kind"), "role", text.alias("text")
    )
    both = F.array(event("message", 0, F.lit("")), event("delta", 1, F.coalesce("text", F.lit(""))))
    return numbered.select("conv_id", F.explode(both).alias("e")).select("conv_id", "e.*")
