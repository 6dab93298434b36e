"""Chat formatting by event-sourced reconstruction.

A log holds one row for each event of a conversation: `message` opens a message with a role and a
text, `delta` appends to the open message, `edit` replaces its text, `regenerate` empties it for the
deltas that follow. The log is partitioned by conversation and sorted by sequence; a running count
numbers the messages, each message keeps what follows its last edit or regeneration, and the messages
are rendered in order. Everything is DataFrame functions, behind one shuffle by conversation.

Template: `<turn>role<text>text</turn>` for turns outside the loss mask and `<turn>role<loss>text</turn>`
for assistant turns. In roles and texts `\\` is written `\\b` and `<` is written `\\l`, so no control
string can stand inside a text, and both come back exactly.

One conversation is one text, so its turns meet in one task, and a very long text is carried whole.

Defined results: null roles and texts are empty; events before a conversation's first message open one
with an empty role; ties in the sequence go by event kind, role and text; repeated rows are repeated
events; a null conversation id is a conversation; an empty log gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, TEXT, LOSS, END = "<turn>", "<text>", "<loss>", "</turn>"
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def events_of_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Finished turns as the log that streams them: assistants in two deltas after a discarded attempt, users as a draft and its edit, others whole."""
    said, half = F.coalesce(F.col(text), F.lit("")), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 2).cast("int")

    def event(step: int, kind: str, value: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), value.alias("said"))

    whole = F.array(event(0, "message", said))
    edited = F.array(event(0, "message", F.substring(said, 1, 4)), event(1, "edit", said))
    streamed = F.array(
        event(0, "message", F.substring(said, 1, 8)),
        event(1, "regenerate", F.lit("")),
        event(2, "delta", F.substring(said, F.lit(1), half)),
        event(3, "delta", F.substring(said, half + 1, F.length(said))),
    )
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), said.alias("whole"), F.monotonically_increasing_id().alias("serial"), F.explode(F.when(F.col(role) == "assistant", streamed).when(F.col(role) == "user", edited).otherwise(whole)).alias("e"))
    # tied turns must not interleave: text and serial number stand before the step. Only equal rows are told apart by
    # the number alone, so whichever comes first the messages are the same
    return rows.select("conv_id", F.struct("turn", "role", F.when(F.col("role") == "assistant", F.md5("whole")).otherwise(F.col("whole")).alias("tie"), "serial", F.col("e.step").alias("step")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.said").alias("text"))


def messages(log: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, message, role, text): the log folded into final messages."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)), F.lit(0))
    rows = log.select(F.col(conv).alias("conv_id"), F.col(seq).alias("seq"), rank.alias("rank"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("seq", "rank", "role", "text")
    opens = (F.col("rank") == 1).cast("long")
    rows = rows.select("*", F.row_number().over(order).alias("at"), F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("message"))
    # what a message keeps: the parts from its last edit or regeneration on
    parts = F.sort_array(F.collect_list(F.struct("at", "rank", "text")))
    resets = F.max(F.when(F.col("rank").isin(1, 2, 3), F.col("at")))
    folded = rows.groupBy("conv_id", "message").agg(parts.alias("parts"), resets.alias("since"), F.max(F.when(F.col("rank") == 1, F.col("role"))).alias("role"))
    kept = F.filter("parts", lambda p: p["at"] >= F.coalesce(F.col("since"), F.lit(0)))
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"))


def render(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted): the messages of each conversation, in order, in the template."""
    marked = F.concat(F.lit(TURN), escape(F.col("role")), F.when(F.col("role") == "assistant", F.lit(LOSS)).otherwise(F.lit(TEXT)), escape(F.col("text")), F.lit(END))
    turns = F.sort_array(F.collect_list(F.struct("message", marked.alias("marked"))))
    return folded.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["marked"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text, loss>> of a formatted conversation."""

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, END, 1)
        loss = F.contains(body, F.lit(LOSS))
        role = F.when(loss, F.substring_index(body, LOSS, 1)).otherwise(F.substring_index(body, TEXT, 1))
        said = F.substring(body, F.length(role) + len(TEXT) + 1, F.length(body))  # the two marks are of one length
        return F.struct(unescape(role).alias("role"), unescape(said).alias("text"), loss.alias("loss"))

    return F.transform(F.filter(F.split(formatted, TURN), lambda x: x != ""), turn)


def digests(rendered: DataFrame) -> DataFrame:
    """What the contract asks of each formatted conversation, all read back from it."""
    rows = rendered.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), every.alias("every"), loss.alias("loss"))
    return rows.select("conv_id", "n_turns", F.sha2("every", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, CASE WHEN role = 'assistant' THEN md5(text) ELSE text END) AS pos,
         length(replace(replace(role, '\', '\b'), '<', '\l')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + 19 AS size
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
