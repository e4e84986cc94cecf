"""Operator 4: chat logs to training strings, with DataFrame functions only.

A log has one row per event.  Events of a message (its first text, streamed
deltas, edits, regenerations, a deletion) are folded in the order of their
sequence numbers; the messages of a conversation are put in order and
rendered.  A log is dealt by conversation once: numbering, folding and
rendering all work on that one shuffle.  A conversation ends as one string, so
its messages do meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashtable import once

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Reversible: a backslash after every ``<`` that ``|`` or a backslash follows, so no ``<|`` is left."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("<\\\\"), F.lit("<\\"))


def escape_role(role: Column) -> Column:
    """Reversible, without line feeds and ``<``."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log.

    ``log`` has conv_id, msg (the message meant), seq, role, op, text.  op is
    "message" (a first text), "delta" (text to append), "edit" (text that
    replaces what is there), "regenerate" (begin anew with this text) or
    "delete"; null and unknown ops count as "message".  Events apply by seq,
    those of equal seq by op and text.  turn is the first seq of a message.
    A null text is empty; a deleted message is left out unless a later event
    gives it text again.  The role is that of the last event that names one.
    """
    events = log.select("conv_id", "msg", "seq", F.coalesce("op", F.lit("message")).alias("op"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "role")
    whole = events.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "text", "role"))).alias("events"))
    # a text is what its last event other than a delta left, and the deltas since
    last = F.coalesce(F.array_max(F.transform("events", lambda e, i: F.when(e["op"] != "delta", i))), F.lit(0))
    since = once(whole, "since", F.slice("events", last + 1, F.size("events")))
    said = F.array_join(F.transform("since", lambda e: F.when(e["op"] == "delete", "").otherwise(e["text"])), "")
    gone = (F.get("since", F.lit(0))["op"] == "delete") & (F.size("since") == 1)
    role = F.element_at(F.filter("events", lambda e: e["role"].isNotNull()), -1)["role"]
    role = F.when(F.exists("events", lambda e: e["role"].isNotNull()), role)
    return since.where(~gone).select("conv_id", F.get("events", F.lit(0))["seq"].alias("turn"), role.alias("role"), said.alias("text"))


def streamed(messages: DataFrame, step: int = 1000) -> DataFrame:
    """A log (see ``fold_events``) of whole messages (conv_id, turn, role, text), as a chat service would have written it.

    An assistant's message begins empty, is regenerated with its first
    ``step`` characters and gets the others as deltas; any other message
    begins empty and is edited.  Messages are numbered by turn, those of equal
    turn by role and text, and repeated rows stay repeated messages.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    numbered = rows.withColumn("msg", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    assistant = F.col("role") == "assistant"
    parts = F.when(assistant, F.ceil(F.char_length("text") / step).cast("int")).otherwise(1)
    later = F.transform(
        F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1),
        lambda i: F.struct(
            (i + 1).cast("long").alias("n"),
            F.when(~assistant, "edit").when(i == 0, "regenerate").otherwise("delta").alias("op"),
            F.when(assistant, F.substring("text", i * step + 1, F.lit(step))).otherwise(F.col("text")).alias("text"),
        ),
    )
    begin = F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit("message").alias("op"), F.lit("").alias("text")))
    events = numbered.select("conv_id", "msg", "role", F.explode(F.concat(begin, later)).alias("e"))
    # sequence numbers leave room for every event of the messages before
    return events.select("conv_id", "msg", F.struct("msg", "e.n").alias("seq"), F.when(F.col("e.n") == 0, F.col("role")).alias("role"), "e.op", "e.text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation.

    Messages (conv_id, turn, role, text) are ordered by turn, those of equal
    turn by role and text; repeated rows are repeated messages.  loss_spans
    (start, length in UTF-8 bytes of ``formatted``) cover exactly the escaped
    texts of the assistant.  Null roles and texts are empty, all rows with a
    null conv_id are one conversation, an empty table gives none.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    tail = CLOSE + "\n"
    parts = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = (F.octet_length("head") + F.octet_length("body") + len(tail)).cast("long")
    before = F.coalesce(F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((F.col("at") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length"))
    placed = parts.withColumn("at", before).select("conv_id", "at", F.concat("head", "body", F.lit(tail)).alias("piece"), F.when(F.col("role") == "assistant", span).alias("span"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.array_sort(F.collect_list("span")).alias("loss_spans"))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def parse(rendered: DataFrame) -> DataFrame:
    """``rendered`` read back: conv_id, turns (role, text), loss_text (all text under the mask), formatted."""
    rendered = once(rendered, "pieces", F.split("formatted", r"<\|im_start\|>", -1))
    pieces = F.slice("pieces", F.lit(2), F.size("pieces"))

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        body = F.substring(p, cut + 1, F.char_length(p) - cut - len(CLOSE) - 1)
        return F.struct(unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    raw = F.col("formatted").cast("binary")
    masked = F.transform("loss_spans", lambda s: F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))
    out = once(rendered, "turns", F.transform(pieces, turn))
    return out.select("conv_id", "turns", F.array_join(F.transform(masked, unescape), "").alias("loss_text"), "formatted")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 1
  + length(replace(replace(text, '<\', '<\\'), '<|', '<\|')) + length('<|im_end|>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
