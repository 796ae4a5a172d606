"""Chat formatting from an event log, in DataFrame functions except for the digests.

Events (conv_id, message, seq, kind, role, text) fold into final messages:

* ``message``     begins a message with its role and text
* ``delta``       appends text to the message
* ``edit``        replaces the message's text
* ``regenerate``  empties the message and drops the messages begun after it and before the event
* ``delete``      removes the message

The log is dealt by (conversation, message) and sorted by ``seq``, so a long conversation is spread over its messages. Then
each message is rendered by itself; a conversation is the concatenation of its segments in order.

Template of a segment::

    ### role:
    text
    </turn>

``\\`` and ``#`` in a text are led by a backslash and ``</turn>`` is written ``<\\/turn>``, so that no text holds a line that
opens or closes a turn; taking the backslash before any character away restores the text. In a role also ``:`` is escaped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, running_sum

SEGMENT = r"(?s)^### ((?:\\.|[^\\:])*):\n(.*)\n</turn>\n$"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rows_to_events(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One ``message`` event for each row of a table of turns. Rows of one turn stand in the order of role and text; rows
    that are equal in all are numbered, so that each stays a message."""
    base = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("seq"))
    same = base.groupBy("conv_id", "seq").agg(F.count(F.lit(1)).cast("int").alias("n"))
    each = same.select("conv_id", "seq", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    seq = F.struct("seq.turn", "seq.role", "seq.text", "copy")
    return each.select("conv_id", seq.alias("message"), seq.alias("seq"), F.lit("message").alias("kind"), F.col("seq.role").alias("role"), F.col("seq.text").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, at, role, text), ``at`` the seq of the event that began each. ``message`` names a message
    within its conversation; ``seq`` is any type that sorts and is unique in a conversation. Null texts are empty,
    a message without a beginning begins with its first event, null kinds are deltas. An event that is repeated with
    its ``seq`` counts as often as it stands there; extra columns are left out and an empty log gives no messages.

    What one message gathers is its own text, so a group is no larger than the row that it becomes.
    """
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    e = events.select("conv_id", "message", "seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    reset = F.when(F.col("kind") != "delta", F.col("seq"))
    heads = e.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"), F.max(reset).alias("last_reset"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
        F.max(F.when(F.col("kind") == "delete", F.col("seq"))).alias("deleted"), F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"))
    h = heads.select(*[F.col(c).alias(f"h_{c}") for c in heads.columns])
    live = e.join(h, e["conv_id"].eqNullSafe(h["h_conv_id"]) & e["message"].eqNullSafe(h["h_message"]))
    live = live.where(F.col("h_last_reset").isNull() | (F.col("seq") >= F.col("h_last_reset")))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.col("text").alias("t"))))
    texts = live.groupBy("conv_id", "message").agg(
        F.first("h_at").alias("at"), F.first("h_role").alias("role"), F.first("h_deleted").alias("deleted"), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))
    redone = heads.where("redone is not null").select(F.col("conv_id").alias("r_conv"), F.col("at").alias("r_from"), F.col("redone").alias("r_to"))
    kept = texts.where("deleted is null")
    dropped = kept["conv_id"].eqNullSafe(redone["r_conv"]) & (kept["at"] > redone["r_from"]) & (kept["at"] < redone["r_to"])
    return kept.join(redone, dropped, "left_anti").select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Segments (conv_id, at, segment, loss_from, loss_to): each message by the template, whatever conversation it is in. The
    loss mask is a span of code points of the segment, null where nothing is learned; it is taken while the segment is put together."""
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:"))
    head, body = F.concat(F.lit("### "), role, F.lit(":\n")), escape(F.col("text"))
    learn = F.col("role").isin(*loss_roles)
    return messages.select("conv_id", "at", F.concat(head, body, F.lit("\n</turn>\n")).alias("segment"),
                           F.when(learn, F.length(head)).alias("loss_from"), F.when(learn, F.length(head) + F.length(body)).alias("loss_to"))


def with_spans(segments: DataFrame) -> DataFrame:
    """Segments with start and end in the formatted conversation and the loss mask there (loss_start, loss_end; null
    where nothing is learned). Starts are running sums over ranges, so no conversation has to fit a task."""
    sized = segments.withColumn("size", F.length("segment").cast("long"))
    placed = running_sum(sized, ["conv_id"], ["at"], "size", "start")
    return placed.select("conv_id", "at", "segment", "start", (F.col("start") + F.col("size")).alias("end"),
                         (F.col("start") + F.col("loss_from")).alias("loss_start"), (F.col("start") + F.col("loss_to")).alias("loss_end"))


def masked(segment: Column, loss_from: Column, loss_to: Column) -> Column:
    """The text under a segment's loss mask, unescaped; null without a mask."""
    return unescape(F.substr(segment, loss_from + 1, loss_to - loss_from))


def parsed(segment: Column) -> tuple[Column, Column]:
    """(role, text) read back from a segment."""
    return unescape(F.regexp_extract(segment, SEGMENT, 1)), unescape(F.regexp_extract(segment, SEGMENT, 2))


def formatted_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the segments: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed by the template; what is learned is cut out by the written mask alone. A SHA-256 takes its bytes in order, so a conversation's segments pass through one task; it holds one
    digest state and one batch of segments, whatever the conversation's length.
    """
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at")
    role, text = parsed(F.col("segment"))
    loss = masked(F.col("segment"), F.col("loss_from"), F.col("loss_to"))
    rows = dealt.select("conv_id", role.alias("role"), text.alias("text"), loss.alias("loss"), F.length("segment").cast("long").alias("size"), F.length(loss).cast("long").alias("chars"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for b in batches:
            for conv, role, text, loss, size, chars in zip(*[b[c].tolist() for c in ("conv_id", "role", "text", "loss", "size", "chars")]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != current:
                    close()
                    current, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[5] += int(size)
                if loss:
                    state[3] += int(chars)
                    state[4].update(loss.encode("utf-8", "surrogatepass"))
            if len(done) >= 10_000:
                yield frame(done)
                done.clear()
        close()
        if done:
            yield frame(done)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return f.assign(conv_id=pd.array([r[0] for r in rows], "Int64"))

    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Formatted segments of a table of turns with their loss masks, written to the shared folder and read back.

    Null texts and roles are empty; null turns come first; null conversations are one conversation; repeated rows are turns
    of their own; an empty table gives no segments; extra columns are left out.
    """
    return cut(render(fold_events(rows_to_events(rows))))
