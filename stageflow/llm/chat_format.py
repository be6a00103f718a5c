"""Conversations rebuilt from event logs and rendered as training text.

Events carry (conversation, sequence, message, kind, role, text). Kinds: ``message`` sets the text, ``delta`` appends to it, ``edit`` replaces
it, ``regenerate`` starts the message again and drops every message begun after it and before the regeneration. ``log_of_turns`` writes plain turns as
such a log: streamed, edited or regenerated, with the text unchanged in the end. A null message means
that the event is a whole message of its own. Unknown kinds and null sequences raise no error: such events are ordered first and act as
``message``.

Folding takes two steps, so that a conversation with a third of all events is not gathered: messages are folded by (conversation, message),
which is a bounded group; then the rows, one a message, are sorted by conversation and order inside partitions and streamed, with a state of
two numbers. Rendered text leaves as one row a turn with its offset in the whole, so no row holds a whole conversation.

A turn is rendered as ``<turn role="ROLE">``, line feed, text, ``</turn>``, line feed. In texts and roles a backslash goes before each
backslash and each ``<``, in roles also before ``"``, so no text can close or open a turn and reading back gives the text exactly. The loss mask
covers the escaped text of assistant turns.

Null text: empty; null role: empty; ties in the sequence: by role, then text; repeated rows without message: each is a turn; an empty log
gives no rows; other columns are not read. A null conversation is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm.common import table

ROLE_TRAINED = "assistant"
EVENTS_PER_TURN = 8
PIECES = "conv_id long, turn long, offset long, piece string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TURN = re.compile(r'<turn role="((?:[^"\\]|\\.)*)">\n((?:[^<\\]|\\.)*)</turn>\n', re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def events_of_turns(df: DataFrame) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as a log of whole messages."""
    return df.select("conv_id", F.col("turn").cast("long").alias("seq"), F.lit(None).cast("string").alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def log_of_turns(df: DataFrame, trained: str = ROLE_TRAINED) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as a log that folds to them: a trained turn breaks off, is regenerated and streamed in two deltas;
    another one is streamed in two parts and then edited to its whole text. A turn has ``EVENTS_PER_TURN`` places in the sequence, so turns are below 2**60;
    one without a number is a whole message."""
    half = (F.length("text") / 2).cast("int")
    left, right = F.left("text", half), F.substr(F.col("text"), half + 1)
    event = lambda place, kind, text: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "message", right), event(1, "delta", left), event(2, "regenerate", F.lit("")), event(3, "delta", left), event(4, "delta", right))
    edited = F.array(event(0, "message", left), event(1, "delta", right), event(2, "edit", F.col("text")))
    whole = F.array(event(0, "message", F.col("text")))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    events = F.when(F.col("turn").isNull(), whole).when(F.col("role").eqNullSafe(F.lit(trained)), streamed).otherwise(edited)
    message = F.when(F.col("turn").isNotNull(), F.col("row").cast("string"))
    return rows.select("conv_id", "turn", message.alias("message_id"), "role", F.explode(events).alias("e")).select(
        "conv_id", (F.col("turn") * EVENTS_PER_TURN + F.col("e.place")).alias("seq"), "message_id", "e.kind", "role", "e.text")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, first_seq, role, text, regenerated): one row a message, before dropping what regenerations replaced."""
    e = events.select("conv_id", "seq", "message_id", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    never = F.lit(None).cast("long")
    whole = e.where("message_id IS NULL").select("conv_id", F.col("seq").alias("first_seq"), "role", "text", never.alias("regenerated"))
    parts = e.where("message_id IS NOT NULL").withColumn("order", F.struct("seq", "kind", "role", "text"))
    starts = ~F.col("kind").eqNullSafe("delta")
    folded = (
        parts.groupBy("conv_id", "message_id").agg(
            F.min("seq").alias("first_seq"), F.min_by("role", "order").alias("role"), F.max(F.when(starts, F.col("order"))).alias("start"),
            F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"), F.sort_array(F.collect_list("order")).alias("all"),
        )
    )
    kept = F.filter("all", lambda x: F.col("start").isNull() | (x >= F.col("start")))
    # equal copies of the starting event set the text once
    text = F.array_join(F.transform(F.filter(kept, lambda x: x["kind"].eqNullSafe("delta")), lambda x: x["text"]), "")
    return whole.unionByName(folded.select("conv_id", "first_seq", "role", F.concat(F.coalesce(F.col("start.text"), F.lit("")), text).alias("text"), "regenerated"))


def _escape(c: Column, quote: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))
    return F.replace(c, F.lit('"'), F.lit('\\"')) if quote else c


def _renderer(trained: str):
    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by conversation and order; state: the latest regeneration of messages begun before and at the current place, the turn
        number and the offset."""
        conv, place, latest, here, turn, offset = object(), None, None, None, 0, 0
        for frame in frames:
            out = []
            for c, seq, again, role, head, body in zip(frame.conv_id, frame.first_seq, frame.regenerated, frame.role, frame["head"], frame.body, strict=True):
                c, seq = (None if pd.isna(x) else int(x) for x in (c, seq))
                if c != conv:
                    conv, place, latest, here, turn, offset = c, None, None, None, 0, 0
                if seq != place:
                    place, latest, here = seq, here if latest is None or (here is not None and here > latest) else latest, None
                if latest is None or seq is not None and seq >= latest:
                    piece = f"{head}{body}</turn>\n"
                    at = offset + len(head)
                    loss = (at, at + len(body)) if role == trained else (None, None)
                    out.append((c, turn, offset, piece, *loss))
                    turn, offset = turn + 1, offset + len(piece)
                    if not pd.isna(again):
                        here = int(again) if here is None else max(here, int(again))
            made = pd.DataFrame(out, columns=["conv_id", "turn", "offset", "piece", "loss_start", "loss_end"])
            yield made.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    return render


def format_conversations(events: DataFrame, trained: str = ROLE_TRAINED) -> DataFrame:
    """One row a turn: (conv_id, turn, offset, piece, loss_start, loss_end). The pieces of a conversation in order of ``turn`` are its text;
    offsets count code points from its start; the loss span is null for turns that aren't trained on."""
    head = F.concat(F.lit('<turn role="'), _escape(F.col("role"), quote=True), F.lit('">\n'))
    rows = messages(events).select("conv_id", "first_seq", "regenerated", "role", head.alias("head"), _escape(F.col("text")).alias("body"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "role", "body")
    return rows.mapInPandas(_renderer(trained), PIECES)


def joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole texts, for conversations that fit a row."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["piece"]), "").alias("formatted"))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered text; an error if it isn't one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return out


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state = object(), None

    def done() -> tuple:
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    for frame in frames:
        out = []
        for c, piece, start, end, offset in zip(frame.conv_id, frame.piece, frame.loss_start, frame.loss_end, frame.offset, strict=True):
            c = None if pd.isna(c) else int(c)
            if c != conv:
                if state is not None:
                    out.append(done())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if not pd.isna(start):
                masked = _ESCAPED.sub(r"\1", piece[int(start) - int(offset) : int(end) - int(offset)])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(piece)
        yield _frame(out)
    if state is not None:
        yield _frame([done()])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})


def digests(pieces: DataFrame) -> DataFrame:
    """What reading the rendered text back gives, by conversation; one pass in order with a state of two running digests."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInPandas(_digest, DIGESTS)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(log_of_turns(turns)))
