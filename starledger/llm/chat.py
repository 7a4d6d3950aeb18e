"""Chat formatting by event-sourced reconstruction (operator 1).

A conversation is a log of events ``(conv_id, msg, seq, kind, role, text)``:

* ``open``        starts message ``msg`` (its role; text may already hold a part),
* ``delta``       appends streamed text,
* ``edit``        replaces what the message says by ``text``,
* ``regenerate``  discards what was streamed so far; new deltas follow.

``fold_events`` partitions the log by conversation and message, orders it by
``seq`` and folds it into final messages.  ``render`` turns each message into
a piece of formatted text; the pieces of a conversation, in ``msg`` order,
are its formatted text.  ``read_back`` parses pieces again.

Defined results: null text or role counts as ``''``; null ``conv_id`` is a
conversation of its own; events of equal ``seq`` apply in (kind, text) order;
a message without an ``open`` event takes the first non-empty role of its
log; an empty log gives an empty frame; other input columns are ignored.
A conversation of any size is folded message by message over many tasks and
then streamed in order, so memory is bounded by one message.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id bigint, msg struct<turn:bigint,copy:int>, seq bigint, kind string, role string, text string"

# Fixed strings of the template and of templates that texts may imitate.
OPEN, MID, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")


def events_of_turns(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """The event log that streaming the rows ``(conv_id, turn, role, text)``
    would have left.

    A user message is opened with its first half and then edited to the full
    text; any other message streams a draft, is regenerated, and then streams
    its text in chunks of ``chunk`` code points.  Rows that repeat a
    (conv_id, turn) stay separate messages, ordered by role and text.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    t = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = t.select("conv_id", "role", "text", F.struct("turn", F.row_number().over(w).alias("copy")).alias("msg"))
    n = F.length("text")
    ev = lambda seq, kind, role, text: F.struct(
        F.lit(seq).cast("bigint").alias("seq") if isinstance(seq, int) else seq.cast("bigint").alias("seq"),
        F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    none = F.lit(None)
    user = F.array(ev(0, "open", F.col("role"), F.substring("text", F.lit(1), F.floor(n / 2).cast("int"))),
                   ev(1, "edit", none, F.col("text")))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / chunk).cast("int") - 1, F.lit(0))),
        lambda i: ev(i + 3, "delta", none, F.substring(F.col("text"), i * chunk + 1, F.lit(chunk))))
    streamed = F.concat(
        F.array(ev(0, "open", F.col("role"), none),
                ev(1, "delta", none, F.substring("text", 1, 40)),
                ev(2, "regenerate", none, none)), parts)
    return (t.select("conv_id", "msg", F.explode(F.when(F.col("role") == "user", user).otherwise(streamed)).alias("e"))
            .select("conv_id", "msg", "e.*"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, msg, role, text)``, one row per message.

    The last ``edit`` or ``regenerate`` of a message cuts its history: only
    its own text and the deltas after it remain.  A message's events meet in
    one group, a conversation's need not.
    """
    e = events.select("conv_id", "msg", F.struct(
        F.col("seq"), F.col("kind"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("role"), F.lit("")).alias("role")).alias("e"))
    g = e.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("e")).alias("es"))
    cut = F.coalesce(F.array_max(F.transform(F.filter("es", lambda x: x.kind.isin("edit", "regenerate")),
                                             lambda x: x.seq)), F.get("es", F.lit(0)).seq)
    kept = F.filter("es", lambda x: x.seq >= F.col("cut"))
    roles = F.filter("es", lambda x: x.role != "")
    return (g.withColumn("cut", cut)
            .select("conv_id", "msg", F.coalesce(F.get(roles, F.lit(0)).role, F.lit("")).alias("role"),
                    F.array_join(F.transform(kept, lambda x: x.text), "").alias("text")))


def escape(col):
    """Reversible: a backslash doubles, then each control string gets one
    after its first character; ``unescape`` drops the first of each pair."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escape_role(col):
    return F.replace(escape(col), F.lit("\n"), F.lit("\\\n"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted pieces ``(conv_id, msg, piece, loss_start, loss_end)``: the
    loss mask covers code points ``[loss_start, loss_end)`` of the piece, the
    text of the roles in ``loss_roles``; an empty span elsewhere."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MID))
    body = escape(F.col("text"))
    masked = F.col("role").isin(*loss_roles)
    return (messages.withColumn("head", head).withColumn("body", body)
            .select("conv_id", "msg", F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
                    F.length("head").cast("bigint").alias("loss_start"),
                    (F.length("head") + F.when(masked, F.length("body")).otherwise(0)).cast("bigint").alias("loss_end")))


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL) if "\\" in s else s


PIECE = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]+|\\.|<(?!\|))*)<\|im_end\|>\n", re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text; an error if any part of
    it is not a turn of the template."""
    turns, at = [], 0
    while at < len(text):
        m = PIECE.match(text, at)
        if not m:
            raise ValueError(f"not formatted text at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


READ = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint")


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: str, start: int, end: int) -> None:
        for role, text in parse(piece):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        said = unescape(piece[start:end])
        self.loss.update(said.encode())
        self.loss_chars += len(said)
        self.chars += len(piece)

    def row(self):
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _stream(batches):
    now = None
    for b in batches:
        out = []
        for null, conv, piece, s, e in zip(b["conv_id"].isna(), b["conv_id"], b["piece"], b["loss_start"], b["loss_end"]):
            conv = None if null else int(conv)
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Digest(conv)
            now.add(piece, int(s), int(e))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")]).astype({"conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([now.row()], columns=[c.split()[0] for c in READ.split(", ")]).astype({"conv_id": "Int64"})


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse the formatted pieces of each conversation in order and digest
    turns and loss text.  Conversations are streamed, one message in memory."""
    p = pieces.select("conv_id", "msg", "piece", "loss_start", "loss_end")
    return (p.repartition("conv_id").sortWithinPartitions("conv_id", "msg")
            .drop("msg").mapInPandas(_stream, READ))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows by turn -> event log -> final messages -> formatted pieces."""
    return render(fold_events(events_of_turns(turns)))
