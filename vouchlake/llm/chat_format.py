"""Chat formatting into budgeted windows.

A conversation's turns, in order, are cut into spans by prefix sums of their token counts: a span takes turns
as long as the sum of its own turns, the conversation's system turn and the repeated history stays within the
budget. Counts are the ids of the turns as they are written, marks and escapes included, and add up to the
window's. Each window but the first repeats the system turn and the last turns before it, up to `history` tokens.
Repeated turns carry no loss: only a window's own assistant turns are under its loss mask, so each is a target
exactly once.

A turn is never cut. One that does not fit beside the history is written without it; beside the system turn,
without that too; alone, in a window of its own over the budget. A system turn of more than half the budget is
written once, as a turn, and not repeated.

A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside texts get a tilde after
their first character, and tildes already there get one more, so that escaping can be undone.

Turns are ranked within their conversation: they are sorted by range, so that a long conversation lies in many
tasks, counted in each, and the few conversations that go over a task's end take offsets. Ranks are cut into
segments of `SEGMENT` turns, each a run of windows of its own, so that no task sees a whole long conversation
and the windows do not depend on the tasks; the turns before a segment and the system turn are sent to it
as context. Tasks stream over sorted rows and hold one window at a time.

Defined results: a null text or role is an empty one; null turns come first; turn numbers may have gaps of any
size; equal turn numbers are ordered by role, the text's first `HEAD`
characters and its digest, and repeated rows are turns each; a null conversation id is
one conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import Encoder

SEGMENT = 128
CONTEXT = 4  # turns before a segment that it may repeat
HEAD = 256  # characters of a text by which equal turn numbers are ordered
TOKEN_BYTES = 128  # no token of the vocabulary is longer
#: A control string's first character, tildes, and its rest.
CONTROL = re.compile(r"([<\[])(~*)(?=/?s>|/?INST\]|/?SYS>>|/SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)")
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
SCHEMA = "conv_id string, segment long, window int, text string, loss array<struct<start:long,end:long>>, n_context int, n_new int, n_tokens int"


def escaped(text: str) -> str:
    return CONTROL.sub(r"\1\2~", text) if "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:], text) if "~" in text else text


def header(role: str) -> str:
    return escaped(role).replace("\\", "\\\\").replace("\n", "\\n")


def role_of(head: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head, flags=re.DOTALL))


def formatted(turns: list[tuple[str, str]], n_context: int) -> tuple[str, list[dict]]:
    """The window's text and the code-point spans of its targets."""
    out, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"<|im_start|>{header(role)}\n", escaped(text)
        if role == "assistant" and i >= n_context:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, "<|im_end|>\n"]
        at += len(head) + len(body) + 11
    return "".join(out), loss


def parsed(text: str) -> list[tuple[str, str]]:
    return [(role_of(m[1]), unescaped(m[2])) for m in TURN.finditer(text)]


def _ranked(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and rank (from 0) of every turn in its conversation's order."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), c("role").alias("role"), c("text").alias("text"))
    # Keys are short, as samples of them go to the driver; equal rows are told apart, so that a range can end among them.
    turns = turns.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.md5("text"), "tie": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "role", "head", "digest", "tie"]
    parts = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, n = None, 0
        for x in batches:
            at = []
            for own in x["conv_id"]:
                conv, n = own, n + 1 if own == conv else 0
                at.append(n)
            yield x.assign(at=at)

    dealt = turns.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(F.coalesce("conv_id", F.lit("")).alias("conv_id"), "role", "text", F.spark_partition_id().alias("part"))
    rows = written(dealt.mapInPandas(counted, "conv_id string, role string, text string, part int, at long"), "chat_turns")
    # Only a conversation that goes over the end of a task needs offsets: two rows a task at most, which may be broadcast.
    n = rows.groupBy("conv_id", "part").agg(F.max("at").alias("last"))
    before = F.sum(F.col("last") + 1).over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = n.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")
    return rows.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", "role", "text", (F.coalesce("before", F.lit(0)) + F.col("at")).alias("rank"))


def _prepared(conversations: DataFrame, budget: int) -> DataFrame:
    """Rows of every segment: its system turn (kind 0), the turns before it (1) and its own (2)."""
    turns = _ranked(conversations).withColumn("segment", F.floor(F.col("rank") / SEGMENT))
    own = turns.withColumn("kind", F.lit(2))
    before = turns.where(F.col("rank") % SEGMENT >= SEGMENT - CONTEXT).withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(1))
    long = turns.where(F.col("rank") % SEGMENT == 0).groupBy("conv_id").agg(F.max("segment").alias("high")).where("high > 0")
    first = turns.where((F.col("rank") == 0) & (F.col("role") == "system") & (F.octet_length("text") <= budget * TOKEN_BYTES)).select("conv_id", "role", "text", "rank")
    system = first.join(long, "conv_id").select("conv_id", "role", "text", "rank", F.explode(F.sequence(F.lit(1).cast("long"), F.col("high"))).alias("segment"), F.lit(0).alias("kind"))
    return own.unionByName(before).unionByName(system)


def windows(conversations: DataFrame, budget: int = 1024, history: int = 128, vocabulary: str | None = None) -> DataFrame:
    """The windows of every conversation, with loss spans, the number of repeated turns at their start and their tokens."""
    columns = ["conv_id", "segment", "window", "text", "loss", "n_context", "n_new", "n_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        key, system, past, new, number, room, out = None, None, [], [], 0, 0, []
        total = lambda turns: sum(t[2] for t in turns)

        def close() -> None:
            """Writes the window that is open; its last turns become history."""
            nonlocal number, past, new, opened
            if new:
                text, loss = formatted([(r, t) for r, t, _ in opened + new], len(opened))
                out.append((*key, number, text, loss, len(opened), len(new), total(opened + new)))
                number += 1
            turns, past = past + new, []
            for turn in reversed(turns):  # history: the last turns whose sum stays within its share
                if turn is system or total(past) + turn[2] > history or len(past) == CONTEXT:
                    break
                past.insert(0, turn)
            new, opened = [], []

        opened: list = []  # the repeated turns of the window that is open
        for x in batches:
            for conv, segment, kind, rank, role, text in zip(x["conv_id"], x["segment"], x["kind"], x["rank"], x["role"], x["text"], strict=True):
                if (conv, segment) != key:
                    if key:
                        close()
                    key, system, past, new, opened, number = (conv, segment), None, [], [], [], 0
                turn = (role, text, len(encoder.ids(formatted([(role, text)], 0)[0])))
                if kind == 0:
                    system = turn if 2 * turn[2] <= budget else None
                    continue
                if kind == 1:
                    past = [*past, turn]
                    continue
                if new and turn[2] > room:
                    close()
                if not new:
                    while past and total(past) > history:
                        past.pop(0)
                    opened = ([system] if system else []) + past
                    if total(opened) + turn[2] > budget:  # without history, then without the system turn
                        opened = [system] if system and system[2] + turn[2] <= budget else []
                    room = budget - total(opened)
                new.append(turn)
                room -= turn[2]
                if rank == 0 and role == "system" and 2 * turn[2] <= budget:
                    system = turn  # a conversation's own system turn: new in this window, repeated in the later ones
                if len(out) >= 200:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if key:
            close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    rows = _prepared(conversations, budget)
    parts = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "rank")
    # Ids travel as text: pandas would make floats of integers beside nulls. A null id is the empty text.
    return dealt.select("conv_id", "segment", "kind", "rank", "role", "text").mapInPandas(run, SCHEMA).withColumn("conv_id", F.col("conv_id").try_cast("long"))


def read_back(of: DataFrame) -> DataFrame:
    """Digests of the conversations as their windows give them back: turns once each, targets unescaped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        turns = chars = n = 0
        all_turns, loss = hashlib.sha256(), hashlib.sha256()
        out: list[tuple] = []
        done = lambda: out.append((key[0], n, all_turns.hexdigest(), turns, loss.hexdigest(), chars))
        for x in batches:
            for conv, text, spans, context in zip(x["conv_id"], x["text"], x["loss"], x["n_context"], strict=True):
                if key != (conv,):
                    if key:
                        done()
                    key, turns, chars, n = (conv,), 0, 0, 0
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for role, body in parsed(text)[context:]:
                    all_turns.update(f"{role}\n{body}\n".encode("utf-8", "replace"))
                    n += 1
                for s in spans:
                    target = unescaped(text[s["start"] : s["end"]])
                    turns += len(target)
                    loss.update(target.encode("utf-8", "replace"))
        if key:
            done()
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    parts = max(1, int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = of.withColumn("conv_id", F.col("conv_id").cast("string")).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return dealt.select("conv_id", "text", "loss", "n_context").mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumn("conv_id", F.col("conv_id").cast("long"))
