"""Chat formatting in budgeted windows.

A turn is written ``### role: text</turn>`` and a line feed; in texts and roles a backslash goes before each backslash, ``###`` and
``</turn>`` (and, in roles, colon), so parsing gives back what went in, whatever the texts hold.

A conversation becomes windows of at most BUDGET tokens. Prefix sums of the turns' tokens say how many whole turns fit.
Every window starts with the system turn and a limited history (the last turns before it, HISTORY tokens and HISTORY_TURNS
turns at most, none if the next turn wouldn't fit). Repeated turns are masked: each assistant text is a target
in one window only. A turn that with the system turn is longer than the budget has a window of its own, over the budget.

Scale: turns are numbered densely in two levels (within range partitions, then over the few conversations that go
from one into the next) and dealt out in blocks of BLOCK turns, so a conversation that holds a third of all rows
is formatted by many tasks, whatever its turn numbers are. A block gets the system turn and the last turns of the block before it along
with its own. Tasks read sorted rows and hold one slice at a time. Only ``digests``, whose contract is one hash over a
conversation's turns in order, reads a conversation in one task, as a stream.

Nulls, empties, repeats: a null text or role is empty; null turns come first; rows with the same turn are ordered by role, then
text; repeated rows are turns of their own; rows without conv_id make one conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_counts

BUDGET, HISTORY, HISTORY_TURNS, BLOCK = 2048, 256, 8, 128
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*+): ((?:\\(?:\\|###|</turn>)|[^\\#<]++|#(?!##)|<(?!/turn>))*+)</turn>\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def written(role: str, text: str) -> tuple[str, int]:
    """The turn as it stands in a window, and where its text starts."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}: "
    return f"{head}{escape(text)}</turn>\n", len(head)


def parsed(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text as it stands) of the turns of a window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


class _Windows:
    """Makes the windows of one block, turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, int, int] | None = None
        self.tail: list[tuple[str, int, int]] = []
        self.fresh: list[tuple[str, int, int, bool]] = []
        self.repeated: list[tuple[str, int, int]] = []
        self.total = self.start = 0

    def remember(self, turn: tuple[str, int, int]) -> None:
        self.tail = [*self.tail, turn][-HISTORY_TURNS:]

    def _open(self, tokens: int) -> None:
        """Choose what the next window repeats, so that a turn of ``tokens`` still fits."""
        self.repeated = [self.system] if self.system else []
        room = min(self.budget - tokens - sum(t[2] for t in self.repeated), self.history)
        past = []
        for turn in reversed(self.tail):
            if turn[2] > room:
                break
            room -= turn[2]
            past.insert(0, turn)
        self.repeated += past
        self.start = self.total - sum(t[2] for t in self.repeated)

    def add(self, turn: tuple[str, int, int], target: bool) -> Iterator[tuple]:
        if self.fresh and self.total + turn[2] - self.start > self.budget:
            yield self.close()
        if not self.fresh:
            self._open(turn[2])
        self.total += turn[2]
        self.fresh.append((*turn, target))
        self.remember(turn)

    def close(self) -> tuple:
        """(text, loss spans, repeated turns, new turns, tokens)."""
        parts, loss, at = [t[0] for t in self.repeated], [], sum(len(t[0]) for t in self.repeated)
        for text, head, _, target in self.fresh:
            if target:
                loss.append({"start": at + head, "end": at + len(text) - len("</turn>\n")})
            parts.append(text)
            at += len(text)
        out = "".join(parts), loss, len(self.repeated), len(self.fresh), self.total - self.start
        self.fresh = []
        return out


_WINDOW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("n_tokens", pa.int64())])
WINDOW = "conv_id long, block long, window long, text string, loss array<struct<start: long, end: long>>, n_repeated long, n_new long, n_tokens long"


def _emit_windows(file: str, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, now, own, n, rows, starts = token_counts.counter(file), None, None, 0, [], False
        for batch in common.slices(batches, most=1 << 20):
            said = [written(role, text) for role, text in zip(common.column(batch, "role"), common.column(batch, "text"))]
            tokens = [int(p[2][-1]) for p in counter.profiles([whole for whole, _ in said])]
            for conv, block, kind, role, (whole, head), n_tokens in zip(*(common.column(batch, c) for c in ("conv_id", "block", "kind", "role")), said, tokens):
                if now != (conv, block):
                    if own and own.fresh:
                        rows.append((*now, n, *own.close()))
                    now, own, n, starts = (conv, block), _Windows(budget, history), 0, False
                if kind == -1:  # the block's first turn is the conversation's system turn
                    starts = True
                    continue
                turn = whole, head, n_tokens
                if kind == 0:
                    own.system = turn
                elif kind == 1:
                    own.remember(turn)
                else:
                    for made in own.add(turn, role == "assistant"):
                        rows.append((*now, n, *made))
                        n += 1
                    if starts:  # repeated from now on, but no history
                        own.system, starts = turn, False
                        own.tail.pop()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOW)], schema=_WINDOW)
                rows = []
        if own and own.fresh:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip((*now, n, *own.close())), _WINDOW)], schema=_WINDOW)

    return run


def _emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place in the part that this task has of their conversation."""
    now, n = None, 0
    for batch in batches:
        places = np.zeros(batch.num_rows, np.int64)
        for k, conv in enumerate(common.column(batch, "conv_id")):
            if (conv,) != now:
                now, n = (conv,), 0
            places[k] = n
            n += 1
        yield batch.append_column("place", pa.array(places))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with their dense place in the conversation: by turn (null first), role, text."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = turns.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    dealt = common.materialize(dealt.mapInArrow(_emit_places, "conv_id long, turn long, role string, text string, part int, place long"), "turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    longer = parts.groupBy("conv_id").agg(F.collect_list(F.struct("part", "n")).alias("parts")).where("size(parts) > 1")
    before = F.aggregate(F.filter("parts", lambda x: x["part"] < F.col("p.part")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    offsets = longer.withColumn("p", F.explode("parts")).select(F.col("conv_id").alias("conv"), F.col("p.part").alias("of"), before.alias("before"))
    found = dealt.join(F.broadcast(offsets), dealt["conv_id"].eqNullSafe(offsets["conv"]) & (F.col("part") == F.col("of")), "left")  # two rows a range partition at most
    return found.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "role", "text")


def windows(turns: DataFrame, file: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``turns`` (conv_id, turn, role, text)."""
    turns = numbered(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    turns = turns.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    system = turns.where("place = 0 and role = 'system'")
    blocks = turns.where(F.col("place") % BLOCK == 0).select(F.col("conv_id").alias("conv"), F.col("block").alias("of"))
    kind = F.when(F.col("of") == 0, -1).otherwise(0)
    heads = blocks.join(system, blocks["conv"].eqNullSafe(system["conv_id"])).select("conv_id", F.col("of").alias("block"), kind.alias("kind"), "place", "role", "text")
    past = turns.where(F.col("place") % BLOCK >= BLOCK - HISTORY_TURNS).select("conv_id", (F.col("block") + 1).alias("block"), F.lit(1).alias("kind"), "place", "role", "text")
    own = turns.select("conv_id", "block", F.lit(2).alias("kind"), "place", "role", "text")
    order = ["conv_id", "block", "kind", "place"]
    every = heads.unionByName(past).unionByName(own).repartition("conv_id", "block").sortWithinPartitions(*order)
    return every.select("conv_id", "block", "kind", "role", "text").mapInArrow(_emit_windows(file, budget, history), WINDOW)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0

    def add(self, text: str, loss: list[dict], repeated: int) -> None:
        self.formatted += len(text)
        for role, said, _, _ in parsed(text)[repeated:]:
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)


def _emit_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, own, rows = None, None, []
    done = lambda: (now[0], own.n_turns, own.turns.hexdigest(), own.loss_chars, own.loss.hexdigest(), own.formatted)
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    for batch in common.slices(batches):
        for conv, text, loss, repeated in zip(*(common.column(batch, c) for c in ("conv_id", "text", "loss", "n_repeated"))):
            if now != (conv,):
                if own:
                    rows.append(done())
                now, own = (conv,), _Digest()
            own.add(text, loss, repeated)
        if rows:
            yield pack(rows)
            rows = []
    if own:
        yield pack([done()])


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows in order."""
    dealt = formatted.select("conv_id", "block", "window", "text", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return dealt.mapInArrow(_emit_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
