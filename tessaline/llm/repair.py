"""Conversation structure repair by a forward Viterbi pass over four grammar states.

Rows of a conversation, in order, are kept, reroled or deleted, and empty turns are
inserted, so that the role initials read ``(s?(ua)+)?`` at the least cost.  The states
are the start, after ``s``, after ``u`` and after ``a``; each carries its least
``(cost, audit)``, where the audit is the initials of the edits, and every row's layer is
closed by the insertions that may follow.  Equal costs have audits of which none begins
another (a longer one would have an insertion more), so the order of two audits never
changes as they grow.

Rows are dealt by ranges of (conversation, order), so a conversation of any length is
spread over tasks.  One that lies whole within a range is decided there.  Others are cut
in segments, each of which gives its least ``(cost, audit)`` from every state to every
state; those are folded in order, and tell every segment the states it runs between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialize, releasing

#: Costs of edits; a truncated row that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A segment has at most so many rows, and ends once its texts have so many characters.
SEGMENT_ROWS, SEGMENT_CHARS = 1_024, 2_000_000
#: Where a role's initial leads from the start, after s, after u and after a.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, ENDS = 0, (0, 3)
ROLES = ("user", "user", "assistant", "user")  # what may be inserted, or reroled to, in each state
SPACE = r"\x20\x09-\x0D"
#: Rows before which a range of order may begin differ in so many code points of their text.
HEAD_CHARS = 32

Vector = list  # of (cost, audit) or None, by state
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _better(v: Vector, state: int, found: tuple[int, str]) -> None:
    if v[state] is None or found < v[state]:
        v[state] = found


def closed(v: Vector) -> Vector:
    """The layer once insertions follow: one leads to u, and at most one more to a."""
    v = list(v)
    for state in (0, 1, 3):
        if v[state] is not None:
            _better(v, 2, (v[state][0] + INSERT, v[state][1] + "I"))
    if v[2] is not None:
        _better(v, 3, (v[2][0] + INSERT, v[2][1] + "I"))
    return v


def advance(v: Vector, initials: str | list[str], faults: str) -> Vector:
    """The layer after rows with these role initials and faults (``B`` and ``D`` must go, ``T`` costs more)."""
    for initial, fault in zip(initials, faults):
        new: Vector = [None] * 4
        stays = fault not in "BD"
        more = TRUNCATED if fault == "T" else 0
        for state, found in enumerate(v):
            if found is None:
                continue
            cost, audit = found
            _better(new, state, (cost + DELETE, audit + "D"))
            if stays:
                if initial in MOVES[state]:
                    _better(new, MOVES[state][initial], (cost + more, audit + "K"))
                _better(new, MOVES[state][ROLES[state][0]], (cost + more + REROLE, audit + "R"))
        v = closed(new)
    return v


def start() -> Vector:
    return closed([(0, ""), None, None, None])


def best(v: Vector) -> tuple[tuple[int, str], int]:
    """The least (cost, audit) of the states in which a conversation may end, and that state."""
    return min((v[state], state) for state in ENDS if v[state] is not None)


def edited(entry: int, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The messages that rows become by the edits of ``audit``, from state ``entry``."""
    out, state, at = [], entry, 0
    for edit in audit:
        if edit != "D":
            kept = edit == "K"
            out.append((roles[at] if kept else ROLES[state], texts[at] if edit != "I" else ""))
            state = MOVES[state][out[-1][0][:1]]
        at += edit != "I"
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows damaged by the crc32 of ``conv_id:turn``.

    Of 20 remainders, 0 drops a row (it stays, not present), 1 empties its text, 2
    removes its ``.``, ``!`` and ``?``, 3 repeats it and 4 sets its role to user.  Nulls
    of any column count as one space, though a null id or turn stays null in the result.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("_kind") != 0).alias("present"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``fault``: B (blank), D (role and text seen earlier), T (truncated) or - for the first that a row has.

    The first place of every (conversation, role, text) is found by aggregation, so that
    neither a conversation nor a text said often has to be in one task.
    """
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    place = F.struct(F.col("turn"), F.col("_row"))
    rows = turns.withColumn("_said", F.when(F.col("present"), digest))
    firsts = rows.filter("present").groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_same")).agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_same"))
    rows = rows.join(firsts.filter("_n > 1"), same, "left")
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    # Structs compare by turn, null first, and then by row.
    repeated = F.col("_first").isNotNull() & (place > F.col("_first"))
    fault = F.when(last == "", "B").when(repeated, "D").when(~last.isin(".", "!", "?"), "T").otherwise("-")
    return rows.withColumn("fault", fault).drop("_conv", "_same", "_n", "_first")


class _Run:
    """Consecutive rows of a conversation, and what they add to its counts."""

    def __init__(self, conv_id, number: int):
        self.conv_id, self.number, self.seg = conv_id, number, 0
        self.clear()

    def clear(self) -> None:
        self.turns, self.roles, self.texts, self.faults, self.chars = [], [], [], [], 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def row(self, part: int, complete: bool) -> dict:
        initials, told = [r[:1] for r in self.roles], "".join(self.faults)
        numbered = [t for t in self.turns if t is not None]
        row = {
            "conv_id": self.conv_id, "part": part, "run": self.number, "seg": self.seg, "complete": complete, "least": min(numbered, default=None), "most": max(numbered, default=None),
            "turns": len(set(numbered)), "opens": initials[0] if initials else None, "ends": initials[-1] if initials else None,
            "blank": told.count("B"), "duplicate": told.count("D"), "truncated": told.count("T"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        }
        if complete:
            (row["cost"], row["audit"]), _ = best(advance(start(), initials, told))
            row["gaps"] = row["most"] - row["least"] + 1 - row["turns"] if numbered else 0
            row["messages"] = [{"role": r, "text": t} for r, t in edited(START, row["audit"], self.roles, self.texts)]
        else:
            ways = []
            for entry in range(4):
                v: Vector = [None] * 4
                v[entry] = (0, "")
                ways += advance(v, initials, told)
            row["costs"], row["audits"] = [w and w[0] for w in ways], [w and w[1] for w in ways]
            row["roles"], row["texts"] = self.roles, self.texts
        return row


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order to one row per conversation that lies whole within the task, or per segment."""
    part, run, done, out = TaskContext.get().partitionId(), None, 0, []
    for b in batches:
        for conv_id, turn, role, text, present, fault in zip(*(b.column(i).to_pylist() for i in range(6))):
            if run is None or run.conv_id != conv_id:
                if run is not None:
                    # The first run of a task may have begun in the one before.
                    out.append(run.row(part, run.number > 0 and run.seg == 0))
                    done += run.chars
                run = _Run(conv_id, 0 if run is None else run.number + 1)
            elif run.full():
                out.append(run.row(part, False))
                done += run.chars
                run.clear()
                run.seg += 1
            if present:
                run.add(turn, role, text, fault)
            if len(out) >= 1_000 or done >= 4 * SEGMENT_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, done = [], 0
    if run is not None:
        out.append(run.row(part, False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments in order to each one's entry state and edits; a conversation's last one tells its counts and audit."""
    conv, started = None, False

    def finished() -> Iterator[dict]:
        (tail_cost, tail), state = best(layer)
        edits = [None] * len(passed)
        for at in range(len(passed) - 1, -1, -1):
            entry, slices = passed[at][2][state]
            edits[at] = (entry, slices)
            state = entry
        for at, ((part, key, _), (entry, audit)) in enumerate(zip(passed, edits)):
            row = {"conv_id": conv, "part": part, "run": key[0], "seg": key[1], "entry": START if at == 0 else entry, "edits": audit}
            if at == len(passed) - 1:
                row |= counts | {"cost": tail_cost, "audit": "".join([*flushed, tail]), "gaps": most - least + 1 - turns if most is not None else 0}
            yield row

    def emitted() -> Iterator[pa.RecordBatch]:
        rows = list(finished())
        for at in range(0, len(rows), 1_000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 1_000], schema)

    for b in batches:
        for r in b.to_pylist():
            if not started or r["conv_id"] != conv:
                if started:
                    yield from emitted()
                conv, started, layer, passed, flushed = r["conv_id"], True, start(), [], []
                least = most = ends = None
                turns, counts = 0, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            new: Vector = [None] * 4
            origin: list = [None] * 4
            for entry, found in enumerate(layer):
                for state in range(4):
                    cost, audit = r["costs"][4 * entry + state], r["audits"][4 * entry + state]
                    if found is not None and cost is not None:
                        way = (found[0] + cost, found[1] + audit)
                        if new[state] is None or way < new[state]:
                            # The first segment's edits begin with those before any row.
                            new[state], origin[state] = way, (entry, audit if passed else found[1] + audit)
            passed.append((r["part"], (r["run"], r["seg"]), origin))
            # What all ways begin with is settled.
            settled = commonprefix([w[1] for w in new if w is not None])
            flushed.append(settled)
            layer = [w and (w[0], w[1][len(settled) :]) for w in new]
            for name in counts:
                counts[name] += r[name]
            if r["opens"] is not None:
                counts["illegal"] += ends is not None and ends + r["opens"] not in ("su", "ua", "au")
                ends = r["ends"]
            if r["least"] is not None:
                turns += r["turns"] - (most is not None and most == r["least"])
                least, most = r["least"] if least is None else least, r["most"]
    if started:
        yield from emitted()


@dataclass
class Repaired:
    """Repaired conversations, split ones apart.

    ``whole``: ``conv_id``, the counts, ``audit`` and ``messages`` (role, text), a row each.
    ``split``: the same without messages.  ``parts``: ``conv_id, part, run, seg, messages``
    of the split ones, in that order.
    """

    whole: DataFrame
    split: DataFrame
    parts: DataFrame

    def messages(self) -> DataFrame:
        """``conv_id, part, run, seg, place, role, text`` of all repaired messages; the numbers give their order."""
        none = (F.lit(0).alias("part"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("seg"))
        rows = self.whole.select("conv_id", *none, "messages").unionByName(self.parts)
        return rows.select("conv_id", "part", "run", "seg", F.posexplode("messages").alias("place", "m")).select("conv_id", "part", "run", "seg", "place", "m.role", "m.text")


_KEY = ("part", "run", "seg")


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def repair(turns: DataFrame) -> Repaired:
    """Repairs conversations of ``conv_id, turn, role, text`` and, if there, ``present``.

    Rows go by turn (null first), then role, then the text's first code points, then its
    digest; repeated rows are duplicates.  Null roles and texts are one space, an empty role
    has no initial and can't be kept, a null id is a conversation, and a row that isn't present (false or null) only makes its
    conversation known.  Other columns aren't read, texts and conversations of any length
    count whole, and an empty table gives no conversations.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in turns.columns else F.lit(True)
    numbered = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), told("role"), F.when(present, told("text")).alias("text"), present.alias("present"), F.monotonically_increasing_id().alias("_row"))
    judged = faults(materialize(numbered, "repair-rows"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, HEAD_CHARS), F.col("_said"), F.col("_row")]
    kind = turns.schema["conv_id"].dataType.simpleString()
    message = "array<struct<role: string, text: string>>"
    schema = (
        f"conv_id {kind}, part int, run long, seg long, complete boolean, least long, most long, turns long, opens string, ends string, blank long, duplicate long, truncated long, "
        f"illegal long, cost long, audit string, gaps long, messages {message}, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
    )
    dealt = judged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "present", "fault")
    arrow = _arrow(schema)
    found = materialize(dealt.mapInArrow(releasing(lambda batches: _segments(batches, arrow)), schema), "repair-segments")

    cut = found.filter("not complete")
    told_once = f"conv_id {kind}, part int, run long, seg long, entry int, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    arrow_fold = _arrow(told_once)
    narrow = cut.select("conv_id", *_KEY, "least", "most", "turns", "opens", "ends", "blank", "duplicate", "truncated", "illegal", "costs", "audits")
    folded = narrow.repartition("conv_id").sortWithinPartitions("conv_id", *_KEY).mapInArrow(releasing(lambda batches: _fold(batches, arrow_fold)), told_once)
    folded = materialize(folded, "repair-folded")

    arrow_parts = _arrow(f"conv_id {kind}, part int, run long, seg long, messages {message}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                said = [{"role": x, "text": t} for x, t in edited(r["entry"], r["edits"], r["roles"], r["texts"])]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("conv_id", *_KEY)} | {"messages": said}], arrow_parts)

    decided = folded.select(*(F.col(k).alias(f"_{k}") for k in _KEY), "entry", "edits")
    joined = cut.select("conv_id", *_KEY, "roles", "texts").join(decided, [F.col(k) == F.col(f"_{k}") for k in _KEY]).select("conv_id", *_KEY, "entry", "edits", "roles", "texts")
    parts = joined.mapInArrow(releasing(apply), f"conv_id {kind}, part int, run long, seg long, messages {message}")
    return Repaired(
        found.filter("complete").select("conv_id", *COUNTS, "audit", "messages"),
        folded.filter("audit is not null").select("conv_id", *COUNTS, "audit"), parts,
    )


def line(message: Column) -> Column:
    return F.concat(message["role"], F.lit(":"), message["text"])


def digests(repaired: Repaired) -> DataFrame:
    """``conv_id``, the counts, ``audit`` and ``repaired_sha256`` of the newline-joined ``role:text``.

    A split conversation's digest is fed segment by segment: a digest reads its text in
    order, so one task streams it, but never holds more than a segment.
    """
    whole = repaired.whole.withColumn("repaired_sha256", F.sha2(F.array_join(F.transform("messages", line), "\n").cast("binary"), 256))
    kind = repaired.parts.schema["conv_id"].dataType.simpleString()
    arrow = _arrow(f"_conv {kind}, repaired_sha256 string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun = None, None, False
        for b in batches:
            for conv_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest is None or conv_id != conv:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"_conv": conv, "repaired_sha256": digest.hexdigest()}], arrow)
                    conv, digest, begun = conv_id, hashlib.sha256(), False
                if text is not None:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"_conv": conv, "repaired_sha256": digest.hexdigest()}], arrow)

    # A segment of which nothing stays has no text; that of an empty message isn't empty.
    text = F.when(F.size("messages") > 0, F.array_join(F.transform("messages", line), "\n"))
    dealt = repaired.parts.repartition("conv_id").sortWithinPartitions("conv_id", *_KEY).select("conv_id", text.alias("text"))
    found = dealt.mapInArrow(releasing(hashed), f"_conv {kind}, repaired_sha256 string")
    split = repaired.split.join(found, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return whole.drop("messages").unionByName(split)
