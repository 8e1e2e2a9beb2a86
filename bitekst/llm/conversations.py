"""Repair of conversations whose turns are lost, empty, cut off, repeated or under a wrong role.

The cheapest edits that turn a conversation's roles into ``(s?(ua)+)?`` come from a dynamic programme
over four states: nothing kept yet, behind the system turn, behind a user turn, behind an assistant
turn. Ties go to the least audit, the text of the edits' initials. An audit is a linked node with its
last edit, so audits share their beginnings; every node has its ancestors 1, 2, 4, … edits back and a
rolling hash of its audit, by which two audits of equal cost are compared at the end of their longest
common prefix in a logarithmic number of steps.

Rows of a conversation are sorted by Spark and read as a stream. What all live audits have in common
is settled from time to time: written out, fed to the checksum of the repaired text, and forgotten.
So a task holds the open part of one conversation only, however long it is. (The checksum is one
SHA-256 over the repaired conversation, hence one stream for each conversation.)
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.llm.common import pick

#: Costs of the edits; a truncated row that stays costs one more.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: White space: anything else makes a text more than blank.
BLANKS = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT_OFF = "blank", "duplicate", "truncated"

START, SYSTEM, USER, ASSISTANT = range(4)
#: States behind a turn of a role, by the state before.
AFTER = {b"s": {START: SYSTEM}, b"u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, b"a": {USER: ASSISTANT}}
#: The turn that edits can make in a state, and the state behind it.
MADE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE_OF = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {(b"s", b"u"), (b"u", b"a"), (b"a", b"u")}

BASE, PRIME = 1_000_003, (1 << 61) - 1
#: Open rows and bytes of text from which a stream is settled.
OPEN_ROWS, OPEN_BYTES = 512, 1 << 24


class Audit:
    """A beginning of an audit: one edit behind another beginning."""

    __slots__ = ("up", "edit", "depth", "hash")

    def __init__(self, before: Audit | None, edit: str = ""):
        self.edit = edit
        if before is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * BASE + ord(edit)) % PRIME
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)


def back(a: Audit, depth: int) -> Audit:
    """The beginning of a that has ``depth`` edits."""
    while a.depth > depth:
        a = a.up[min((a.depth - depth).bit_length(), len(a.up)) - 1]
    return a


def same(a: Audit, b: Audit) -> bool:
    """Whether two audits of one length are equal: hashes tell unequal ones, equal hashes are verified."""
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.edit != b.edit:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Audit, b: Audit) -> bool:
    """Whether the text of a comes before that of b."""
    depth = min(a.depth, b.depth)
    x, y = back(a, depth), back(b, depth)
    if same(x, y):
        return a.depth < b.depth
    for k in range(len(x.up) - 1, -1, -1):
        # x and y have one length and differ; go back while they still differ.
        if k < len(x.up) and not same(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x.edit < y.edit


class Repair:
    """One conversation, its rows given in order."""

    def __init__(self):
        self.best: dict[int, tuple[int, Audit]] = {START: (0, Audit(None))}
        self.insert()
        self.open, self.bytes, self.limit = deque(), 0, OPEN_ROWS
        self.state, self.audit, self.digest, self.first = START, [], hashlib.sha256(), True

    def offer(self, to: dict, state: int, cost: int, before: Audit, edit: str) -> None:
        known = to.get(state)
        if known is None or cost < known[0]:
            to[state] = cost, Audit(before, edit)
        elif cost == known[0] and less(new := Audit(before, edit), known[1]):
            to[state] = cost, new

    def insert(self) -> None:
        # In this order every useful chain of insertions (at most a user and an assistant turn) is met.
        for state in (START, SYSTEM, ASSISTANT, USER):
            if state in self.best:
                cost, audit = self.best[state]
                self.offer(self.best, MADE[state], cost + INSERT, audit, "I")

    def add(self, role: bytes, text: bytes, fault: str | None) -> None:
        kept = AFTER.get(role[:1], {})
        worse = TRUNCATED if fault == CUT_OFF else 0
        after: dict[int, tuple[int, Audit]] = {}
        for state, (cost, audit) in self.best.items():
            self.offer(after, state, cost + DELETE, audit, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            if state in kept:
                self.offer(after, kept[state], cost + worse, audit, "K")
            self.offer(after, MADE[state], cost + REROLE + worse, audit, "R")
        self.best = after
        self.insert()
        # From behind an assistant turn everything can be done that can be done behind the system
        # turn, and at three more what can be done before it; dearer states lead nowhere.
        if ASSISTANT in after:
            done = after[ASSISTANT][0]
            self.best = {s: b for s, b in after.items() if s not in (START, SYSTEM) or b[0] <= done + (3 if s == START else 0)}
        self.open.append((role, text))
        self.bytes += len(role) + len(text)
        if len(self.open) >= self.limit or self.bytes >= OPEN_BYTES and len(self.open) > 1:
            self.settle()
            self.limit = max(OPEN_ROWS, 2 * len(self.open))

    def settle(self) -> None:
        """Write out what all live audits begin with, and start them behind it."""
        ends = [audit for _, audit in self.best.values()]
        depth = min(a.depth for a in ends)
        common = [back(a, depth) for a in ends]
        while any(a is not common[0] for a in common):
            k = max((k for k in range(len(common[0].up)) if any(a.up[k] is not common[0].up[k] for a in common)), default=0)
            common = [a.up[k] for a in common]
        self.write(common[0])
        root = common[0]
        made = {id(root): Audit(None)}
        for state, (cost, audit) in self.best.items():
            path = []
            while id(audit) not in made:
                path.append(audit)
                audit = audit.up[0]
            new = made[id(audit)]
            for old in reversed(path):
                new = made[id(old)] = Audit(new, old.edit)
            self.best[state] = cost, new

    def write(self, audit: Audit) -> None:
        edits = []
        while audit.depth:
            edits.append(audit.edit)
            audit = audit.up[0]
        edits.reverse()
        self.audit.append("".join(edits))
        for edit in edits:
            role, text = (b"", b"") if edit == "I" else self.open.popleft()
            self.bytes -= len(role) + len(text)
            if edit == "D":
                continue
            if edit == "K":
                self.state = AFTER[role[:1]][self.state]
            else:
                self.state = MADE[self.state]
                role = ROLE_OF[self.state]
            self.digest.update((b"" if self.first else b"\n") + role + b":")
            self.digest.update(text)
            self.first = False

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired text)."""
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, audit = ends[0]
        for other, end in ends[1:]:
            if other < cost or other == cost and less(end, audit):
                cost, audit = other, end
        self.write(audit)
        return cost, "".join(self.audit), self.digest.hexdigest()


class Conversation:
    """The report of one conversation, its rows given in order."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.faults = dict.fromkeys((BLANK, DUPLICATE, CUT_OFF), 0)
        self.illegal, self.before = 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: bytes, text: bytes, fault) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if fault:
            self.faults[fault] += 1
        if self.before is not None and (self.before, role[:1]) not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.faults.values(), self.illegal, *self.repair.finish()


SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) with faults put in by a checksum of conv_id and turn.

    A dropped row stays as one that is ``lost``, so that its conversation is not forgotten.
    """
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", either("conv_id"), either("turn")).cast("binary")) % 20
    role, text = either("role"), either("text")
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _fault() -> Column:
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    seen = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return (
        F.when(F.col("lost"), None)
        .when(ends == "", BLANK)
        .when(F.row_number().over(seen) > 1, DUPLICATE)
        .when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), CUT_OFF)
    )


def repair(rows: DataFrame) -> DataFrame:
    """A report on every conversation of rows(conv_id, turn, role, text, lost).

    Rows are taken by turn, nulls first, ties by role and then text in the order of their bytes. Rows
    without a conv_id are one conversation. A role is known by its first letter (s, u, a); any other
    role, an empty one too, is renamed or deleted. A conversation of lost rows alone has zeros, an empty
    audit and the checksum of an empty text. Texts of any length are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                conv_id, turn, role, text, lost, fault = (c[i].as_py() for c in columns)
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = Conversation(conv_id)
                if not lost:
                    now.add(turn, role, text, fault)
            if out:
                yield flush()
                out.clear()
        if now is not None:
            out.append(now.row())
            yield flush()

    judged = rows.withColumn("fault", _fault())
    sent = judged.select(
        "conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "lost", "fault"
    )
    # Of rows equal in everything the one that is no duplicate comes first.
    order = [*(F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")), F.col("fault").eqNullSafe(DUPLICATE)]
    return sent.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def audit_repair(conversations: DataFrame) -> DataFrame:
    """Damage conversations(conv_id, turn, role, text) and report on their repair, one row for each
    conv_id of the table. A null stands for one space, in the checksum as in role and text. Columns
    of other names are ignored; an empty table gives no rows."""
    return repair(damage(pick(conversations, "conv_id", "turn", "role", "text")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair of all conversations."""
    return audit_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
