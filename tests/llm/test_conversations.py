import hashlib
import itertools
import random
import re
import zlib

import pytest

from bitekst.llm import conversations
from bitekst.llm.conversations import Audit, Conversation, less

PATTERN, BEGUN = re.compile(rb"(s?(ua)+)?"), re.compile(rb"s?(ua)*u?")


def plain(rows):
    """(cost, audit, repaired) by trying all edits of a short conversation."""
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        roles = b"".join(r[:1] for r, _ in out)
        # Deleting every row is always possible.
        if cost > (best[0] if best else 3 * len(rows)) or not BEGUN.fullmatch(roles):
            return
        if i == len(rows):
            if PATTERN.fullmatch(roles):
                found = cost, audit, out
                if best is None or found[:2] < best[:2]:
                    best = found
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] in (b"s", b"u", b"a"):
                    go(i + 1, cost + late, audit + "K", [*out, (role, text)])
                for made in (b"user", b"assistant"):
                    go(i + 1, cost + 2 + late, audit + "R", [*out, (made, text)])
        for made in (b"user", b"assistant"):
            go(i, cost + 2, audit + "I", [*out, (made, b"")])

    go(0, 0, "", [])
    cost, audit, out = best
    return cost, audit, hashlib.sha256(b"\n".join(r + b":" + t for r, t in out)).hexdigest()


def repaired(rows):
    c = Conversation(0)
    for role, text, fault in rows:
        c.add(0, role, text, fault)
    return c.repair.finish()


ROLES = (b"system", b"user", b"assistant", b"tool", b"")


def test_all_edits_of_short_conversations():
    rng = random.Random(3)
    for roles in itertools.chain(*(itertools.product(ROLES[:4], repeat=n) for n in range(4))):
        rows = [(r, b"t%d" % i, None) for i, r in enumerate(roles)]
        assert repaired(rows) == plain(rows)
    for _ in range(150):
        rows = [
            (rng.choice(ROLES), b"t%d" % i, rng.choice([None, None, "truncated", "blank", "duplicate"]))
            for i in range(rng.randint(1, 5))
        ]
        assert repaired(rows) == plain(rows)


@pytest.mark.parametrize("clash", [False, True])
def test_settling_changes_nothing(monkeypatch, clash):
    """A stream settled every other row gives what one settled at the end gives, also if all hashes
    are equal."""
    if clash:
        monkeypatch.setattr(conversations, "PRIME", 1)
    rng = random.Random(4)
    for _ in range(30):
        rows = [
            (rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES), b"t%d" % i, rng.choice([None] * 5 + ["truncated", "blank"]))
            for i in range(rng.randint(1, 120))
        ]
        monkeypatch.setattr(conversations, "OPEN_ROWS", 10**9)
        whole = repaired(rows)
        monkeypatch.setattr(conversations, "OPEN_ROWS", 2)
        assert repaired(rows) == whole


def test_long_conversation_stays_small():
    c = Conversation(0)
    rng = random.Random(5)
    for i in range(20_000):
        c.add(i, rng.choice(ROLES[1:3]), b"x.", None)
        assert len(c.repair.open) <= conversations.OPEN_ROWS
    assert max(a.depth for _, a in c.repair.best.values()) <= 2 * conversations.OPEN_ROWS


def test_order_of_audits():
    rng = random.Random(6)
    made = {"": Audit(None)}
    for _ in range(400):
        text = rng.choice(list(made))
        for e in "DIKR":
            made.setdefault(text + e, Audit(made[text], e))
    texts = list(made)
    for _ in range(3000):
        a, b = rng.choice(texts), rng.choice(texts)
        assert less(made[a], made[b]) == (a < b)


def plain_report(table):
    """The whole contract on rows (conv_id, turn, role, text), in Python."""
    by = {}
    for conv_id, turn, role, text in table:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by.setdefault(conv_id, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = set()
    for conv_id, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in rows:
            ends = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not ends else "duplicate" if (role, text) in seen else None if ends[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role.encode(), text.encode(), fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
        counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        out.add((conv_id, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), *plain(judged)))
    return out


def test_odd_rows(spark):
    texts = ["Well.", "Well.", "cut off", "", None, " \t\n", "Überall?  \r\n", "a\nb!", "Long " * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rng = random.Random(7)
    table = [
        (c, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts))
        for c in [*range(60), None]
        for _ in range(rng.randint(1, 6))
    ]
    table += [r for r in table if r[0] == 5]
    schema = "conv_id long, turn long, role string, text string"
    got = conversations.audit_repair(spark.createDataFrame(table, schema))
    assert {tuple(r) for r in got.collect()} == plain_report(table)
    clash = spark.createDataFrame([(*r, True, "x", 1) for r in table], schema + ", lost boolean, fault string, copy int")
    assert sorted(map(str, conversations.audit_repair(clash).collect())) == sorted(map(str, got.collect()))
    assert conversations.audit_repair(spark.createDataFrame([], schema)).collect() == []


def test_conversation_of_lost_rows(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = conversations.audit_repair(spark.createDataFrame([(lost, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
