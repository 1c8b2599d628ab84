"""Conversation repair against a search over all audits and a plain program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millwarden.llm import conversations
from millwarden.llm.conversations import Audits, Conversation
from millwarden.llm.queries import QUERIES

KINDS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """First fault of each (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """All of the contract over one conversation's rows in order, with whole strings as states: initials so far by (audit, rows)."""
    kinds = faults(rows)
    best = {"": (0, "", ())}  # last state -> cost, audit, repaired rows

    def offer(table, at, value):
        if at not in table or value[:2] < table[at][:2]:
            table[at] = value

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(table):
        table = dict(table)
        for _ in range(4):
            for at, (cost, audit, out) in list(table.items()):
                to = "a" if at == "u" else "u"
                offer(table, to, (cost + 5, audit + "I", (*out, ({"u": "user", "a": "assistant"}[to], ""))))
        return table

    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for at, (cost, audit, out) in with_inserts(best).items():
            offer(new, at, (cost + 2, audit + "D", out))
            if kind not in ("blank", "duplicate"):
                more = 5 if kind == "truncated" else 0
                if role[:1] and role[:1] in follows[at]:
                    offer(new, role[0], (cost + more, audit + "K", (*out, (role, text))))
                for name in ("user", "assistant"):
                    if name[0] in follows[at]:
                        offer(new, name[0], (cost + more + 1, audit + "R", (*out, (name, text))))
        best = new
    ends = with_inserts(best)
    cost, audit, out = min(v for k, v in ends.items() if k in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(), out)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def plain_damage(rows):
    """(conv_id, turn, role, text) to conversations of (turn, role, text) after damage."""
    found = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = found.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            here += [row] * (2 if kind == 3 else 1)
    return found


def check(spark, rows, got, damaged):
    want = {conv: plain_repair(in_order(r))[:-1] for conv, r in damaged.items()}
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)


def test_least_audit_against_every_audit():
    """All audits of short conversations: the cheapest legal one, least in ASCII order."""
    rng = random.Random(5)
    for _ in range(150):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", "", "Go on!"])) for k in range(rng.randrange(4))]
        kinds, best = faults(rows), None
        for shape in itertools.product("DKRI", repeat=len(rows) + 3):
            for size in range(len(rows), len(shape) + 1):
                audit = "".join(shape[:size])
                if len(audit.replace("I", "")) != len(rows) or (size < len(shape) and set(shape[size:]) != {"I"}):
                    continue
                for names in itertools.product(*(("u", "a") if c in "RI" else ("",) for c in audit)):
                    cost, initials, left = 0, "", iter(zip(rows, kinds))
                    for c, name in zip(audit, names):
                        if c == "I":
                            cost, initials = cost + 5, initials + name
                            continue
                        (_, role, _), kind = next(left)
                        if c == "D":
                            cost += 2
                        elif kind in ("blank", "duplicate"):
                            break
                        else:
                            cost, initials = cost + (c == "R") + 5 * (kind == "truncated"), initials + (name or role[:1] or "?")
                    else:
                        if LEGAL.fullmatch(initials):
                            best = min(best or (99, ""), (cost, audit))
        assert plain_repair(rows)[5:7] == best, rows


@pytest.mark.parametrize("modulus", [conversations._MODULUS, 7, 1])
def test_program_equals_plain_one(modulus):
    """Also with hashes that collide, which must be verified, and with prefixes settled every few rows."""
    rng = random.Random(9)
    letters = {"blank": conversations.BLANK, "duplicate": conversations.DUPLICATE, "truncated": conversations.TRUNCATED, "": conversations.FINE}
    for n in [0, 1, 2, 3, 5, 8, 40, 300] * 12:
        rows = [(k, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ü"]), rng.choice(["Yes.", "No", " ", "Why?"]) if rng.random() < 0.3 else f"Row {k}.") for k in range(n)]
        run = Conversation(settle=16, modulus=modulus)
        for (turn, role, text), kind in zip(rows, faults(rows)):
            run.add(turn, role.encode(), role[:1], text.encode(), letters[kind])
        assert run.result() == plain_repair(rows)[:-1], rows


def test_long_conversations_settle():
    run = Conversation(settle=1000)
    for k in range(50_000):
        run.add(k, b"user" if k % 2 == 0 else b"assistant", "ua"[k % 2], b"Yes.", conversations.FINE)
    assert len(run.audits.parent) < 4000
    assert run.result()[5:7] == (0, "K" * 50_000)


def test_audits_compare_as_strings():
    rng, tree = random.Random(2), Audits()
    strings = {0: ""}
    for _ in range(400):
        at = rng.choice(list(strings))
        letter = rng.choice("DIKR")
        strings[tree.add(at, ord(letter))] = strings[at] + letter
    for _ in range(3000):
        x, y = rng.choice(list(strings)), rng.choice(list(strings))
        assert tree.less(x, y) == (strings[x] < strings[y])


def test_query_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows, QUERIES["op12_conversations"](spark, "/root/testdata/sf0.01").collect(), plain_damage(rows))


def test_edges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 400]), rng.choice([None, 0, 1, 2, 9]), rng.choice([None, "", "user", "assistant", "system", "Ünknown"]), rng.choice([None, "", " \t\n", "Fine.", "Broken", "x" * 50_000 + "?\n"])) for _ in range(400)]
    frame = spark.createDataFrame(rows, KINDS).withColumns({"fault": F.lit("own"), "present": F.lit(False), "KEY": F.lit(1)})
    damaged = conversations.damage(frame)
    got = conversations.repair(damaged, present="present")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    check(spark, rows, got.collect(), plain_damage(rows))
    assert conversations.repair(conversations.damage(frame.limit(0)), present="present").count() == 0
    gone = conversations.repair(frame.limit(5), present="present").collect()
    assert all(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)


def test_repaired_rows(spark):
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate(random.Random(c).choices([("user", "Why?"), ("assistant", "So."), ("system", "Be kind."), ("tool", "Run"), ("user", "")], k=c % 9))]
    frame = spark.createDataFrame(rows, KINDS)
    repairs = conversations.repair(frame)
    got = {}
    for r in conversations.repaired_rows(frame, repairs).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in repairs.collect():
        here = got.get(r.conv_id, [])
        assert tuple(here) == plain_repair(in_order([x[1:] for x in rows if x[0] == r.conv_id]))[-1]
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in here).encode()).hexdigest() == r.repaired_sha256
