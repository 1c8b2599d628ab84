"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal.

A conversation is legal if its role initials are ``(s?(ua)+)?``.  Rows that are blank or repeat an earlier row must go.  A row is
kept (K, 0), given the role user or assistant (R, 1) or deleted (D, 2); a row without text can be inserted anywhere (I, 5); a row
that stays although its text breaks off adds 5.  Of equally cheap audits the least in ASCII order is taken.

The dynamic program runs over the rows in order with four states: nothing yet, after s, after u, after a.  Audits are
persistent: a state points to its last edit, edits share their prefixes as linked nodes, each with a rolling hash of its
prefix and a binary-lifting ancestor.  A tie is settled by a search for the longest common prefix, which climbs both paths while
the hashes differ; equal hashes of different nodes are verified edit by edit.  Prefixes that all live states share are
settled and their nodes go, so no text and, but for edits still open, no edit of a conversation is held.  The digest of the repaired
conversation is carried in every state; a digest is sequential, so one task streams a conversation, however long.

Defined results: null roles and texts count as one space; null turns come first and do not count in ``gaps``; rows of one turn go
by role and text; the rows with a null key are one conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millwarden.llm.common import SPACES

#: The order of states, what follows what, the costs.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

_MODULUS, _BASE = (1 << 61) - 1, 1_000_003
#: Nodes after which shared prefixes are settled.
SETTLE = 1 << 16


class Audits:
    """Strings of edits as nodes of one tree; node 0 is the settled prefix.  ``jump`` is an ancestor that depends on the depth alone."""

    def __init__(self, modulus: int = _MODULUS):
        self.modulus, self.settled = modulus, bytearray()
        self.parent, self.jump, self.depth, self.hash, self.letter = [0], [0], [0], [0], [0]

    def add(self, node: int, letter: int) -> int:
        jump, depth = self.jump, self.depth
        over = jump[node]
        self.jump.append(jump[over] if node and depth[node] - depth[over] == depth[over] - depth[jump[over]] else node)
        self.parent.append(node)
        self.depth.append(depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + letter) % self.modulus)
        self.letter.append(letter)
        return len(self.parent) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def same(self, a: int, b: int) -> bool:
        """Equal strings of one length: by node, by hash, then edit by edit."""
        if a == b or self.hash[a] != self.hash[b]:
            return a == b
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, x: int, y: int) -> bool:
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.same(a, b):
            return self.depth[x] < self.depth[y]
        while True:
            if not self.same(self.jump[a], self.jump[b]):
                a, b = self.jump[a], self.jump[b]
            elif not self.same(self.parent[a], self.parent[b]):
                a, b = self.parent[a], self.parent[b]
            else:
                return self.letter[a] < self.letter[b]

    def letters(self, node: int, above: int = 0) -> bytes:
        out = bytearray()
        while node != above:
            out.append(self.letter[node])
            node = self.parent[node]
        out.reverse()
        return bytes(out)

    def settle(self, live: list[int]) -> list[int]:
        """Drops what no live node needs, and takes the prefix they share into ``settled``; returns the live nodes' new numbers."""
        low = min(self.depth[x] for x in live)
        ends = {self.ancestor(x, low) for x in live}
        while len(ends) > 1:
            ends = {self.parent[x] for x in ends}
        (root,) = ends
        self.settled += self.letters(root)
        old, numbers = self.__dict__.copy(), {root: 0}
        self.parent, self.jump, self.depth, self.hash, self.letter = [0], [0], [0], [0], [0]
        for x in live:
            path = []
            while x not in numbers:
                path.append(x)
                x = old["parent"][x]
            for node in reversed(path):
                numbers[node] = self.add(numbers[old["parent"][node]], old["letter"][node])
        return [numbers[x] for x in live]


#: Cost, node, digest so far, bytes that are to follow it.
State = tuple[int, int, "hashlib._Hash", bytes]


class Conversation:
    """The program over the rows of one conversation, fed in order."""

    def __init__(self, settle: int = SETTLE, modulus: int = _MODULUS):
        self.audits, self.limit = Audits(modulus), settle
        self.states: dict[int, State] = {NOTHING: (0, 0, hashlib.sha256(), b"")}
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None

    def _better(self, cost: int, node: int, letter: int, other: State | None) -> int | None:
        """A node for the edit if it beats the other way to its state."""
        if other is not None and cost > other[0]:
            return None
        new = self.audits.add(node, letter)
        return new if other is None or cost < other[0] or self.audits.less(new, other[1]) else None

    def _with_inserts(self) -> dict[int, State]:
        states = dict(self.states)
        for _ in (1, 2):
            for at in (NOTHING, SYSTEM, ASSISTANT, USER):
                if at in states:
                    cost, node, digest, tail = states[at]
                    to = NEXT[at]
                    new = self._better(cost + INSERT, node, 73, states.get(to))
                    if new is not None:
                        states[to] = (cost + INSERT, new, digest, tail + (b"\n" if at else b"") + ROLES[to] + b":")
        return states

    def add(self, turn: int | None, role: bytes, initial: str, text: bytes, fault: int) -> None:
        self._count(turn, initial, fault)
        add, cost_of = self.audits.add, BROKEN if fault == TRUNCATED else 0
        # A row is inserted after deleted ones, never before: that audit is the lesser.
        new: dict[int, State] = {at: (cost + DELETE, add(node, 68), digest, tail) for at, (cost, node, digest, tail) in self.states.items()}
        if fault not in (BLANK, DUPLICATE):
            chosen: dict[int, tuple] = {}
            for at, (cost, node, digest, tail) in self._with_inserts().items():
                own = INITIALS.get(initial)
                to = own if own == NEXT[at] or (own == SYSTEM and at == NOTHING) else None
                ways = [] if to is None else [(to, cost + cost_of, 75, role)]
                if NEXT[at] != to:
                    ways.append((NEXT[at], cost + cost_of + REROLE, 82, ROLES[NEXT[at]]))
                for to, cost_to, letter, as_role in ways:
                    better = self._better(cost_to, node, letter, new.get(to))
                    if better is not None:
                        new[to] = (cost_to, better, digest, tail)
                        chosen[to] = (better, (b"\n" if at else b"") + as_role + b":")
            for to, (node, head) in chosen.items():
                cost, at, digest, tail = new[to]
                if at == node:
                    digest = digest.copy()
                    digest.update(tail + head)
                    digest.update(text)
                    new[to] = (cost, at, digest, b"")
        # What an open end can save at most: a system row kept (2), a row inserted (5).  Dearer states cannot win or tie.
        for x, y, most in ((NOTHING, ASSISTANT, DELETE), (SYSTEM, ASSISTANT, 0), (NOTHING, USER, DELETE + INSERT), (SYSTEM, USER, INSERT), (USER, ASSISTANT, INSERT), (ASSISTANT, USER, INSERT)):
            if x in new and y in new and new[x][0] > new[y][0] + most:
                del new[x]
        self.states = new
        if len(self.audits.parent) > self.limit:
            nodes = self.audits.settle([s[1] for s in new.values()])
            self.states = {at: (s[0], n, *s[2:]) for (at, s), n in zip(new.items(), nodes)}
            self.limit = max(self.limit, 2 * len(self.audits.parent))

    def _count(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        self.faults[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of the repaired rows."""
        ends = self._with_inserts()
        best = ends.get(NOTHING)
        other = ends.get(ASSISTANT)
        if best is None or (other is not None and (other[0] < best[0] or (other[0] == best[0] and self.audits.less(other[1], best[1])))):
            best = other
        cost, node, digest, tail = best
        digest = digest.copy()
        digest.update(tail)
        audit = (bytes(self.audits.settled) + self.audits.letters(node)).decode()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, cost, audit, digest.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    current, run = None, None

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * (len(_COUNTS) + 3)
        arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:-2]), *(pa.array(c, pa.string()) for c in columns[-2:])]
        found.clear()
        return pa.RecordBatch.from_arrays(arrays, ["key", *_COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        for key, turn, role, initial, text, fault in zip(*(batch.column(k) for k in range(6))):
            key = key.as_py()
            if run is None or key != current:
                if run is not None:
                    found.append((current, *run.result()))
                    if len(found) >= 2000:
                        yield flushed()
                current, run = key, Conversation()
            fault = fault.as_py()
            if fault is not None:
                run.add(turn.as_py(), role.as_py(), initial.as_py(), text.as_py(), fault)
    if run is not None:
        found.append((current, *run.result()))
    yield flushed()


def with_faults(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """key, turn, role, text, ``present``, ``fault`` (null where not present), dealt by key; rows that are not present only name their conversation."""
    body = rows.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))),
                       F.lit(True).alias("present") if present is None else F.coalesce(F.col(present), F.lit(False)).alias("present"))
    # Dealt once: the window below and the order of the stream are met within the partitions of the key.
    earlier = F.row_number().over(Window.partitionBy("key", "present", "role", "text").orderBy("turn"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(~F.col("present"), None).when(trimmed == "", BLANK).when(F.col("earlier") > 1, DUPLICATE).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return body.repartition("key").withColumn("earlier", earlier).withColumn("fault", fault).drop("earlier")


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """Per conversation: key, ``gaps`` in its turns, rows by fault, ``illegal`` pairs, ``cost``, ``audit`` and the digest of the repaired rows."""
    judged = with_faults(rows, key, turn, role, text, present)
    stream = judged.select("key", "turn", F.col("role").cast("binary").alias("role"), F.substring("role", 1, 1).alias("initial"), F.col("text").cast("binary").alias("text"), "fault").sortWithinPartitions("key", "turn", "role", "text")
    field = judged.schema["key"]
    kind = to_arrow_type(field.dataType)
    columns = ", ".join(f"{c} long" for c in _COUNTS)
    done = stream.mapInArrow(lambda batches: _streamed(batches, kind), f"key {field.dataType.simpleString()}, {columns}, audit string, repaired_sha256 string")
    return done.withColumnRenamed("key", key)


def repaired_rows(rows: DataFrame, repairs: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """The rows that ``repairs`` (of ``repair``) leaves and adds: key, ``position`` from 1, ``turn`` (null if added), role, text, ``edit`` (K, R or I)."""
    judged = with_faults(rows, key, turn, role, text, present).filter("present")
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    numbered = judged.withColumn("row", F.row_number().over(order)).select("key", "row", "turn", "role", "text")
    letters = repairs.select(F.col(key).alias("key"), F.posexplode(F.split("audit", "")).alias("place", "edit")).filter("edit != ''")
    through = Window.partitionBy("key").orderBy("place")
    letters = letters.select("key", "edit", F.when(F.col("edit") != "I", F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(through)).alias("row"),
                             F.sum(F.when(F.col("edit") != "D", 1).otherwise(0)).over(through).alias("position")).filter("edit != 'D'")
    joined = letters.alias("l").join(numbered.alias("n"), F.col("l.key").eqNullSafe(F.col("n.key")) & (F.col("l.row") == F.col("n.row")), "left")
    joined = joined.select(F.col("l.key").alias("key"), "position", "edit", "turn", "role", "text")
    system = F.max(F.when((F.col("position") == 1) & (F.col("edit") == "K"), F.substring("role", 1, 1) == "s").otherwise(False)).over(Window.partitionBy("key"))
    given = F.when((F.col("position") + system.cast("int")) % 2 == 1, "user").otherwise("assistant")
    return joined.select(F.col("key").alias(key), "position", F.col("turn").alias(turn), F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias(role),
                         F.coalesce("text", F.lit("")).alias(text), "edit")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults planted by crc32 of ``key:turn`` modulo 20; dropped rows stay with ``present`` false, so that no conversation is lost."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known(key), F.lit(":"), known(turn)).cast("binary")) % 20
    body = rows.select(F.col(key).alias(key), F.col(turn).alias(turn), kind.alias("kind"), known(role).alias(role), known(text).alias(text))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return body.select(key, turn, F.when(F.col("kind") == 4, "user").otherwise(F.col(role)).alias(role), changed.alias(text), (F.col("kind") != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")
