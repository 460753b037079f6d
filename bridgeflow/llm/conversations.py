"""Conversation structure repair: the cheapest edits that give system, then user and assistant in turn.

Every row of a conversation becomes one symbol, its role's initial and its first fault, and the row
symbols in order its signature. Signatures are read from the end into an automaton whose nodes are
registered by (symbol, node of the rest), so equal ends of any conversations are one node. A node
knows, for each state of the grammar ``(s?(ua)+)?``, the least cost of the rows from it on and the
first edit of the ASCII-least cheapest audit; both follow from the node of the rest, so they are
computed once. The signatures are dealt to tasks by ranges of their ends, which brings equal ends together.

Flow: small marks per row, without texts, are sorted within conversations and streamed into
signatures; signatures meet their automaton; the texts, shuffled once, stream past the audit of
their conversation. A conversation is hashed as one text, so its rows go through one task, as a
stream: a task holds one Arrow batch, one byte a row of the conversation at hand, and the register.

Cases: null columns count as one space, in the damage's digest too, and a null key is a
conversation like any other; null turns come first. Rows of one turn are ordered by role, then by
the MD5 of role and text; repeated rows are duplicates of the first. Empty texts are blank.
A conversation without rows has an empty audit and the hash of the empty text. An empty table gives
an empty one. Roles that begin with none of s, u, a can only be changed or deleted. Texts are
hashed as a whole, of any length. Further columns, also with clashing names, are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SPACES = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3

# states of the grammar: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or changed role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
_INITIALS = "sua"
#: state -> initial -> state after keeping a role with it
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = {"su", "ua", "au"}

#: A register beyond this many nodes starts anew; a longer signature gets nodes of its own.
REGISTERED = 500_000
_NEVER = 1 << 60


def symbol(initial: str, fault: int) -> int:
    """One of twelve: four kinds of role, and a row that may stay, may stay at a price, or must go."""
    role = _INITIALS.find(initial) if initial else -1
    return (role if role >= 0 else 3) * 3 + (0 if fault == FINE else 1 if fault == TRUNCATED else 2)


class Automaton:
    """Nodes of signature ends with cost-to-go and first edit per grammar state; node 0 is the end."""

    def __init__(self) -> None:
        self.register: dict[int, int] = {}
        self.rest = array("q", [0])
        self.symbols = bytearray([0])
        self.cost = array("q", [0, INSERT_COST * 2, INSERT_COST, 0])
        self.edit = bytearray(b"\0II\0")

    def node(self, sym: int, rest: int) -> int:
        """A new node: ``sym`` before the rows of ``rest``."""
        role, stay = divmod(sym, 3)
        price = TRUNCATED_COST if stay == 1 else 0
        later = self.cost[4 * rest:4 * rest + 4]
        costs, edits = [], []
        for state in range(4):
            best, edit = DELETE_COST + later[state], DELETE
            if stay < 2:
                after = KEPT[state].get(_INITIALS[role]) if role < 3 else None
                if after is not None and price + later[after] < best:
                    best, edit = price + later[after], KEEP
                if REROLE_COST + price + later[NEXT[state]] < best:
                    best, edit = REROLE_COST + price + later[NEXT[state]], REROLE
            costs.append(best)
            edits.append(edit)
        # an insertion leads on inside the node; two in a row only from the first two states.
        # Of equal costs the ASCII-least first edit wins: D, I, K, R
        for state in (USER, ASSISTANT, START, SYSTEM):
            found = INSERT_COST + costs[NEXT[state]]
            if found < costs[state] or found == costs[state] and edits[state] > INSERT:
                costs[state], edits[state] = found, INSERT
        self.rest.append(rest)
        self.symbols.append(sym)
        self.cost.extend(costs)
        self.edit.extend("".join(edits).encode())
        return len(self.symbols) - 1

    def read(self, reverse: bytes) -> int:
        """The node of a signature, given from its end."""
        at, register, named = 0, self.register, len(reverse) <= REGISTERED
        for sym in reverse:
            if not named:
                at = self.node(sym, at)
                continue
            key = at * 12 + sym
            found = register.get(key)
            if found is None:
                found = register[key] = self.node(sym, at)
            at = found
        return at

    def audit(self, at: int) -> str:
        out, state = bytearray(), START
        while True:
            edit = self.edit[4 * at + state]
            if not edit:
                return out.decode()
            out.append(edit)
            if edit == 0x49:  # insert
                state = NEXT[state]
                continue
            if edit == 0x4B:  # keep
                state = KEPT[state][_INITIALS[self.symbols[at] // 3]]
            elif edit == 0x52:  # change the role
                state = NEXT[state]
            at = self.rest[at]


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and ``gone`` after the damage drawn by CRC-32; a dropped row stays as a gone one."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    c = F.col
    drawn = rows.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"),
                        (F.crc32(F.concat(spaced(conversation), F.lit(":"), spaced(turn)).cast("binary")) % 20).alias("harm"))
    hurt = drawn.select(
        "conv", "turn", F.when(c("harm") == 4, "user").otherwise(c("role")).alias("role"),
        F.when(c("harm").isin(0, 1), "").when(c("harm") == 2, F.translate("text", ".!?", "")).otherwise(c("text")).alias("text"),
        (c("harm") == 0).alias("gone"), F.explode(F.when(c("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return hurt.drop("copy")


def whole(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and ``gone`` of rows taken as they are; nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(False).alias("gone"))


def _named(rows: DataFrame) -> DataFrame:
    """With the digest that tells rows apart; the length keeps role and text from running together."""
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


_ORDER = ["conv", "turn", "role", "digest"]


def _marks(rows: DataFrame) -> DataFrame:
    """Small rows without texts: the first fault of each row and the initial of its role."""
    from pyspark.sql import Window as W

    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    small = _named(rows).select(
        "conv", "turn", "role", "digest", "gone", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    # the window follows the shuffle by conversation, which serves the sort as well
    place = F.row_number().over(W.partitionBy("conv", "digest", "gone").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > 1, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    return (small.repartition("conv").withColumn("place", place).withColumn("fault", fault.cast("byte"))
            .sortWithinPartitions(*[F.asc_nulls_first(c) for c in _ORDER + ["place"]]).select("conv", "turn", "initial", "fault", "gone"))


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Rows of sorted batches, each with whether its conversation begins."""
    last = begun = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            new = begun is None or row[0] != last
            last, begun = row[0], True
            yield new, row


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, and the signature from its end."""
    marks = _marks(rows)
    fields = [marks.schema["conv"]] + [T.StructField(n, T.LongType()) for n in _STATS] + [T.StructField("ends", T.BinaryType())]
    kind = pa.schema([("conv", _arrow(marks, "conv"))] + [(n, pa.int64()) for n in _STATS] + [("ends", pa.binary())])

    def run(batches):
        out, key, stats, signature, turns = [], None, None, None, None

        def close():
            if turns[0]:
                stats[0] = turns[2] - turns[1] + 1 - turns[0]
            out.append((key, *stats, bytes(reversed(signature))))

        for new, (conv, turn, initial, fault, gone) in _runs(batches):
            if new:
                if stats is not None:
                    close()
                key, stats, signature, turns, before = conv, [0] * 5, bytearray(), [0, None, None], None
            if not gone:
                if turn is not None and turn != turns[2]:
                    turns = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
                if fault:
                    stats[fault] += 1
                if before is not None and before + initial not in LEGAL:
                    stats[4] += 1
                before = initial
                signature.append(symbol(initial, fault))
            if len(out) >= 5_000:
                yield _batch(out, kind)
                out = []
        if stats is not None:
            close()
        yield _batch(out, kind)

    return marks.mapInArrow(run, T.StructType(fields))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


#: Symbols from the end by which signatures are dealt to tasks.
_DEALT = 64


def audits(signed: DataFrame) -> DataFrame:
    """``signed`` with ``cost`` and ``audit`` in place of the signature; ends are shared over all conversations of a task."""
    names = [c for c in signed.columns if c != "ends"]
    schema = T.StructType([signed.schema[c] for c in names] + [T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    # long runs of one signature are cut by the key, so no range holds all of them
    tail = F.substring("ends", 1, _DEALT)
    dealt = signed.repartitionByRange(tail, "conv").sortWithinPartitions(tail)

    def run(batches):
        automaton = Automaton()
        for batch in batches:
            costs, found = [], []
            for reverse in batch.column("ends").to_pylist():
                if len(automaton.symbols) > REGISTERED:
                    automaton = Automaton()
                at = automaton.read(reverse)
                costs.append(automaton.cost[4 * at])
                found.append(automaton.audit(at))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(costs, pa.int64()), pa.array(found, pa.string())],
                                             names=names + ["cost", "audit"])

    return dealt.select(*names, "ends").mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv, gaps, faults, illegal neighbours, cost, audit and ``repaired_sha256`` of each conversation.

    ``rows`` come from ``damaged`` or ``whole``.
    """
    judged = audits(signatures(rows))
    stats = [c for c in judged.columns if c != "conv"]
    texts = _named(rows.filter(~F.col("gone"))).select(
        "conv", F.lit(True).alias("is_row"), "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"),
        F.encode("role", "UTF-8").alias("role_bytes"), F.encode("text", "UTF-8").alias("text"))
    both = texts.unionByName(judged.withColumn("is_row", F.lit(False)), allowMissingColumns=True).repartition("conv")
    ordered = both.sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv", "is_row", "turn", "role", "digest")])
    schema = T.StructType([judged.schema[c] for c in ["conv"] + stats] + [T.StructField("repaired_sha256", T.StringType())])
    kind = pa.schema([(f.name, _arrow(judged, f.name)) for f in schema.fields[:-1]] + [("repaired_sha256", pa.string())])
    sent = ordered.select("conv", "is_row", "initial", "role_bytes", "text", *stats)

    def run(batches):
        out, work = [], None
        for _, (conv, is_row, initial, role, text, *judged) in _runs(batches):
            if not is_row:
                if work is not None:
                    out.append(work.done())
                work = Repaired(conv, judged)
            else:
                work.add(initial, role, text)
            if len(out) >= 5_000:
                yield _batch(out, kind)
                out = []
        if work is not None:
            out.append(work.done())
        yield _batch(out, kind)

    return sent.mapInArrow(run, schema)


class Repaired:
    """Digest of one conversation's repaired text, built up row by row."""

    def __init__(self, conv, judged: list) -> None:
        self.conv, self.judged = conv, judged
        self.edits = iter(judged[-1])
        self.state, self.hash, self.empty = START, hashlib.sha256(), True

    def _put(self, role: bytes, text: bytes) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(role)
        self.hash.update(b":")
        self.hash.update(text)

    def _inserted(self) -> str | None:
        """Carry out insertions up to the next edit of a row."""
        for edit in self.edits:
            if edit != INSERT:
                return edit
            self.state = NEXT[self.state]
            self._put(ROLE[self.state], b"")
        return None

    def add(self, initial: str, role: bytes, text: bytes) -> None:
        edit = self._inserted()
        if edit == KEEP:
            self.state = KEPT[self.state][initial]
            self._put(role, text)
        elif edit == REROLE:
            self.state = NEXT[self.state]
            self._put(ROLE[self.state], text)

    def done(self) -> tuple:
        self._inserted()
        return (self.conv, *self.judged, self.hash.hexdigest())
