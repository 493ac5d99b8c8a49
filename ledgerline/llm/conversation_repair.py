"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

A repaired conversation is ``(s?(ua)+)?`` in the initials of its roles: an optional system turn, then
user and assistant in turn. Every row is kept (K), given the other role (R) or deleted (D), and empty
turns may be inserted (I) anywhere. The cheapest sequence of edits wins, and of equally cheap ones the
one whose letters come first.

The rows of a conversation pass in order, as a stream. One path of edits survives for each state (what
the repaired conversation ends with), and all paths share one tree of back pointers that counts
references. Once every survivor has the same first edit, that edit is final: it is emitted with its
row and cut from the tree. So memory holds the edits on which survivors still differ, however long the
conversation is. Paths of equal cost are compared by their whole unresolved letters, back to where
they part. A state that a cheaper one can follow at every step is dropped: without that the path that
deletes everything would survive for ever and nothing would be final.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a repaired conversation can end with: nothing yet, the system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept row of this initial or an added turn leads to, from each state that allows it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
COMPLETE = (START, ASSISTANT)
INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Initials of roles that may stand side by side.
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

EDITS = "conv_id {id}, step long, edit string, turn {turn}, old_role string, role string, text string, fault string, cost long"


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str | None


class Node:
    """One edit of a path, leading to ``state``; ``uses`` counts the survivors and edits that hang on it."""

    __slots__ = ("parent", "letter", "cost", "row", "state", "uses", "depth")

    def __init__(self, parent: Node | None, letter: str, cost: int, row: Row | None, state: int):
        self.parent, self.letter, self.cost, self.row, self.state, self.uses, self.depth = parent, letter, cost, row, state, 1, 0
        if parent is not None:
            parent.uses += 1
            self.depth = parent.depth + 1


def _comes_first(a: Node, b: Node) -> bool:
    """Whether the letters of path ``a`` come before those of ``b``, read from where the two part."""
    of_a, of_b = [], []
    while a is not b:
        if a.depth >= b.depth:
            of_a.append(a.letter)
            a = a.parent
        else:
            of_b.append(b.letter)
            b = b.parent
    return of_a[::-1] < of_b[::-1]


def _release(node: Node | None) -> None:
    """Give up a path: edits that nothing else hangs on go with it."""
    while node is not None:
        node.uses -= 1
        if node.uses:
            return
        node = node.parent


class Repair:
    """Search over one conversation. ``push`` takes a row, ``close`` ends it; both return edits that are final."""

    def __init__(self):
        self.root = Node(None, "", 0, None, START)  # the last final edit
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}

    def path(self, node: Node) -> list[Node]:
        """The unresolved edits of a survivor, last edit first."""
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out

    def _offer(self, best: dict, state: int, total: int, parent: Node, letter: str, cost: int, row: Row | None = None) -> None:
        """Let the path over ``parent`` survive in ``state`` if it is cheaper, or as cheap and its letters come first."""
        held = best.get(state)
        if held and held[0] < total:
            return
        node = Node(parent, letter, cost, row, state)
        if held and held[0] == total and not _comes_first(node, held[1]):
            _release(node)
            return
        best[state] = (total, node)
        if held:
            _release(held[1])

    def _drop_hopeless(self, best: dict) -> None:
        """Drop the states before the first user turn once another can do all they can for less.

        After an assistant's turn the same edits are open as before the first user turn, but that a system
        row has to be deleted there; after a user's turn an added turn leads to the same.
        """
        totals = [best[s][0] + more for s, more in ((ASSISTANT, 0), (USER, INSERT)) if s in best]
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if state in best and totals and best[state][0] > min(totals) + more:
                _release(best.pop(state)[1])

    def _insert(self) -> None:
        """Added turns before the next row; a third one in a row would only come back to a cheaper state."""
        for _ in range(2):
            for state in list(self.best):
                total, node = self.best[state]
                self._offer(self.best, NEXT[state], total + INSERT, node, "I", INSERT)

    def _survive(self, best: dict[int, tuple[int, Node]]) -> list[Node]:
        """Take over the survivors of a row and return the edits on which all of them agree."""
        for _, node in self.best.values():
            _release(node)
        self.best = best
        final = []
        if self.root.uses == 1:
            # one survivor or edit hangs on the root, so every path leads over it
            for node in reversed(self.path(next(iter(best.values()))[1])):
                if self.root.uses > 1:
                    break
                node.parent, self.root = None, node
                final.append(node)
        return final

    def push(self, row: Row) -> list[Node]:
        self._insert()
        best: dict[int, tuple[int, Node]] = {}
        initial, stays = row.role[:1], TRUNCATED if row.fault == "truncated" else 0
        for state, (total, node) in self.best.items():
            self._offer(best, state, total + DELETE, node, "D", DELETE, row)
            if row.fault in ("blank", "duplicate"):
                continue
            after = NEXT[state]
            self._offer(best, after, total + REROLE + stays, node, "R", REROLE + stays, row)
            if initial == INITIAL[after]:
                self._offer(best, after, total + stays, node, "K", stays, row)
            elif initial == INITIAL[SYSTEM] and state == START:
                self._offer(best, SYSTEM, total + stays, node, "K", stays, row)
        self._drop_hopeless(best)
        return self._survive(best)

    def close(self) -> list[Node]:
        self._insert()
        (total, node), *others = [self.best[s] for s in COMPLETE if s in self.best]
        for other_total, other in others:
            if other_total < total or other_total == total and _comes_first(other, node):
                total, node = other_total, other
        node.uses += 1
        return self._survive({node.state: (total, node)})


def find_faults(turns: DataFrame, dropped: str | None = None) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``fault``: blank, duplicate, truncated or null.

    A row is blank without a visible character, a duplicate if its conversation held the same role and
    text before, and truncated if its last visible character does not end a sentence; the first of
    these counts. The result lies in order within its partitions, conversations whole.

    Rows are ordered by turn (nulls first), role and text. A null role or text is one space, so such
    a text is blank; rows of a null conv_id are one conversation. Rows marked by the column ``dropped``
    only tell that their conversation exists. Other columns are ignored, whatever their names.
    """
    rows = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit(" ")).alias("role"),
        F.coalesce(turns["text"], F.lit(" ")).alias("text"), (F.coalesce(turns[dropped], F.lit(False)) if dropped else F.lit(False)).alias("dropped"),
    )
    # one exchange: the window and the order below both follow the conversation
    rows = rows.repartition("conv_id").withColumn("digest", F.sha2("text", 256))
    same = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return (
        rows.withColumn("nth", F.row_number().over(same))
        .withColumn("fault", F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(*ENDS), "truncated"))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
        .select("conv_id", "turn", "role", "text", "fault", "dropped")
    )


def repair(turns: DataFrame, dropped: str | None = None) -> DataFrame:
    """Edits that make every conversation of ``turns`` legal at the least cost; cases as in ``find_faults``.

    Returns ``conv_id, step, edit, turn, old_role, role, text, fault, cost``: the edits K, R, D and I of
    each conversation in order, numbered from 0. What is kept, rerolled or inserted, in this order, is
    the repaired conversation; ``role`` is null in deleted rows, ``turn``, ``old_role`` and ``fault`` in
    inserted ones. Of a conversation with no rows left, one row with no edit tells that it is there; an
    empty table gives no rows.

    A conversation passes through one task, since each edit depends on those before it, but as a
    stream: rows are sorted by Spark, which spills, and what is held is what survivors differ in. The
    rows come out in order within their partition.
    """
    faults = find_faults(turns, dropped)
    types = dict(faults.dtypes)
    return faults.mapInArrow(_edits, EDITS.format(id=types["conv_id"], turn=types["turn"]))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, search, step, out, schema = None, None, 0, [], None

    def write(nodes: list[Node]) -> None:
        nonlocal step
        for node in nodes:
            row, letter = node.row, node.letter
            role = None if letter == "D" else row.role if letter == "K" else ROLE_OF[node.state]
            out.append((key, step, letter, row and row.turn, row and row.role, role, row.text if row else "", row and row.fault, node.cost))
            step += 1

    def finish() -> None:
        write(search.close())
        if not step:
            out.append((key, None, None, None, None, None, None, None, 0))

    for batch in batches:
        types = batch.schema
        words = [(n, pa.string()) for n in ("old_role", "role", "text", "fault")]
        schema = pa.schema([("conv_id", types.field("conv_id").type), ("step", pa.int64()), ("edit", pa.string()), ("turn", types.field("turn").type), *words, ("cost", pa.int64())])
        for conv_id, turn, role, text, fault, is_dropped in zip(*batch.to_pydict().values(), strict=True):
            if search is None or conv_id != key:
                if search is not None:
                    finish()
                key, search, step = conv_id, Repair(), 0
            if not is_dropped:
                write(search.push(Row(turn, role, text, fault)))
        if out:
            yield _batch(out, schema)
            out.clear()
    if search is not None:
        finish()
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One row a conversation of ``repair``'s result, read in the order it comes in (no shuffle).

    ``gaps`` counts missing turn numbers between the first and the last, ``illegal`` the neighbours that
    could not follow each other before the repair; ``audit`` holds the letters of all edits and
    ``repaired_sha256`` the digest of the repaired ``role:text``, joined by newlines.
    """
    return edits.mapInArrow(_reports, REPORT.format(id=dict(edits.dtypes)["conv_id"]))


class _Tally:
    def __init__(self):
        self.first = self.last = self.before = None
        self.turns, self.illegal, self.cost, self.repaired = 0, 0, 0, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.digest = [], hashlib.sha256()

    def add(self, edit, turn, old_role, role, text, fault, cost) -> None:
        self.audit.append(edit)
        self.cost += cost
        if role is not None:
            self.digest.update(("\n" * bool(self.repaired) + f"{role}:{text}").encode())
            self.repaired += 1
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None and self.before + old_role[:1] not in LEGAL:
            self.illegal += 1
        self.before = old_role[:1]

    def row(self, key) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, tally, out, schema = None, None, [], None
    for batch in batches:
        numbers = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for conv_id, _, edit, *rest in zip(*batch.to_pydict().values(), strict=True):
            if tally is None or conv_id != key:
                if tally is not None:
                    out.append(tally.row(key))
                key, tally = conv_id, _Tally()
            if edit is not None:
                tally.add(edit, *rest)
        if out:
            yield _batch(out, schema)
            out = []
    if tally is not None:
        yield _batch([tally.row(key)], schema)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults that the crc32 of ``conv_id:turn`` decides, one row in four.

    Of each twenty, 0 drops the row (it stays behind with ``dropped`` set), 1 empties its text, 2 removes
    its sentence ends, 3 repeats it and 4 gives it the user's role. Nulls are read as one space.
    """

    def filled(name: str) -> Column:
        return F.coalesce(turns[name].cast("string"), F.lit(" "))

    case = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), F.when(case == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"), (case == 0).alias("dropped"), F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
