from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from ledgerline.llm import conversation_repair
from ledgerline.llm.common import table
from ledgerline.llm.conversation_repair import Repair, Row
from ledgerline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, letters, repaired rows) by trying edits in order of cost and letters; rows are (role, text, fault)."""
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, letters, i, out = heapq.heappop(heap)
        initials = "".join(role[:1] or "-" for role, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, letters, list(out)
        if (i, initials) in done or not re.fullmatch("s?(ua)*u?", initials):
            continue
        done.add((i, initials))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, letters + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + more, letters + "K", i + 1, (*out, (role, text))))
            for other in ("user", "assistant"):
                heapq.heappush(heap, (cost + more + 1, letters + "R", i + 1, (*out, (other, text))))


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        def show(v):
            return " " if v is None else str(v)
        case = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        found = out[conv]
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", show(text)) if case == 2 else show(text)
        found.extend([(turn, "user" if case == 4 else show(role), text)] * (2 if case == 3 else 1))
    return out


def expected(rows):
    for conv, found in damaged(rows).items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in found:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, *_ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for role, *_ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters, repaired = cheapest(judged)
        n = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
        yield (conv, gaps, *n, illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "open", "", " \n", "Why? ", "Done.\t", None]
    return [
        (conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts))
        for conv in [*range(n), None] for turn in range(rng.randrange(1, 8))
    ]


def test_search_equals_plain_search():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice([None, None, "truncated", "blank", "duplicate"])) for i in range(rng.randrange(9))]
        search, edits = Repair(), []
        for role, text, fault in rows:
            edits += search.push(Row(0, role, text, fault))
        edits += search.close()
        cost, letters, _ = cheapest(rows)
        assert (sum(e.cost for e in edits), "".join(e.letter for e in edits)) == (cost, letters), rows


def test_memory_stays_bounded():
    """A long conversation with faults all along is emitted as it goes, and nothing dead is kept."""
    rng, search, emitted, held = random.Random(2), Repair(), 0, 0
    for i in range(20_000):
        role = rng.choice(["system", "user", "assistant"])
        emitted += len(search.push(Row(i, role, "", rng.choice([None, None, "truncated", "blank"]))))
        nodes = {id(n) for _, end in search.best.values() for n in search.path(end)}
        held = max(held, len(nodes))
    assert held < 1000 and emitted > 19_000
    assert len(search.close()) < 1000


def test_equals_plain_code(spark):
    rows = conversations(3, 150)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = conversation_repair.report(conversation_repair.repair(conversation_repair.damaged(turns), dropped="dropped"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows), key=str)


def test_query_equals_plain_code(spark, sf_dir):
    rows = list(map(tuple, table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()))
    found = QUERIES["op12_conversation_repair"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(expected(rows))


def test_edits_hold_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", " "), (1, 4, "assistant", "So?")]
    found = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.step, r.edit, r.old_role, r.role, r.fault) for r in found] == [
        (0, "K", "system", "system", None), (1, "R", "assistant", "user", None), (2, "D", "assistant", None, "duplicate"),
        (3, "D", "user", None, "blank"), (4, "K", "assistant", "assistant", None),
    ]
    assert sum(r.cost for r in found) == 5


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "long " * 200_000 + ".", True, "a"), (1, 1, "assistant", "long " * 200_000, False, "b")]
    found = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA + ", dropped boolean, fault string")).collect()
    assert "".join(r.edit for r in found) == "DD" and [r.fault for r in found] == [None, "truncated"]



def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.report(conversation_repair.repair(conversation_repair.damaged(empty), dropped="dropped")).count() == 0
