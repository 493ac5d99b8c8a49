from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from ledgerline.llm import chat

NASTY = ["", "</turn>", "<turn user>x</turn>\n", "\\", "\\<", "a\\\\>b", "\\### Assistant: </turn> ok", "\n\n", "ünï 🙂", "<|endoftext|>"]


def rows_of(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(30):
        n = r.choice([1, 2, 5, 9, 40])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 2 else r.choice(["user", "assistant", "assistant", "tool>x"])
            rows.append((conv, turn, role, r.choice([*NASTY, *("word " * r.randrange(1, 400) for _ in range(6))]), "extra"))
    return rows


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append(((turn is None, turn or 0), role or "", text or ""))
    out = {}
    for conv, ts in by.items():
        # ties go by what is written
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        out[conv] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [64, 300, 2048])
def test_round_trip_and_budget(spark, budget):
    rows = rows_of(budget)
    r = random.Random(1)
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == expected(rows)
    opening = {c: (role, t) for c, turn, role, t, _ in rows if turn == 0}
    for w in windows.collect():
        found = chat.turns_of(w["text"])
        own = len(found) - w["repeated_turns"]
        system = opening[w["conv_id"]][0] == "system"
        assert own >= 1 and w["repeated_turns"] <= chat.HISTORY_TURNS + system
        if system:
            assert found[0][:2] == opening[w["conv_id"]]
        assert w["tokens"] <= budget or own == 1 or w["window"] == 0 and own == 2 and system
        spans = [(s["start"], s["end"]) for s in w["loss_spans"]]
        assert spans == [(a, b) for role, _, a, b in found[w["repeated_turns"] :] if role == "assistant"]


def test_windows_are_several_and_repeat_history(spark):
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"t{i} " * 20) for i in range(60)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 400).orderBy("window").collect()
    assert len(windows) > 5
    assert all(w["repeated_turns"] >= 2 for w in windows[1:])


def test_nulls_ties_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "a"), (None, None, "assistant", "b"), (None, 1, None, None), (4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (4, 0, "user", "y")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_windows(spark.createDataFrame(rows, kind))).collect()}
    assert got == expected(rows)
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], kind))).count() == 0
