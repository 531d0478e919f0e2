"""Conversation repair against a plain search over all edits, and over small segments."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from purchaseflow.llm import conversations, queries, repair_paths

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 1:
            text = ""
        elif what == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def brute(rows):
    """One conversation (after damage), with the cheapest audits compared as strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                new = "a" if state == "u" else "u"
                offer = (cost + 5, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[new]))
                states[new] = min(states.get(new, offer), offer)
        return states

    best = inserted(best)
    for (_, _, role, text), fault in zip(rows, faults):
        step = {}

        def offer(state, value):
            step[state] = min(step.get(state, value), value)
        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("", "truncated"):
                late = 5 if fault else 0
                if (state, role[:1]) in after:
                    offer(after[state, role[:1]], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
                new = "assistant" if state == "u" else "user"
                offer(new[0], (cost + 1 + late, audit + "R", (*lines, f"{new}:{text}")))
        best = inserted(step)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = {r[1] for r in rows if r[1] is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    left = damage(rows)
    return sorted(((c, *brute([r for r in left if r[0] == c])) for c in {r[0] for r in rows}), key=str)


def result(df):
    return sorted(map(tuple, conversations.repair(conversations.damaged(df)).collect()), key=str)


def some_rows(seed, n_conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "other", "", None])
            text = rng.choice(["Yes.", "no", " \n", "", None, f"Text {turn}!", f"Text {turn} é", "Well? \t"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    return rows + rng.choices(rows, k=len(rows) // 10)


def test_equals_a_plain_search(spark):
    rows = some_rows(1, 150, 12)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_conversations_over_many_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "CLOSED", 2)
    rows = some_rows(2, 3, 120) + [(7, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == expected(rows)


def test_a_hot_conversation_of_equal_rows(spark):
    rows = [(1, 4, "user", "Same.")] * 400 + [(None, None, None, None)] * 300 + [(2, t, "user", "Same.") for t in range(90)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_long_texts_empty_tables_and_other_columns(spark):
    rows = [(1, 0, "user", "Long text. " * 100_000), (1, 1, "assistant", "x" * 1_000_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", times int, first string")
    assert result(df) == expected(rows)
    assert result(df.filter("conv_id = 5")) == []


def test_query_covers_all_conversations(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_conversations(spark, sf_small).collect()), key=str)
    assert got == expected(rows)


def test_blocks_of_the_cost_table_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    bounds = np.array([0, 0, 1, 40, 41, 200])
    rows = repair_paths.Rows(rng.integers(0, 4, 200), rng.random(200) < .1, rng.random(200) < .2, rng.integers(0, 3, 200), bounds)
    ends = repair_paths.final_costs(5)
    whole = repair_paths.costs_to_go(rows, ends)
    monkeypatch.setattr(repair_paths, "BLOCK", 7)
    assert (repair_paths.costs_to_go(rows, ends) == whole).all()
    assert repair_paths.least_audits(rows, whole, np.zeros(5, int), True)[0][0] == ""
