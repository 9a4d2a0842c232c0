"""Conversation repair against all edit strings, against SQL, and across cut conversations."""

import hashlib
import re

import numpy as np
import pytest

from knotwork.llm import queries, turn_repair
from tests.oracle import mismatch

ROLES = ["system", "user", "assistant", "tool", "", None]
SAID = ["Yes.", "No!", "why?  \n", "cut off", " ", "", None, "　."]


def faults_of(rows):
    """Rows (role, text) in order with their first faults."""
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    return out


def fits(said, new):
    """Whether a turn with initial ``new`` may follow one with initial ``said`` (empty: nothing)."""
    return (said, new) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}


def plain(rows):
    """Cost, edits and lines of one conversation: all edit strings with up to three insertions at a place."""
    faults = faults_of(rows)
    paths = {("", 0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):
            paths |= {(r[0], c + 5, a + "I", (*lines, f"{r}:")) for s, c, a, lines in paths for r in ("user", "assistant") if fits(s, r[0])}
        if i == len(rows):
            break
        role, text = rows[i]
        after = {(s, c + 2, a + "D", lines) for s, c, a, lines in paths}
        if faults[i] not in ("blank", "duplicate"):
            more = 5 * (faults[i] == "truncated")
            for new, extra, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                after |= {(new[:1], c + more + extra, a + letter, (*lines, f"{new}:{text}")) for s, c, a, lines in paths if fits(s, new[:1])}
        paths = after
    return min((c, a, "\n".join(lines)) for s, c, a, lines in paths if s in ("", "a"))


def in_order(rows):
    """Rows (turn, role, text) as the operator takes them."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


@pytest.mark.parametrize("piece", [256, 2, 1])
def test_random_conversations_against_all_edits(spark, piece):
    """Whole, and cut into pieces of two rows and of one, which have to be linked."""
    draw = np.random.default_rng(piece)
    talks, table = {}, []
    for conv in [None, *range(60)]:
        talks[conv] = []
        for _ in range(int(draw.integers(1, 5))):
            turn = None if draw.random() < 0.1 else int(draw.integers(0, 6))
            row = (turn, ROLES[int(draw.choice(6, p=[0.2, 0.35, 0.3, 0.05, 0.05, 0.05]))], SAID[int(draw.integers(0, 8))])
            talks[conv] += [row] * (1 + (draw.random() < 0.15))
        table += [(conv, *row, "x", 7) for row in talks[conv]]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, conv string, id int").repartition(4)
    fixed = turn_repair.repair(df, piece=piece)
    got = {r.conv: r for r in fixed.summary().collect()}
    assert got.keys() == talks.keys()
    lines = {}
    for r in fixed.conversations().orderBy("at", "place", "step").collect():
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for conv, rows in talks.items():
        rows = in_order(rows)
        turns = [t for t, _, _ in rows if t is not None]
        said = [(r, x) for _, r, x in rows]
        faults, r = faults_of(said), got[conv]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(faults.count, ("blank", "duplicate", "truncated")))
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, text = plain(said)
        assert (r.cost, r.audit, "\n".join(lines.get(conv, []))) == (cost, audit, text)
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_conversation_and_long_text(spark):
    """One conversation of 3,000 turns, all in order but one, and a text of 5 MB."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000) if t != 1001] + [(2, 0, "user", "x" * 5_000_000 + "."), (2, 1, "assistant", "ok.")]
    got = {r.conv: r for r in turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).summary().collect()}
    assert (got[1].cost, got[1].gaps, got[1].illegal, got[2].cost) == (2, 1, 1, 0)
    # the cheapest cure is to drop one of the two users' turns, the least string drops as early as it may
    assert got[1].audit.count("D") == 1 and len(got[1].audit) == 2999


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    fixed = turn_repair.repair(turn_repair.damage(df))
    assert fixed.summary().count() == 0 and fixed.conversations().count() == 0


def test_damage(spark):
    """Every kind of fault, by crc32 of conversation and turn with nulls as a space."""
    import zlib

    rows = [(c, t, "assistant", f"a.{t}!") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    got = sorted((str(r.conv_id), str(r.turn), r.role, r.text) for r in turn_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (str(c), str(t), "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    name = "op13_turn_repair"
    assert mismatch(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], f"/root/testdata/{sf}") == ""
