"""Repairs of conversations against trying all edits, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from journeyloom.llm import conversation_repair as repair

NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def cheapest(kinds: tuple[tuple[str, str], ...]):
    """Least (cost, audit) over all edits of rows given as (role initial, fault)."""

    none = (10**9, "")
    behind = [none] * 4
    for i in range(len(kinds), -1, -1):
        base = [(0, "") if i == len(kinds) and state in (0, 3) else none for state in range(4)]
        if i < len(kinds):
            initial, fault = kinds[i]
            extra = 3 if fault == "truncated" else 0
            for state in range(4):
                ways = [(4, "D", state)]
                if fault not in ("blank", "duplicate"):
                    ways.append((3 + extra, "R", NEXT[state][0]))
                    if (initial, state) in KEEPS:
                        ways.append((extra, "K", KEEPS[initial, state]))
                base[state] = min((c + behind[to][0], letter + behind[to][1]) for c, letter, to in ways)
        here = base
        for _ in range(3):  # more than three inserts in one place never pay
            here = [min(base[s], (3 + here[NEXT[s][0]][0], "I" + here[NEXT[s][0]][1])) for s in range(4)]
        behind = here
    return behind[0]


def as_text(v):
    return " " if v is None else str(v)


def expected(rows):
    """The query's result by plain Python."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept: dict = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{as_text(conv)}:{as_text(turn)}".encode()) % 20
        role, text = as_text(role), as_text(text)
        text = "" if way == 1 else re.sub(r"[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        kept[conv] += [] if way == 0 else [(turn, role, text)] * (2 if way == 3 else 1)
    out = []
    for conv, turns in kept.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        own = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(tuple(zip(own, faults)))
        lines, state, row = [], 0, iter(turns)
        for letter in audit:
            if letter == "I":
                state, role = NEXT[state]
                lines.append(f"{role}:")
                continue
            _, role, text = next(row)
            if letter == "K":
                state = KEEPS[role[:1], state]
            elif letter == "R":
                state, role = NEXT[state]
            if letter != "D":
                lines.append(f"{role}:{text}")
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines))))
    return out


NAMES = {"blank": repair.GONE, "duplicate": repair.GONE, "truncated": repair.CUT_OFF, "": repair.PLAIN}


def kinds_of(rows):
    return "".join(NAMES[f]["suax".index(i)] for i, f in rows)


def random_rows(rng, most):
    faults = rng.choice([("",), ("", "", "truncated"), ("", "", "blank", "duplicate", "truncated")])
    return tuple((rng.choice("uauauasx"), rng.choice(faults)) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("block", [1, 3, 32])
def test_edits_are_the_cheapest_and_first_in_order(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(700):
        rows = random_rows(rng, 14)
        kinds = kinds_of(rows)
        edits, _ = repair.edits_of(kinds)
        assert (repair.cost_of(kinds, edits), repair.audit_of(edits)) == cheapest(rows)


def test_prices_are_feasible_and_tight():
    rng = random.Random(9)
    for _ in range(300):
        block = repair.Block(kinds_of(random_rows(rng, 10)), repair.END, True)
        for node, arcs in enumerate(block.arcs):
            assert all(block.price[node] <= cost + block.price[to] for _, cost, to in arcs)
        for entry in range(4):
            assert block.price[entry] - block.price[block.goal] == block.values[entry]
            block.way(entry)


def test_pieces_join_to_the_whole():
    rng = random.Random(11)
    for _ in range(500):
        rows = random_rows(rng, 16)
        cuts = sorted(rng.sample(range(len(rows) + 1), min(2, len(rows) + 1)))
        pieces = [kinds_of(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]
        behind, solved = list(repair.END), []
        for k, piece in enumerate(reversed(pieces)):
            solved.append((piece, tuple(behind), k == 0))
            behind = [0, 6, 3, 0] if k == 0 else behind
            costs = repair.crossing_costs(piece)
            behind = [min(c + b for c, b in zip(row, behind) if c is not None) for row in costs]
        state, audit, cost = 0, "", 0
        for piece, terminal, last in reversed(solved):
            edits, state = repair.edits_of(piece, terminal, last, state)
            audit, cost = audit + repair.audit_of(edits), cost + repair.cost_of(piece, edits)
        assert (cost, audit) == cheapest(rows) or not rows


@pytest.fixture
def small_partitions(spark):
    """Partitions stay as they are dealt, so that the large conversation is cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_equals_plain_python(spark, tmp_path, small_partitions):
    rng = random.Random(13)
    lines = ["Yes.", "No?", "Go on", "", " \n", "Well!\n", "a.b", "long " * 4_000, "so. ", "why!?"]
    rows = []
    for conv in [None, *range(250)]:
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 4) + rng.choice([[], ["tool"], [None], [""], ["agent"]])
        for turn, role in enumerate(roles):
            turn = rng.choice([None, turn, turn + 3]) if rng.random() < 0.15 else turn
            rows.append((conv, turn, role, rng.choice([None, *lines]) if rng.random() < 0.2 else f"{rng.choice(lines)} {rng.random()}."))
    # One conversation with a large part of all rows goes over all partitions.
    rows += [(7_000, k, ("user", "assistant")[k % 2 if k % 7 else 0], f"text {k if k % 5 else 0}" + "." * (k % 11 > 0)) for k in range(600)]
    rows += [(7_001, 1, "user", "same.")] * 300 + [(7_002, None, "assistant", "same")] * 5
    clash = [(c, t, r, x, "?", 5, 6) for c, t, r, x in rows]
    ddl = "conv_id bigint, turn int, role string, text string, audit string, at int, digest int"
    spark.createDataFrame(clash, ddl).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/none/conversations.parquet")
    got = [tuple(r) for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    placed = repair.ordered_rows(repair.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
    assert placed.where("conv_id = 7000").selectExpr("count(distinct shiftright(at, 33))").first()[0] > 1
    assert repair.op13_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_repaired_turns_have_the_form(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Ok."), (1, 2, "user", "Ok."), (2, 0, "system", "S."), (2, 1, "user", "cut off")]
    plan = repair.Repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    turns = [tuple(r) for r in plan.turns().orderBy("conv_id", "at", "slot").select("conv_id", "role", "text", "edit").collect()]
    found = {r.conv_id: (r.cost, r.audit) for r in plan.conversations().collect()}
    for conv in (1, 2):
        form = "".join(r[1][0] for r in turns if r[0] == conv)
        assert re.fullmatch("(s?(ua)+)?", form)
    assert found[1] == cheapest((("a", ""), ("u", ""), ("u", "duplicate"))) and found[2] == cheapest((("s", ""), ("u", "truncated")))
